"""What the operators share: distributed numbering, size-checked broadcasts, ordered passes over groups."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one window numbers at the expected size.
ROWS_A_WINDOW = 1 << 18
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 200_000


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it (spark.checkpoint.dir; below the warehouse if it names none)."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(found)
        return found
    return held.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of df from the shared folder; what made them is not run again.

    They are written as columns, compressed; later steps read only the columns
    they ask for.
    """
    path = scratch(df.sparkSession, "rows")
    df.write.option("parquet.block.size", 1 << 24).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than so many rows; beyond that it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(df: DataFrame, order: str, name: str, *, within: Sequence[str] = (), ties: Sequence[str] = (), rows: int = ROWS_A_WINDOW) -> DataFrame:
    """Adds name: row numbers from 0 by the numeric column order (not null), then ties, inside each group of within.

    Groups of up to `rows` rows are numbered whole. Larger ones are cut into
    ranges of order by approximate quantiles; each range is numbered by itself
    and raised by the counts of those before it, so no task sorts more than
    about `rows` rows of a group, however large it is.
    """
    return _by_size(df, within, rows, lambda part, cut: _numbered(part, order, name, within, ties, rows, cut))


def _numbered(df: DataFrame, order: str, name: str, within: Sequence[str], ties: Sequence[str], rows: int, cut: bool) -> DataFrame:
    parted, ranges = _ranged(df, order, rows) if cut else (df, 1)
    if ranges == 1:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*within).orderBy(order, *ties)) - 1).cast("long"))
    by = Window.partitionBy(*within, "range of order").orderBy(order, *ties)
    counts = parted.groupBy(*within, "range of order").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*within).orderBy("range of order").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"of {c}") for c in within), F.col("range of order").alias("of range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows before"))
    out = parted.join(counts, _of(parted, counts, within)).withColumn(name, F.row_number().over(by) - 1 + F.col("rows before"))
    return out.select(*df.columns, F.col(name).cast("long").alias(name))


def _of(parted: DataFrame, table: DataFrame, within: Sequence[str]) -> list[Column]:
    return [parted[c].eqNullSafe(table[f"of {c}"]) for c in within] + [parted["range of order"] == table["of range"]]


def _by_size(df: DataFrame, within: Sequence[str], rows: int, f: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """f of the groups that one window can take, and f with ranges of the larger ones; of these there are fewer than one in `rows` rows."""
    if not within:
        return f(df, True)
    found = df.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows).select(*(F.col(c).alias(f"large {c}") for c in within))
    large = found.collect()
    if not large:
        return f(df, False)
    table = F.broadcast(df.sparkSession.createDataFrame(large, found.schema))
    same = [df[c].eqNullSafe(table[f"large {c}"]) for c in within]
    return f(df.join(table, same, "left_anti"), False).unionByName(f(df.join(table, same, "left_semi"), True))


def _ranged(df: DataFrame, order: str, rows: int) -> tuple[DataFrame, int]:
    """df with its range of the order, found by bisection, and how many ranges there are."""
    ranges = max(1, -(-df.count() // rows))
    if ranges == 1:
        return df, 1
    marks = df.agg(F.percentile_approx(F.col(order), [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    splits = [-math.inf, *sorted({float(x) for x in marks}), math.inf]
    cut = Bucketizer(splits=splits, inputCol="order as double", outputCol="range of order", handleInvalid="keep")
    return cut.transform(df.withColumn("order as double", F.col(order).cast("double"))).drop("order as double"), ranges


def surrounding(df: DataFrame, order: str, *, before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None, upto: Mapping[str, Column] | None = None, within: Sequence[str] = (), rows: int = ROWS_A_WINDOW) -> DataFrame:
    """Adds columns by name: the largest value among earlier rows (before), earlier rows and its own (upto), the least among later rows (after).

    The order is a numeric column without ties inside a group of within. Large
    groups are cut into ranges like numbered, so few or hot groups don't make
    large tasks; what other ranges give comes from a small table.
    """
    return _by_size(df, within, rows, lambda part, cut: _surrounding(part, order, before or {}, after or {}, upto or {}, within, rows, cut))


def _surrounding(df: DataFrame, order: str, before: Mapping[str, Column], after: Mapping[str, Column], upto: Mapping[str, Column], within: Sequence[str], rows: int, cut: bool) -> DataFrame:
    parted, ranges = _ranged(df, order, rows) if cut else (df, 1)
    high = {**before, **upto}
    parted = parted.withColumns({f"value of {n}": v for n, v in {**high, **after}.items()})
    own = Window.partitionBy(*within, *["range of order"] * (ranges > 1)).orderBy(order)
    frame = lambda n: own.rowsBetween(Window.unboundedPreceding, 0 if n in upto else -1)
    # the rows after are those before in descending order, whose frames grow row by row too
    last = Window.partitionBy(*within, *["range of order"] * (ranges > 1)).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    found = {n: F.max(f"value of {n}").over(frame(n)) for n in high} | {n: F.min(f"value of {n}").over(last) for n in after}
    if ranges == 1:
        return parted.select(*df.columns, *(c.alias(n) for n, c in found.items()))
    tops = parted.groupBy(*within, "range of order").agg(*(F.max(f"value of {n}").alias(f"m {n}") for n in high), *(F.min(f"value of {n}").alias(f"m {n}") for n in after))
    by = Window.partitionBy(*within).orderBy("range of order")
    rest = [F.max(f"m {n}").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias(f"r {n}") for n in high] + [F.min(f"m {n}").over(by.rowsBetween(1, Window.unboundedFollowing)).alias(f"r {n}") for n in after]
    tops = tops.select(*(F.col(c).alias(f"of {c}") for c in within), F.col("range of order").alias("of range"), *rest)
    out = parted.join(tops, _of(parted, tops, within))
    both = {n: F.greatest(c, f"r {n}") if n in high else F.least(c, f"r {n}") for n, c in found.items()}
    return out.select(*df.columns, *(c.alias(n) for n, c in both.items()))


def running_max(df: DataFrame, value: str, order: str, name: str, *, within: Sequence[str] = (), rows: int = ROWS_A_WINDOW) -> DataFrame:
    """Adds name: the largest value up to and including each row in the order of a numeric column (no ties within a group)."""
    return surrounding(df, order, upto={name: F.col(value)}, within=within, rows=rows)


def in_groups(df: DataFrame, group: str, order: Sequence[str], f: Callable[[object, Iterator[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """f(group, its rows in order) for every group, as rows of schema.

    Groups are dealt over all tasks and streamed through f one after the other,
    so a task holds no more than f itself does.
    """
    out = T.StructType.fromDDL(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (row for batch in batches for low in range(0, batch.num_rows, 4096) for row in batch.slice(low, 4096).to_pylist())
        for key, members in groupby(rows, key=lambda r: r[group]):
            yield from f(key, members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = made(batches)
        while held := list(islice(rows, 4096)):
            yield _batch(held, out)

    return df.repartition(parallelism(df.sparkSession), group).sortWithinPartitions(group, *order).mapInArrow(run, out)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], _ARROW[f.dataType.simpleString()]) for f in schema], names=schema.names)
