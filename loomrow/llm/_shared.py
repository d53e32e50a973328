"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the ASCII white space characters, everywhere in these operators.
BLANKS = "\x20\x09-\x0d"
WORD = rf"[^{BLANKS}]+"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLANK = str.maketrans("\t\n\x0b\x0c\r", "     ")


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def split_words(text: str) -> list[str]:
    """The words of a text: maximal runs without ASCII white space."""
    return [w for w in text.translate(_BLANK).split(" ") if w]


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; one below the warehouse if it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found is None and held.isDefined():
        found = held.get()
    if found is None:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; what made them is not run again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that never gathers it in the driver: for sides that grow with the input, however small they look now."""
    return df.hint("merge")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    """The column as string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sum_arrays(arrays: DataFrame) -> DataFrame:
    """Sums by key of rows key (string), data (little-endian 64-bit integers, one length a key).

    Rows are streamed in order of their keys, so a task holds one sum at a time.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        key, total = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([total.tobytes()], pa.binary())], names=["key", "data"])
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                k, x = k.as_py(), np.frombuffer(data.as_py(), "<i8")
                if k != key:
                    if key is not None:
                        yield made()
                    key, total = k, np.zeros(len(x), "<i8")
                total += x
        if key is not None:
            yield made()

    return arrays.select("key", "data").repartition(parallelism(arrays.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "key string, data binary")
