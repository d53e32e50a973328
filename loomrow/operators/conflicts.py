"""The order that locks in log order give: who waits for whom.

Every transaction asks for each of its keys once, shared (S) if it only reads
the key and exclusive (X) if it writes it, in the order of the log. Requests
wait for incompatible ones before them; commits release all.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrow.operators.frames import ROWS_A_WINDOW, in_groups, numbered, surrounding

#: Lock modes that each mode goes with, besides the requester's own locks (fixed values).
COMPATIBLE = {"S": ("S", "IS"), "X": (), "SIX": ("IS",), "IX": ("IX", "IS"), "IS": ("IS", "IX", "S", "SIX")}


def compatibility(spark: SparkSession) -> DataFrame:
    """requested, held, compatible for all pairs of modes."""
    return spark.createDataFrame([(a, b, b in COMPATIBLE[a]) for a in COMPATIBLE for b in COMPATIBLE], "requested string, held string, compatible boolean")


def lockable(requested: str, held: list[tuple[int, str]], tx: int) -> bool:
    """Whether tx can take a mode: others' locks are compatible with it."""
    return all(owner == tx or mode in COMPATIBLE[requested] for owner, mode in held)


def requests(accesses: DataFrame) -> DataFrame:
    """tx, tbl, k, mode: one request for each key of a transaction; a write makes it X."""
    return accesses.groupBy("tx", "tbl", "k").agg(F.max(F.col("op") != "R").alias("w")).select("tx", "tbl", "k", F.when(F.col("w"), "X").otherwise("S").alias("mode"))


def queue_positions(locks: DataFrame, rows: int = ROWS_A_WINDOW) -> DataFrame:
    """Adds position (from 1) of each request in its key's queue."""
    return numbered(locks, "tx", "position", within=("tbl", "k"), rows=rows).withColumn("position", F.col("position") + 1)


def waits(locks: DataFrame, rows: int = ROWS_A_WINDOW) -> DataFrame:
    """tbl, k, tx, mode, waits_for, held_mode: the requests that each request directly waits for.

    A shared request waits for the last exclusive one before it. An exclusive
    one waits for every shared one since the last exclusive, or for that itself
    if there is none between. Each request is waited for by no more than the
    shared ones up to the next exclusive, so there are at most two rows a
    request, however hot a key is; a hot key's queue is cut into ranges.
    """
    exclusive = F.when(F.col("mode") == "X", F.col("tx"))
    seen = surrounding(locks, "tx", before={"x_before": exclusive, "tx_before": F.col("tx")}, after={"x_after": exclusive}, within=("tbl", "k"), rows=rows)
    lit = F.lit
    row = lambda tx, mode, waits_for, held: F.struct(tx.alias("tx"), lit(mode).alias("mode"), waits_for.alias("waits_for"), lit(held).alias("held_mode"))
    shared, x = F.col("mode") == "S", F.col("mode") == "X"
    found = F.array(
        F.when(shared & F.col("x_before").isNotNull(), row(F.col("tx"), "S", F.col("x_before"), "X")),
        F.when(shared & F.col("x_after").isNotNull(), row(F.col("x_after"), "X", F.col("tx"), "S")),
        F.when(x & (F.col("x_before") == F.col("tx_before")), row(F.col("tx"), "X", F.col("x_before"), "X")),
    )
    return seen.select("tbl", "k", F.inline(F.filter(found, lambda r: r.isNotNull())))


def levels(locks: DataFrame, batched: DataFrame) -> DataFrame:
    """batch, tx, level: 1 + the highest level among the transactions of the batch that it waits for (0: none).

    Transactions of one level of a batch run side by side.
    """

    def run(batch: object, rows: Iterator[dict]) -> Iterator[dict]:
        level: dict[int, int] = {}
        written: dict[tuple, int] = {}
        read: dict[tuple, int] = {}
        held: dict[int, list[dict]] = {}
        for r in rows:
            held.setdefault(r["tx"], []).append(r)
        for tx in sorted(held):
            found = -1
            for r in held[tx]:
                key = (r["tbl"], r["k"])
                found = max(found, written.get(key, -1), read.get(key, -1) if r["mode"] == "X" else -1)
            level[tx] = found + 1
            for r in held[tx]:
                side = written if r["mode"] == "X" else read
                key = (r["tbl"], r["k"])
                side[key] = max(side.get(key, -1), level[tx])
        for tx, x in level.items():
            yield {"batch": batch, "tx": tx, "level": x}

    rows = locks.join(batched, "tx").select("batch", "tx", "tbl", "k", "mode")
    return in_groups(rows, "batch", ["tx", "tbl", "k"], run, "batch bigint, tx bigint, level int")
