"""The low-water mark on transaction numbers, and records that come too late for it.

Commits are rows (n, tx): tx committed as the n-th. Dispatchers share the
numbers by tx modulo their count; each one's mark is the largest number up to
which all of its own have committed, and starts below its first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrow.operators.frames import running_max


def marks(commits: DataFrame, dispatchers: int = 1) -> DataFrame:
    """n, tx, dispatcher, mark: the dispatcher's mark after each commit. Numbers are dense from 0."""
    own = commits.withColumn("dispatcher", (F.col("tx") % dispatchers).cast("int"))
    need = running_max(own, "n", "tx", "need", within=("dispatcher",))
    reached = need.groupBy("dispatcher", F.col("need").alias("n")).agg(F.max("tx").alias("t"))
    seen = running_max(own.join(reached, ["dispatcher", "n"], "left"), "t", "n", "top", within=("dispatcher",))
    return seen.select("n", "tx", "dispatcher", F.coalesce("top", F.col("dispatcher") - dispatchers).cast("long").alias("mark"))


def record_fates(records: DataFrame, commits: DataFrame, dispatchers: int = 1) -> DataFrame:
    """Adds fate to records (tx, at: number of commits before it): dropped if its transaction is at or below the mark, else kept."""
    known = marks(commits, dispatchers).select(F.col("dispatcher"), (F.col("n") * 2).alias("o"), "mark")
    mine = records.withColumn("dispatcher", (F.col("tx") % dispatchers).cast("int"))
    # many records may stand between two commits
    asked = mine.select("dispatcher", (F.col("at") * 2 - 1).alias("o")).distinct().select("dispatcher", "o", F.lit(None).cast("long").alias("mark"))
    top = running_max(known.unionByName(asked), "mark", "o", "top", within=("dispatcher",)).where("mark is null").select("dispatcher", "o", "top")
    out = mine.withColumn("o", F.col("at") * 2 - 1).join(top, ["dispatcher", "o"])
    mark = F.coalesce("top", F.col("dispatcher") - dispatchers)
    return out.select(*records.columns, F.when(F.col("tx") <= mark, "dropped").otherwise("kept").alias("fate"))
