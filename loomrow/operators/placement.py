"""Which partition a key belongs to.

A plan adds to rows with a key the columns part (int) and replicated (boolean).
Rows have tbl (the table's name) and k (the partitioning key, a number).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrow.operators.frames import small

#: The table of control messages between nodes; its keys belong to no partition.
NOTIFICATION, NO_PARTITION = "notification", -1


@dataclass(frozen=True)
class ModuloPlan:
    """k modulo n, never negative; tables in `replicated` lie on every partition."""

    n: int
    replicated: tuple[str, ...] = ()

    def place(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"part": F.pmod("k", F.lit(self.n)).cast("int"), "replicated": F.col("tbl").isin(*self.replicated) if self.replicated else F.lit(False)})


@dataclass(frozen=True)
class NotificationPlan:
    """A plan in which control messages belong to partition -1 and are never replicated."""

    base: object

    @property
    def n(self) -> int:
        return self.base.n

    def place(self, rows: DataFrame) -> DataFrame:
        control = F.col("tbl") == NOTIFICATION
        return self.base.place(rows).withColumns({"part": F.when(control, NO_PARTITION).otherwise(F.col("part")), "replicated": ~control & F.col("replicated")})


@dataclass(frozen=True)
class OverridePlan:
    """Keys in overrides (tbl, k, dest) lie there, the others where the base plan has them.

    Over another such plan the overrides are merged, newer ones first, so that
    plans never nest.
    """

    base: object
    overrides: DataFrame = field(compare=False)

    @property
    def n(self) -> int:
        return self.base.n

    def merged(self) -> tuple[object, DataFrame]:
        own = self.overrides.select("tbl", "k", "dest")
        if not isinstance(self.base, OverridePlan):
            return self.base, own
        base, older = self.base.merged()
        return base, own.unionByName(older.join(own.select("tbl", "k"), ["tbl", "k"], "left_anti"))

    def place(self, rows: DataFrame) -> DataFrame:
        base, overrides = self.merged()
        placed = base.place(rows).join(small(overrides.withColumnRenamed("dest", "override of part")), ["tbl", "k"], "left")
        return placed.withColumn("part", F.coalesce("override of part", "part").cast("int")).drop("override of part").select(*rows.columns, "part", "replicated")


@dataclass(frozen=True)
class VersionedPlan:
    """Plans by the transaction from which each holds, the first from the beginning; rows have tx."""

    versions: tuple[tuple[int, object], ...]

    @property
    def n(self) -> int:
        return self.versions[-1][1].n

    def place(self, rows: DataFrame) -> DataFrame:
        out = None
        for i, (start, plan) in enumerate(self.versions):
            mine = rows if i == 0 else rows.where(F.col("tx") >= start)
            if i + 1 < len(self.versions):
                mine = mine.where(F.col("tx") < self.versions[i + 1][0])
            placed = plan.place(mine)
            out = placed if out is None else out.unionByName(placed)
        return out


def notification_key(sender: int, receiver: int) -> dict:
    """The key of a control message."""
    return {"tbl": NOTIFICATION, "sender_node_id": sender, "recv_node_id": receiver}


def partitioning_key(rows: DataFrame, tables: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Adds part_key: of a table named in tables that field, of others all of keys as text."""
    whole = F.concat_ws("|", *(F.col(c).cast("string") for c in keys))
    out = whole
    for table, name in tables.items():
        out = F.when(F.col("tbl") == table, F.col(name).cast("string")).otherwise(out)
    return rows.withColumn("part_key", out)


def partition_load(placed: DataFrame, n: int) -> DataFrame:
    """part, keys, accesses for every partition, empty ones too; replicated keys belong to none."""
    counts = placed.where("not replicated").groupBy("part", "tbl", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("part").agg(F.count(F.lit(1)).alias("keys"), F.sum("c").alias("accesses"))
    every = placed.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))
    return every.join(counts, "part", "left").select("part", F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("accesses", F.lit(0)).alias("accesses"))
