"""Folding the change rows of an ordered log into table state, and what comes back to clients.

Change rows are (keys, tx, op, fields); op is I, U or D. Of a transaction's rows
of one key, a delete counts before an insert, an insert before an update.
Everything is an aggregate by key, so a hot key is combined before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strongest(changes: DataFrame, on: Sequence[str]) -> DataFrame:
    """One change a key and transaction: the strongest operation and the fields given with it (of several values the largest)."""
    fields = [c for c in changes.columns if c not in (*on, "tx", "op")]
    rank = F.when(F.col("op") == "D", 2).when(F.col("op") == "I", 1).otherwise(0)
    grouped = changes.withColumn("rank of op", rank).groupBy(*on, "tx")
    out = grouped.agg(F.max("rank of op").alias("r"), *(F.max(F.struct("rank of op", c)).alias(c) for c in fields))
    op = F.element_at(F.array(F.lit("U"), F.lit("I"), F.lit("D")), F.col("r") + 1)
    return out.select(*on, "tx", op.alias("op"), *(F.col(c)[c].alias(c) for c in fields))


def last_state(changes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Of each key: what is left of its changes: last_tx, deleted, replaced (a delete or insert came), and its fields' last values since."""
    fields = [c for c in changes.columns if c not in (*on, "tx", "op")]
    one = strongest(changes, on)
    fresh = one.where("op <> 'U'").groupBy(*on).agg(F.max("tx").alias("since"))
    marked = one.join(fresh, list(on), "left").where("since is null or tx >= since")
    return marked.groupBy(*on).agg(
        F.max("tx").alias("last_tx"),
        F.max_by("op", "tx").eqNullSafe("D").alias("deleted"),
        F.first("since").isNotNull().alias("replaced"),
        *(F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("op") != "D"), F.col("tx"))).alias(c) for c in fields),
    )


def apply_changes(table: DataFrame, changes: DataFrame, on: Sequence[str]) -> DataFrame:
    """table after all changes in the order of tx, with version: the last transaction that changed a row, -1 for none.

    An update of an absent key inserts it; an insert replaces the whole record.
    """
    fields = [c for c in table.columns if c not in on]
    state = last_state(changes.select(*on, "tx", "op", *fields), on)
    new = state.select(*on, "last_tx", "deleted", "replaced", *(F.col(c).alias(f"new {c}") for c in fields))
    both = table.join(new, list(on), "full").where(~F.coalesce("deleted", F.lit(False)))
    keep = lambda c: F.when(F.coalesce("replaced", F.lit(False)), F.col(f"new {c}")).otherwise(F.coalesce(f"new {c}", c)).alias(c)
    return both.select(*on, *map(keep, fields), F.coalesce("last_tx", F.lit(-1)).cast("long").alias("version"))


def snapshot(table: DataFrame, changes: DataFrame, on: Sequence[str], before: int) -> DataFrame:
    """What transaction `before` reads: the state after all earlier ones."""
    return apply_changes(table, changes.where(F.col("tx") < before), on)


def committed(changes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Changes of transactions whose outcome (tx, committed) is a commit; those without an outcome don't count."""
    return changes.join(outcomes.where("committed").select("tx"), "tx", "left_semi")


def declared_only(changes: DataFrame, accesses: DataFrame, on: Sequence[str]) -> DataFrame:
    """Changes of keys that their transaction has declared to write; others are passed over in silence."""
    return changes.join(accesses.where("op <> 'R'").select("tx", *on).distinct(), ["tx", *on], "left_semi")


def accepted_responses(responses: DataFrame) -> DataFrame:
    """One response for each (client_id, rte_id, tx): the answer of the lowest node; later duplicates from other nodes drop out."""
    return responses.groupBy("client_id", "rte_id", "tx").agg(F.min("node").alias("node"), F.min_by("committed", "node").alias("committed"))


def two_phase_decisions(votes: DataFrame, master: int = 0) -> DataFrame:
    """tx, committed, aborting node and message: any abort aborts all; the master's own comes first, then the lowest node's."""
    order = F.when(~F.col("commit"), F.when(F.col("node") == master, -1).otherwise(F.col("node")))
    return votes.groupBy("tx").agg(F.min("commit").alias("committed"), F.min_by("node", order).alias("abort_node"), F.min_by("message", order).alias("message")).select("tx", "committed", F.when(~F.col("committed"), F.col("abort_node")).alias("abort_node"), F.when(~F.col("committed"), F.col("message")).alias("message"))


def all_finished(reports: DataFrame, nodes: int) -> DataFrame:
    """tx, complete: whether every node has reported 1."""
    return reports.groupBy("tx").agg((F.count_distinct(F.when(F.col("finished") == 1, F.col("node"))) == nodes).alias("complete"))
