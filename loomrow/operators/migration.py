"""Moving keys between partitions while transactions run.

Ranges are rows (tbl, k, src, dest): the keys on the move. What has moved is a
table of (tbl, k, migrated_tx): a transaction finds a key moved if that came
before it in the log. Accesses are placed under the old plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrow.operators.analysis import KINDS
from loomrow.operators.frames import BROADCAST_ROWS, checkpoint, numbered, small

KEY = ("tbl", "k")


def chunks(ranges: DataFrame, size: int, order: str = "push_order") -> DataFrame:
    """Adds chunk (from 0): runs of `size` keys of each (src, dest) in push order."""
    return numbered(ranges, order, "at", within=("src", "dest"), ties=KEY).withColumn("chunk", F.floor(F.col("at") / size)).drop("at")


def containing_range(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """keys with src and dest of the first range (by range_no) that holds each; null outside all."""
    first = ranges.groupBy(*KEY).agg(F.min_by(F.struct("src", "dest"), "range_no").alias("r"))
    return keys.join(small(first), list(KEY), "left").select(*keys.columns, "r.src", "r.dest")


def remaining(unmigrated: DataFrame, still_to_push: DataFrame) -> DataFrame:
    """Unmigrated keys that the update of their own (src, dest) still lists; other ranges' stay."""
    listed = still_to_push.select("src", "dest", *KEY).distinct()
    touched = still_to_push.select("src", "dest").distinct()
    kept = unmigrated.join(listed, ["src", "dest", *KEY], "left_semi")
    return kept.unionByName(unmigrated.join(F.broadcast(touched), ["src", "dest"], "left_anti").select(*kept.columns))


def _names(keys: DataFrame) -> list[str]:
    return [r.tbl for r in keys.select("tbl").distinct().collect()]


def _of_tables(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows of the tables that have keys on the move, and all others."""
    inside = F.coalesce(F.col("tbl").isin(names), F.lit(False))
    return rows.where(inside), rows.where(~inside)


def first_touches(placed: DataFrame, ranges: DataFrame, start: int, end: int, ops: Sequence[str] = ("R", "U")) -> DataFrame:
    """tbl, k, migrated_tx: the first transaction from start to before end that touches a key on the move (its foreground copy)."""
    inside = placed.where((F.col("tx") >= start) & (F.col("tx") < end) & F.col("op").isin(*ops))
    return _of_tables(inside, _names(ranges))[0].groupBy(*KEY).agg(F.min("tx").alias("migrated_tx")).join(small(ranges.select(*KEY).distinct()), list(KEY), "left_semi")


def status(placed: DataFrame, ranges: DataFrame, migrated: DataFrame) -> DataFrame:
    """placed with src, dest (null: not on the move) and is_migrated, as its transaction finds them.

    Only rows of tables with such keys are joined, and then dealt by transaction
    like the others.
    """
    keys = checkpoint(ranges.select(*KEY, "src", "dest").join(migrated.select(*KEY, "migrated_tx"), list(KEY), "full"))
    here, rest = _of_tables(placed, _names(keys))
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = here.join(F.broadcast(keys) if few else keys, list(KEY), "left")
    found = joined.select(*placed.columns, "src", "dest", F.coalesce(F.col("migrated_tx") < F.col("tx"), F.lit(False)).alias("is_migrated"))
    types = dict(keys.dtypes)
    none = rest.select(*placed.columns, *(F.lit(None).cast(types[c]).alias(c) for c in ("src", "dest")), F.lit(False).alias("is_migrated"))
    return (found if few else found.repartition("tx")).unionByName(none)


def stopped_copy(placed: DataFrame, ranges: DataFrame, start: int) -> DataFrame:
    """status of a migration that copies everything while no transaction runs: from start on all keys have moved."""
    return status(placed, ranges, ranges.select(*KEY, F.lit(start - 1).cast("long").alias("migrated_tx")).distinct())


def copied_chunks(table: DataFrame, ranges: DataFrame, on: str, size: int) -> DataFrame:
    """Rows of table that a stopped copy sends, with chunk, src and dest: all that exist, four background chunks of `size` keys at once."""
    return table.join(chunks(ranges, 4 * size).select(F.col("k").alias(on), "chunk", "src", "dest"), on)


def analyse(seen: DataFrame, n: int, how: str, remote: bool = True) -> DataFrame:
    """tx, node, kind, tbl, k: what each of n nodes does, for accesses with their status; replicated keys left out.

    kind is local_read, remote_read, update, insert, delete, copy_out (the
    source sends the record before the transaction runs) and copy_in. Keys that
    don't move follow their owner. Of moving ones:

    source_only: everything at the source.
    stop_and_copy: everything at the source until moved, then at the destination.
    on_demand: all keys of a transaction on one way (src, dest) at the
        destination if any key it reads or updates there has moved, else at the
        source; unmoved ones it reads or updates are copied first.
    crabbing: reads and writes at both ends; unmoved ones read or updated are copied.
    caught_up: reads at the destination, and at the source until moved; writes
        at the destination; unmoved ones read or updated are copied.

    Without remote, remote reads are left out.
    """
    rows = seen.where("not replicated").select("tx", *KEY, "op", "part", "src", "dest", "is_migrated").distinct()
    # keys that don't move need no more than that to be distinct
    still = rows.where("src is null").withColumn("homes", F.array("part"))
    rows = rows.where("src is not null")
    moving, touch = F.col("src").isNotNull(), F.col("op").isin("R", "U")
    if how == "on_demand":
        ways = rows.where(moving & touch).groupBy("tx", "src", "dest").agg(F.max("is_migrated").alias("at_dest"))
        rows = rows.join(ways, ["tx", "src", "dest"], "left").withColumn("at", F.when(F.coalesce("at_dest", F.lit(False)), F.col("dest")).otherwise(F.col("src")))
        homes = F.array("at")
        copied = touch & (F.col("at") == F.col("dest")) & ~F.col("is_migrated")
    elif how == "crabbing":
        homes, copied = F.array("src", "dest"), touch & ~F.col("is_migrated")
    elif how == "caught_up":
        homes = F.when((F.col("op") == "R") & ~F.col("is_migrated"), F.array("src", "dest")).otherwise(F.array("dest"))
        copied = touch & ~F.col("is_migrated")
    elif how == "stop_and_copy":
        homes, copied = F.array(F.when(F.col("is_migrated"), F.col("dest")).otherwise(F.col("src"))), F.lit(False)
    elif how == "source_only":
        homes, copied = F.array("src"), F.lit(False)
    else:
        raise ValueError(f"no such way to move data: {how}")
    rows = rows.withColumns({"homes": F.when(moving, homes).otherwise(F.array("part")), "copied": moving & copied})
    nodes = F.when(F.col("op") == "R", F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.col("homes")) if remote else F.col("homes")
    kind = F.when(F.col("op") == "R", F.when(F.array_contains("homes", F.col("node")), "local_read").otherwise("remote_read"))
    for op, name in KINDS.items():
        kind = kind.when(F.col("op") == op, name)
    given = lambda of: of.withColumn("node", F.explode(nodes)).select("tx", F.col("node").cast("int").alias("node"), kind.alias("kind"), *KEY)
    copies = rows.where("copied").select("tx", *KEY, F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit("copy_out").alias("kind")), F.struct(F.col("dest").alias("node"), F.lit("copy_in").alias("kind")))))
    return given(still).unionByName(given(rows).unionByName(copies).distinct())


def over_time(placed: DataFrame, ranges: DataFrame, start: int, end: int) -> DataFrame:
    """status of a migration from its start to before its end: earlier transactions find the old places, later ones the new, and nothing on the move."""
    seen, tx = status(placed, ranges, first_touches(placed, ranges, start, end)), F.col("tx")
    inside = (tx >= start) & (tx < end)
    part = F.when((tx >= end) & F.col("dest").isNotNull(), F.col("dest")).otherwise(F.col("part"))
    return seen.withColumns({"part": part, "src": F.when(inside, F.col("src")), "dest": F.when(inside, F.col("dest"))})


def roles(sets: DataFrame, seen: DataFrame, n: int, how: str) -> DataFrame:
    """tx, node, role under a way to move data: writers are active, else the node that most reads count for (the lowest of equals).

    In caught_up a moving key's read counts for the destination, else for every
    node where it is local.
    """
    read = F.col("kind") == "local_read"
    if how == "caught_up":
        moving = seen.where("op = 'R' and src is not null").select("tx", *KEY, F.col("dest")).distinct()
        sets = sets.join(moving, ["tx", *KEY], "left")
        counts = read & (F.col("dest").isNull() | (F.col("dest") == F.col("node")))
    else:
        counts = read
    each = sets.groupBy("tx", "node").agg(F.count(F.when(counts, 1)).alias("n"), F.max(F.col("kind").isin(*KINDS.values())).alias("w"), F.max(F.col("kind").isin("local_read", "copy_out")).alias("p"))
    order = F.when(F.col("n") > 0, F.struct(-F.col("n"), "node"))
    some = lambda c: F.collect_set(F.when(F.col(c), F.col("node"))).alias(c)
    one = each.groupBy("tx").agg(F.min_by("node", order).alias("most"), some("w"), some("p"))
    none = F.array().cast("array<int>")
    every = seen.select("tx").distinct().join(one, "tx", "left").select("tx", F.coalesce("most", F.lit(0)).alias("most"), F.coalesce("w", none).alias("w"), F.coalesce("p", none).alias("p"))
    active = F.when(F.size("w") > 0, F.col("w")).otherwise(F.array("most"))
    nodes = F.array_union(F.array_union(F.sequence(F.lit(0), F.lit(n - 1)), active), "p")
    role = F.when(F.array_contains(active, F.col("node")), "ACTIVE").when(F.array_contains("p", F.col("node")), "PASSIVE").otherwise("IGNORE")
    return every.withColumn("node", F.explode(nodes)).select("tx", F.col("node").cast("int").alias("node"), role.alias("role"))


def pushes(sets: DataFrame, role: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """tx, node, target, tbl, k: local reads that go to other active nodes which don't have them; with ranges, never between a key's two ends."""
    targets = role.where("role = 'ACTIVE'").select("tx", F.col("node").alias("target"))
    local = sets.where("kind = 'local_read'").select("tx", "node", *KEY)
    out = local.join(targets, "tx").where("node <> target")
    if ranges is not None:
        ends = small(ranges.select(*KEY, "src", "dest"))
        out, others = _of_tables(out.select("tx", "node", "target", *KEY), _names(ranges))
        both = F.array_contains(F.array("src", "dest"), F.col("node")) & F.array_contains(F.array("src", "dest"), F.col("target"))
        out = out.join(ends, list(KEY), "left").where(~F.coalesce(both, F.lit(False))).select(*others.columns).unionByName(others)
    return out.select("tx", "node", "target", *KEY)


def changed_keys(placed: DataFrame, ranges: DataFrame, start: int, end: int) -> DataFrame:
    """dest, tbl, k, kind: keys on the move that were written from start to before end, by kind of write."""
    rows = placed.where((F.col("tx") >= start) & (F.col("tx") < end) & (F.col("op") != "R"))
    return rows.join(small(ranges.select(*KEY, "dest")), list(KEY)).select("dest", *KEY, "op").distinct()


def handover(changes: DataFrame) -> DataFrame:
    """dest, tbl, k, op: what the source hands over: inserts, deletes of the rest, updates of what is left."""
    rank = F.when(F.col("op") == "I", 0).when(F.col("op") == "D", 1).otherwise(2)
    return changes.groupBy("dest", *KEY).agg(F.min_by("op", rank).alias("op"))


def last_handover(changes: DataFrame) -> DataFrame:
    """dest, tbl, k, op by the last change (rows have tx): a key inserted and then deleted is handed over as deleted."""
    return changes.groupBy("dest", *KEY).agg(F.max_by("op", "tx").alias("op"))


def merge_routes(moves: DataFrame) -> DataFrame:
    """tbl, k, src, dest from moves (tbl, k, step, src, dest): a to b and b to c is a to c, a to b and b to a is none.

    A step that doesn't start where the one before ended fails the job. Moves
    of a key are few: one for each merged plan.
    """
    all_ = moves.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("step", "src", "dest"))).alias("m"))
    joins = F.forall(F.sequence(F.lit(1), F.size("m")), lambda i: (i == 1) | (F.get("m", i - 1)["src"] == F.get("m", i - 2)["dest"]))
    broken = F.raise_error(F.concat(F.lit("moves don't meet for "), F.col("tbl"), F.lit(" "), F.col("k").cast("string")))
    ends = all_.where(F.when(~joins, broken.cast("boolean")).otherwise(F.lit(True))).select(*KEY, F.get("m", F.lit(0))["src"].alias("src"), F.element_at("m", -1)["dest"].alias("dest"))
    return ends.where("src <> dest")


def new_overrides(older: DataFrame, routes: DataFrame) -> DataFrame:
    """tbl, k, dest: an override map after a migration, new entries first."""
    new = routes.select(*KEY, F.col("dest").alias("d"))
    return older.join(new, list(KEY), "full").select(*KEY, F.coalesce("d", "dest").cast("int").alias("dest"))


def single_key_plans(routes: DataFrame) -> DataFrame:
    """plan, tbl, k, src, dest: one plan for each key."""
    return numbered(routes, "k", "plan", ties=("tbl",)).select("plan", *KEY, "src", "dest")


def background_copy(table: DataFrame, chunked: DataFrame, migrated: DataFrame, on: str, push_tx: DataFrame) -> DataFrame:
    """Rows of table that background pushes carry, with chunk: keys that exist and hadn't moved when their chunk was pushed (chunk, push_tx)."""
    due = chunked.join(F.broadcast(push_tx), "chunk").join(migrated, list(KEY), "left").where("migrated_tx is null or migrated_tx >= push_tx")
    return table.join(due.select(F.col("k").alias(on), "chunk", "src", "dest"), on)


def two_phase_stored(chunked: DataFrame, migrated: DataFrame, phases: DataFrame) -> DataFrame:
    """chunk, tbl, k, shipped, stored: keys read and shipped at read_tx, and stored at store_tx if they haven't moved by then."""
    rows = chunked.join(F.broadcast(phases), "chunk").join(migrated, list(KEY), "left")
    unmoved = lambda at: F.coalesce(F.col("migrated_tx") >= F.col(at), F.lit(True))
    return rows.select("chunk", *KEY, unmoved("read_tx").alias("shipped"), (unmoved("read_tx") & unmoved("store_tx")).alias("stored"))


def ranges_left(ranges: DataFrame, finished: DataFrame) -> DataFrame:
    """finish_tx, ranges_left: the count-down of ranges as finish messages come; 0 ends the migration."""
    n = ranges.select("src", "dest").distinct().count()
    return numbered(finished, "finish_tx", "at", ties=("src", "dest")).select("finish_tx", (F.lit(n) - F.col("at") - 1).alias("ranges_left"))


def phase_at(txs: DataFrame, phases: Sequence[tuple[int, str]]) -> DataFrame:
    """Adds phase: the last one that began at or before the transaction, by its place in the log."""
    out = F.lit("normal")
    for start, name in sorted(phases):
        out = F.when(F.col("tx") >= start, name).otherwise(out)
    return txs.withColumn("phase", out)
