import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomrow.operators import crud, fold, frames, placement
from loomrow.functions.keys import Key


@pytest.mark.parametrize("rows", [1 << 18, 40])
def test_numbering_in_ranges_is_the_same_as_in_one(spark, rows):
    rng = random.Random(1)
    data = [(i, rng.choice("aab"), rng.randrange(60)) for i in range(500)]
    df = spark.createDataFrame(data, "i long, g string, o long").repartition(5)
    got = {r.i: r.n for r in frames.numbered(df, "o", "n", within=("g",), ties=("i",), rows=rows).collect()}
    for g in "ab":
        mine = sorted((o, i) for i, x, o in data if x == g)
        assert [got[i] for _, i in mine] == list(range(len(mine)))
    whole = frames.numbered(df, "o", "n", ties=("i",), rows=rows)
    assert whole.columns == ["i", "g", "o", "n"] and [r.n for r in whole.orderBy("o", "i").collect()] == list(range(500))
    assert frames.numbered(df.limit(0), "o", "n", rows=rows).count() == 0


@pytest.mark.parametrize("rows", [1 << 18, 40])
def test_running_max_in_ranges(spark, rows):
    rng = random.Random(2)
    data = [(i, i % 2, rng.choice([None, rng.randrange(1000)])) for i in range(400)]
    got = {r.o: r.m for r in frames.running_max(spark.createDataFrame(data, "o long, g int, v long"), "v", "o", "m", within=("g",), rows=rows).collect()}
    top = {0: None, 1: None}
    for o, g, v in data:
        top[g] = v if top[g] is None else top[g] if v is None else max(v, top[g])
        assert got[o] == top[g]


def test_groups_are_streamed_in_order(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (-F.col("id")).alias("o"))
    out = frames.in_groups(df, "g", ["o"], lambda g, rows: [{"g": g, "n": sum(1 for _ in rows)}], "g bigint, n bigint")
    assert sorted((r.g, r.n) for r in out.collect()) == [(g, len(range(g, 1000, 7))) for g in range(7)]


TABLE = "k long, a string, b double"


def test_reads_and_writes(spark):
    table = spark.createDataFrame([(1, "x", 1.0), (2, "y", None), (2, "z", 3.0), (None, "n", 0.0)], TABLE)
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert crud.point_read(table, Key.of("t", k=2)).first().a == "y" and crud.point_read(table, Key.of("t", k=9)).count() == 0
    assert crud.batch_read(table, keys(1, 2, 2), ["k"]).count() == 3
    with pytest.raises(PySparkException, match="no record of key"):
        crud.batch_read(table, keys(1, 9), ["k"]).collect()
    assert crud.read_keys(table, keys(2, 9), ["k"]).count() == 2 and crud.delete(table, keys(2), ["k"]).count() == 2
    assert [tuple(r) for r in crud.found_by_update(table, keys(1, 9), ["k"]).orderBy("k").collect()] == [(1, True), (9, False)]
    up = crud.update(table, spark.createDataFrame([(2, "new", None)], TABLE), ["k"])
    assert rows(up) == sorted(["(1, 'x', 1.0)", "(2, 'new', None)", "(2, 'new', 3.0)", "(None, 'n', 0.0)"])
    dirty = spark.createDataFrame([(1, "q", None, ["b"])], TABLE + ", d array<string>")
    assert crud.update(table, dirty, ["k"], "d").where("k = 1").first() == (1, "x", None)
    cache, stored = crud.write_back(table.where("k = 1"), table.where("k = 2"), spark.createDataFrame([(1, "c", None), (5, "s", 5.0)], TABLE), ["k"])
    assert rows(cache) == ["(1, 'c', 1.0)"] and "(5, 's', 5.0)" in rows(stored)
    cache, stored = crud.evict(table.where("k = 1"), table.where("k = 2"), keys(1), ["k"])
    assert cache.count() == 0 and stored.count() == 3
    with pytest.raises(ValueError):
        crud.set_values(crud.as_records(table), {"k": F.lit(1)}, ["k"])
    rec = crud.set_values(crud.as_records(table, 7), {"a": F.lit("!")}, ["k"]).where("k = 1")
    assert rec.first()[crud.DIRTY] == ["a"] and rec.first()[crud.OP] == "U" and rec.first()[crud.SOURCE_TX] == 7
    assert crud.remove_field(rec, "a", ["k"]).first()[crud.DIRTY] == [] and crud.mark_all(rec, ["k"]).first()[crud.DIRTY] == ["a", "b"]
    assert crud.removed(rec).select(crud.value("a")).first()[0] is None


def test_fold_against_one_change_after_another(spark):
    rng = random.Random(5)
    base = {k: (f"b{k}", float(k)) for k in range(0, 20, 2)}
    changes, now, version = [], dict(base), dict.fromkeys(base, -1)
    for tx in range(300):
        k, rows = rng.randrange(20), []
        for op in rng.sample("UUID", rng.randrange(1, 4)):
            rows.append((k, tx, op, None if op == "D" else rng.choice([None, f"t{tx}"]), None if op == "D" else float(tx)))
        changes += rows
        top = max((r[2] for r in rows), key="UID".index)
        mine = [r for r in rows if r[2] == top]
        a, b = (max([r[i] for r in mine if r[i] is not None], default=None) for i in (3, 4))
        version[k] = tx
        if top == "D":
            now.pop(k, None)
        elif top == "I":
            now[k] = (a, b)
        else:
            old = now.get(k, (None, None))
            now[k] = (old[0] if a is None else a, old[1] if b is None else b)
    table = spark.createDataFrame([(k, *v) for k, v in base.items()], TABLE)
    rows = spark.createDataFrame(changes, "k long, tx long, op string, a string, b double").repartition(4)
    got = {r.k: ((r.a, r.b), r.version) for r in fold.apply_changes(table, rows, ["k"]).collect()}
    assert got == {k: (v, version[k]) for k, v in now.items()}
    assert fold.apply_changes(table, rows.limit(0), ["k"]).count() == len(base)
    assert fold.snapshot(table, rows, ["k"], 0).where("version = -1").count() == len(base)
    assert fold.snapshot(table, rows, ["k"], 300).count() == len(now)


def test_votes_and_reports(spark):
    votes = spark.createDataFrame([(1, 0, True, None), (1, 1, True, None), (2, 0, True, None), (2, 3, False, "c"), (2, 1, False, "b"), (3, 1, False, "b"), (3, 2, False, "a")], "tx long, node int, commit boolean, message string")
    assert [tuple(r) for r in fold.two_phase_decisions(votes, master=2).orderBy("tx").collect()] == [(1, True, None, None), (2, False, 1, "b"), (3, False, 2, "a")]
    done = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 1, 1), (2, 0, 1), (2, 1, 0)], "tx long, node int, finished int")
    assert [tuple(r) for r in fold.all_finished(done, 2).orderBy("tx").collect()] == [(1, True), (2, False)]


def test_plans(spark):
    rows = spark.createDataFrame([(1, "a", -1), (2, "a", 5), (3, "r", 5), (4, "notification", 0)], "tx long, tbl string, k long")
    base = placement.NotificationPlan(placement.ModuloPlan(4, ("r",)))
    at = lambda plan: [(r.part, r.replicated) for r in plan.place(rows).orderBy("tx").collect()]
    assert at(base) == [(3, False), (1, False), (1, True), (-1, False)]
    over = lambda k, dest: spark.createDataFrame([("a", k, dest)], "tbl string, k long, dest int")
    twice = placement.OverridePlan(placement.OverridePlan(placement.OverridePlan(base, over(5, 2)), over(-1, 0)), over(5, 3))
    assert at(twice) == [(0, False), (3, False), (1, True), (-1, False)] and twice.n == 4
    assert not isinstance(twice.merged()[0], placement.OverridePlan) and twice.merged()[1].count() == 2
    assert at(placement.VersionedPlan(((0, base), (2, twice)))) == [(3, False), (3, False), (1, True), (-1, False)]
    assert placement.partitioning_key(rows, {"a": "k"}, ["tbl", "k"]).orderBy("tx").first().part_key == "-1"
