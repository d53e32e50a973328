"""Steps that must not grow faster than their input: what they read, shuffle and keep."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomrow import registry
from loomrow.operators import analysis, conflicts, frames, graph, migration, pairs, placement, repartition, routing
from loomrow.sources import tables
from tests.oracle import compare


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_groups_are_not_cut(spark, monkeypatch):
    """Ranges are for groups beyond one window; a log of small queues has one window each, whatever its length."""
    rng = random.Random(4)
    rows = [(tx, "a", rng.randrange(50), rng.choice("SX")) for tx in range(600)] + [(tx, "hot", 0, rng.choice("SX")) for tx in range(300)]
    locks = spark.createDataFrame(rows, "tx long, tbl string, k long, mode string")
    cut = []
    ranged = frames._ranged
    monkeypatch.setattr(frames, "_ranged", lambda df, *a: cut.append(sorted({r.tbl for r in df.select("tbl").distinct().collect()})) or ranged(df, *a))
    whole = sorted(map(tuple, conflicts.queue_positions(locks).collect())), sorted(map(tuple, conflicts.waits(locks).collect()))
    assert not cut
    parts = sorted(map(tuple, conflicts.queue_positions(locks, rows=100).collect())), sorted(map(tuple, conflicts.waits(locks, rows=100).collect()))
    assert cut == [["hot"], ["hot"]] and parts == whole


def test_stored_rows_are_columns(spark):
    """A stored table takes less than its rows do, and null groups stay one."""
    df = spark.range(20000).select((F.col("id") % 3).alias("k"), F.lit("the same text in every row").alias("t"), F.when(F.col("id") % 2 == 0, 1).alias("g"))
    kept = frames.checkpoint(df)
    assert kept.dtypes == df.dtypes and kept.count() == 20000 and kept.inputFiles() and kept.inputFiles()[0].endswith(".parquet")
    got = frames.numbered(df.select("g", F.monotonically_increasing_id().alias("o")), "o", "n", within=("g",), rows=3000).groupBy("g").agg(F.max("n").alias("n"), F.count_distinct("n").alias("d")).collect()
    assert sorted((r.n, r.d) for r in got) == [(9999, 10000)] * 2


def test_sources_need_no_join(spark):
    """A source's node comes with it: a join by source has the storages' few numbers as hot keys."""
    keys = spark.createDataFrame([(0, 1, "a", 5, True, True, 1, False, 2), (0, 2, "a", 5, True, False, 1, False, 3), (0, 2, "r", 7, True, False, 3, True, 3)], "batch long, tx long, tbl string, k long, rd boolean, wr boolean, part int, replicated boolean, node int")
    found = graph.sources(graph.routed(keys, None))
    assert "Join" not in plan_of(found) and "Join" not in plan_of(graph.sunk_flags(keys))
    assert sorted((r.tx, r.tbl, r.src, r.src_node, r.last) for r in found.collect()) == [(1, "a", -2, 1, True), (2, "a", 1, 2, False), (2, "r", -4, 3, False)]
    routes = keys.select("tx", "node").distinct()
    assert sorted(map(tuple, graph.sunk_plans(keys.drop("node"), routes).collect())) == sorted(map(tuple, graph.sunk_plans(keys).collect()))


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["clump_seed", "recv_load_delta", "metis_lines"])
def test_questions_on_the_heat_graph_make_no_edges(spark, monkeypatch, name):
    monkeypatch.setattr(repartition, "heat_edges", lambda placed: pytest.fail("all edges were made"))
    assert registry.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("wide", [1, 1 << 45, 1 << 59])
def test_pairs_are_summed_in_pieces(spark, monkeypatch, wide):
    """Edges by the tasks' own sums: one row a bucket and task is shuffled, not one a pair; any numbers and names."""
    monkeypatch.setattr(pairs, "PAIRS", 50)
    rng = random.Random(6)
    rows = {(tx, 0, rng.choice(["a", "b", "a:b", "é"]), rng.randrange(-6, 7) * wide, rng.choice("RU")) for tx in range(40) for _ in range(rng.randrange(1, 9))} | {(99, 0, "a", k * wide, "R") for k in range(-12, 13)}
    rows |= {(5, 0, None, 3, "R"), (5, 0, "a", None, "R"), (6, 0, "a", None, "R"), (6, 0, None, 3, "U")}
    placed = placement.ModuloPlan(4).place(spark.createDataFrame(sorted(rows, key=str), "tx long, seq int, tbl string, k long, op string"))
    edges = repartition.heat_edges(placed)
    n = Counter((tx, ":".join(str(x) for x in (t, k) if x is not None)) for tx, _, t, k, _ in rows)
    want = Counter()
    for (tx, v), a in n.items():
        for (other, u), b in n.items():
            if tx == other and u != v:
                want[v, u] += a * b
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == want
    assert "data" in plan_of(edges) and "Generate" not in plan_of(edges)
    some = spark.createDataFrame([(v,) for v in sorted({v for _, v in n})[:5]], "v string")
    ours = {r.v for r in some.collect()}
    assert {(r.src, r.dst): r.weight for r in repartition.edges_from(some, placed).collect()} == {x: w for x, w in want.items() if x[0] in ours}
    lines = repartition.metis_graph(placed.where("k is not null and tbl is not null"))
    clean = placed.where("k is not null and tbl is not null").cache()
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, repartition.metis_lines(repartition.heat_vertices(clean), repartition.heat_edges(clean)).collect()))


@pytest.mark.parametrize("most", [1, 50, 1 << 21])
def test_pairs_in_pieces_of_any_size(monkeypatch, most):
    monkeypatch.setattr(pairs, "PAIRS", most)
    rng = random.Random(most)
    keys = [(tx, t, k) for tx in range(30) for t, k in sorted({(rng.choice(["+a:", "+b:"]), rng.randrange(9)) for _ in range(rng.randrange(1, 12))})]
    of = Counter(tx for tx, _, _ in keys)
    rows = [{"tx": tx, "bucket": hash((t, k)) % 5, "t": t, "k": k, "n": 1 + k % 2, "c": of[tx]} for tx, t, k in keys]
    made = list(pairs._made(iter([pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7)]), True))
    flat = sorted(((b, d) for x in made for b, d in zip(x["bucket"].to_pylist(), x["data"].to_pylist(), strict=True)), key=lambda x: x[0])
    got = Counter()
    for names, cols in pairs.summed(iter([pa.RecordBatch.from_pylist([{"bucket": b, "data": d}]) for b, d in flat])):
        for a, ak, b, bk, w in zip(*(c.tolist() for c in cols), strict=True):
            assert ((names[a], ak), (names[b], bk)) not in got
            got[(names[a], ak), (names[b], bk)] = w
    want = Counter()
    for x in keys:
        for y in keys:
            if x[0] == y[0]:
                want[x[1:], y[1:]] += 1 + x[2] % 2 if x == y else (1 + x[2] % 2) * (1 + y[2] % 2)
    assert got == want


@pytest.mark.parametrize("rule", ["balanced", "local_first"])
@pytest.mark.parametrize("size", [3, 1000])
def test_fused_routes_are_those_of_the_plain_steps(spark, rule, size):
    """Packing and unpacking are dealt over tasks; what the one task of a log gives is what fused_step does row by row."""
    rng = random.Random(size)
    rows = {}
    for log in "xy":
        for tx in range(90):
            for _ in range(rng.randrange(1, 8)):
                t = rng.choice("aabrs")
                k = rng.randrange(-4, 12) * (1 << 58 if t == "s" else 1)
                rows[log, tx // 5, tx, t, k] = (rng.random() < 0.8, t != "b" and rng.random() < 0.4, k % 4, t == "r")
    keys = spark.createDataFrame([(*a, *b) for a, b in rows.items() if b[0] or b[1]], "log string, batch long, tx long, tbl string, k long, rd boolean, wr boolean, part int, replicated boolean").repartition(3)
    got = Counter(tuple(r) for r in routing.fused_routes(keys, 4, rule=rule, size=size, log="log").collect())
    want = Counter()
    plain = sorted(r.asDict().items() for r in keys.collect())
    by = {}
    for r in map(dict, plain):
        by.setdefault((r["log"], r["batch"]), []).append(r)
    table = {log: routing.FusionTable(size) for log in "xy"}
    for (log, batch), mine in sorted(by.items()):
        route, moves = routing.fused_step(table[log], sorted(mine, key=lambda r: (r["tx"], r["tbl"], r["k"])), 4, rule)
        want.update((batch, tx, node, *[None] * 6) for tx, node in route.items())
        want.update((batch, m["tx"], route[m["tx"]], *(m[c] for c in ("tbl", "k", "src", "dest", "cache_insert", "cache_delete"))) for m in moves)
    assert got == want


def test_rows_are_distinct_before_they_are_given_to_nodes(spark):
    """One row an access is moved for a transaction's sets, not one for each node; only tables with moving keys are joined with them."""
    rng = random.Random(9)
    rows = [(tx, s, rng.choice("abr"), rng.randrange(12), rng.choice("RRUI")) for tx in range(40) for s in range(5)]
    placed = placement.ModuloPlan(4, ("r",)).place(spark.createDataFrame(rows * 2, "tx long, seq int, tbl string, k long, op string"))
    text = plan_of(analysis.local_sets(placed, 4))
    assert text.index("Generate") < text.index("Aggregate")
    assert "Join" not in plan_of(analysis.plan_flags(placed, 4))
    moves = spark.createDataFrame([("a", k, k % 4, (k + 1) % 4) for k in range(0, 12, 3)], "tbl string, k long, src int, dest int")
    seen = migration.status(placed, moves, migration.first_touches(placed, moves, 10, 30))
    assert plan_of(seen).index("Union") < plan_of(seen).index("Join")
    for how in ("crabbing", "caught_up", "on_demand"):
        every = migration.analyse(seen, 4, how)
        assert Counter(map(tuple, every.collect())) == Counter(set(map(tuple, every.collect())))
        near = migration.analyse(seen, 4, how, remote=False)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, every.where("kind <> 'remote_read'").collect()))
        assert sorted(map(tuple, migration.roles(near, seen, 4, how).collect())) == sorted(map(tuple, migration.roles(every, seen, 4, how).collect()))


@pytest.mark.parametrize("seed", [8, 9])
def test_plans_on_transactions_are_those_on_edges(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(tx, 0, "a", rng.choice([rng.randrange(0, 40, 4), rng.randrange(40)]), "R") for tx in range(250)]
    rows += [(tx, 1, rng.choice("ab"), rng.randrange(40), rng.choice("RU")) for tx in range(0, 250, 6)]
    placed = placement.ModuloPlan(4).place(spark.createDataFrame(list(dict.fromkeys(rows)), "tx long, seq int, tbl string, k long, op string")).cache()
    want = sorted(map(tuple, repartition.plan_moves(repartition.heat_vertices(placed), repartition.heat_edges(placed), 4, overload=1.05, clump_size=4).collect()))
    monkeypatch.setattr(repartition, "heat_edges", lambda placed: pytest.fail("all edges were made"))
    assert want and sorted(map(tuple, repartition.plan_moves_of(placed, 4, overload=1.05, clump_size=4).collect())) == want
    assert registry.QUERIES["plan_moves"](spark, SMALL).count() > 0


def test_a_tasks_share_of_accesses_does_not_grow(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES_A_TASK", 300)
    assert tables.accesses_parts(spark, SMALL) == 20
    assert tables.order_accesses(spark, SMALL, True).distinct()._jdf.queryExecution().executedPlan().toString().count(", 20)") >= 3
    why, _ = compare(spark, registry.QUERIES["sink_reads"], registry.ORACLE_SQL["sink_reads"], SMALL)
    assert why is None, why
