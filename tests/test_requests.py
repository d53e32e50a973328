"""Analysis, graphs, routing, conflicts, moves, plans and streams against step-by-step simulations."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomrow.config import Config, Migration, Service
from loomrow.operators import analysis, conflicts, fold, graph, migration, placement, repartition, routing, watermarks
from loomrow.plans.engine import Engine, Procedure
from loomrow.sources import graphs, requests
from loomrow.streaming import state

N = 4
SCHEMA = "tx long, seq int, tbl string, k long, op string"


def accesses(seed=1, txs=120, keys=30):
    rng, out = random.Random(seed), []
    for tx in range(txs):
        for seq in range(rng.randrange(1, 7)):
            out.append((tx, seq, rng.choice("aab") if rng.random() > 0.15 else "r", rng.randrange(keys), rng.choice("RRRUID")))
    return list(dict.fromkeys(out))


@pytest.fixture(scope="module")
def acc():
    return accesses()


@pytest.fixture(scope="module")
def placed(spark, acc):
    return placement.ModuloPlan(N, ("r",)).place(spark.createDataFrame(acc, SCHEMA)).cache()


def by_tx(acc):
    out = defaultdict(list)
    for r in acc:
        out[r[0]].append(r)
    return out


def sequential_roles(rows):
    """Reads one by one; the node that first reaches the most is kept."""
    count, best, most = Counter(), 0, 0
    for _, _, t, k, op in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        if op == "R" and t != "r":
            count[k % N] += 1
            if count[k % N] > most:
                best, most = k % N, count[k % N]
    active = {k % N for _, _, t, k, op in rows if op != "R" and t != "r"} or {best}
    return best, active, set(count)


def test_nodes_and_roles(placed, acc):
    most = {r.tx: r.node for r in analysis.most_reads_node(placed).collect()}
    roles = {(r.tx, r.node): r.role for r in analysis.participant_roles(placed, N).collect()}
    pushes = {tuple(r) for r in analysis.push_sets(placed).collect()}
    want = set()
    for tx, rows in by_tx(acc).items():
        best, active, readers = sequential_roles(rows)
        assert most[tx] == best
        for node in range(N):
            assert roles[tx, node] == ("ACTIVE" if node in active else "PASSIVE" if node in readers else "IGNORE")
        want |= {(tx, k % N, a, t, k) for _, _, t, k, op in rows if op == "R" and t != "r" for a in active if a != k % N}
    assert pushes == want


def test_missing_records_fail(spark, placed):
    values = spark.createDataFrame([("a", k, 1.0) for k in range(30)], "tbl string, k long, value double")
    only = placed.where("tbl = 'a'")
    assert analysis.read_values(only, values).count() == only.where("op = 'R'").select("tx", "k").distinct().count()
    with pytest.raises(PySparkException, match="no record of"):
        analysis.read_values(placed.where("tbl = 'b'"), values).collect()


def keyed_rows(acc, size):
    """Batches of the keys of each transaction, as graph.keyed has them."""
    order = sorted({r[0] for r in acc})
    out = defaultdict(dict)
    for tx, _, t, k, op in acc:
        r = out[order.index(tx) // size].setdefault((tx, t, k), {"tx": tx, "tbl": t, "k": k, "rd": False, "wr": False, "part": k % N, "replicated": t == "r"})
        r["rd"] |= op == "R"
        r["wr"] |= op != "R"
    return {b: sorted(x.values(), key=lambda r: (r["tx"], r["tbl"], r["k"])) for b, x in out.items()}


def test_edges_against_one_transaction_after_another(placed, acc):
    keys = graph.keyed(placed, graph.batches(placed, 10)).cache()
    got = {(r.batch, r.src, r.dst, r.tbl, r.k) for r in graph.read_edges(keys).collect()}
    back = {(r.batch, r.src, r.tbl, r.k, r.part) for r in graph.writeback_edges(keys).collect()}
    want, want_back = set(), set()
    for b, rows in keyed_rows(acc, 10).items():
        last, txs = {}, sorted({r["tx"] for r in rows})
        for tx in txs:
            mine = [r for r in rows if r["tx"] == tx]
            want |= {(b, None if r["replicated"] else last.get((r["tbl"], r["k"]), -(r["part"] + 1)), tx, r["tbl"], r["k"]) for r in mine if r["rd"]}
            last.update({(r["tbl"], r["k"]): tx for r in mine if r["wr"]})
        want_back |= {(b, tx, t, k, k % N) for (t, k), tx in last.items()}
    assert got == want and back == want_back


def remote_reads(rows, tx, p, position):
    return sum(position(r) != p for r in rows if r["tx"] == tx and r["rd"] and not r["replicated"])


def test_cost_routes(placed, acc):
    keys = graph.keyed(placed, graph.batches(placed, 10))
    for beta in (1.0, 0.4):
        got = {r.tx: r.node for r in routing.cost_routes(keys, N, beta).collect()}
        for rows in keyed_rows(acc, 10).values():
            at, load, route = {}, [0] * N, {}
            for tx in sorted({r["tx"] for r in rows}):
                cost = [math.floor(((load[p] + 1) * (1 - beta) + beta * remote_reads(rows, tx, p, lambda r: at.get((r["tbl"], r["k"]), r["part"]))) * 10000 + 1e-9) for p in range(N)]  # noqa: B023
                route[tx] = cost.index(min(cost))
                load[route[tx]] += 1
                at.update({(r["tbl"], r["k"]): route[tx] for r in rows if r["tx"] == tx and r["wr"]})
            assert all(got[tx] == p for tx, p in route.items())


def test_balanced_routes(placed, acc):
    keys = graph.keyed(placed, graph.batches(placed, 20))
    got = {r.tx: r.node for r in routing.balanced_routes(keys, N, 0.25).collect()}
    for rows in keyed_rows(acc, 20).values():
        txs = sorted({r["tx"] for r in rows})
        load = Counter(got[tx] for tx in txs)
        assert max(load.values()) <= max(1, math.ceil(len(txs) / N * 1.25))
    # without a limit, every transaction is where it reads fewest from elsewhere
    free = {r.tx: r.node for r in routing.balanced_routes(keys, N, 100.0).collect()}
    for rows in keyed_rows(acc, 20).values():
        at = {}
        for tx in sorted({r["tx"] for r in rows}):
            away = [remote_reads(rows, tx, p, lambda r: at.get((r["tbl"], r["k"]), r["part"])) for p in range(N)]  # noqa: B023
            assert free[tx] == away.index(min(away))
            at.update({(r["tbl"], r["k"]): free[tx] for r in rows if r["tx"] == tx and r["wr"]})
    hot = [{"tx": t, "tbl": "a", "k": 0, "rd": True, "wr": False, "part": 0, "replicated": False} for t in range(8)]
    assert Counter(routing.route_balanced(hot, 4, 0.0).values()) == Counter({0: 2, 1: 2, 2: 2, 3: 2}) and routing.route_balanced(hot, 4, 0.0)[0] == 0


def test_local_first(placed, acc):
    got = {r.tx: (r.node, r.n_remote) for r in routing.local_first(placed, N).collect()}
    for rows in keyed_rows(acc, 1).values():
        tx = rows[0]["tx"]
        away = [remote_reads(rows, tx, p, lambda r: r["part"]) for p in range(N)]
        ties = [p for p in range(N) if away[p] == min(away)]
        assert got[tx] == (ties[tx % len(ties)], min(away))


def test_fusion_table():
    t = routing.FusionTable(2)
    t.set("a", 1)
    t.set("b", 2)
    t.set("c", 3)  # all slots are marked: the hand clears them and takes the first out
    assert t.overflow == {"a": 1} and t.get("b") == 2 and t.get("x") is None and (t.hits, t.misses) == (1, 1) and len(t) == 3
    t.set("a", 0)
    assert t.overflow == {"a": 0} and t.remove("a") == 0 and "a" not in t
    assert t.remove("b") == 2 and t.remove("b") is None
    t.set("d", 1)
    assert not t.overflow and len(t) == 2


def test_fused_routes(placed, acc):
    keys = graph.keyed(placed, graph.batches(placed, 10))
    out = routing.fused_routes(keys, N, size=8).collect()
    route = {r.tx: r.node for r in out if r.k is None}
    assert set(route) == {r[0] for r in acc}
    at, held = {}, {}
    for batch, rows in sorted(keyed_rows(acc, 10).items()):
        moves = [r for r in out if r.batch == batch and r.k is not None]
        written = {(r["tbl"], r["k"]): max(x["tx"] for x in rows if (x["tbl"], x["k"]) == (r["tbl"], r["k"]) and x["wr"]) for r in rows if r["wr"]}
        assert set(written) <= {(m.tbl, m.k) for m in moves}
        for m in moves:
            key, home = (m.tbl, m.k), m.k % N
            assert m.src == at.get(key, home) and m.dest in (home, route[written.get(key, m.tx)])
            at[key] = m.dest
            held[key] = m.dest != home
    assert sum(held.values()) <= 8 + 10 * 7


def test_waits_and_levels(spark, acc):
    df = spark.createDataFrame(acc, SCHEMA)
    locks = conflicts.requests(df).cache()
    mode = {(r.tx, r.tbl, r.k): r.mode for r in locks.collect()}
    waits = conflicts.waits(locks).collect()
    assert sorted(map(tuple, waits)) == sorted(map(tuple, conflicts.waits(locks, rows=25).collect()))
    assert len(waits) <= 2 * len(mode)
    # a lock manager that grants in queue order blocks on the same ones
    before = defaultdict(set)
    for w in waits:
        before[w.tx, w.tbl, w.k].add(w.waits_for)
        assert mode[w.tx, w.tbl, w.k] == w.mode and mode[w.waits_for, w.tbl, w.k] == w.held_mode and w.waits_for < w.tx
    queue = defaultdict(list)
    for (tx, t, k), m in sorted(mode.items()):
        held = queue[t, k]
        last_x = max((x for x, y in held if y == "X"), default=-1)
        shared = {x for x, y in held if y == "S" and x > last_x}
        want = ({last_x} - {-1}) if m == "S" or not shared else shared
        assert before[tx, t, k] == want
        held.append((tx, m))
    places = {(r.tx, r.tbl, r.k): r.position for r in conflicts.queue_positions(locks).collect()}
    assert all(places[x, t, k] == i for (t, k), held in queue.items() for i, (x, _) in enumerate(held, 1))
    batches = graph.batches(df, 15)
    of = {r.tx: r.batch for r in batches.collect()}
    level = {r.tx: r.level for r in conflicts.levels(locks, batches).collect()}
    clash = lambda a, b: any((b, t, k) in mode and "X" in (m, mode[b, t, k]) for (x, t, k), m in mode.items() if x == a)
    for tx in level:
        assert level[tx] == max((level[o] + 1 for o in level if o < tx and of[o] == of[tx] and clash(tx, o)), default=0)
    assert conflicts.lockable("X", [(1, "X")], 1) and not conflicts.lockable("S", [(2, "IX")], 1) and conflicts.lockable("IS", [(2, "SIX")], 1)


def test_marks_and_late_records(spark, tmp_path):
    rng, d = random.Random(3), 3
    order = sorted(range(120), key=lambda t: t + rng.randrange(12))
    commits = spark.createDataFrame(list(enumerate(order)), "n long, tx long")
    got = {r.n: r.mark for r in watermarks.marks(commits, d).collect()}
    mark, ahead, want = [i - d for i in range(d)], set(), {}
    for n, t in enumerate(order):
        ahead.add(t)
        while mark[t % d] + d in ahead:
            mark[t % d] += d
        want[n] = mark[t % d]
    assert got == want
    records = [(rng.randrange(120), rng.randrange(0, 121)) for _ in range(200)]
    fates = watermarks.record_fates(spark.createDataFrame(records, "tx long, at long"), commits, d).collect()
    assert len(fates) == len(records)
    for r in fates:
        seen, m = set(order[: r["at"]]), r.tx % d - d
        while m + d in seen:
            m += d
        assert r.fate == ("dropped" if r.tx <= m else "kept")
    for i in range(6):
        commits.where(f"n >= {i * 20} and n < {i * 20 + 20}").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("n long, tx long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = state.low_water_marks(stream, d).writeStream.format("memory").queryName("marks").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.dispatcher: r.m for r in spark.sql("select dispatcher, max(mark) as m from marks group by dispatcher").collect()} == dict(enumerate(mark))


def moves(spark):
    return spark.createDataFrame([("a", k, k % N, (k % N + 1) % N, k) for k in range(0, 30, 3)], "tbl string, k long, src int, dest int, push_order long")


def test_moving_keys_against_rules(spark, placed, acc):
    going = {("a", k): (k % N, (k % N + 1) % N) for k in range(0, 30, 3)}
    first = {(r.tbl, r.k): r.migrated_tx for r in migration.first_touches(placed, moves(spark), 30, 90).collect()}
    want = {}
    for tx, _, t, k, op in acc:
        if (t, k) in going and 30 <= tx < 90 and op in "RU":
            want[t, k] = min(tx, want.get((t, k), tx))
    assert first == want
    seen = migration.status(placed, moves(spark), migration.first_touches(placed, moves(spark), 30, 90)).cache()
    for how in ("stop_and_copy", "source_only", "crabbing", "caught_up", "on_demand"):
        rows = set()
        for tx, mine in by_tx(acc).items():
            moved = lambda t, k: first.get((t, k), 1 << 60) < tx  # noqa: B023, E731
            way = defaultdict(bool)
            for _, _, t, k, op in mine:
                if (t, k) in going and op in "RU":
                    way[going[t, k]] |= moved(t, k)
            for _, _, t, k, op in mine:
                if t == "r":
                    continue
                home, copied = {k % N}, False
                if (t, k) in going:
                    s, d = going[t, k]
                    fresh = op in "RU" and not moved(t, k)
                    home, copied = {"stop_and_copy": ({d} if moved(t, k) else {s}, False), "source_only": ({s}, False), "crabbing": ({s, d}, fresh), "caught_up": ({s, d} if op == "R" and not moved(t, k) else {d}, fresh), "on_demand": ({d} if way[s, d] else {s}, fresh and way[s, d])}[how]
                    if copied:
                        rows |= {(tx, s, "copy_out", t, k), (tx, d, "copy_in", t, k)}
                for node in range(N) if op == "R" else home:
                    rows.add((tx, node, {"U": "update", "I": "insert", "D": "delete"}.get(op) or ("local_read" if node in home else "remote_read"), t, k))
        assert {tuple(r) for r in migration.analyse(seen, N, how).collect()} == rows, how
    with pytest.raises(ValueError):
        migration.analyse(seen, N, "by magic")


def test_engine_migrates_by_the_configured_way(spark, placed):
    last = placed.where("tx >= 90")
    for way in Migration:
        engine = Engine(spark, Config(migration=way), placement.ModuloPlan(N, ("r",)))
        sets, plan = engine.migrate(placed, moves(spark), 30, 90, 60)
        new = {(r.tx, r.tbl, r.k): r.part for r in plan.place(last.select("tx", "seq", "tbl", "k", "op")).where("not replicated").collect()}
        writes = {(r.tx, r.tbl, r.k): r.node for r in sets.where("kind = 'update' and tx >= 90").collect()}
        assert writes and all(new[x] == node for x, node in writes.items())
        before = {(r.tx, r.node, r.tbl, r.k) for r in sets.where("tx < 30 and kind = 'local_read'").collect()}
        assert before == {(r.tx, r.part, r.tbl, r.k) for r in placed.where("tx < 30 and op = 'R' and not replicated").collect()}
        # on demand, a key is copied only for a transaction that also names a moved one on the same way
        if way != Migration.ON_DEMAND:
            assert (sets.where("kind = 'copy_in'").count() > 0) == (way == Migration.CRABBING)


def test_moves(spark):
    df = lambda rows: spark.createDataFrame([("a", k, i, s, d) for k, i, s, d in rows], "tbl string, k long, step int, src int, dest int")
    got = migration.merge_routes(df([(1, 0, 0, 1), (1, 1, 1, 2), (2, 0, 0, 1), (2, 1, 1, 0), (3, 0, 2, 3)]))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 0, 2), ("a", 3, 2, 3)]
    with pytest.raises(PySparkException, match="don't meet"):
        migration.merge_routes(df([(1, 0, 0, 1), (1, 1, 2, 3)])).collect()
    old = spark.createDataFrame([("a", 1, 9), ("a", 4, 1)], "tbl string, k long, dest int")
    assert sorted(tuple(r) for r in migration.new_overrides(old, got).collect()) == [("a", 1, 2), ("a", 3, 3), ("a", 4, 1)]
    assert [r.plan for r in migration.single_key_plans(got).orderBy("k").collect()] == [0, 1]
    chunk = {r.k: r.chunk for r in migration.chunks(moves(spark), 2).collect()}
    assert chunk[0] == 0 and chunk[12] == 0 and chunk[24] == 1
    log = spark.createDataFrame([(0, "a", 1, "I", 5), (0, "a", 1, "D", 7), (0, "a", 2, "U", 1), (0, "a", 2, "D", 2), (0, "a", 3, "U", 1)], "dest int, tbl string, k long, op string, tx long")
    assert {r.k: r.op for r in migration.handover(log).collect()} == {1: "I", 2: "D", 3: "U"}
    assert {r.k: r.op for r in migration.last_handover(log).collect()} == {1: "D", 2: "D", 3: "U"}
    keys = spark.createDataFrame([(0, 1, "a", 1), (0, 1, "a", 2), (1, 2, "a", 3)], "src int, dest int, tbl string, k long")
    assert sorted(r.k for r in migration.remaining(keys, keys.where("k = 1")).collect()) == [1, 3]
    ranges = spark.createDataFrame([("a", 1, 0, 1, 0), ("a", 1, 2, 3, 1)], "tbl string, k long, src int, dest int, range_no int")
    assert migration.containing_range(spark.createDataFrame([("a", 1), ("b", 1)], "tbl string, k long"), ranges).orderBy("tbl").collect() == [("a", 1, 0, 1), ("b", 1, None, None)]
    done = spark.createDataFrame([(9, 2, 3), (4, 0, 1)], "finish_tx long, src int, dest int")
    assert [tuple(r) for r in migration.ranges_left(ranges, done).orderBy("finish_tx").collect()] == [(4, 1), (9, 0)]
    assert [r.phase for r in migration.phase_at(spark.range(4).withColumnRenamed("id", "tx"), [(1, "crabbing"), (3, "caught_up")]).orderBy("tx").collect()] == ["normal", "crabbing", "crabbing", "caught_up"]


def test_both_graphs_give_the_same_plan(spark, tmp_path):
    rng = random.Random(8)
    rows = [(tx, 0, "a", rng.choice([rng.randrange(0, 40, 4), rng.randrange(40)]), "R") for tx in range(250)]
    rows += [(tx, 1, "a", rng.randrange(40), rng.choice("RU")) for tx in range(0, 250, 12)]
    placed = placement.ModuloPlan(N).place(spark.createDataFrame(list(dict.fromkeys(rows)), SCHEMA)).cache()
    vertices, edges = repartition.heat_vertices(placed).cache(), repartition.heat_edges(placed).cache()
    plan = lambda **o: sorted(tuple(r) for r in repartition.plan_moves(vertices, edges, N, overload=1.1, clump_size=3, most_clumps=4, **o).collect())
    here = plan()
    assert here and here == plan(driver_edges=0)
    heat = {r.part: r.total_load for r in repartition.partition_heat(vertices, edges, N).collect()}
    moved = vertices.join(spark.createDataFrame(here, "v string, src int, dest int"), "v", "left").select("v", F.coalesce("dest", "part").alias("part"), "weight")
    after = {r.part: r.total_load for r in repartition.partition_heat(moved, edges, N).collect()}
    assert max(after.values()) < max(heat.values())
    graphs.save(vertices, edges, f"{tmp_path}/g")
    v, e = graphs.load(spark, f"{tmp_path}/g")
    assert (v.count(), e.count()) == (vertices.count(), edges.count())
    lines = repartition.metis_lines(vertices, edges)
    graphs.write_lines(lines, f"{tmp_path}/metis")
    text = [r.value for r in spark.read.text(f"{tmp_path}/metis").collect()]
    head = next(x for x in text if x.endswith("011")).split()
    assert int(head[0]) == vertices.count() == len(text) - 1 and int(head[1]) * 2 == edges.count()
    assert sum(len(x.split()) // 2 for x in text if not x.endswith(" 011")) == edges.count()


def toy(pid):
    declare = lambda log: log.select("tx", F.lit(0).alias("seq"), F.lit("t").alias("tbl"), F.col("conn_id").alias("k"), F.explode(F.array(F.lit("R"), F.lit("U"))).alias("op"))
    change = lambda log, values: log.select(F.lit("t").alias("tbl"), F.col("conn_id").alias("k"), "tx", F.lit("U").alias("op"), F.col("tx").cast("double").alias("value"))
    return Procedure(pid, declare, change, lambda log: log.where("tx % 10 = 3").select("tx"))


def test_engine_in_batches_and_as_a_stream(spark, tmp_path):
    calls = spark.range(60).select((F.col("id") * 3 % 60).alias("at"), F.lit(0).alias("client_id"), (F.col("id") % 7).alias("conn_id"), F.when(F.col("id") == 5, requests.NO_OPERATION).otherwise(1).alias("pid"), F.create_map(F.lit("a"), F.lit("b")).alias("params"))
    log = requests.number_requests(calls, "at").select(*requests.REQUESTS.names).cache()
    assert sorted(r.tx for r in log.collect()) == list(range(60))
    values = spark.createDataFrame([("t", k, 0.0) for k in range(5)], "tbl string, k long, value double")
    engine = Engine(spark, Config(service=Service.READ_WRITE_SETS)).register(toy(1))
    with pytest.raises(ValueError):
        engine.register(toy(1))
    out = engine.run(log, values)
    table = {r.k: r.value for r in out.table.collect()}
    rows = [r for r in log.orderBy("tx").collect() if r.pid == 1]
    want = {k: 0.0 for k in range(5)} | {r.conn_id: float(r.tx) for r in rows if r.tx % 10 != 3}
    assert table == want and out.outcomes.where("not committed").count() == sum(r.tx % 10 == 3 for r in rows)
    for service in Service:
        routes = engine.with_config(service=service).run(log, values).routes.collect()
        assert len(routes) == len(rows) and all(0 <= r.node < 4 for r in routes)
        if service in (Service.READ_WRITE_SETS, Service.LOCAL_FIRST):
            assert all(r.node == next(x.conn_id for x in rows if x.tx == r.tx) % 4 for r in routes)
    with pytest.raises(ValueError, match="no procedure 1"):
        Engine(spark).accesses(log)
    for i in range(3):
        requests.write_log(log.where(f"tx >= {i * 20} and tx < {i * 20 + 20}").coalesce(1), f"{tmp_path}/log")
    assert requests.read_log(spark, f"{tmp_path}/log").count() == 60
    held = state.StateTable(values, f"{tmp_path}/state", ["tbl", "k"])
    stream = requests.stream_log(spark, f"{tmp_path}/log")
    changes = lambda batch: toy(1).change(batch.where(f"pid = 1 and tx % 10 <> 3"), None)  # noqa: E731, F541
    held.follow(stream, changes, f"{tmp_path}/checkpoints").awaitTermination()
    assert held.last() == 2 and {r.k: r.value for r in held.read().collect()} == want
    held.apply(changes(log.where("tx >= 40")), 2)  # a batch run again changes nothing
    assert {r.k: r.value for r in held.read().collect()} == want


def test_streamed_responses(spark, tmp_path):
    rows = [(0, 1, tx, True, node) for tx in range(30) for node in range(N)]
    for i in range(3):
        part = [r for r in rows if r[2] // 10 == i or (i and r[2] == 10 * i - 1)]  # a late duplicate each
        spark.createDataFrame(part, "client_id int, rte_id long, tx long, committed boolean, node int").coalesce(1).write.parquet(f"{tmp_path}/r/{i}")
    stream = spark.readStream.schema("client_id int, rte_id long, tx long, committed boolean, node int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/r")
    state.accepted_responses(stream).writeStream.format("memory").queryName("answers").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.table("answers").collect())
    assert got == sorted((0, 1, tx, True, 0) for tx in range(30))
    both = fold.accepted_responses(spark.createDataFrame(rows, "client_id int, rte_id long, tx long, committed boolean, node int"))
    assert both.count() == 30
