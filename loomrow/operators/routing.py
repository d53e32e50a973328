"""Where each transaction runs.

The local-first rule looks at a transaction alone and is plain aggregation. The
batch rules place transactions one after another, each seeing where earlier
writers of its batch lie: batches are independent, so they are dealt over all
tasks. The fused rules carry the places of written records from batch to batch:
that is one state machine over the total order, one task a log; its table is of
a fixed size, with what leaves it until the next batch.
"""

from __future__ import annotations

import marshal
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrow.functions.keys import truncated
from loomrow.operators.frames import parallelism


def _least_remote(counts: list[Column], n: int) -> Column:
    own = F.array(*counts)
    ties = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.when(F.get(own, p) == F.array_max(own), p)), lambda p: p.isNotNull())
    return F.get(ties, (F.col("tx") % F.size(ties)).cast("int"))


def local_first(placed: DataFrame, n: int) -> DataFrame:
    """tx, node, n_remote: the partition with fewest remote reads; of ties the one numbered tx modulo their count."""
    read = F.expr("op = 'R' and not replicated")
    keys = placed.groupBy("tx", "tbl", "k").agg(F.max(F.when(read, F.col("part"))).alias("part"), F.max(read).alias("rd"))
    counts = keys.groupBy("tx").agg(F.count(F.when(F.col("rd"), 1)).alias("total"), *(F.count(F.when(F.col("rd") & (F.col("part") == p), 1)).alias(f"p{p}") for p in range(n)))
    own = [F.col(f"p{p}") for p in range(n)]
    return counts.select("tx", _least_remote(own, n).alias("node"), (F.col("total") - F.array_max(F.array(*own))).alias("n_remote"))


def routed_locally(keys: DataFrame, n: int) -> DataFrame:
    """Keys of graph.keyed with node, their transaction's route by local_first."""
    by = Window.partitionBy("tx")
    read = F.col("rd") & ~F.col("replicated")
    counts = keys.withColumns({f"p{p}": F.count(F.when(read & (F.col("part") == p), 1)).over(by) for p in range(n)})
    return counts.select(*keys.columns, _least_remote([F.col(f"p{p}") for p in range(n)], n).alias("node"))


def _few(rows: list[dict]) -> list[tuple]:
    """Transactions of one batch in order: number, reads (key, owner), written keys, weight."""
    txs: dict[int, list[dict]] = {}
    for r in rows:
        txs.setdefault(r["tx"], []).append(r)
    key = lambda r: (r["tbl"], r["k"])
    return [(tx, [(key(r), r["part"]) for r in mine if r["rd"] and not r["replicated"]], [key(r) for r in mine if r["wr"]], mine[0].get("weight")) for tx, mine in sorted(txs.items())]


def _by_cost(txs: list[tuple], n: int, beta: float) -> list[int]:
    writer: dict[object, int] = {}
    route: list[int] = []
    load = [0.0] * n
    for tx, reads, writes, weight in txs:
        near = Counter(route[writer[key]] if key in writer else part for key, part in reads)
        away = [len(reads) - near[p] for p in range(n)]
        if beta == 1 and weight is None:  # loads don't count
            costs = away
        else:
            costs = [truncated((load[p] + (weight or 1.0)) * (1 - beta) + away[p] * beta) for p in range(n)]
        best = costs.index(min(costs))
        route.append(best)
        load[best] += weight or 1.0
        for key in writes:
            writer[key] = len(route) - 1
    return route


def route_by_cost(rows: list[dict], n: int, beta: float = 1.0) -> dict[int, int]:
    """Partition of each transaction of one batch: least (1 - beta) * load + beta * remote reads, cut after 4 decimals; the lowest of equals."""
    txs = _few(rows)
    return dict(zip((x[0] for x in txs), _by_cost(txs, n, beta), strict=True))


class _Balance:
    """The transactions of one batch, placed one after another and then moved away from overloaded partitions."""

    def __init__(self, n: int):
        self.n, self.load, self.route = n, [0] * n, []
        self.writer: dict[object, int] = {}
        #: Of each transaction: reads that stay where they are, by partition and all, and the writers of the others; who reads what it writes.
        self.fixed: list[list[int]] = []
        self.total: list[int] = []
        self.behind: list[list[int]] = []
        self.readers: dict[int, list[int]] = {}

    def place(self, fixed: list[int], total: int, behind: list[int], writes: Iterable) -> None:
        i, near = len(self.route), fixed
        if behind:
            near = fixed[:]
            for w in behind:
                near[self.route[w]] += 1
                self.readers.setdefault(w, []).append(i)
        best = near.index(max(near))
        self.route.append(best)
        self.load[best] += 1
        self.fixed.append(fixed)
        self.total.append(total)
        self.behind.append(behind)
        for key in writes:
            self.writer[key] = i

    def _edges(self, i: int, p: int) -> int:
        route = self.route
        return self.total[i] - self.fixed[i][p] + sum(route[w] != p for w in self.behind[i]) + sum(route[t] != p for t in self.readers.get(i, ()))

    def balanced(self, tolerance: float) -> list[int]:
        n, load, route = self.n, self.load, self.route
        most = max(1, math.ceil(len(route) / n * (1 + tolerance)))
        over = {p for p in range(n) if load[p] > most}
        if not over:
            return route
        waiting = [i for i in reversed(range(len(route))) if route[i] in over]
        allowed = 1
        while over:
            left = []
            for i in waiting:
                here = route[i]
                if here not in over:
                    continue
                now = self._edges(i, here)
                # growth, load and number decide; a partition with the load of this one is no better
                open_ = [(self._edges(i, p) - now, load[p], p) for p in range(n) if p != here and load[p] < most]
                best = min((x for x in open_ if x[0] <= allowed), default=None)
                if best is None:
                    left.append(i)
                    continue
                route[i] = best[2]
                load[here] -= 1
                load[best[2]] += 1
                if load[here] == most:
                    over.discard(here)
                if not over:
                    break
            waiting = left
            allowed += 1
            if allowed > 100 and over:
                raise RuntimeError("a batch can't be balanced")
        return route


def _balanced(txs: list[tuple], n: int, tolerance: float, home: Callable[[object], int] | None = None) -> list[int]:
    state = _Balance(n)
    writer = state.writer
    for _, reads, writes, _ in txs:
        fixed, behind = [0] * n, []
        for key, part in reads:
            w = writer.get(key)
            if w is not None:
                behind.append(w)
                continue
            at = part if home is None else home(key)
            if at is not None and 0 <= at < n:
                fixed[at] += 1
        state.place(fixed, len(reads) - len(behind), behind, writes)
    return state.balanced(tolerance)


def route_balanced(rows: list[dict], n: int, tolerance: float = 0.25, home: Callable[[tuple], int] | None = None) -> dict[int, int]:
    """Partition of each transaction of one batch: fewest remote reads (the lowest of equals), then moves away from overloaded ones.

    A partition is overloaded beyond ceil(batch / n * (1 + tolerance)), 1 at
    least. Later transactions move first, to a partition that is neither
    overloaded nor full, with the least growth of remote edges (reads, and what
    later ones read of its writes), the less loaded of equals. Growth of 1 is
    allowed in the first pass, one more in each next.
    """
    txs = _few(rows)
    return dict(zip((x[0] for x in txs), _balanced(txs, n, tolerance, home), strict=True))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, 8192):
            part = batch.slice(low, 8192)
            yield from zip(*(part.column(c).to_pylist() for c in names), strict=True)


def _by_batch(keys: DataFrame, rule: Callable[[list[tuple]], list[int]]) -> DataFrame:
    weighted = "weight" in keys.columns
    names = ["batch", "tx", "tbl", "k", "rd", "wr", "part", "replicated", *["weight"] * weighted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        made = lambda: pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["batch", "tx", "node"])
        for batch, rows in groupby(_rows(batches, names), key=itemgetter(0)):
            txs, last = [], None
            for _, tx, tbl, k, rd, wr, part, replicated, *weight in rows:
                if tx != last:
                    reads, writes, last = [], [], tx
                    txs.append((tx, reads, writes, weight[0] if weight else None))
                if rd and not replicated:
                    reads.append(((tbl, k), part))
                if wr:
                    writes.append((tbl, k))
            out[0].extend([batch] * len(txs))
            out[1].extend(x[0] for x in txs)
            out[2].extend(rule(txs))
            if len(out[0]) > 8192:
                yield made()
                out = ([], [], [])
        if out[0]:
            yield made()

    dealt = keys.select(*names).repartition(parallelism(keys.sparkSession), "batch").sortWithinPartitions("batch", "tx", "tbl", "k")
    return dealt.mapInArrow(run, "batch bigint, tx bigint, node int")


def cost_routes(keys: DataFrame, n: int, beta: float = 1.0) -> DataFrame:
    """batch, tx, node by route_by_cost for keys of graph.keyed (weight optional)."""
    return _by_batch(keys, lambda txs: _by_cost(txs, n, beta))


def balanced_routes(keys: DataFrame, n: int, tolerance: float = 0.25) -> DataFrame:
    """batch, tx, node by route_balanced for keys of graph.keyed."""
    return _by_batch(keys, lambda txs: _balanced(txs, n, tolerance))


class FusionTable:
    """Places of the records that were written last, at most `size`; what a clock hand takes out waits to go home."""

    def __init__(self, size: int = 100_000):
        self.size, self.slots, self.at, self.free, self.hand = size, [], {}, [], 0
        self.overflow: dict[tuple, int] = {}
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return len(self.at) + len(self.overflow)

    def __contains__(self, key: tuple) -> bool:
        return key in self.at or key in self.overflow

    def peek(self, key: tuple) -> int | None:
        """The key's partition, None if it isn't held; leaves marks and counts alone."""
        return self.slots[self.at[key]][1] if key in self.at else self.overflow.get(key)

    def get(self, key: tuple) -> int | None:
        """The key's partition; marks the slot as used and counts the hit or miss."""
        found = self.peek(key)
        self.hits += found is not None
        self.misses += found is None
        if key in self.at:
            self.slots[self.at[key]][2] = True
        return found

    def set(self, key: tuple, part: int) -> None:
        if key in self.at:
            self.slots[self.at[key]][1:] = [part, True]
        elif key in self.overflow:
            self.overflow[key] = part
        else:
            slot = self._slot()
            self.slots[slot], self.at[key] = [key, part, True], slot

    def _slot(self) -> int:
        if self.free:
            return self.free.pop()
        if len(self.slots) < self.size:
            self.slots.append(None)
            return len(self.slots) - 1
        while self.slots[self.hand][2]:
            self.slots[self.hand][2] = False
            self.hand = (self.hand + 1) % self.size
        slot, self.hand = self.hand, (self.hand + 1) % self.size
        key, part, _ = self.slots[slot]
        del self.at[key]
        self.overflow[key] = part
        return slot

    def remove(self, key: tuple) -> int | None:
        """Takes the key out; its partition, None if it wasn't held."""
        if key in self.at:
            slot = self.at.pop(key)
            part = self.slots[slot][1]
            self.slots[slot] = [None, None, False]
            self.free.append(slot)
            return part
        return self.overflow.pop(key, None)


def fused_step(table: FusionTable, rows: list[dict], n: int, rule: str, tolerance: float = 0.25) -> tuple[dict[int, int], list[dict]]:
    """Routes one batch and moves the places on: routes, and where each written or overflowed key goes.

    rule is "balanced" (a batch) or "local_first" (a transaction alone, ties by
    its number). Overflowed keys go to their owner, by the last writer in the
    batch or else by its last transaction; every other written key stays where
    its last writer ran. Rows have every owner in part, for overflowed keys in
    table.owner.
    """
    txs: dict[int, list[dict]] = {}
    for r in rows:
        txs.setdefault(r["tx"], []).append(r)
    owner = {(r["tbl"], r["k"]): r["part"] for r in rows}
    owners = table.__dict__.setdefault("owner", {})
    owners.update(owner)

    def home(key: tuple) -> int:
        at = table.get(key)
        return owners[key] if at is None else at

    if rule == "balanced":
        route = route_balanced(rows, n, tolerance, home)
    else:
        route = {}
        for tx in sorted(txs):
            at = Counter(home((r["tbl"], r["k"])) for r in txs[tx] if r["rd"] and not r["replicated"])
            away = [at.total() - at[p] for p in range(n)]
            ties = [p for p in range(n) if away[p] == min(away)]
            route[tx] = ties[tx % len(ties)]
    last: dict[tuple, int] = {}
    for tx in sorted(txs):
        last.update({(r["tbl"], r["k"]): tx for r in txs[tx] if r["wr"]})
    moves = []
    final = max(txs)
    for key in sorted(table.overflow):
        moves.append((key, last.pop(key, final), owners[key]))
    moves += [(key, tx, route[tx]) for key, tx in sorted(last.items())]
    out = []
    for key, tx, dest in moves:
        was, home_of = table.get(key), owners[key]
        now = home_of if was is None else was
        out.append({"tx": tx, "tbl": key[0], "k": key[1], "src": now, "dest": dest, "cache_insert": now != dest and dest != home_of, "cache_delete": now != dest and now != home_of})
        if now != dest and dest == home_of and key in table:
            table.remove(key)
        elif now != dest:
            table.set(key, dest)
    for key in {*owner, *(m[0] for m in moves)}:
        if key not in table:
            owners.pop(key, None)
    return route, out


#: Rows of keys that are handed to the state machine as one value.
_HANDED = 500


def _value(x: list) -> bytes:
    return zlib.compress(marshal.dumps(x, 2), 1)


def _of_value(data: bytes) -> list:
    return marshal.loads(zlib.decompress(data))


def _packed(batches: Iterator[pa.RecordBatch], n: int, tables: dict[str, tuple[int, bool]], low: int, span: int) -> Iterator[pa.RecordBatch]:
    """log, first, data: some batches of a log as one value, with all that doesn't depend on the table done.

    A transaction is its number, the reads that no write can move, by partition
    and all of them, the other reads, its writes, and other keys it names; keys
    are numbers in the order of table and key, each followed by its owner.
    """
    names = ["the log", "batch", "tx", "tbl", "k", "rd", "wr", "part", "replicated"]
    log = first = last = at = None
    held: list[tuple] = []
    size = 0
    made = lambda: pa.RecordBatch.from_pydict({"log": [log], "first": [first], "data": [_value(held)]}, pa.schema([("log", pa.string()), ("first", pa.int64()), ("data", pa.binary())]))
    for of, batch, tx, tbl, k, rd, wr, part, replicated in _rows(batches, names):
        if batch != last or of != log:
            if held and (size > _HANDED or of != log):
                yield made()
                held, size = [], 0
            if not held:
                first = batch
            log, last, at = of, batch, None
            txs: list[tuple] = []
            held.append((batch, txs))
        if tx != at:
            at, fixed, moving, writes, others = tx, [0] * (n + 1), [], [], []
            txs.append((tx, fixed, moving, writes, others))
        size += 1
        t, written = tables[tbl]
        key = t * span + k - low
        if rd and not replicated:
            if written:
                moving += (key, part)
            else:
                fixed[n] += 1
                if part is not None and 0 <= part < n:
                    fixed[part] += 1
        elif not wr and written:
            others += (key, part)
        if wr:
            writes += (key, part)
    if held:
        yield made()


def _stepped(batches: Iterator[pa.RecordBatch], n: int, rule: str, size: int, tolerance: float) -> Iterator[pa.RecordBatch]:
    """What fused_step gives, over rows of _packed in order: data has of each batch its routes and moves."""
    last_log, at = object(), {}
    for data in batches:
        out = []
        for log, first, packed in zip(*(c.to_pylist() for c in data.columns), strict=True):
            if log != last_log:
                table, last_log = FusionTable(size), log
                at, slots, overflow = table.at, table.slots, table.overflow
                owners: dict[int, int] = {}
            done = []
            for batch, txs in _of_value(packed):
                last: dict[int, int] = {}
                route: list[int] = []
                state = _Balance(n)
                writer = state.writer if rule == "balanced" else {}
                homes: dict[int, int] = {}
                for i, (tx, fixed, moving, writes, others) in enumerate(txs):
                    total, behind = fixed.pop(), []
                    for j in range(0, len(moving), 2):
                        key = moving[j]
                        if (w := writer.get(key)) is not None:
                            behind.append(w)
                            continue
                        if (slot := at.get(key)) is not None:
                            held = slots[slot]
                            held[2] = True
                            p, owners[key] = held[1], moving[j + 1]
                        elif overflow and key in overflow:
                            p, owners[key] = overflow[key], moving[j + 1]
                        else:
                            p = moving[j + 1]
                        total += 1
                        if p is not None and 0 <= p < n:
                            fixed[p] += 1
                    for j in range(0, len(others), 2):
                        if others[j] in owners:
                            owners[others[j]] = others[j + 1]
                    for j in range(0, len(writes), 2):
                        last[writes[j]], homes[writes[j]] = i, writes[j + 1]
                    if rule == "balanced":
                        state.place(fixed, total, behind, writes[::2])
                    else:
                        most = max(fixed)
                        ties = [p for p in range(n) if fixed[p] == most]
                        route.append(ties[tx % len(ties)])
                if rule == "balanced":
                    route = state.balanced(tolerance)
                owners.update(homes)
                moves = [(key, last.pop(key, len(txs) - 1), owners[key]) for key in sorted(overflow)] if overflow else []
                moves += [(key, i, route[i]) for key, i in sorted(last.items())]
                gone, moved = [], []
                for key, i, dest in moves:
                    home = owners[key]
                    if (slot := at.get(key)) is not None:
                        held = slots[slot]
                        held[2] = True
                        now = held[1]
                    else:
                        now = overflow.get(key, home) if overflow else home
                    moved += (i, key, now, dest, home)
                    if now != dest:
                        if dest != home:
                            table.set(key, dest)
                        else:
                            table.remove(key)
                    if key not in at and key not in overflow:
                        gone.append(key)
                for key in gone:
                    if key not in at and key not in overflow:
                        owners.pop(key, None)
                done.append((batch, [x[0] for x in txs], route, moved))
            out.append((log, first, _value(done)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["log", "first", "data"])


_FUSED = "batch bigint, tx bigint, node int, tbl string, k bigint, src int, dest int, cache_insert boolean, cache_delete boolean"


def _spread_out(batches: Iterator[pa.RecordBatch], tables: list[str], low: int, span: int) -> Iterator[pa.RecordBatch]:
    """Rows of fused_routes out of what _stepped hands on."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    none = (None,) * 6
    for data in batches:
        for packed in data.column("data"):
            rows = []
            for batch, txs, route, moved in _of_value(packed.as_py()):
                rows += [(batch, tx, node, *none) for tx, node in zip(txs, route, strict=True)]
                for j in range(0, len(moved), 5):
                    i, key, now, dest, home = moved[j : j + 5]
                    t, k = divmod(key, span)
                    rows.append((batch, txs[i], route[i], tables[t], k + low, now, dest, now != dest and dest != home, now != dest and now != home))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _FUSED.split(", ")])


def fused_routes(keys: DataFrame, n: int, *, rule: str = "balanced", size: int = 100_000, tolerance: float = 0.25, log: str | None = None) -> DataFrame:
    """batch, tx, node, tbl, k, src, dest, cache_insert, cache_delete: routes with a fusion table, and the moves of keys (null keys: the route alone).

    The batches of a log (all rows, or those of one value of the column log)
    are stepped through in order by one task, as fused_step does. Reading the
    rows, and making rows of what comes out, is dealt over all tasks; that task
    has only the keys that some transaction writes to look up. Keys are read
    several times. Null keys are an error.
    """
    spark = keys.sparkSession
    rows = keys.select((F.col(log).cast("string") if log else F.lit("")).alias("the log"), "batch", "tx", "tbl", "k", "rd", "wr", "part", "replicated")
    found = sorted(rows.groupBy("tbl").agg(F.max("wr").alias("wr"), F.min("k").alias("low"), F.max("k").alias("high")).collect())
    low = min((r.low for r in found), default=0)
    span = max((r.high for r in found), default=0) - low + 1
    tables = {r.tbl: (i, r.wr) for i, r in enumerate(found)}
    dealt = rows.repartitionByRange(parallelism(spark), "the log", "batch").sortWithinPartitions("the log", "batch", "tx", "tbl", "k")
    packed = dealt.mapInArrow(lambda x: _packed(x, n, tables, low, span), "log string, first bigint, data binary")
    ordered = packed.repartition(parallelism(spark), "log").sortWithinPartitions("log", "first")
    stepped = ordered.mapInArrow(lambda x: _stepped(x, n, rule, size, tolerance), "log string, first bigint, data binary")
    return stepped.repartition(parallelism(spark), "log", "first").mapInArrow(lambda x: _spread_out(x, list(tables), low, span), _FUSED)


def by_range(keys: DataFrame, single: int, width: int) -> DataFrame:
    """Adds node for numbers from 1: the first `single` have a partition each, later ones go `width` to one."""
    k = F.col("k")
    return keys.withColumn("node", F.when(k <= single, k - 1).otherwise(F.floor((k - 1) / width)).cast("int"))
