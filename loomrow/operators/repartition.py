"""Finding a better placement from what transactions access together.

The heat graph has vertices (v, part, weight), one for each partitioning key,
and edges (src, dst, weight) for ordered pairs of keys in one transaction. Keys
are texts table:key, so ties are decided by them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrow.operators import incidence, pairs
from loomrow.operators.frames import checkpoint, numbered

#: Edges of a graph that the driver plans on by itself; larger ones stay tables.
DRIVER_EDGES = 2_000_000


def vertex_key() -> F.Column:
    return F.concat_ws(":", "tbl", F.col("k").cast("string"))


def _named(placed: DataFrame) -> DataFrame:
    """tx, tbl, k, part, n: how often a transaction names a key: as read, and as written."""
    write = F.col("op") != "R"
    flags = placed.where("not replicated").groupBy("tx", "tbl", "k", "part").agg(F.max(write).alias("w"), F.max(~write).alias("r"), F.max(write.isNull()).alias("x"))
    n = sum((F.coalesce(F.col(c), F.lit(False)).cast("long") for c in ("w", "r")), F.col("x").cast("long"))
    return flags.select("tx", "tbl", "k", "part", n.alias("n"))


def occurrences(placed: DataFrame) -> DataFrame:
    """tx, v, part, n: how often a transaction names a key: as read, and as written."""
    return _named(placed).select("tx", vertex_key().alias("v"), "part", "n")


def heat_vertices(placed: DataFrame) -> DataFrame:
    """v, part, weight: accesses of every key; a read and a write of one transaction count both."""
    return occurrences(placed).groupBy("v").agg(F.first("part").alias("part"), F.sum("n").alias("weight"))


def _texts(names: list[str], t: np.ndarray, k: np.ndarray) -> pa.Array:
    """Keys as texts: a name that begins with + goes before its number, others stand alone."""
    number = pc.if_else(pa.array(np.array([x[0] == "+" for x in names])[t]), pa.array(k).cast(pa.string()), "")
    return pc.binary_join_element_wise(pa.array([x[1:] for x in names]).take(pa.array(t)), number, "")


def heat_edges(placed: DataFrame) -> DataFrame:
    """src, dst, weight: ordered pairs of distinct keys of a transaction; repeated keys multiply. Transactions have few keys."""
    before = F.when(F.col("k").isNull(), F.concat(F.lit("-"), F.coalesce("tbl", F.lit("")))).otherwise(F.concat(F.lit("+"), F.coalesce(F.concat("tbl", F.lit(":")), F.lit(""))))
    own = _named(placed).select("tx", before.alias("t"), F.coalesce("k", F.lit(0)).cast("long").alias("k"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, found in pairs.summed(batches):
            for low in range(0, len(found[0]), 1 << 16):
                at, ak, bt, bk, w = (x[low : low + (1 << 16)] for x in found)
                yield pa.RecordBatch.from_arrays([_texts(names, at, ak), _texts(names, bt, bk), pa.array(w)], names=["src", "dst", "weight"])

    return pairs.bucketed(own).mapInArrow(run, "src string, dst string, weight long")


def edges_from(members: DataFrame, placed: DataFrame) -> DataFrame:
    """src, dst, weight: the edges that leave some keys (column v), from the transactions that name them."""
    own = occurrences(placed).select("tx", "v", "n")
    ours = own.join(F.broadcast(members.select("v")), "v").select("tx", F.col("v").alias("src"), F.col("n").alias("m"))
    return ours.join(own, "tx").where("src <> v").groupBy("src", F.col("v").alias("dst")).agg(F.sum(F.col("n") * F.col("m")).alias("weight"))


def placed_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the parts of both ends."""
    at = lambda c: vertices.select(F.col("v").alias(c), F.col("part").alias(f"{c}_part"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", "weight", "src_part", "dst_part")


def partition_heat(vertices: DataFrame, edges: DataFrame, n: int, cost: float = 1.0) -> DataFrame:
    """part, local_load, cross_load, total_load for every partition; vertices on others than the n are left out."""
    local = vertices.groupBy("part").agg(F.sum("weight").alias("l"))
    cross = placed_edges(vertices, edges).where("src_part <> dst_part").groupBy(F.col("src_part").alias("part")).agg(F.sum("weight").alias("c"))
    every = vertices.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))
    out = every.join(local, "part", "left").join(cross, "part", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return out.select("part", zero("l").alias("local_load"), zero("c").alias("cross_load"), (zero("l") + F.lit(float(cost)) * zero("c")).alias("total_load"))


def partition_loads(placed: DataFrame, n: int, cost: float = 1.0) -> DataFrame:
    """What partition_heat gives for the graph of placed, without its edges.

    A transaction that names W keys, W_p of them on p, adds W_p * (W - W_p) to
    p's edges that cross: two aggregates, whatever the number of pairs.
    """
    own = occurrences(placed).groupBy("tx", "part").agg(F.sum("n").alias("w"))
    totals = own.groupBy("tx").agg(F.sum("w").alias("all"), F.collect_list(F.struct("part", "w")).alias("parts"))
    each = totals.select("all", F.inline("parts")).groupBy("part").agg(F.sum("w").alias("l"), F.sum(F.col("w") * (F.col("all") - F.col("w"))).alias("c"))
    every = placed.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return every.join(F.broadcast(each), "part", "left").select("part", zero("l").alias("local_load"), zero("c").alias("cross_load"), (zero("l") + F.lit(float(cost)) * zero("c")).alias("total_load"))


def overload_threshold(heat: DataFrame, factor: float = 1.3) -> DataFrame:
    """threshold and overloaded: the mean load times factor, and the first partition above it (null: none)."""
    mean = heat.agg((F.avg("total_load") * factor).alias("threshold"))
    return heat.crossJoin(F.broadcast(mean)).groupBy("threshold").agg(F.min(F.when(F.col("total_load") > F.col("threshold"), F.col("part"))).alias("overloaded"))


def hottest_vertices(vertices: DataFrame, k: int = 1) -> DataFrame:
    """part, rank, v, weight: the k heaviest vertices of each partition, ties by key; all, if fewer."""
    by = Window.partitionBy("part").orderBy(F.desc("weight"), "v")
    return vertices.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("part", "rank", "v", "weight")


def first_destination(vertex: DataFrame, vertices: DataFrame, edges: DataFrame, heat: DataFrame) -> DataFrame:
    """v, dest: for each row of vertex (v, part) the other partition with most edges to it, else the least loaded other one."""
    near = edges.join(vertex.select(F.col("v").alias("src"), F.col("part").alias("own")), "src").join(vertices.select(F.col("v").alias("dst"), F.col("part").alias("to")), "dst").where("to <> own").groupBy(F.col("src").alias("v"), "to").agg(F.count(F.lit(1)).alias("n"))
    most = near.groupBy("v").agg(F.min_by("to", F.struct(-F.col("n"), "to")).alias("near"))
    rest = vertex.select("v", F.col("part").alias("own")).join(F.broadcast(heat), F.col("own") != F.col("part")).groupBy("v").agg(F.min_by("part", F.struct("total_load", "part")).alias("least"))
    return vertex.select("v").join(most, "v", "left").join(rest, "v", "left").select("v", F.coalesce("near", "least").alias("dest"))


def receive_delta(members: DataFrame, vertices: DataFrame, edges: DataFrame, n: int, cost: float = 1.0) -> DataFrame:
    """dest, delta: the load that each partition gains by receiving a clump (column v)."""
    mine = members.select("v").join(vertices, "v")
    out = edges.join(mine.select(F.col("v").alias("src"), F.col("part").alias("src_part")), "src").join(vertices.select(F.col("v").alias("dst"), F.col("part").alias("dst_part")), "dst").join(members.select(F.col("v").alias("dst"), F.lit(True).alias("inside")), "dst", "left")
    every = vertices.sparkSession.range(n).select(F.col("id").cast("int").alias("dest"))
    ours = mine.groupBy("part").agg(F.sum("weight").alias("w"))
    gained = every.join(F.broadcast(ours), F.col("part") != F.col("dest")).groupBy("dest").agg(F.sum("w").alias("gained"))
    ends = out.groupBy("src_part", "dst_part", F.coalesce("inside", F.lit(False)).alias("inside")).agg(F.sum("weight").alias("w"))
    sign = F.when(F.col("dst_part") == F.col("dest"), -F.col("w")).when(F.col("inside"), 0).otherwise(F.col("w"))
    crossed = every.join(F.broadcast(ends), F.col("src_part") != F.col("dest")).groupBy("dest").agg(F.sum(sign).alias("crossed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return every.join(gained, "dest", "left").join(crossed, "dest", "left").select("dest", (zero("gained") + F.lit(float(cost)) * zero("crossed")).alias("delta"))


def metis_vertices(vertices: DataFrame) -> DataFrame:
    """v, weight, id: the number of every vertex in the METIS form, from 1 by key (its number, then its text)."""
    number = F.coalesce(F.substring_index("v", ":", -1).try_cast("long"), F.lit(0))
    return numbered(vertices.withColumn("order", number), "order", "id", ties=("v",)).select("v", "weight", (F.col("id") + 1).alias("id"))


def metis_partition(vertices: DataFrame, found: DataFrame) -> DataFrame:
    """v, src, dest: the moves that a METIS result asks for; found has the line's number (from 1) and its part."""
    both = metis_vertices(vertices).join(found.select(F.col("line_no").alias("id"), F.col("part").cast("int").alias("dest")), "id")
    return both.join(vertices.select("v", F.col("part").cast("int").alias("src")), "v").where("src <> dest").select("v", "src", "dest")


def metis_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """line_no, line: the graph in METIS form, vertices numbered from 1 by key (its number, then its text); each line has a weight, then neighbours with edge weights."""
    spark = vertices.sparkSession
    ids = checkpoint(metis_vertices(vertices))
    ends = edges.join(ids.select(F.col("v").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("v").alias("dst"), F.col("id").alias("b")), "dst")
    lists = ends.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("b", "weight"))).alias("near"))
    text = F.concat_ws(" ", F.col("weight").cast("string"), F.transform("near", lambda x: F.concat_ws(" ", x["b"].cast("string"), x["weight"].cast("string"))))
    lines = ids.join(lists, F.col("a") == F.col("id"), "left").select(F.col("id").alias("line_no"), text.alias("line"))
    n, m = ids.count(), edges.count()
    return spark.createDataFrame([(0, f"{n} {m // 2} 011")], "line_no long, line string").unionByName(lines)


def metis_graph(placed: DataFrame) -> DataFrame:
    """What metis_lines gives for the graph of placed, without a row for each of its edges."""
    ids = checkpoint(metis_vertices(heat_vertices(placed)))
    own = occurrences(placed).select("tx", "v", "n").join(ids.select("v", F.col("id").alias("k")), "v").select("tx", F.lit("").alias("t"), "k", "n")
    made = pairs.bucketed(own, own=True)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, a, _, b, w) in pairs.summed(batches):
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            for low in range(0, len(first), 4096):
                at = np.append(first[low : low + 4097], [len(a)] * (low + 4097 > len(first)))
                x, y, z = (c[at[0] : at[-1]] for c in (a, b, w))
                # a key's own weight comes first
                order = np.lexsort((y, y != x, x))
                x, y, z = x[order], y[order], z[order]
                text = pa.array(z).cast(pa.string())
                text = pc.if_else(pa.array(x == y), text, pc.binary_join_element_wise(pa.array(y).cast(pa.string()), text, " "))
                lists = pa.LargeListArray.from_arrays(pa.array(at - at[0], pa.int64()), text)
                yield pa.RecordBatch.from_arrays([pa.array(a[at[:-1]]), pc.binary_join(lists, " ").cast(pa.string())], names=["line_no", "line"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(int((a != b).sum()) for _, (_, a, _, b, _) in pairs.summed(batches))
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    m = made.mapInArrow(counted, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("m"))
    head = m.select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", F.lit(str(ids.count())), F.floor(F.col("m") / 2).cast("string"), F.lit("011")).alias("line"))
    return head.unionByName(made.mapInArrow(lines, "line_no long, line string"))


class DriverGraph:
    """A heat graph of bounded size in memory."""

    def __init__(self, vertices: Iterable[tuple], edges: Iterable[tuple]):
        self.part, self.weight, self.near = {}, {}, {}
        for v, part, weight in vertices:
            self.part[v], self.weight[v] = part, weight
        for a, b, weight in edges:
            self.near.setdefault(a, {})[b] = weight
        self.local, self.cross = Counter(), Counter()
        for v, p in self.part.items():
            self.local[p] += self.weight[v]
            self.cross[p] += self._crossing(v)

    def _crossing(self, v: str) -> int:
        return sum(w for u, w in self.near.get(v, {}).items() if self.part[u] != self.part[v])

    def loads(self, n: int, cost: float) -> list[float]:
        return [self.local[p] + float(cost) * self.cross[p] for p in range(n)]

    def hottest(self, part: int) -> str:
        return min((v for v, p in self.part.items() if p == part), key=lambda v: (-self.weight[v], v))

    def around(self, members: Iterable[str]) -> tuple[dict[str, int], dict[str, tuple[int, int]], Counter, tuple[str, int] | None]:
        members = list(members)
        inside, by, total = set(members), Counter(), Counter()
        for v in members:
            for u, w in self.near.get(v, {}).items():
                by[self.part[v], self.part[u], u in inside] += w
                if u not in inside:
                    total[u] += w
        to: Counter = Counter()
        for u, w in total.items():
            to[self.part[u]] += w
        best = min(total, key=lambda u: (-total[u], u)) if total else None
        return {v: self.part[v] for v in members}, by, to, best

    def weights(self, members: Iterable[str]) -> dict[str, int]:
        return {v: self.weight[v] for v in members}

    def degree_by_part(self, v: str) -> Counter:
        return Counter(self.part[u] for u in self.near.get(v, {}))

    def move(self, members: Iterable[str], dest: int) -> None:
        """Loads follow the moved keys and their neighbours; nothing else is counted again."""
        for v in members:
            here = self.part[v]
            if here == dest:
                continue
            self.local[here] -= self.weight[v]
            self.local[dest] += self.weight[v]
            self.cross[here] -= self._crossing(v)
            for u, w in self.near.get(v, {}).items():
                self.cross[self.part[u]] += w * ((self.part[u] != dest) - (self.part[u] != here))
            self.part[v] = dest
            self.cross[dest] += self._crossing(v)


class TableGraph:
    """The same questions asked of tables: only a clump's aggregates come to the driver."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.spark, self.first = vertices.sparkSession, checkpoint(vertices)
        self.edges = checkpoint(edges)
        self.moved: dict[str, int] = {}

    @property
    def vertices(self) -> DataFrame:
        if not self.moved:
            return self.first
        moved = self.spark.createDataFrame(list(self.moved.items()), "v string, now int")
        return self.first.join(F.broadcast(moved), "v", "left").select("v", F.coalesce("now", "part").alias("part"), "weight")

    def loads(self, n: int, cost: float) -> list[float]:
        return [r.total_load for r in partition_heat(self.vertices, self.edges, n, cost).orderBy("part").collect()]

    def hottest(self, part: int) -> str:
        return self.vertices.where(F.col("part") == part).orderBy(F.desc("weight"), "v").first().v

    def around(self, members: Iterable[str]) -> tuple:
        members = list(members)
        parts = {r.v: r.part for r in self.vertices.where(F.col("v").isin(members)).collect()}
        own = self.spark.createDataFrame(list(parts.items()), "src string, src_part int")
        ends = self.edges.where(F.col("src").isin(members)).join(F.broadcast(own), "src").join(self.vertices.select(F.col("v").alias("dst"), F.col("part").alias("dst_part")), "dst").withColumn("inside", F.col("dst").isin(members))
        by = Counter({(r.src_part, r.dst_part, r.inside): r.w for r in ends.groupBy("src_part", "dst_part", "inside").agg(F.sum("weight").alias("w")).collect()})
        out = ends.where("not inside")
        to = Counter({r.dst_part: r.w for r in out.groupBy("dst_part").agg(F.sum("weight").alias("w")).collect()})
        best = out.groupBy("dst").agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "dst").first()
        return parts, by, to, best and best.dst

    def weights(self, members: Iterable[str]) -> dict[str, int]:
        return {r.v: r.weight for r in self.first.where(F.col("v").isin(list(members))).collect()}

    def degree_by_part(self, v: str) -> Counter:
        ends = self.edges.where(F.col("src") == v).select(F.col("dst").alias("v")).join(self.vertices, "v")
        return Counter({r.part: r["count"] for r in ends.groupBy("part").count().collect()})

    def move(self, members: Iterable[str], dest: int) -> None:
        self.moved.update(dict.fromkeys(members, dest))


class _Clump:
    """Vertices that move together, and where to."""

    def __init__(self, graph, members: tuple[str, ...], dest: int | None = None):
        self.graph, self.members, self.dest = graph, members, dest
        self.parts, self.by, self.to, self.next = graph.around(members)
        self.weight = graph.weights(members)

    def delta(self, dest: int, cost: float) -> float:
        own = sum(w for v, w in self.weight.items() if self.parts[v] != dest)
        crossed = sum(-w if b == dest else 0 if inside else w for (a, b, inside), w in self.by.items() if a != dest)
        return own + cost * crossed


def _first_dest(graph, v: str, loads: list[float]) -> int:
    own = graph.around([v])[0][v]
    near = {p: c for p, c in graph.degree_by_part(v).items() if p != own}
    if near:
        return min(near, key=lambda p: (-near[p], p))
    return min((p for p in range(len(loads)) if p != own), key=lambda p: (loads[p], p))


def _clump(graph, start: str, loads: list[float], threshold: float, cost: float, look_ahead: int, most: int) -> _Clump | None:
    """Grows a clump by its hottest neighbour and keeps the last one that its destination can take."""
    n = len(loads)
    fits = lambda c, p: (d := c.delta(p, cost)) <= 0 or loads[p] + d < threshold
    clump, found = _Clump(graph, (start,), _first_dest(graph, start, loads)), None
    while True:
        if fits(clump, clump.dest):
            found = clump
        elif found is not None:
            look_ahead -= 1
        if len(clump.members) > most:
            return found or clump
        if look_ahead == 0 or clump.next is None:
            return found
        clump = _Clump(graph, (*clump.members, clump.next), clump.dest)
        if not fits(clump, clump.dest):
            near = min(range(n), key=lambda p: (-clump.to[p], p))
            least = min(range(n), key=lambda p: (loads[p], p))
            if near != clump.dest and fits(clump, near):
                clump.dest = near
            elif least != clump.dest and clump.delta(near, cost) < clump.delta(least, cost) and fits(clump, least):
                clump.dest = least


def plan_moves(vertices: DataFrame, edges: DataFrame, n: int, *, cost: float = 1.0, overload: float = 1.3, look_ahead: int = 5, clump_size: int = 20, most_clumps: int = 5000, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """v, src, dest: the moves that bring partitions below the threshold, clump by clump.

    The rounds are one after another by nature. Up to driver_edges edges are
    planned on in the driver; a larger graph stays in tables, and the driver
    gets the aggregates around one clump (clump_size vertices) at a time. Both
    give the same plan.
    """
    if edges.limit(driver_edges + 1).count() <= driver_edges:
        graph = DriverGraph([tuple(r) for r in vertices.select("v", "part", "weight").collect()], [tuple(r) for r in edges.select("src", "dst", "weight").collect()])
    else:
        graph = TableGraph(vertices.select("v", "part", "weight"), edges.select("src", "dst", "weight"))
    routes = _planned(graph, n, cost, overload, look_ahead, clump_size, most_clumps)
    return vertices.sparkSession.createDataFrame([(v, a, b) for v, (a, b) in sorted(routes.items()) if a != b], "v string, src int, dest int")


def plan_moves_of(placed: DataFrame, n: int, *, cost: float = 1.0, overload: float = 1.3, look_ahead: int = 5, clump_size: int = 20, most_clumps: int = 5000) -> DataFrame:
    """What plan_moves gives for the graph of placed, without its edges.

    The rounds are one after another by nature: one task plans, on the
    transactions' keys in files of its own.
    """
    vertices = incidence.in_order(heat_vertices(placed))
    own = occurrences(placed).join(vertices.select("v", "id"), "v").select("tx", "id", "n")
    heat = partition_loads(placed, n).collect()
    local, cross = (Counter({r.part: int(r[c]) for r in heat}) for c in ("local_load", "cross_load"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, graph = incidence.read(batches, local, cross)
        found = [(v, a, b) for v, (a, b) in _planned(graph, n, cost, overload, look_ahead, clump_size, most_clumps).items() if a != b]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(cols[0], np.int64)]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "src", "dest"])

    moves = incidence.handed(vertices, own).mapInArrow(run, "id long, src int, dest int")
    return checkpoint(moves).join(vertices.select("v", "id"), "id").select("v", "src", "dest")


def _planned(graph, n: int, cost: float, overload: float, look_ahead: int, clump_size: int, most_clumps: int) -> dict:
    """First and last part of the keys that move."""
    routes: dict = {}
    for _ in range(most_clumps):
        loads = graph.loads(n, cost)
        threshold = sum(loads) / n * overload
        over = next((p for p in range(n) if loads[p] > threshold), None)
        if over is None:
            break
        clump = _clump(graph, graph.hottest(over), loads, threshold, cost, look_ahead, clump_size)
        if clump is None or all(p == clump.dest for p in clump.parts.values()):
            break
        for v, p in clump.parts.items():
            if p != clump.dest:
                routes.setdefault(v, [p, p])[1] = clump.dest
        graph.move(clump.members, clump.dest)
    return routes
