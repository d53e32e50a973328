"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Bits that go together are grouped into parts; for each fingerprint a dynamic
programme allots thresholds t_i to the parts with sum(t_i) = k - m + 1 so that
the estimated number of candidates is least. Two fingerprints within k bits then
agree to t_i bits on some part i. Probes meet data on equal part values, and
candidates are verified in place, so that only a spanning forest of the links of
each block leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import checkpoint, parallelism, shuffled, text_or_empty
from loomrow.llm.components import components, forest

BITS = 64
#: Fingerprints of one value that meet in one block at the expected size; a hot value has a grid of blocks.
BLOCK = 2048
#: Candidate pairs verified at once.
_PAIRS = 1 << 20
#: Flips of a part value that a probe can take at most.
_MOST = 2


def raw_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of a text's shingles in their order, repeats included; A-Z in lower case, words between ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[: max(1, len(words) - shingle + 1)].tolist()
    ends = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes; zero without any."""
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(h), 32768):
        counts += np.unpackbits(h[low : low + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """The SimHash of a text's shingles."""
    return majority(raw_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, shingle: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, fp (the 64 bits as a signed long)."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=out.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, out)


#: Words of 64 bits in a shingle sketch; minwise prints that candidates are searched by, and least hashes in each.
#: At similarity j a pair shares no print with probability (1 - j^LEAST)^PRINTS: 0.0004 at 0.8.
SKETCH, PRINTS, LEAST = 4, 20, 5
#: Sets of shingles handed on at once, and their hashes that meet in one cell at the expected size.
_SETS, _ELEMENTS = 500, 1 << 20
#: Odd factors that order hashes anew, one for each bit of a sketch.
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, 64 * SKETCH, np.uint64) << np.uint64(1) | np.uint64(1)


def _again(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit hash out of one."""
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted; none without words."""
    return np.unique(raw_hashes(text, shingle, seed))


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least of the hashes in each of 256 orders; two sets have equal ones as often as their Jaccard similarity."""
    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for low in range(0, len(h), 512):
        np.minimum(least, (_FACTORS[:, None] * h[low : low + 512]).min(axis=1), out=least)
    return least


def likeness(differ: np.ndarray | int) -> np.ndarray | float:
    """Jaccard similarity that so many different bits of two sketches tell."""
    return 1 - 2 * differ / (64 * SKETCH)


def word_prints(text: str, shingle: int, seed: int) -> np.ndarray:
    """PRINTS minwise prints of the word shingles, then their sketch, one bit of each least hash; zeros without words."""
    return _prints(shingle_hashes(text, shingle, seed))


def _prints(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(PRINTS + SKETCH, np.uint64)
    least = least_hashes(h)
    prints = np.arange(PRINTS, dtype=np.uint64)
    for i in range(LEAST):
        prints = _again(prints + least[i * PRINTS : (i + 1) * PRINTS], 2)
    bit = _again(least, 1) >> np.uint64(63)
    return np.concatenate([prints, np.packbits(bit.astype(np.uint8), bitorder="little").view(np.uint64)])


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _part(bits: np.ndarray, part: list[int]) -> np.ndarray:
    value = np.zeros(len(bits), np.int64)
    for j, b in enumerate(part):
        value |= bits[:, b].astype(np.int64) << j
    return value


def correlated_parts(gram: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in parts of equal size, each filled with the bits that correlate most with those already in it.

    gram[i, j] counts fingerprints with both bits set, among n.
    """
    p = np.diag(gram) / max(1, n)
    cov = gram / max(1, n) - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(dev, dev))
    left, found = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        grown = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(grown[0])
        while len(grown) < size:
            best = max(left, key=lambda b: (tie[b, grown].sum(), -b))
            grown.append(best)
            left.remove(best)
        found.append(sorted(grown))
    return found


def within(counts: np.ndarray, width: int) -> np.ndarray:
    """[t, v]: how many fingerprints have a part value within t bits of v, for t = 0.._MOST."""
    at = np.arange(1 << width)
    one = sum(counts[at ^ (1 << j)] for j in range(width))
    # each value two flips away is met from both flips
    two = (sum(one[at ^ (1 << j)] for j in range(width)) - width * counts) // 2
    return np.stack([counts, counts + one, counts + one + two])


def allot(cost: np.ndarray, total: int) -> np.ndarray:
    """Thresholds [row, part] of least cost that sum to total; cost[part, t + 1, row] for t = -1.._MOST."""
    parts, choices, n = cost.shape
    low = -parts
    best = np.full((total - low + 1 + parts * choices, n), np.inf)
    best[-low] = 0
    taken = []
    for i in range(parts):
        new, how = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for c in range(choices):
            for s in range(len(best)):
                if 0 <= s - (c - 1) < len(best):
                    x = best[s - (c - 1)] + cost[i, c]
                    take = x < new[s]
                    new[s] = np.where(take, x, new[s])
                    how[s] = np.where(take, c - 1, how[s])
        best = new
        taken.append(how)
    out, s = np.zeros((n, parts), np.int64), np.full(n, total - low)
    for i in reversed(range(parts)):
        out[:, i] = taken[i][s, np.arange(n)]
        s = s - out[:, i]
    return out


def _spread(fps: np.ndarray, turn: int) -> np.ndarray:
    """A mixed positive number of each fingerprint, for dealing to blocks."""
    x = fps ^ np.uint64(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(2)).astype(np.int64)


MEETINGS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("data_block", T.IntegerType()), T.StructField("probe_block", T.IntegerType()), T.StructField("role", T.IntegerType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _meetings(fps: np.ndarray, nodes: np.ndarray, parts: list[list[int]], near: list[np.ndarray], distance: int, row: float, block: int) -> list[list[np.ndarray]]:
    """Columns of MEETINGS for some fingerprints, by their places: role 1 is data, 2 a probe, 3 both. Nodes deal them to blocks."""
    places = np.arange(len(fps))
    bits, m = _bits(fps), len(parts)
    values = [_part(bits, p) for p in parts]
    probes = np.array([[sum(math.comb(len(p), k) for k in range(t + 1)) for t in range(_MOST + 1)] for p in parts])
    cost = np.stack([np.concatenate([np.zeros((1, len(fps))), near[i][:, values[i]] + row * probes[i][:, None]]) for i in range(m)])
    limit = allot(cost, distance - m + 1)
    out: list[list[np.ndarray]] = []

    def put(i: int, value: np.ndarray, at: np.ndarray, role: int) -> None:
        grid = -(-near[i][[0, _MOST]][:, value] // block)
        data, probe = np.maximum(grid[0], 1), np.maximum(grid[1], 1)
        plain = (data == 1) & (probe == 1)
        zero = np.zeros(int(plain.sum()), np.int64)
        out.append([zero + i, value[plain], zero, zero, zero + role, at[plain]])
        for r in (1, 2) if (hot := ~plain).any() else ():
            if role & r:
                own, of = (data, probe) if r == 1 else (probe, data)
                n, own, x, v = of[hot], own[hot], at[hot], value[hot]
                each = np.repeat(np.arange(len(n)), n)
                other = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                mine = (_spread(nodes[x], r) % own)[each]
                out.append([np.full(len(each), i), v[each], mine if r == 1 else other, other if r == 1 else mine, np.full(len(each), r), x[each]])

    for i, part in enumerate(parts):
        put(i, values[i][limit[:, i] >= 0], places[limit[:, i] >= 0], 3)
        put(i, values[i][limit[:, i] < 0], places[limit[:, i] < 0], 1)
        for t in range(1, _MOST + 1):
            if (take := limit[:, i] >= t).any():
                v, x = values[i][take], places[take]
                for flips in combinations(range(len(part)), t):
                    value = v ^ sum(1 << j for j in flips)
                    if (met := near[i][0][value] > 0).any():
                        put(i, value[met], x[met], 2)
    return out


def _meetings_of(key: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of every probe (role 2 or 3) with every data row (1 or 3) of its key; keys are ascending from 0."""
    at_data, at_probe = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    n = np.bincount(key[at_data], minlength=key[-1] + 1)
    of = key[at_probe]
    count, begin = n[of], (np.cumsum(n) - n)[of]
    end = np.cumsum(count)
    low = 0
    while low < len(at_probe):
        high = max(low + 1, int(np.searchsorted(end, (end[low - 1] if low else 0) + _PAIRS, "right")))
        c = count[low:high]
        each = np.repeat(np.arange(low, high), c)
        at = np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c) + begin[each]
        yield at_probe[each], at_data[at]
        low = high


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by their first columns (integers) in runs of whole keys, with the number of each row's key in its run."""
    rest: list[pa.RecordBatch] = []

    def change(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        cols = [c.to_numpy() for c in batch.columns[:keys]]
        return np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1

    def run() -> tuple[np.ndarray, pa.Table]:
        table = pa.Table.from_batches(rest).combine_chunks()
        key = np.zeros(table.num_rows, np.intp)
        key[change(table)] = 1
        return np.cumsum(key), table

    last = lambda batch, i: [c[i].as_py() for c in batch.columns[:keys]]
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = change(batch)
        same = not rest or last(rest[-1], -1) == last(batch, 0)
        if same and not len(cuts):
            rest.append(batch)
            continue
        cut = int(cuts[-1]) if len(cuts) else 0  # the last key goes on
        if cut:
            rest.append(batch.slice(0, cut))
        yield run()
        rest = [batch.slice(cut)]
    if rest:
        yield run()


def verify(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by all of MEETINGS but role and fp; a block goes on over batches."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for key, rows in _runs(batches, 4):
        fps = rows["fp"].to_numpy()
        for x, y in _meetings_of(key, rows["role"].to_numpy()):
            a, b = fps[x], fps[y]
            near = (np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= distance) & (a != b)
            if near.any():
                kept.append(forest(a[near], b[near]))
                held += len(kept[-1][0])
        if held > _PAIRS:
            kept = [forest(*map(np.concatenate, zip(*kept, strict=True)))]
            held = len(kept[0][0])
    if kept:
        a, b = forest(*map(np.concatenate, zip(*kept, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)


def links(fps: DataFrame, distance: int, *, parts: int = 4, block: int = BLOCK, row: float = 4.0) -> DataFrame:
    """Links a, b whose components are those of all pairs within distance bits, for distinct fingerprints (column fp).

    Part values are counted exactly (parts * 2^width counts, of at most 22 bits),
    which is what the driver gets and broadcasts: under 64 MB whatever the input.
    A probe is weighed as much as `row` candidate pairs.
    """
    if not 3 <= parts <= 8 or not -parts <= distance - parts + 1 <= parts * _MOST:
        raise ValueError("3 to 8 parts, with a sum of thresholds within -parts and 2 * parts")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([n] * BITS, pa.int64()), *map(pa.array, total)], names=["bit", "n", *(f"b{i}" for i in range(BITS))])

    fields = [T.StructField("bit", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(f"b{i}", T.LongType()) for i in range(BITS))]
    gram = sorted(fps.select("fp").mapInArrow(together, T.StructType(fields)).groupBy("bit").agg(F.sum("n"), *(F.sum(f"b{i}") for i in range(BITS))).collect())
    if not gram:
        return fps.sparkSession.createDataFrame([], LINKS)
    grouped = correlated_parts(np.array([r[2:] for r in gram], np.int64), gram[0][1], parts)

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64))
            for i, p in enumerate(grouped):
                value, n = np.unique(_part(bits, p), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(value), pa.array(n)], names=["part", "value", "n"])

    counted = fps.select("fp").mapInArrow(valued, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    near = []
    for i, p in enumerate(grouped):
        of = counted.filter(pa.compute.equal(counted["part"], i))
        n = np.zeros(1 << len(p), np.int64)
        n[of["value"].to_numpy()] = of["n"].to_numpy()
        near.append(within(n, len(p)))
    shared = fps.sparkSession.sparkContext.broadcast((grouped, near))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for cols in _meetings(own, own, *shared.value, distance, row, block):
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c).cast(t) for c, t in zip(cols, types, strict=False)), pa.array(own[cols[5]].view(np.int64))], names=MEETINGS.names)

    key = MEETINGS.names[:4]
    met = fps.select("fp").mapInArrow(meet, MEETINGS).repartition(parallelism(fps.sparkSession), *key).sortWithinPartitions(*key)
    return met.mapInArrow(lambda batches: verify(batches, distance), LINKS)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, seed: int = 42, distance: int = 4, parts: int = 4, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, fp, component_id, one for each row of docs.

    component_id is the smallest id reachable over fingerprints that differ in
    at most `distance` bits, a row's own included. Texts with fewer words than a
    shingle have the hash of the whole sequence; null, empty and blank texts have
    fingerprint zero, linked like any other. Null ids stay null and count for no
    minimum (a component of null ids alone has a null id). Equal rows stay.
    Whole texts count, however long. Other columns are ignored, whatever their
    names. No rows give none. Documents with one fingerprint are one class
    before anything is linked, so copies cost no pairs.
    """
    prints = checkpoint(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes, distance, parts=parts, block=block))
    rooted = checkpoint(classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    # written first, so that the join below can split a large component
    named = checkpoint(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: What names a cell of rows that are compared with each other.
CELL = ("bucket", "turn", "data_block", "probe_block")


def _dealt(met: DataFrame, partitions: int) -> DataFrame:
    return met.repartition(partitions, *CELL).sortWithinPartitions(*CELL)


def _partners(batches: Iterator[pa.RecordBatch], limit: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of each cell, the rows that have a partner there which the sketches and sizes don't rule out.

    A pair counts in its first common bucket only, and not if it has one root.
    """
    slack = similarity * (1 - 1e-9)
    for key, rows in _runs(batches, len(CELL)):
        n = rows.num_rows
        node, root, size, turn = (rows[c].to_numpy() for c in ("node", "root", "size", "turn"))
        told = np.frombuffer(b"".join(rows["told"].to_pylist()), np.uint64).reshape(n, PRINTS + SKETCH)
        told = np.concatenate([rows["family"].to_numpy().view(np.uint64)[:, None], told], axis=1)
        marked = np.zeros(n, bool)
        for x, y in _meetings_of(key, rows["role"].to_numpy()):
            open_ = (node[x] != node[y]) & (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= slack * np.maximum(size[x], size[y]))
            x, y = x[open_], y[open_]
            near = np.bitwise_count(told[x, PRINTS + 1 :] ^ told[y, PRINTS + 1 :]).sum(axis=1) <= limit
            x, y = x[near], y[near]
            earlier = np.arange(PRINTS + 1) < turn[x][:, None]
            first = ~((told[x, : PRINTS + 1] == told[y, : PRINTS + 1]) & earlier).any(axis=1)
            marked[x[first]] = marked[y[first]] = True
        if marked.any():
            at = pa.array(np.flatnonzero(marked))
            sketch = [x.tobytes() for x in told[marked, PRINTS + 1 :]]
            found = rows.select([*CELL, "role", "node", "root"]).take(at).append_column("sketch", pa.array(sketch, pa.binary()))
            yield from found.to_batches()


def confirm(node: np.ndarray, root: np.ndarray, role: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], limit: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell's similar sets (sorted, distinct elements) that join what all of them join.

    Pairs that are joined already are passed over, so a group of near copies
    costs one comparison each.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(size) - size
    distinct, ids = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True)
    mark = np.zeros(len(distinct), bool)
    label = np.unique(root, return_inverse=True)[1]
    data = np.flatnonzero(role & 1)
    out_a, out_b = [], []
    for x in np.flatnonzero(role & 2).tolist():
        open_ = (label[data] != label[x]) & (np.bitwise_count(sketch[data] ^ sketch[x]).sum(axis=1) <= limit)
        y = data[open_]
        y = y[np.minimum(size[y], size[x]) >= similarity * (1 - 1e-9) * np.maximum(size[y], size[x])]
        if not len(y):
            continue
        own = ids[start[x] : start[x] + size[x]]
        mark[own] = True
        first = np.cumsum(size[y]) - size[y]
        at = np.arange(int(size[y].sum())) + np.repeat(start[y] - first, size[y])
        # a set without elements is a class of its own, which has no partner
        common = np.add.reduceat(mark[ids[at]], first, dtype=np.int64)
        mark[own] = False
        y = y[common >= (similarity - 1e-12) * (size[x] + size[y] - common)]
        for i, lab in zip(y.tolist(), label[y].tolist(), strict=True):
            if label[i] != label[x]:
                out_a.append(node[x])
                out_b.append(node[i])
                label[label == lab] = label[x]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _confirmed(batches: Iterator[pa.RecordBatch], limit: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of all cells, by their rows' sets."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for key, rows in _runs(batches, len(CELL)):
        node, root, role = (rows[c].to_numpy() for c in ("node", "root", "role"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(key), SKETCH)
        lists = rows["set"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        flat, edge = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            kept.append(confirm(node[low:high], root[low:high], role[low:high], sketch[low:high], [flat[edge[i] : edge[i + 1]] for i in range(low, high)], limit, similarity))
        if sum(len(x) for x, _ in kept) > _PAIRS or len(kept) > _PAIRS:
            kept = [forest(*map(np.concatenate, zip(*kept, strict=True)))]
    if kept:
        a, b = forest(*map(np.concatenate, zip(*kept, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)


def _grid(members: DataFrame, block: int) -> DataFrame:
    """Cells of the buckets that are too large for one: what is apart from a bucket's commonest root meets all of it.

    Columns of members: bucket, turn, node, size, root. The commonest root's rows
    are no probes, so a bucket that is joined already costs nothing, and one that
    nearly is costs a row each and a few more.
    """
    of = ("bucket", "turn")
    roots = members.groupBy(*of, "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("e"))
    most = roots.groupBy(*of).agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / block), F.ceil(F.col("e") / _ELEMENTS * n / F.col("n"))).cast("int")
    most = checkpoint(most.select(*of, F.col("most.root").alias("common"), parts(F.col("n")).alias("data_blocks"), parts(F.col("n") - F.col("most.n")).alias("probe_blocks")))
    met = members.join(shuffled(most), list(of))
    own = lambda n, salt: F.pmod(F.xxhash64("node", "bucket", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ("node", "size", "root")
    data = met.select(*of, own("data_blocks", 1).alias("data_block"), every("probe_blocks").alias("probe_block"), F.lit(1).alias("role"), *rest)
    probe = met.filter("root <> common").select(*of, every("data_blocks").alias("data_block"), own("probe_blocks", 2).alias("probe_block"), F.lit(2).alias("role"), *rest)
    return data.unionByName(probe)


def _once(df: DataFrame, many: DataFrame | None, key: list[str]) -> DataFrame:
    """The rows of df, one for each key in many; other keys are known to be unique."""
    if many is None:
        return df
    same = lambda: [df[c].eqNullSafe(many[f"many {i}"]) for i, c in enumerate(key)]
    return df.join(shuffled(many), same(), "left_anti").unionByName(df.join(shuffled(many), same(), "left_semi").dropDuplicates(key))


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame | None:
    found = checkpoint(rows.groupBy(*key).count().filter("count > 1").select(*(F.col(c).alias(f"many {i}") for i, c in enumerate(key))))
    return None if found.isEmpty() else found


def similar_classes(docs: DataFrame, *, keys: tuple[str, ...], shingle: int = 5, similarity: float = 0.8, slack: float = 0.14, distance: int = 4, seed: int = 42, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """Rows of keys and component (a number), one for each row of docs: equal for texts that a chain of similar ones joins.

    Two texts are similar if the Jaccard similarity of their word shingles is
    `similarity` or more, by the sets of 64-bit shingle hashes themselves. They
    meet in buckets: first the families of SimHashes within `distance` bits,
    which the generalised pigeonhole search links; then their minwise prints,
    since a pair at 0.8 lies some ten bits apart, beyond any such search. Of
    pairs at 0.8 the prints miss 0.0004, whatever the edit. In a bucket sketches
    of 256 bits keep out the pairs that are far below (standard error 0.04 at
    0.8; `slack` below it, which 0.0003 of the pairs at 0.8 don't reach); a pair
    is looked at in the first bucket that it shares. Only the sets of texts
    with such a partner are moved, once for each of these buckets, and compared
    in place: what leaves a task is a forest of the links.

    A bucket of more than `block` texts is cut into blocks. After these are
    compared within, the texts that aren't joined with its commonest component
    meet all of the bucket, block by block.

    Texts with the same shingles are one class before anything is linked. Texts
    shorter than a shingle have the whole sequence as their one; null, empty and
    blank texts are one class. Null keys and repeated rows stay, whole texts
    count, other columns are ignored, no rows give none.
    """
    out = T.StructType([*(docs.schema[c] for c in keys), T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.LongType()), T.StructField("told", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            found, told = np.empty((3, batch.num_rows), np.uint64), []
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                raw = raw_hashes(x.as_py(), shingle, seed)
                h = np.unique(raw)
                found[:, i] = xxh64_intdigest(h.tobytes(), seed), majority(raw), len(h)
                told.append(_prints(h).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in found.view(np.int64)), pa.array(told, pa.binary())], names=out.names)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(batch.num_rows, -1)[:, :PRINTS]
            buckets = np.concatenate([batch.column(1).to_numpy()[:, None], prints], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(buckets.ravel()), PRINTS + 1).cast(pa.list_(pa.int64()))], names=["node", "size", "buckets"])

    spark = docs.sparkSession
    deal, limit = parallelism(spark), math.floor((1 - similarity + slack) * 32 * SKETCH + 1e-9)
    rows = checkpoint(docs.select(*keys, text_or_empty(text_col).alias("text of the row")).mapInArrow(run, out))
    # the copies of a class are one row from here on, with the least keys of one of them
    classes = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "size", "told")), F.min(F.struct(*keys)).alias("k"))
    classes = checkpoint(classes.select("node", "fp", "size", "told", *(F.col("k")[c].alias(f"of {i}") for i, c in enumerate(keys))))
    families = components(links(checkpoint(classes.select("fp").distinct()), distance))
    # equal SimHashes are one family as well
    family = F.xxhash64(F.coalesce("root", "fp"), F.lit(seed))
    classes = checkpoint(classes.join(shuffled(families.withColumnRenamed("node", "fp")), "fp", "left").select("node", family.alias("family"), "size", "told", *(f"of {i}" for i in range(len(keys)))))
    met = classes.filter("size > 0").select("node", "family", "size", "told").mapInArrow(printed, "node long, size long, buckets array<long>")
    met = met.select("node", "size", F.posexplode("buckets").alias("turn", "bucket"))
    large = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("e") / _ELEMENTS)).cast("int")
    shared = met.groupBy("bucket", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("e")).filter("n > 1").select("bucket", "turn", large.alias("blocks"))
    met = checkpoint(met.join(shuffled(shared), ["bucket", "turn"]))

    asked_for = [f"key {i}" for i in range(len(keys))]
    many = _repeated(rows, list(keys))
    texts = _once(docs.select(*(F.col(c).alias(n) for c, n in zip(keys, asked_for, strict=True)), text_or_empty(text_col).alias("text")), many, asked_for)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, _SETS):
                batch = whole.slice(low, _SETS)
                found = [shingle_hashes(x.as_py(), shingle, seed).view(np.int64) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "set"])

    def linked(cells: DataFrame) -> DataFrame:
        """Links among the rows of the cells, by their sets."""
        told = _dealt(cells.drop("size").join(shuffled(classes), "node"), deal)
        whole = "bucket long, turn int, data_block int, probe_block int, role int, node long, root long, sketch binary"
        open_ = checkpoint(told.select(*CELL, "role", "node", "root", "family", "size", "told").mapInArrow(lambda x: _partners(x, limit, similarity), whole))
        named = classes.join(shuffled(open_.select("node").distinct()), "node", "left_semi").select("node", *(f"of {i}" for i in range(len(keys))))
        known = texts.join(shuffled(named), [F.col(f"of {i}").eqNullSafe(F.col(n)) for i, n in enumerate(asked_for)]).select("node", "text").mapInArrow(sets, "node long, set array<long>")
        return checkpoint(_dealt(open_.join(shuffled(known), "node").select(*CELL, "role", "node", "root", "sketch", "set"), deal).mapInArrow(lambda x: _confirmed(x, limit, similarity), LINKS))

    own = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    found = linked(met.select("bucket", "turn", own.alias("data_block"), own.alias("probe_block"), F.lit(3).alias("role"), "node", "size", F.col("node").alias("root")))
    hot = checkpoint(met.filter("blocks > 1").drop("blocks"))
    if not hot.isEmpty():
        roots = components(found)
        members = checkpoint(hot.join(shuffled(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
        found = found.unionByName(linked(_grid(members, block)))
    return rows.select(*keys, "node").join(shuffled(components(found)), "node", "left").select(*keys, F.coalesce("root", "node").alias("component"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, one of each component of similar_classes: that of the smallest id (null: larger than any), one of equal rows.

    Options are those of similar_classes. All columns of docs stay; texts are
    moved once, in a join of the rows with the keepers' ids and text hashes.
    """
    marked = docs.withColumns({"id of the row": F.col(id_col).cast("long"), "hash of the row": F.xxhash64(F.col(text_col).cast("string"))})
    key = ("id of the row", "hash of the row")
    classes = similar_classes(marked, keys=key, text_col=text_col, **options)
    order = F.struct(F.col(key[0]).isNull(), *key)  # combined before the shuffle, so a large group is no hot key
    kept = checkpoint(classes.groupBy("component").agg(F.min(order).alias("k")).select(*(F.col("k")[c].alias(c) for c in key)))
    same = lambda a, b: a[key[0]].eqNullSafe(b[key[0]]) & (a[key[1]] == b[key[1]])
    many = _repeated(classes, list(key))
    return _once(marked.join(shuffled(kept), same(marked, kept), "left_semi"), many, list(key)).drop(*key)
