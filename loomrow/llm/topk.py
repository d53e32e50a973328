"""Exact top-k search by distributed histogram selection.

Everything is scored: candidates stay in blocks where they were read, and blocks
of queries are sent to them, a bounded number of bytes at a time. Global
histograms of each query's scores come back and narrow the interval that holds
its kth score, by a factor of 1024 a round, down to one score; then all that
exceeds it and the smallest ids among its equals are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import checkpoint, parallelism

#: Vectors of a block; the pairs of a query run with a block that are scored at once.
QUERY_BLOCK, CANDIDATE_BLOCK, _RUN = 1024, 1 << 16, 1 << 20
#: Bytes of query blocks that are sent together.
SENT = 32 << 20
_BITS = 10
_BINS = 1 << _BITS
#: No score is below; what a query with fewer than k candidates takes for its kth.
_FLOOR = -(1 << 63)

BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("norm", T.DoubleType()),
        T.StructField("wide", T.BooleanType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("values", T.BinaryType()),
    ]
)
COUNTS = T.StructType([T.StructField("q_block", T.LongType()), T.StructField("counts", T.BinaryType())])
STATE = T.StructType([T.StructField("block", T.LongType()), T.StructField("low", T.BinaryType()), T.StructField("above", T.BinaryType())])
HITS = T.StructType([T.StructField("q_block", T.LongType()), T.StructField("q", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
_COUNT = np.dtype([("q", "<u2"), ("bin", "<u2"), ("n", "<u4")])


def blocks(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows vec_id, embedding in blocks of one dimension, components as floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        made = 0

        def row(dim: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            wide = bool(np.abs(values).max(initial=0) > 32767)
            norm = float(np.sqrt((values * values).sum(axis=1)).max(initial=0)) if dim else 0.0
            made += 1
            data = values.astype("<f8" if wide else "<i2").tobytes()
            return pa.RecordBatch.from_pylist([{"block": first + made, "dim": dim, "n": len(ids), "norm": norm, "wide": wide, "ids": ids.astype("<i8").tobytes(), "values": data}], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("norm", pa.float64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("values", pa.binary())])
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            lengths = np.asarray(lists.value_lengths())
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                values = flat[starts[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                held.setdefault(dim, []).append((ids[at], values))
                if sum(len(x) for x, _ in held[dim]) >= size:
                    ids_, values = (np.concatenate(x) for x in zip(*held[dim], strict=True))
                    whole = len(ids_) // size * size
                    for low in range(0, whole, size):
                        yield row(dim, ids_[low : low + size], values[low : low + size])
                    held[dim] = [(ids_[whole:], values[whole:])]
        for dim, parts in held.items():
            ids_, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(ids_):
                yield row(dim, ids_, values)

    x = F.col("embedding")
    ok = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(ok).mapInArrow(run, BLOCKS)


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["values"], "<f8" if row["wide"] else "<i2").reshape(row["n"], row["dim"])


def scores(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows, exact: bound is no less than any product of norms.

    Beyond the range of a long they stop at its ends.
    """
    if bound < 1 << 24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if bound < 1 << 53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    whole = np.vectorize(int, otypes=[object])
    both = whole(q.astype(np.float64)).dot(whole(c.astype(np.float64)).T) if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.clip(both, _FLOOR, -_FLOOR - 1).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], queries: list[dict]) -> Iterator[tuple[dict, Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Each block of queries with each of candidates of its dimension: the former, and for runs of its queries the first one, scores, which of them count, and candidate ids."""
    for batch in batches:
        for row in batch.to_pylist():
            c, c_ids = _matrix(row), np.frombuffer(row["ids"], "<i8")
            order = np.argsort(c_ids, kind="stable")
            step = max(1, _RUN // len(c))

            def runs(query: dict, c=c, c_ids=c_ids, order=order, step=step, norm=row["norm"]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
                q, q_ids = _matrix(query), np.frombuffer(query["ids"], "<i8")
                left, right = (np.searchsorted(c_ids[order], q_ids, side) for side in ("left", "right"))
                for low in range(0, len(q), step):
                    s = scores(q[low : low + step], c, query["norm"] * norm)
                    counts = np.ones(s.shape, bool)
                    for i in np.flatnonzero(right[low : low + step] > left[low : low + step]):
                        counts[i, order[left[low + i] : right[low + i]]] = False
                    yield low, s, counts, c_ids

            for query in queries:
                if query["dim"] == row["dim"]:
                    yield query, runs(query)


def _tally(batches: Iterator[pa.RecordBatch], queries: list[dict], state: dict[int, tuple[np.ndarray, np.ndarray]], k: int, shift: int, bins_open: int) -> Iterator[pa.RecordBatch]:
    """Counts of scores by bin, for the highest bins of each pair of blocks that can hold the kth score."""
    for query, runs in _pairs(batches, queries):
        lows, above = state[query["block"]]
        n = np.zeros((len(lows), _BINS), np.int64)
        for low, s, counts, _ in runs:
            own = lows[low : low + len(s)]
            at_q, at_c = np.nonzero(counts & (s >= own[:, None]) & (above[low : low + len(s)] >= 0)[:, None])
            # the difference of two longs, the second no larger, fits an unsigned one
            bins = (s[at_q, at_c].astype(np.int64).view(np.uint64) - own[at_q].view(np.uint64)) >> np.uint64(shift)
            inside = bins < bins_open  # what lies above the interval has been counted
            n[low : low + len(s)] += np.bincount(at_q[inside] * _BINS + bins[inside].astype(np.intp), minlength=len(s) * _BINS).reshape(-1, _BINS)
        higher = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n  # what this pair has above each bin
        q, b = np.nonzero((n > 0) & (higher < (k - above)[:, None]))
        out = np.zeros(len(q), _COUNT)
        out["q"], out["bin"], out["n"] = q, b, n[q, b]
        yield pa.RecordBatch.from_arrays([pa.array([query["block"]], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=COUNTS.names)


def narrowed(total: np.ndarray, low: np.ndarray, above: np.ndarray, k: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """New lows and counts above them, from the counts in the bins; above is -1 where all candidates are fewer than k."""
    upto = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] + above[:, None]
    reach = upto >= k  # the bin of the kth score is the highest one with k or more in it and above
    found = reach.any(axis=1) & (above >= 0)
    at = _BINS - 1 - np.argmax(reach[:, ::-1], axis=1)
    each = np.arange(len(at))
    raised = (low.view(np.uint64) + (at.astype(np.uint64) << np.uint64(shift))).view(np.int64)
    return np.where(found, raised, _FLOOR), np.where(found, upto[each, at] - total[each, at], -1)


def _narrow(batches: Iterator[pa.RecordBatch], state: dict[int, tuple[np.ndarray, np.ndarray]], k: int, shift: int) -> Iterator[pa.RecordBatch]:
    """The new state of each query block, whose counts come in a row."""
    block, total = None, None

    def made() -> pa.RecordBatch:
        low, above = narrowed(total, *state[block], k, shift)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([low.astype("<i8").tobytes()], pa.binary()), pa.array([above.astype("<i8").tobytes()], pa.binary())], names=STATE.names)

    for batch in batches:
        for b, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                if block is not None:
                    yield made()
                block, total = b, np.zeros((len(state[b][0]), _BINS), np.int64)
            x = np.frombuffer(counts, _COUNT)
            total[x["q"], x["bin"]] += x["n"]
    if block is not None:
        yield made()


def _take(batches: Iterator[pa.RecordBatch], queries: list[dict], state: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, what exceeds the kth score and the smallest ids of its equals that can be needed."""
    for query, runs in _pairs(batches, queries):
        q_ids = np.frombuffer(query["ids"], "<i8")
        for low, s, counts, c_ids in runs:
            lows, above = (x[low : low + len(s)] for x in state[query["block"]])
            q, c = np.nonzero(counts & (s >= lows[:, None]))
            score, ids = s[q, c].astype(np.int64), c_ids[c]
            order = np.lexsort((ids, ~score, q))
            q, score, ids = q[order], score[order], ids[order]
            tied = score == lows[q]
            place = np.arange(len(q)) - np.searchsorted(q * 2 + tied, q * 2 + tied, "left")
            keep = ~tied | (place < (k - above)[q])
            q, score, ids = q[keep], score[keep], ids[keep]
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), query["block"])), pa.array((q + low).astype(np.int32)), pa.array(q_ids[q + low]), pa.array(ids), pa.array(score)], names=HITS.names)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, *, scale: float = 64.0, sent: int = SENT) -> DataFrame:
    """Rows query_id, rank, vec_id, score: each query's k highest inner products.

    Both tables have vec_id and embedding; components count as floor(scale * x).
    Ties go to the smaller vec_id; fewer than k candidates all come. Rows with a
    null id, a null vector or a null or non-finite component take no part. Only
    vectors of equal length have a score; empty ones score 0. Rows that have the
    query's vec_id are its own and no candidates of it. Repeated rows count each,
    as candidates and as queries. Scores that a long can't hold stop at its ends.
    Other columns are ignored, whatever their names. No rows give none.

    Query blocks are broadcast `sent` bytes at a time, however many there are;
    candidates aren't moved. Histograms leave a task only for bins that can hold
    the kth score: at most k a query and block of candidates, whatever the ties.
    The driver holds the blocks that it sends and their state, and for all blocks
    a number and a size.
    """
    spark, deal = candidates.sparkSession, parallelism(candidates.sparkSession)
    q_blocks, c_blocks = checkpoint(blocks(queries, QUERY_BLOCK, scale)), checkpoint(blocks(candidates, CANDIDATE_BLOCK, scale))
    norm = (c_blocks.agg(F.max("norm")).first()[0] or 0.0) * (q_blocks.agg(F.max("norm")).first()[0] or 0.0)
    bound = int(min(norm * (1 + 1e-9) + 2, 1 << 63))
    sizes = q_blocks.select("block", (F.octet_length("ids") + F.octet_length("values")).alias("size")).orderBy("block").collect()
    groups: list[list[int]] = []
    size = 0
    for r in sizes:
        if not groups or size + r.size > sent:
            groups.append([r.block, r.block])
            size = 0
        groups[-1][1] = r.block
        size += r.size
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for first, last in groups:
        own = [r.asDict() for r in q_blocks.filter(F.col("block").between(first, last)).collect()]
        one = _group(spark, own, c_blocks, k, bound, deal)
        found = found.unionByName(one if len(groups) == 1 else checkpoint(one))
    return found


def _group(spark: SparkSession, queries: list[dict], c_blocks: DataFrame, k: int, bound: int, deal: int) -> DataFrame:
    """The results of some query blocks."""
    shared = spark.sparkContext.broadcast(queries)
    state = {q["block"]: (np.full(q["n"], -bound, np.int64), np.zeros(q["n"], np.int64)) for q in queries}
    shift = max(0, (2 * bound + 1).bit_length() - _BITS)
    open_ = _BINS
    while True:
        now = spark.sparkContext.broadcast(state)
        counts = c_blocks.mapInArrow(lambda x, s=shift, o=open_, n=now: _tally(x, shared.value, n.value, k, s, o), COUNTS)
        new = counts.repartition(deal, "q_block").sortWithinPartitions("q_block").mapInArrow(lambda x, s=shift, n=now: _narrow(x, n.value, k, s), STATE)
        # a block that no candidate has met has none
        state = {b: (np.full(len(low), _FLOOR, np.int64), np.full(len(low), -1, np.int64)) for b, (low, _) in state.items()}
        state |= {r.block: (np.frombuffer(r.low, "<i8"), np.frombuffer(r.above, "<i8")) for r in new.collect()}
        if not shift:
            break
        open_, shift = 1 << min(shift, _BITS), max(0, shift - _BITS)
    last = spark.sparkContext.broadcast(state)
    hits = c_blocks.mapInArrow(lambda x: _take(x, shared.value, last.value, k), HITS)
    rank = F.row_number().over(Window.partitionBy("q_block", "q").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
