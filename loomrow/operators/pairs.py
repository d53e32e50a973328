"""Pairs of the keys that lie in one transaction, summed without a row for each.

The tasks that hold transactions make the pairs of some of them at a time, sum
equal ones and cut them into buckets by their first key; a bucket's part is one
value of some five bytes a pair. What reads the buckets sums these parts, one
bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrow.operators.frames import parallelism

#: Pairs that are made, and summed, at once; a bucket holds as many and its distinct ones.
PAIRS = 1 << 21
_BUCKETS_A_TASK = 16


def _sums(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their weights."""
    if not len(a):
        return a, b, w
    low, high = int(b.min()), int(b.max())
    width = high - low + 1
    if max(abs(int(a.min())), abs(int(a.max()))) + 1 < (1 << 62) // width:
        both = a * width + (b - low)
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    else:
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    return a[order][first], b[order][first], np.add.reduceat(w[order], first)


def _packed(x: np.ndarray) -> bytes:
    """Integers by their least and as few bytes as the rest needs."""
    low = int(x.min()) if len(x) else 0
    rest = (x - low).view(np.uint64) if len(x) else np.zeros(0, np.uint64)  # wraps around, and back
    width = max(1, -(-int(rest.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + low.to_bytes(8, "little", signed=True) + width.to_bytes(1, "little") + planes.tobytes()


def _unpacked(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, low, width = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little", signed=True), data[at + 16]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 17).reshape(width, n).T
    return out.view("<u8").ravel().view(np.int64) + low, at + 17 + n * width


def _pieces(c: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose pairs are some PAIRS together."""
    end, low = np.cumsum(c), 0
    while low < len(c):
        high = max(low + 1, int(np.searchsorted(end, (end[low - 1] if low else 0) + PAIRS, "right")))
        yield low, high
        low = high


def _made(batches: Iterator[pa.RecordBatch], own: bool) -> Iterator[pa.RecordBatch]:
    """bucket, data of the pairs among rows tx, bucket, t, k, n that come transaction by transaction."""
    kept: list[pa.RecordBatch] = []
    pairs = 0

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        tx, bucket, k, n = (rows[c].to_numpy() for c in ("tx", "bucket", "k", "n"))
        t = rows["t"].combine_chunks().dictionary_encode()
        t = t if isinstance(t, pa.DictionaryArray) else t.combine_chunks()
        names, t = t.dictionary.to_pylist(), t.indices.to_numpy().astype(np.int64)
        wide = np.zeros(0, np.int64)
        if len(k) and max(abs(int(k.min())), abs(int(k.max()))) >= (1 << 62) // len(names):
            wide, k = np.unique(k, return_inverse=True)
        code = k * len(names) + t
        start = np.flatnonzero(np.append(True, tx[1:] != tx[:-1]))
        size = np.diff(np.append(start, len(tx)))
        first, c = np.repeat(start, size), np.repeat(size, size)
        head = "\n".join(names).encode()
        for low, high in _pieces(c):
            m = c[low:high]
            x = np.repeat(np.arange(low, high), m)
            y = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m) + first[x]
            same = code[x] == code[y]
            keep = ~same | (own & (x == y))
            x, y = x[keep], y[keep]
            w = np.where(x == y, n[x], n[x] * n[y])
            order = np.argsort(bucket[x], kind="stable")
            x, y, w = x[order], y[order], w[order]
            of = bucket[x]
            cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            data = []
            for i, j in zip(cut.tolist(), np.append(cut[1:], len(of)).tolist(), strict=True):
                a, b, s = _sums(code[x[i:j]], code[y[i:j]], w[i:j])
                at = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                data.append(len(head).to_bytes(8, "little") + head + b"".join(map(_packed, (wide, a[at], np.diff(np.append(at, len(a))), b, s))))
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(of[cut].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        pairs += int(pa.compute.sum(batch["c"]).as_py())
        if pairs > PAIRS:
            rows = pa.Table.from_batches(kept)
            tx = rows["tx"].to_numpy()
            cut = int(np.flatnonzero(tx != tx[-1])[-1]) + 1 if tx[0] != tx[-1] else 0  # the last transaction goes on
            if cut:
                yield from flush(rows.slice(0, cut))
                kept = rows.slice(cut).combine_chunks().to_batches()
                pairs = sum(int(pa.compute.sum(b["c"]).as_py()) for b in kept)
    if kept:
        yield from flush(pa.Table.from_batches(kept))


class _Bucket:
    """The sums of a bucket's parts."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.least = 0

    def add(self, data: bytes) -> None:
        end = 8 + int.from_bytes(data[:8], "little")
        names, got = data[8:end].decode().split("\n"), []
        for _ in range(5):
            x, end = _unpacked(data, end)
            got.append(x)
        wide, a, times, b, w = got
        for x in names:
            if x not in self.names:
                self.names.append(x)
        to, n = np.array([self.names.index(x) for x in names]), len(names)
        key = lambda code: (to[code % n], wide[code // n] if len(wide) else code // n)
        (at, ak), (bt, bk) = key(a), key(b)
        self.parts.append((np.repeat(at, times), np.repeat(ak, times), bt, bk, w))
        self.held += len(w)
        if self.held > 2 * PAIRS + self.least:
            self.parts = [self.sums()]
            self.held = self.least = len(self.parts[0][0])

    def sums(self) -> tuple[np.ndarray, ...]:
        """First keys' names and numbers, second keys', weights: distinct pairs in the order of number and name."""
        at, ak, bt, bk, w = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(self.names)  # code by rank of the name
        rank = np.argsort(order)
        n = len(self.names)
        if max(int(np.abs(x).max(initial=0)) for x in (ak, bk)) < (1 << 62) // n and min(int(x.min(initial=0)) for x in (ak, bk)) > -(1 << 62) // n:
            a, b, s = _sums(ak * n + rank[at], bk * n + rank[bt], w)
            return order[a % n], a // n, order[b % n], b // n, s
        k, both = np.unique(np.concatenate([ak, bk]), return_inverse=True)
        a, b, s = _sums(both[: len(ak)] * n + rank[at], both[len(ak) :] * n + rank[bt], w)
        return order[a % n], k[a // n], order[b % n], k[b // n], s


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], tuple[np.ndarray, ...]]]:
    """Of each bucket (rows bucket, data in order): the names, and what _Bucket.sums gives."""
    at, held = None, _Bucket()
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if i != at and at is not None:
                yield held.names, held.sums()
                held = _Bucket()
            at = i
            held.add(data.as_py())
    if at is not None:
        yield held.names, held.sums()


def bucketed(rows: DataFrame, *, own: bool = False) -> DataFrame:
    """bucket, data: the pairs of distinct keys (t, k) among the rows tx, t, k, n of every transaction, products of n summed; with own also each key with itself, n summed.

    Neither t nor k may be null, and t has no line break.
    """
    spark = rows.sparkSession
    tasks = parallelism(spark)
    dealt = rows.select("tx", F.pmod(F.xxhash64("t", "k"), F.lit(tasks * _BUCKETS_A_TASK)).cast("int").alias("bucket"), "t", "k", F.col("n").cast("long").alias("n"))
    # the window deals and sorts by transaction where that is not so already
    whole = dealt.withColumn("c", F.expr("count(1) over (partition by tx)"))
    made = whole.mapInArrow(lambda x: _made(x, own), "bucket int, data binary")
    return made.repartitionById(tasks, "bucket").sortWithinPartitions("bucket")
