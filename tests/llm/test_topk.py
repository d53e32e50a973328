import math
import random

import numpy as np

from loomrow.llm import topk


def brute(queries, candidates, k):
    ok = lambda r: r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    whole = lambda v: [math.floor(64 * float(x)) for x in v]
    out = []
    for i, q in filter(ok, queries):
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole(q), whole(c), strict=True)))), j) for j, c in filter(ok, candidates) if j != i and len(c) == len(q))
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, queries, candidates, k, parts=3, **options):
    make = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string").repartition(parts)
    return sorted(tuple(r) for r in topk.top_k(make(queries), make(candidates), k, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 17)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [rows[3], rows[20]]
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, rows[0][1]), (404, [0.5] * 3), (420, []), (440, [])]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    assert run(spark, queries, rows, 20) == brute(queries, rows, 20)
    assert run(spark, queries, rows[:4], 20) == brute(queries, rows[:4], 20)
    assert run(spark, queries, rows, 3, sent=1) == brute(queries, rows, 3)


def test_wide_values_and_none(spark):
    rng = random.Random(2)
    for size in (1e3, 1e7, 2e7, 1e30):
        rows = [(i, np.array([rng.uniform(-size, size) for _ in range(4)], np.float32).tolist()) for i in range(30)]
        assert run(spark, rows[:5], rows, 3) == brute(rows[:5], rows, 3)
    assert run(spark, [], [], 3) == run(spark, rows[:2], [], 3) == []
