import random

import numpy as np
import pytest
import xxhash

from loomrow.llm import simhash
from loomrow.llm.components import components, forest


def brute_fingerprint(text, k):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {x: find(x) for x in nodes}


def test_fingerprints():
    rng = random.Random(1)
    words = ["The", "É", "cat", "İx", "\x0bno", "a\x85b", "\x1ck"]
    texts = ["", " \n", "one", "one two three", "A b\tc\x0bd\x0ce"] + [" ".join(rng.choices(words, k=n)) for n in (4, 5, 50, 333)]
    for t in texts:
        assert simhash.fingerprint(t, 4, 42) == brute_fingerprint(t, 4)


@pytest.mark.parametrize("block", [2048, 7])
@pytest.mark.parametrize("parts", [3, 4, 5])
def test_links_join_all_pairs_within_distance(spark, block, parts):
    rng = random.Random(parts)
    fps = {0, 1, 15, 31, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 25)):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
    signed = {int(np.uint64(f).view(np.int64)): f for f in fps}
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3), 4, parts=parts, block=block)
    roots = {r.node: r.root for r in components(got).collect()}
    want = brute_components(signed, lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 4)
    assert {s: roots.get(s, s) for s in signed} == want


def test_allotted_thresholds_are_least_and_sum():
    rng = np.random.default_rng(2)
    cost = np.concatenate([np.zeros((4, 1, 50)), np.cumsum(rng.random((4, 3, 50)), axis=1)], axis=1)
    import itertools

    got = simhash.allot(cost, 1)
    for j in range(50):
        best = min(sum(cost[i, t + 1, j] for i, t in enumerate(ts)) for ts in itertools.product((-1, 0, 1, 2), repeat=4) if sum(ts) == 1)
        assert got[j].sum() == 1 and abs(sum(cost[i, t + 1, j] for i, t in enumerate(got[j])) - best) < 1e-9


def test_values_within():
    n = np.random.default_rng(1).integers(0, 5, 64)
    got = simhash.within(n, 6)
    for t in range(3):
        assert got[t].tolist() == [sum(int(n[w]) for w in range(64) if (v ^ w).bit_count() <= t) for v in range(64)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (-3, 9), (9, 12)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots[160] == 100 and roots[559] == 500 and roots[12] == -3 and 7 not in roots and len(roots) == 61 + 60 + 3
    a, b = forest(np.array([5, 6, 1, 9]), np.array([6, 7, 2, 9]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (6, 5), (7, 5)]


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "", "c"), (5, None, "c"), (4, " ", "c"), (8, "only", "c"), (9, "ONLY", "c"), (None, "alone with null", "c")]
    for i in range(30):
        base = rng.choices(words, k=rng.randrange(3, 300))
        for j in range(4):
            rows.append((100 + i * 10 + j, " ".join(base), "x"))
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
    rows += [rows[10]] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((str(r.doc_id), r.fp, r.component_id) for r in simhash.near_duplicates(df, shingle=4).collect())
    fps = {t: brute_fingerprint(t or "", 4) for _, t, _ in rows}
    roots = brute_components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            r = roots[fps[t]]
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), int(np.uint64(fps[t]).view(np.int64)), least.get(roots[fps[t]])) for i, t, _ in rows)
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
