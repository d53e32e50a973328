import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from loomrow.llm import imatch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def terms(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())}


def of_list(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return f"{seed:016x}"


def hashes(text, lex):
    t = terms(text)
    kept = sorted(t & lex)
    if not kept:
        return [of_list(sorted(t))] * len(imatch.EXPONENTS)
    out = []
    for s, e in enumerate(imatch.EXPONENTS):
        shift, want = (11 * s) % 55, (0x9E3779B9 >> s % 16) & (1 << e) - 1
        own = [h for h in kept if ((h & (1 << 64) - 1) >> shift) & (1 << e) - 1 == want]
        out.append(of_list(own) if own else "-" * 16)
    return out


def alike(a, b):
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-" * 16,) * 2]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def rows_for(seed):
    rng = random.Random(seed)
    words = [f"wörd{i}" for i in range(60)] + ["The", "ΑB", "x\x1cy", "."]
    rows = [(i * 7 % 101, " ".join(rng.choices(words, k=rng.randrange(0, 40))) + rng.choice(["", "\n", "🙂 "])) for i in range(101)]
    return rows + [(500, None), (501, ""), (502, rows[3][1]), (7, "seven again"), (7, "seven again"), (None, "no id"), (1 << 62, "far " * 5000)]


@pytest.mark.parametrize("part", [250, 2])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(imatch, "_PART", part)
    rows = rows_for(part)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, hs string, part int").repartition(3)
    plain = [(i, t or "") for i, t in rows]
    n = len(plain)
    df_of = {}
    for _, t in plain:
        for h in terms(t):
            df_of[h] = df_of.get(h, 0) + 1
    want_lex = {h for h, d in df_of.items() if 0.03 * n <= d <= 0.3 * n}
    lex = imatch.lexicon(df, low=0.03, high=0.3)
    assert {r.h for r in lex.collect()} == want_lex and want_lex
    line = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = hashes(t, want_lex), hashes(edited, want_lex), hashes(after, want_lex)
        want.append(str((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c))))
    got = [str(tuple(r)) for r in imatch.edited_likeness(df, lex).collect()]
    assert sorted(got) == sorted(want)
    some = {(r.doc_id, tuple(r.hashes)) for r in imatch.fingerprints(df, lex).collect()}
    assert some == {(i, tuple(hashes(t, want_lex))) for i, t in plain}


def test_a_large_lexicon_is_joined_and_tables_may_be_empty(spark, monkeypatch):
    df = spark.createDataFrame(rows_for(9), "doc_id long, text string")
    lex = imatch.lexicon(df, low=0.01, high=0.9)
    found = lambda: sorted(str(tuple(r)) for r in imatch.edited_likeness(df, lex).collect())
    sent = found()
    monkeypatch.setattr(imatch, "LEXICON", 10)
    assert lex.count() > 10 and found() == sent
    none = df.limit(0)
    assert imatch.edited_likeness(none, imatch.lexicon(none)).count() == 0
    one = df.filter("doc_id = 501").unionByName(df.limit(1)).limit(1)
    assert imatch.edited_likeness(one, lex).count() == 1


def test_edits_are_nearer_than_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = imatch.edited_likeness(docs, imatch.lexicon(docs)).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("more")).first()
    assert got.e > 4 * got.n and got.more > 0.8, got


def test_copies_that_hold_a_third_of_the_rows_stay_alike(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(20_000)]
    hot = rng.sample(words, 200)
    texts = [" ".join(rng.choices(words, k=150)) for _ in range(200)]
    for i in range(100):
        copy = list(hot)
        copy[rng.randrange(200)] = f"changed{i}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = imatch.lexicon(df, by_class=True)
    found = {r.doc_id: r.hashes for r in imatch.fingerprints(df, lex, few=imatch.FEW).collect()}
    likes = [alike(found[200], found[i]) for i in range(201, 300)]
    assert sum(likes) / len(likes) > 0.6 and min(likes) > 0.3, likes
    assert max(alike(found[200], found[i]) for i in range(200)) < 0.3
    near = imatch.edited_likeness(df, lex, few=imatch.FEW).filter("doc_id between 200 and 298").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert near.n > 0.6 and near.e > 0.15, near  # the edit takes half the terms of a copy before a copy
