import random

import numpy as np

import corpus_pipeline as cp
from loomrow.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(seed=5):
    rng = random.Random(seed)
    words = {lang: [f"{p}{''.join(rng.choices('aeiou', k=3))}{i}" for i in range(300)] for lang, p in (("en", "th"), ("fr", "qu"))}
    words = {k: ["".join(c for c in w if c.isalpha()) + "xyz"[i % 3] * (i % 7) for i, w in enumerate(ws)] for k, ws in words.items()}
    rows, groups, at = [], {}, 0
    for g in range(30):
        lang = rng.choice(("en", "fr"))
        base = rng.choices(words[lang], k=rng.randrange(60, 400))
        for j in range(rng.choice((1, 1, 2, 5))):
            text = list(base)
            if j >= 2:  # the second is an exact copy, others have a word changed
                text[rng.randrange(len(text))] = rng.choice(words[lang])
            rows.append((at, " ".join(text), lang, "s", None))
            groups[at] = g
            at += 1
    return rows, groups


def test_sketches_tell_similarity():
    rng = random.Random(1)
    apart = []
    for _ in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 500))]
        other = [w if rng.random() > 0.02 else f"v{rng.random()}" for w in base]
        a, b = (simhash.word_prints(" ".join(x), 5, 42) for x in (base, other))
        differ = int(sum(np.bitwise_count(x ^ y) for x, y in zip(a[simhash.PRINTS :], b[simhash.PRINTS :], strict=True)))
        apart.append(simhash.likeness(differ) - jaccard(shingles(" ".join(base)), shingles(" ".join(other))))
    assert abs(np.mean(apart)) < 0.015 and np.std(apart) < 0.06
    assert (simhash.word_prints("A b", 5, 42) == simhash.word_prints("a  B\n", 5, 42)).all() and not simhash.word_prints(" ", 5, 42).any()


def test_near_copies_against_brute_force(spark):
    rows, groups = corpus()
    extra = [(None, rows[0][1], "en", "s", None), (900, rows[0][1], "en", "s", None), (900, rows[0][1], "en", "s", None), (901, "alone here", "en", "s", 1), (901, "alone here", "en", "s", 1), (None, "no id at all", "en", "s", 1), (902, None, None, None, None), (903, " ", None, None, None)]
    docs = spark.createDataFrame(rows + extra, SCHEMA).withColumn("node", cp.F.lit(1)).withColumn("component", cp.F.lit("x"))
    got = simhash.deduplicate(docs).collect()
    sets = {i: shingles(t) for i, t, *_ in rows}
    keep = {i for i in sets if not any(j < i and jaccard(sets[i], sets[j]) >= 0.8 for j in sets)}
    assert keep == {min(i for i in groups if groups[i] == g) for g in set(groups.values())}
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [*keep, 901, None, 902]))
    assert got[0].component == "x" and simhash.deduplicate(docs.limit(0)).count() == 0


def pairs_of(kind, low, high, n, seed):
    """Rows of n text pairs (ids 2 i, 2 i + 1) whose Jaccard similarity lies within low and high, and the similarities."""
    rng = random.Random(seed)
    rows, likes = [], []
    while len(likes) < n:
        m = rng.randrange(40, 300)
        base = [f"w{rng.randrange(10**6)}" for _ in range(m)]
        if kind == "truncated":
            other = base[: rng.randrange(m // 2, m)]
        elif kind == "appended":
            other = base + [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, m // 2))]
        else:
            other = [w if rng.random() > 0.05 else f"w{rng.randrange(10**6)}" for w in base]
        j = jaccard(shingles(" ".join(base)), shingles(" ".join(other)))
        if low <= j < high:
            rows += [(2 * len(likes), " ".join(base)), (2 * len(likes) + 1, " ".join(other))]
            likes.append(j)
    return rows, likes


def test_copies_cut_or_appended_are_found(spark):
    rows, likes = [], []
    for k, (kind, low) in enumerate((kind, low) for kind in ("truncated", "appended", "scattered") for low in (0.8, 0.85, 0.9)):
        found, j = pairs_of(kind, low, low + 0.05, 60, k)
        rows += [(i + 2 * len(likes), t) for i, t in found]
        likes += j
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.similar_classes(df, keys=("doc_id",)).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(likes))]
    for k in range(9):
        assert sum(linked[60 * k : 60 * k + 60]) >= 58, (k, sum(linked[60 * k : 60 * k + 60]))
    assert len(set(got.values())) == len(rows) - sum(linked)


def test_no_pair_below_the_similarity_is_joined(spark):
    rng = random.Random(4)
    rows, likes = pairs_of("scattered", 0.7, 0.8, 100, 1)
    found, j = pairs_of("truncated", 0.7, 0.8, 100, 2)
    rows += [(i + 200, t) for i, t in found]
    likes += j
    for n in range(12, 60):  # short texts, with a word changed or some cut off
        for edit in (lambda b: [*b[: n // 2], "changed", *b[n // 2 + 1 :]], lambda b: b[: n - n // 7], lambda b: b[: n - n // 10 - 1]):
            base = [f"s{rng.randrange(10**6)}" for _ in range(n)]
            other = edit(base)
            j = jaccard(shingles(" ".join(base)), shingles(" ".join(other)))
            rows += [(2 * len(likes), " ".join(base)), (2 * len(likes) + 1, " ".join(other))]
            likes.append(j)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component for r in simhash.similar_classes(df, keys=("doc_id",)).collect()}
    wrong = [(j, 2 * i) for i, j in enumerate(likes) if j < 0.8 and got[2 * i] == got[2 * i + 1]]
    lost = [(j, 2 * i) for i, j in enumerate(likes) if j >= 0.8 and got[2 * i] != got[2 * i + 1]]
    assert not wrong and len(lost) <= 1 and any(j >= 0.8 for j in likes), (wrong, lost)


def test_groups_of_templates_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"t{g}.{i}" for i in range(120)]
        for _ in range(15):  # members lie about 0.8 from each other, so that chains and gaps are mixed
            text = list(base)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text[: rng.randrange(105, 121)])))
    got = {r.doc_id: r.component for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), keys=("doc_id",)).collect()}
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    split = lambda of: {frozenset(i for i in range(len(rows)) if of(i) == c) for c in {of(i) for i in range(len(rows))}}
    assert split(label.__getitem__) == split(got.__getitem__) and len(split(label.__getitem__)) > 20


def test_a_bucket_cut_into_blocks_loses_no_link(spark):
    rng = random.Random(11)
    rows = []
    common = [f"c{i}" for i in range(40)]
    for g in range(3):  # two groups share a passage of 40 words, so that they meet in one bucket
        base = (common if g else []) + [f"g{g}.{i}" for i in range(100)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(40, len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = lambda block: {frozenset(r.m) for r in simhash.similar_classes(df, keys=("doc_id",), block=block).groupBy("component").agg(cp.F.collect_list("doc_id").alias("m")).collect()}
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    assert parts(5) == {frozenset(i for i in range(len(rows)) if label[i] == c) for c in set(label)}


def test_stages(spark, tmp_path):
    rows, groups = corpus(7)
    odd = [(500, "1234 !! 55", "en", "s", 10), (501, None, "en", "s", None), (502, "", None, "s", 0), (503, rows[3][1] + " write to jane@example.com now", None, None, None), (504, "the only words of another text 10.1.2.3 stay", "en", "s", 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = cp.language(spark, docs.withColumn("score", cp.F.lit(0)), "")
    assert known.columns == docs.columns
    found = {r.doc_id: r for r in known.collect()}
    assert set(found) == set(groups) | {503, 504} and found[503].lang == rows[3][2]
    assert all(found[i].lang == lang and found[i].text == t for i, t, lang, *_ in rows)
    apart = cp.near_copies(spark, known, "")
    assert apart.columns == docs.columns
    kept = {r.doc_id for r in apart.collect()}
    assert kept == {min(i for i in groups if groups[i] == g) for g in set(groups.values())} | {504}
    clean = cp.personal_data(spark, docs, "")
    assert clean.columns == docs.columns
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[503].text == rows[3][1] + " write to <EMAIL> now" and texts[504].text == "the only words of another text <IP> stay" and texts[501].text is None and texts[501].n_chars is None
    assert all(texts[i].text == t and texts[i].n_chars == len(t) for i, t, *_ in rows)
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == kept and max(r.offset + r.length for r in out) <= 4096
    for stage in (cp.language, cp.near_copies, cp.personal_data, cp.pack):
        assert stage(spark, docs.limit(0), "").count() == 0
    bare = cp.language(spark, docs.withColumn("lang", cp.F.lit(None).cast("string")), "")
    assert {r.doc_id for r in bare.collect()} == set(found)
