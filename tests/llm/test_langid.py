import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomrow.llm import langid


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lab = langid.Labeller({"langs": ["a", "b", "c"], "log": np.zeros((langid.BUCKETS, 3)), "allowed": np.ones((len(langid.SCRIPTS), 3), bool)}, 1.5, 1.0)
    lengths = np.array([7, 5, 5, 2, 1, 1, 0])
    S = rng.normal(0, 1.5, (lengths.sum(), 3))
    first = np.cumsum(lengths) - lengths
    path = lab._viterbi(S, first, lengths)
    value = lambda s, p: sum(s[t, j] for t, j in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
    for f, n in zip(first, lengths, strict=True):
        if n:
            s = S[f : f + n]
            best = max(value(s, p) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(value(s, path[f : f + n]) - best) < 1e-9


def test_grams_of_words():
    bucket, word, letters, scripts = langid.grams(["ab", "a.b", "..", "да"])
    alone = langid.grams(["a"])
    assert letters.tolist() == [2, 2, 0, 2] and scripts[2] == -1 and langid.SCRIPTS[scripts[3]] == "Cyrillic"
    assert np.bincount(word, minlength=4).tolist() == [2 + 3 + 2, 2 + 4 + 2, 0, 7]
    # each part of a.b is a word of one letter
    assert sorted(bucket[word == 1].tolist())[:1] and set(alone[0]) <= set(bucket[word == 1].tolist())


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out("doc_id", 4, 2))
    model = langid.train(docs.filter("not held_out"))
    got = langid.identify(docs.select("doc_id", "held_out", "lang", "text"), model, keep=("doc_id", "held_out", "lang")).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and {r.doc_id for r in held} == {i for i in range(1000) if langid.fold_of(i, 4) == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "x"), (3, "12 -- 4", "x"), (None, "καλημέρα", None), (5, "the of and " * 3, "y"), (5, "the of and " * 3, "y")], "doc_id long, text string, score string")
    rows = langid.identify(odd, model, keep=("doc_id",)).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and rows[3].lang_pred in model["langs"] and rows[4] == rows[5] and rows[5].lang_pred == "en"
    assert langid.identify(odd.limit(0), model, keep=("doc_id",)).count() == 0
    empty = langid.train(odd.limit(0).withColumn("lang", odd.score))
    assert langid.identify(odd, empty, keep=("doc_id",)).filter("lang_pred = 'und'").count() == 6


def test_mixed_language_text_gets_spans(spark):
    rng = random.Random(1)
    latin, cyr, other = ["casa", "perro", "gato", "mesa", "llave"], ["дом", "кот", "стол"], ["house", "dog", "whale", "think"]
    rows = [(" ".join(rng.choices(w, k=30)), n) for n, w in (("es", latin), ("ru", cyr), ("en", other)) for _ in range(20)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    text = "gato perro mesa casa llave, дом кот  стол\nhouse think whale dog house"
    r = langid.identify(spark.createDataFrame([(text,)], "text string"), model, with_spans=True, switch=3.0).first()
    assert [(text[s.start : s.end].split()[0], s.lang) for s in r.spans] == [("gato", "es"), ("дом", "ru"), ("house", "en")]


class Handed(Exception):
    pass


def handed(call, docs, monkeypatch):
    """The function that call hands to the workers, and the columns they get."""

    def stop(self, run, *_, **__):
        raise Handed(run, self.columns)

    with monkeypatch.context() as m, pytest.raises(Handed) as e:
        m.setattr(type(docs), "mapInArrow", stop)
        call(docs)
    return e.value.args


def peak_mb(call):
    tracemalloc.start()
    try:
        found = call()
        return found, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def new_words(texts, words, chars):
    rng = np.random.default_rng(3)
    return [" ".join(bytes(w).decode() for w in rng.integers(97, 123, (words, chars), np.uint8)) for _ in range(texts)]


def test_counting_takes_little_memory(spark, monkeypatch):
    run, _ = handed(langid.train, spark.createDataFrame([], "text string, lang string"), monkeypatch)
    # many different words, and texts that are one long word each
    for texts in (new_words(200, 1500, 10), new_words(100, 1, 40_000)):
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["xx"] * len(texts))], names=["text", "lang"])
        got, mb = peak_mb(lambda batch=batch: list(run(iter([batch]))))
        counts = np.zeros(langid.BUCKETS + len(langid.SCRIPTS), np.int64)
        for key, data in zip(*(itertools.chain(*(b.column(i).to_pylist() for b in got)) for i in (0, 1)), strict=True):
            part = np.frombuffer(data, "<i8")
            counts[int(key.split(":")[0]) :][: len(part)] += part
        want = sum(np.bincount(langid.grams(t.split())[0], minlength=langid.BUCKETS) for t in texts)
        assert (counts[: langid.BUCKETS] == want).all() and counts[langid.BUCKETS :].sum() == sum(len("".join(t.split())) for t in texts)
        assert mb < 60, mb


def test_labelling_takes_little_memory(spark, monkeypatch):
    rng = np.random.default_rng(2)
    model = {"langs": ["a", "b"], "log": np.log(rng.random((langid.BUCKETS, 2))).astype(np.float32), "allowed": np.ones((len(langid.SCRIPTS), 2), bool)}
    langid.grams(["a"])
    for texts in (new_words(240, 1000, 10), new_words(100, 2, 40_000)):
        lab = langid.Labeller(model, 8.0, 0.5)
        blocks = [texts[i : i + 60] for i in range(0, len(texts), 60)]
        got, mb = peak_mb(lambda lab=lab, blocks=blocks: [x[:2] for b in blocks for x in lab.label(b)])
        assert got == [langid.Labeller(model, 8.0, 0.5).label([t])[0][:2] for t in texts]
        assert mb < 60, mb


def test_a_kept_text_goes_to_the_workers_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two", 5), (2, None, 6)], "doc_id long, text string, number long")
    model = langid.train(spark.createDataFrame([("one two three", "en")], "text string, lang string"))
    for keep in (("doc_id", "text", "number"), ("text",), ("number", "text")):
        _, columns = handed(lambda df, keep=keep: langid.identify(df, model, keep=keep), docs, monkeypatch)
        assert columns == list(keep)
        got = langid.identify(docs, model, keep=keep).orderBy(langid.F.desc("text")).collect()
        assert [(r.text, r.lang_pred) for r in got] == [("one two", "en"), (None, "und")] and got[0].asDict().get("number", 5) == 5
    # other kinds, and texts that are not kept, are turned into a column of their own
    for keep, text_col in (("doc_id",), "text"), (("number",), "number"):
        got = langid.identify(docs, model, keep=keep, text_col=text_col).collect()
        assert sorted(r.lang_pred for r in got) == (["en", "und"] if text_col == "text" else ["und", "und"])
        assert got[0].asDict().keys() == {*keep, "lang_pred", "score", "spans"}
