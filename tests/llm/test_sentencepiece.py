import random

import public_tokenizers
import pytest
import sentencepiece as library

from loomrow.llm import sentencepiece as own

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "a", " a", "a ", "  two  spaces ", "\n\n x\n", "▁lit▁eral ▁", "tab\tnul\x00 \x0b", "漢字かな交じり", "🙂🙂 x🙂y", "<s></s><unk> <0x0A>", "é" * 50, "ab" * 3000, " " * 40, "�﻿", "the cat's isn't 12345.67e-8"]


@pytest.fixture(scope="module")
def models():
    return own.MergeModel(PATH), library.SentencePieceProcessor(model_file=PATH)


def same(models, text):
    ids = memoryview(models[0].encode(text)).cast("i").tolist()
    assert ids == models[1].encode(text), text
    assert models[0].decode([*ids, 2]) == models[1].decode([*ids, 2]), text


def test_odd_texts(models):
    for text in ODD:
        same(models, text)


def test_random_texts(models):
    rng = random.Random(5)
    alphabets = ["abcdehilnorst", "aAbB ▁\n.,'0123", "éèçñßüöä aen", "漢字🙂ab \x00", "=-_*#/\\ <>"]
    for _ in range(3000):
        same(models, "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60))))


def test_decoding_any_ids(models):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 29871]) for _ in range(rng.randrange(12))]
        assert models[0].decode(ids) == models[1].decode(ids), ids


def test_table(spark, models):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, None), (1, "copy", "y"), (1, "copy", "y")]
    got = own.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    want = sorted((str(i), models[1].encode(t or "") + [2], models[1].decode(models[1].encode(t or "") + [2])) for i, t, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in got) == want
