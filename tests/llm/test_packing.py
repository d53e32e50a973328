import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomrow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The cat's hat — isn't  it?\n\nYES 12 345",
    "",
    None,
    "été ́x ﬁne  no break\ttab\x1cfs",
    "valentinesday " + packing.WordEncoder(PATH)._mark + " a " + packing.WordEncoder(PATH)._mark + "!",
    "Ünï\x00cödé 漢字 🙂🙂 İI ΣΑΣ",
    "word " * 9000,
    "x" * 5000,
]


def test_words_encode_as_whole_texts():
    tok = Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS]
    want = [struct.pack(f"<{len(i)}I", *i) for i in (tok.encode(t, add_special_tokens=False).ids for t in texts)]
    assert packing.WordEncoder(PATH).encode(texts) == want


@pytest.mark.parametrize("lengths", [[], [5], [4, 4, 4, 4], [7, 1, 8, 3, 3, 2, 6, 5]])
def test_first_fit_decreasing_is_the_plain_one(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 8)
    rooms, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        if b == len(rooms):
            rooms.append(8)
        want[i] = (b, 8 - rooms[b])
        rooms[b] -= lengths[i]
    assert {i: (bins[i], offsets[i]) for i in range(len(lengths))} == want


def test_every_id_lies_in_one_piece(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again", 2), (None, "no id", None, None)] + [(99, "copy of it", "c", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, offset int")
    got = packing.pack(docs, PATH, sequence=64, group_pieces=16, with_ids=True).collect()
    tok, seqs, texts = Tokenizer.from_file(PATH), {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 256
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for spans in seqs.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in enumerate(TEXTS):
        want = tok.encode(t or "", add_special_tokens=False).ids + [2]
        found = b"".join(x for _, x, _ in sorted(texts[i]))
        whole = struct.pack(f"<{len(want)}I", *want)
        assert found == whole or i == 3 and sorted(texts[i]) == sorted(2 * [(at // 4, whole[at : at + 256], len(want)) for at in range(0, len(whole), 256)])
    assert len(texts[99]) == 40 and len(texts[None]) == 1
    total, used = len(seqs) * 64, sum(r.length for r in got)
    assert used / total > 0.9
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_random_words_encode_as_the_tokenizer_does():
    import random

    rng, tok = random.Random(4), Tokenizer.from_file(PATH)
    bits = ["tion", "the", "é", "ß", "ü", "ª", "µ", "×", "a", "qu", "S", "T", ".", ",", "'", "1", "_", "ñ", "ó", "İ", "Σ", "\xa0", "\x85", "\x00", "-"]
    texts = [" ".join("".join(rng.choices(bits[: rng.choice([12, len(bits)])], k=rng.randrange(1, 9))) for _ in range(40)) for _ in range(400)]
    want = [struct.pack(f"<{len(i)}I", *i) for i in (tok.encode(t, add_special_tokens=False).ids for t in texts)]
    assert packing.WordEncoder(PATH).encode(texts) == want
