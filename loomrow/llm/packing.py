"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Every document becomes its token ids and an end id, cut into pieces of at most
one sequence. Pieces are dealt at random to groups of bounded size; each group
packs its own pieces, so no task sees more than a group and nothing is ordered
over the whole corpus.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import text_or_empty

#: Pieces that one group packs, at the expected size.
GROUP_PIECES = 1024
#: Words whose ids a worker keeps; the cache starts anew beyond that.
CACHE_WORDS = 600_000
#: Words encoded in one call, each followed by a mark.
_RUN = 512

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("salt", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """Token ids as little-endian 32-bit bytes, each white-space-separated word encoded once.

    Correct for byte-level merge vocabularies with word ends that normalise by
    NFC and lower case, drop white space and keep letters apart from the rest:
    the ids for a text are those of its words in a row. New words of Latin-1
    letters, with or without a full stop or comma behind them, are merged in bulk
    by ranks (a zero byte stands for the word end); what else there is goes to
    the tokenizer itself, runs of it in one call with a mark after each word.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._cache: dict[str, bytes] = {}
        words = sorted((w for w in self._tokenizer.get_vocab() if w.endswith("</w>") and w[:-4].isascii() and w[:-4].isalpha()), key=lambda w: (-len(w), w))
        self._mark = next(w[:-4] for w in words if len(self._ids([w[:-4]])[0]) == 1)
        self._mark_id = self._ids([self._mark])[0][0]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte, vocab = _byte_of(), model["vocab"]
        raw = lambda x: bytes(byte[c] for c in x.removesuffix("</w>")) + b"\0" * x.endswith("</w>")
        merged = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        names = [c for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        names = [*names, *(c + "</w>" for c in names), *("".join(x) for x in merged)]
        ranks: dict[bytes, int] = {}
        for i, x in enumerate(names):
            ranks.setdefault(raw(x), i)
        self._id = np.array([vocab[x] for x in names], dtype="<u4")
        self._last = np.array([x.endswith("</w>") for x in names])
        self._ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        letters, stopped, rest = [], [], []
        for w in words:
            if w.isalpha() and (w.isascii() or max(w) <= "\xff"):
                letters.append(w)
            elif w[-1:] in (".", ",") and (x := w[:-1]).isalpha() and (x.isascii() or max(x) <= "\xff"):
                stopped.append(w)
            else:
                rest.append(w)
        if letters:
            self._merge(letters, "\0".join(letters).lower() + "\0", 1)
        if stopped:
            self._merge(stopped, "".join([f"{w[:-1]}\0{w[-1]}\0" for w in stopped]).lower(), 2)
        self._tokenize(rest)

    def _merge(self, words: list[str], joined: str, each: int) -> None:
        """Encodes words whose parts, `each` a word, stand in joined, a zero after each part."""
        ranks = self._ranks.encode_to_numpy(joined) if hasattr(self._ranks, "encode_to_numpy") else np.array(self._ranks.encode_ordinary(joined))
        ends = (np.flatnonzero(self._last[ranks])[each - 1 :: each] + 1) * 4
        raw, at = self._id[ranks].tobytes(), 0
        for word, end in zip(words, ends.tolist(), strict=True):
            self._cache[word] = raw[at:end]
            at = end

    def _tokenize(self, words: list[str]) -> None:
        """Encodes words by the tokenizer; a run that holds the mark itself goes word by word."""
        runs = [words[i : i + _RUN] for i in range(0, len(words), _RUN)]
        mark = f" {self._mark} "
        for run, ids in zip(runs, self._ids([mark.join(run) + mark for run in runs]), strict=True):
            flat = np.array(ids, dtype="<u4")
            ends = np.flatnonzero(flat == self._mark_id)
            if len(ends) != len(run) or self._mark in run:
                self._cache.update((w, np.array(x, dtype="<u4").tobytes()) for w, x in zip(run, self._ids(run), strict=True))
                continue
            raw, at = flat.tobytes(), 0
            for word, end in zip(run, (ends * 4).tolist(), strict=True):
                self._cache[word] = raw[at:end]
                at = end + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        split = []
        for text in texts:
            try:
                text.encode("latin-1")
                text = text.lower()  # here the same as what the tokenizer does, and fewer words
            except UnicodeEncodeError:
                pass
            split.append(text.replace("\n", " ").split(" "))
        if new := set().union(*split).difference(self._cache):
            self._learn(sorted(new))
        of = self._cache.__getitem__
        return [b"".join(map(of, words)) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int, sequence: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows doc_id, start, length, ids_crc32, doc_tokens, salt, ids: the pieces of every document.

    ids (little-endian unsigned 32-bit) is null unless with_ids. salt tells
    apart pieces of equal content, so that copies are dealt to many groups.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, end = encoder(tokenizer), Counter(), np.array([end_id], dtype="<u4").tobytes()
        step = 4 * sequence
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for doc_id, raw in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    raw += end
                    key = (doc_id, zlib.crc32(raw))
                    seen[key] += 1
                    if len(seen) > 1_000_000:
                        seen.clear()
                    for at in range(0, len(raw), step):
                        x = raw[at : at + step]
                        rows.append((doc_id, at // 4, len(x) // 4, zlib.crc32(x), len(raw) // 4, seen[key], x if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)], names=PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, PIECES)


class Tournament:
    """A tree over the room left in bins; each inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.most = [capacity] * (2 * self.width)

    def first_fit(self, size: int) -> int:
        """Takes room for size from the leftmost bin that has it; that bin's number."""
        most, at = self.most, 1
        while at < self.width:
            at *= 2
            if most[at] < size:
                at += 1
        bin_, most[at] = at - self.width, most[at] - size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the given order; lengths are at most capacity, ties keep their order."""
    tree = Tournament(max(1, len(lengths)), capacity)
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), [0] * max(1, len(lengths))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = bins[i] = tree.first_fit(lengths[i])
        offsets[i] = used[b]
        used[b] += lengths[i]
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, sequence: int = 4096, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `sequence` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and ids (with_ids only, else null). Sequences are gapless
    from offset 0; what is missing to `sequence` is padding.

    Null and empty texts are one piece with the end id. A null id stays null.
    Equal rows are packed each. Very long texts are cut into full sequences and a
    rest. Other columns are ignored, whatever their names. No rows give none.

    Groups are as many as pieces / group_pieces, bounded before tokenising by
    rows + bytes / sequence (a token has at least a byte, but for the end id).
    """
    size = docs.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text_or_empty(text_col))), F.lit(0)).alias("b")).first()
    groups = max(1, -(-(size.n + size.b // sequence) // group_pieces))
    cut = pieces(docs, tokenizer, end_id=end_id, sequence=sequence, id_col=id_col, text_col=text_col, with_ids=with_ids)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        # a fixed order, so that a group packed again after a lost executor comes out alike
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "salt")])
        bins, offsets = first_fit_decreasing(table["length"].to_pylist(), sequence)
        first = (table["part"][0].as_py() if table.num_rows else 0) << 32
        table = table.append_column("sequence_id", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return table.select(out.names)

    out = T.StructType([f for f in PIECES if f.name not in ("salt", "ids")] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])
    return cut.groupBy("part").applyInArrow(place, out)
