"""Exact encoding and decoding with a SentencePiece model of the merge type.

A text is cut where no vocabulary piece can reach across: before a run of
spaces, and around characters that no piece holds. Each part is encoded by
backtracking: an Aho-Corasick pass finds the longest piece at every place, a
piece may follow another only if merging their joint text gives those two
again, and a bit field remembers the places from which no encoding goes on.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import text_or_empty

SPACE = "▁"
#: Parts whose ids a worker keeps, and the longest part that is kept.
CACHE_PARTS, CACHE_CHARS = 800_000, 64


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("loomrow-each-byte", _each_byte)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, raw[at : at + size]
        at += size


class MergeModel:
    """The pieces of a model file and the exact encoder over them.

    Takes merge-type models with byte fallback, no normalisation rules, no
    removal of extra white space, no unused or user-defined pieces, and a
    vocabulary in which every character of a piece is itself a piece; others
    are refused with ValueError.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(x)) for n, x in model if n == 1]
        trainer = {k: v for n, x in model if n == 2 for k, v in _fields(x)}
        normal = {k: v for n, x in model if n == 3 for k, v in _fields(x)}
        names, kinds = [p[1].decode() for p in pieces], [p.get(3, 1) for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(6) or normal.get(4, 1) or not normal.get(5, 1) or not {*kinds} <= {1, 2, 3, 6}:
            raise ValueError("not a merge-type model of the kind this encoder takes")
        self.prefix = bool(normal.get(3, 1))
        self.id_of = {x: i for i, x in enumerate(names) if kinds[i] == 1}
        self.text_of = {i: x for x, i in self.id_of.items()}
        self.score = {x: struct.unpack("<f", pieces[i][2])[0] if 2 in pieces[i] else 0.0 for x, i in self.id_of.items()}
        self.byte_id = {int(names[i][3:5], 16): i for i, k in enumerate(kinds) if k == 6}
        chars = {x for x in self.id_of if len(x) == 1}
        if len(self.byte_id) != 256 or not {c for x in self.id_of for c in x} <= chars or any(SPACE in x.lstrip(SPACE) for x in self.id_of):
            raise ValueError("pieces reach across the places where this encoder cuts")
        self._part = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if "\n" not in chars else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._foreign = re.compile(f"([^{re.escape(''.join(sorted(chars)))}])")
        self._compatible: dict[int, bool] = {}
        self._shorter: dict[int, int | None] = {}
        self._cache: dict[str, bytes] = {}
        self._automaton = ahocorasick.Automaton()
        for x, i in self.id_of.items():
            if self.merge(x) == [i]:
                self._automaton.add_word(x[::-1], (len(x), i))
        self._automaton.make_automaton()
        self._reached = {i for _, i in self._automaton.values()}
        table = [b""] * len(names)
        for i, (x, kind) in enumerate(zip(names, kinds, strict=True)):
            table[i] = bytes([int(x[3:5], 16)]) if kind == 6 else x.replace(SPACE, " ").encode() if kind == 1 else b" \xe2\x81\x87 " if kind == 2 else b""
        self._bytes = table

    def merge(self, text: str) -> list[int]:
        """Encodes text of known characters by the definition: the best-scored adjacent pair merges first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max(((score[x], -i) for i, x in enumerate(map(str.__add__, parts, parts[1:])) if x in score), default=(None, 0))
            if best is None:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return [self.id_of[x] for x in parts]

    def _fits(self, a: int, b: int) -> bool:
        """Whether b can follow a: their joint text merges to the two again."""
        key = a << 32 | b
        found = self._compatible.get(key)
        if found is None:
            if len(self._compatible) > 2_000_000:
                self._compatible.clear()
            found = self._compatible[key] = self.merge(self.text_of[a] + self.text_of[b]) == [a, b]
        return found

    def _next_shorter(self, token: int) -> int | None:
        """The longest piece that is a proper prefix of the token's."""
        if token not in self._shorter:
            x = self.text_of[token]
            self._shorter[token] = next((i for n in range(len(x) - 1, 0, -1) if (i := self.id_of.get(x[:n])) in self._reached), None)
        return self._shorter[token]

    def _known(self, text: str) -> list[int]:
        """Encodes text of known characters by backtracking."""
        n, last = len(text), len(text) - 1
        longest = [0] * n
        width = [0] * n
        for end, (size, token) in self._automaton.iter(text[::-1]):
            if size > width[last - end]:
                width[last - end], longest[last - end] = size, token
        dead, path, at = bytearray(n + 1), [], 0
        token: int | None = longest[0]
        fits, text_of = self._fits, self.text_of
        while True:
            while token is not None and (dead[at + len(text_of[token])] or path and not fits(path[-1], token)):
                token = self._next_shorter(token)
            if token is None:
                dead[at] = 1
                token = path.pop()
                at -= len(text_of[token])
                token = self._next_shorter(token)
                continue
            path.append(token)
            at += len(text_of[token])
            if at == n:
                return path
            token = longest[at]

    def _encode_part(self, part: str) -> bytes:
        ids: list[int] = []
        for i, x in enumerate(self._foreign.split(part)):
            if i % 2:
                ids += [self.byte_id[b] for b in x.encode()]
            elif x:
                ids += self._known(x)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        cache, out = self._cache, []
        parts = self._part.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        try:
            return b"".join(map(cache.__getitem__, parts))
        except KeyError:
            pass
        for part in parts:
            ids = cache.get(part)
            if ids is None:
                ids = self._encode_part(part)
                if len(part) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PARTS:
                        cache.clear()
                    cache[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; control ids have none, and the first space goes if encoding puts one there."""
        raw = b"".join(map(self._bytes.__getitem__, ids))
        if self.prefix and raw[:1] == b" " and (first := next((i for i in ids if self._bytes[i]), None)) in self.text_of:
            raw = raw[1:] if self.text_of[first].startswith(SPACE) else raw
        return raw.decode("utf-8", "loomrow-each-byte")


_MODELS: dict[str, MergeModel] = {}


def model(path: str) -> MergeModel:
    """The worker's model of a file."""
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, path: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, ids, decoded: every text's ids with the end id, and the text that those ids give.

    Null and empty texts have the end id alone and decode to the empty text.
    A null id stays null, equal rows stay, very long texts are taken whole,
    other columns are ignored whatever their names, and no rows give none.
    """
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, end = model(path), b"" if end_id is None else struct.pack("<i", end_id)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                raws = [m.encode(x) + end for x in part.column(1).to_pylist()]
                offsets = [0]
                for x in raws:
                    offsets.append(offsets[-1] + len(x) // 4)
                values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(raws))])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                decoded = pa.array([m.decode(memoryview(x).cast("i").tolist()) for x in raws], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=out.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, out)
