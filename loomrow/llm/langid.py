"""Language identification: scripts narrow the candidates, Viterbi over words labels spans.

A word's score for a language is the log likelihood of its hashed character
n-grams, counted over all training documents. Languages that are not written in
the word's script drop out. A path through the words of a text pays a penalty
for each change of language, so single odd words don't change it and passages do.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import sum_arrays

#: Buckets of hashed n-grams: the model has that many counts a language, whatever the corpus.
BUCKETS = 1 << 16
_CHUNK = 1 << 12
#: First code points of script ranges, in order; letters between two belong to the first.
_RANGES = [(0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x780, "Thaana"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other")]
SCRIPTS = sorted({s for _, s in _RANGES})
#: A script counts as one of a language if it has this share of its letters.
SCRIPT_SHARE = 0.001
#: Characters of words whose n-grams are worked out at once; each takes some 130 bytes meanwhile.
PIECE = 1 << 17
#: Different words that a task counts before it sums up their n-grams, and characters of the texts they come from.
COUNT_WORDS, COUNT_CHARS = 60_000, 8_000_000
#: Words whose scores a worker keeps, and their characters.
CACHE_WORDS, CACHE_CHARS = 100_000, 4_000_000


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and the number of its script."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.int8)
    for at, name in _RANGES:
        script[at:] = SCRIPTS.index(name)
    return letter, script


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram (1 to 3 characters, word edges included), letters and script of every word.

    What is no letter ends a word; a word without letters has script -1.
    """
    letter, script = _letters()
    chars = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), "<u4")
    of = np.cumsum(np.frombuffer(chars, "<u4") == 10) - 1
    inside = letter[chars]
    c = np.where(inside, chars, 0).astype(np.uint64)
    mixed = lambda x, n: ((x + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    two = c[:-1] * np.uint64(0x100003) ^ c[1:]
    three = two[:-1] * np.uint64(0x10000019) ^ c[2:]
    ok2, ok3 = inside[:-1] | inside[1:], inside[1:-1]
    bucket = np.concatenate([mixed(c[inside], 1), mixed(two[ok2], 2), mixed(three[ok3], 3)])
    # a pair that starts with an edge belongs to the word of its letter
    own2 = np.where(inside[:-1], of[:-1], of[1:])
    word = np.concatenate([of[inside], own2[ok2], of[1:-1][ok3]])
    letters = np.bincount(of[inside], minlength=len(words))[: len(words)]
    scripts = np.full(len(words), -1)
    where = np.flatnonzero(inside)[::-1]
    scripts[of[where]] = script[chars[where]]
    return bucket, word, letters, scripts


def pieces(words: list[str]) -> Iterator[list[str]]:
    """The words in runs of at most PIECE characters, or of one longer word."""
    low = size = 0
    for at, n in enumerate(map(len, words)):
        if at > low and size + n > PIECE:
            yield words[low:at]
            low, size = at, 0
        size += n + 1
    if low < len(words):
        yield words[low:]


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Counts over all rows with a language and a text: langs, log likelihoods [bucket, lang], allowed [script, lang].

    One array of counts a language leaves each task, in pieces, and is summed
    by key; the driver gets BUCKETS counts for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        total: dict[str, np.ndarray] = {}

        def flush() -> None:
            for lang, n in words.items():
                for names in pieces(list(n)):
                    times = np.fromiter(map(n.__getitem__, names), np.float64, len(names))
                    bucket, word, letters, scripts = grams(names)
                    counts = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    counts[:BUCKETS] += np.bincount(bucket, times[word], BUCKETS).astype(np.int64)
                    counts[BUCKETS:] += np.bincount(scripts[scripts >= 0], (times * letters)[scripts >= 0], len(SCRIPTS)).astype(np.int64)
                n.clear()

        chars = 0
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                low = text.as_py().lower()
                words.setdefault(lang.as_py(), Counter()).update(low.split())
                chars += len(low)
                if chars > COUNT_CHARS or sum(map(len, words.values())) > COUNT_WORDS:
                    flush()
                    chars = 0
        flush()
        for lang, counts in total.items():
            keys, data = [], []
            for low in range(0, len(counts), _CHUNK):
                if counts[low : low + _CHUNK].any():
                    keys.append(f"{low}:{lang}")
                    data.append(counts[low : low + _CHUNK].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(data, pa.binary())], names=["key", "data"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null").mapInArrow(run, "key string, data binary")
    found: dict[str, np.ndarray] = {}
    for r in sum_arrays(rows).collect():
        low, lang = r.key.split(":", 1)
        part = np.frombuffer(r.data, "<i8")
        found.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS)))[int(low) : int(low) + len(part)] = part
    langs = sorted(found)
    if not langs:
        return {"langs": [], "log": np.zeros((BUCKETS, 0), np.float32), "allowed": np.zeros((len(SCRIPTS), 0), bool)}
    counts = np.stack([found[x] for x in langs], axis=1)
    n, by_script = counts[:BUCKETS] + 0.1, counts[BUCKETS:]
    return {"langs": langs, "log": np.log(n / n.sum(axis=0)).astype(np.float32), "allowed": by_script >= np.maximum(1, SCRIPT_SHARE * by_script.sum(axis=0))}


class Labeller:
    """Labels words of texts by a trained model; keeps the scores of words that it has met."""

    def __init__(self, model: dict, switch: float, scale: float):
        self.model, self.switch, self.scale = model, switch, scale
        self._clear()

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._chars = 0
        self._scores = np.zeros((0, len(self.model["langs"])), np.float32)
        self._letters = np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        scores, letters = zip(*map(self._score, pieces(words)), strict=True)
        self._at.update(zip(words, range(len(self._at), len(self._at) + len(words)), strict=True))
        self._chars += sum(map(len, words))
        self._scores = np.concatenate([self._scores, *scores])
        self._letters = np.concatenate([self._letters, *letters])

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [word, lang] and letters of the words."""
        bucket, word, letters, scripts = grams(words)
        s = np.zeros((len(words), len(self.model["langs"])))
        for j in range(s.shape[1]):
            s[:, j] = np.bincount(word, self.model["log"][bucket, j], len(words))
        s *= self.scale
        allowed = self.model["allowed"][scripts] & (scripts >= 0)[:, None]
        narrow = allowed.any(axis=1)
        s[narrow] = np.where(allowed[narrow], s[narrow], s[narrow].min(axis=1, keepdims=True, initial=0) - 10 * self.switch)
        s -= s.max(axis=1, keepdims=True, initial=-np.inf) if s.shape[1] else 0
        s[letters == 0] = 0
        return s.astype(np.float32), letters

    def label(self, texts: list[str]) -> list[tuple[str | None, float, np.ndarray]]:
        """Language, score and the language number of each word, for each text; None where there is no letter."""
        if len(self._at) > CACHE_WORDS or self._chars > CACHE_CHARS:
            self._clear()
        split = [x.lower().split() for x in texts]
        if new := set().union(*split).difference(self._at):
            self._learn(sorted(new))
        at, L = self._at.__getitem__, len(self.model["langs"])
        n = np.array([len(x) for x in split], np.int64)
        order = np.argsort(-n, kind="stable")
        index = np.fromiter((i for d in order for i in map(at, split[d])), np.int64, int(n.sum()))
        del split, new  # the words of a block are larger than all that follows
        S, letters, lengths = self._scores[index], self._letters[index], n[order]
        first = np.cumsum(lengths) - lengths
        path = self._viterbi(S, first, lengths)
        out: list = [None] * len(texts)
        doc = np.repeat(np.arange(len(order)), lengths)
        mass = np.bincount(doc * max(L, 1) + path, letters, len(order) * max(L, 1)).reshape(len(order), -1)
        total = np.stack([np.bincount(doc, S[:, j], len(order)) for j in range(L)], axis=1) if L else np.zeros((len(order), 1))
        for k, d in enumerate(order.tolist()):
            if L and mass[k].sum() > 0:
                best = max(range(L), key=lambda j: (mass[k, j], total[k, j]))
                odds = np.exp(total[k] - total[k, best])
                out[d] = (self.model["langs"][best], float(mass[k, best] / mass[k].sum() / max(1.0, odds.sum())), path[first[k] : first[k] + lengths[k]])
            else:
                out[d] = (None, 0.0, np.full(lengths[k], -1))
        return out

    def _viterbi(self, S: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best language of each word; texts come longest first and go side by side, word by word."""
        path = np.zeros(len(S), np.int64)
        if not len(S) or S.shape[1] < 2:
            return path
        stay, best = np.ones(S.shape, bool), np.zeros(len(S), np.int32)
        going = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts with more than t words
        V = S[first[: going[0]]].astype(np.float64)
        for t in range(1, len(going)):
            g = going[t]
            V, at = V[:g], first[:g] + t
            top = V.argmax(axis=1)
            jump = V[np.arange(g), top] - self.switch
            k = V >= jump[:, None]
            stay[at], best[at] = k, top
            new = np.where(k, V, jump[:, None]) + S[at]
            # texts that end here keep their last values in path, as the label of the last word
            ended = going[t + 1] if t + 1 < len(going) else 0
            path[at[ended:]] = new[ended:].argmax(axis=1)
            V = new
        one = (lengths == 1)
        path[first[one]] = S[first[one]].argmax(axis=1)
        for t in range(len(going) - 1, 0, -1):
            at = first[: going[t]] + t
            label = path[at]
            path[at - 1] = np.where(stay[at, label], label, best[at])
        return path


def spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    """Runs of words of one language, as code point offsets."""
    out: list[dict] = []
    for m, j in zip(re.finditer(r"\S+", text), path.tolist(), strict=True):
        if j >= 0 and out and out[-1]["lang"] == langs[j]:
            out[-1]["end"] = m.end()
        elif j >= 0:
            out.append({"start": m.start(), "end": m.end(), "lang": langs[j]})
    return out


def identify(docs: DataFrame, model: dict, *, keep: tuple[str, ...] = (), switch: float = 8.0, scale: float = 0.5, with_spans: bool = False, text_col: str = "text") -> DataFrame:
    """Rows lang_pred, score, spans and the columns named in keep (renamed before if they clash).

    lang_pred is the language with most letters on the best path, `und` (score
    0) for null texts, texts without a letter, and models without a language.
    score is its share of the letters times its posterior against the others
    over the whole text. spans (with_spans only, else null) are runs of words.
    Whole texts count, however long; equal rows stay; no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])))])
    # a text that is kept anyway goes to the workers once
    at = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType == T.StringType() else len(keep)
    own = [F.col(text_col).cast("string").alias("text of the row")] if at == len(keep) else []
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(shared.value, switch, scale)
        most = max(1, 2_000_000 // max(1, len(lab.model["langs"])))
        for batch in batches:
            column = batch.column(at)
            words = [n // 4 for n in pc.fill_null(pc.utf8_length(column), 0).to_pylist()]
            low = 0
            while low < len(words):
                high, size = low, 0
                while high < len(words) and (high == low or size + words[high] <= most):
                    size += words[high]
                    high += 1
                texts = [x or "" for x in column.slice(low, high - low).to_pylist()]
                found = lab.label(texts)
                marked = [spans(t, p, lab.model["langs"]) if with_spans else None for t, (_, _, p) in zip(texts, found, strict=True)]
                del texts
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([x or "und" for x, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array(marked, kinds)], names=out.names)
                low = high
            pa.default_memory_pool().release_unused()

    return docs.select(*keep, *own).mapInArrow(run, out)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds == fold, F.lit(False))


def fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
