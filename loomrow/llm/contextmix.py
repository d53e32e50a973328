"""Scoring of texts by online logistic context mixing, beside a smoothed word model.

A text is its lower-case words and one end. Each token is a walk down a Huffman
tree of the corpus's most frequent words; a word outside them takes the escape,
and its probability then is a mixture of two: its share in the corpus's words
outside the tree, whose counts are all kept, and its spelling by bytes, down a
tree of their own. Every turn is a bit.
Hashed-context predictors, whose counts come from all training documents, and
one that learns within the text each give a logit for it; weights chosen by the
depth in the tree (the gate) combine them and are updated after every word; an
adaptive map from the mixed logit to a probability refines the result. The bits'
log probabilities add up to the text's.

Long texts are scored in segments side by side: a segment has its left context
and starts from the fitted weights, so a text's score depends on nothing else.

Whatever is learned is learned from all training documents, in sums of integers
of a fixed size, so that it doesn't depend on how the rows are spread: counts,
the code of the bytes, the kinds of texts and the starting weights.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import checkpoint, sum_arrays, text_or_empty

#: Words in the tree, and the slots of each table of hashed contexts: bounds of the model, whatever the corpus.
WORDS, WORD_SLOTS, BYTE_SLOTS = 1 << 16, 1 << 19, 1 << 18
#: Texts of fit_sample, and the characters of each: a piece at a place that its hash chooses.
FIT_DOCS, FIT_CHARS = 256, 1 << 14
#: The last of so many commonest words is a context; so is the kind of text that the commonest words so far tell.
_COMMON, _TELLING, KINDS = 64, 256, 8
#: The kinds are told from the sums of the texts on the same side of the mean in each of so many directions.
_DIRECTIONS = 12
#: Tokens of a segment, and of what is scored side by side.
SEGMENT, _TOGETHER = 256, 1 << 17
_GATES, _ORDERS = 32, (1, 2, 3, 4)
_PLACES = 8
_RATE, _FADE = 0.004, 0.15
_STEPS, _APM_RATE, _APM_TOP = 24, 0.02, 12.0
_OWN = 1 << 9
_TOP = 8
#: Steps to which inputs are rounded for the fit of the starting weights (of words' logits, of what the text has shown, of bytes' logits), and the shape of the counts: gate, inputs, bit.
_STEP, _OWN_STEP, _BYTE_STEP = 0.5, 0.5, 1.0
_OWN_TOP = 7
_WORD_CELLS = (_GATES, int(2 * _TOP / _STEP) + 1, int(2 * _TOP / _STEP) + 1, int(2 * _OWN_TOP / _OWN_STEP) + 1, 2)
_BYTE_CELLS = (_PLACES, *[int(2 * _TOP / _BYTE_STEP) + 1] * len(_ORDERS), 2)
_CHUNK = 1 << 14
#: Words, and bytes after others, whose log probabilities a worker keeps, as powers of two; letters that it counts at once.
_WORDS_KEPT, _BYTES_KEPT, _LETTERS = 20, 20, 1 << 20
_SEED = 7
_SALT = np.uint32(0x9E3779B1)


class Tree:
    """Huffman code of symbols; paths[start[s]:start[s] + length[s]] are the nodes from the root, turns the bits taken."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        least = max(1, int(counts.sum()) >> 18)
        heap = [(max(least, int(c)), s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, turn = np.zeros(2 * n, np.int32), np.zeros(2 * n, np.int8)
        made = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], turn[y] = made, made, 1
            heapq.heappush(heap, (a + b, made))
            made += 1
        paths, turns = [], []
        for s in range(n):
            path, bits = [], []
            while s != made - 1:
                bits.append(turn[s])
                s = parent[s]
                path.append(s - n)
            paths.append(path[::-1])
            turns.append(bits[::-1])
        self.length = np.array([len(x) for x in paths], np.intp)
        self.start = np.cumsum(self.length) - self.length
        depth = np.arange(int(self.length.sum())) - np.repeat(self.start, self.length)
        #: Node, bit and depth of every step of every path, in one number.
        self.packed = (np.array([x for p in paths for x in p], np.uint32) << 6) | (np.array([x for p in turns for x in p], np.uint32) << 5) | np.minimum(depth, _GATES - 1).astype(np.uint32)

    def walk(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of bits of each symbol, and for every bit in a row its packed number."""
        n = self.length.take(symbols)
        at = np.repeat(self.start.take(symbols) - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        return n, self.packed.take(at)


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """32-bit mixing of context numbers."""
    x = (x.astype(np.uint32) + np.uint32(turn * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)


def _node(packed: np.ndarray) -> np.ndarray:
    return packed >> np.uint32(6)


def _turn(packed: np.ndarray) -> np.ndarray:
    return (packed >> np.uint32(5)) & np.uint32(1)


def _slot(context: np.ndarray, salted: np.ndarray, slots: int) -> np.ndarray:
    """Slots of mixed contexts and nodes times an odd number."""
    x = context + salted
    x *= np.uint32(0x7FEB352D)
    x >>= np.uint32(33 - slots.bit_length())
    return x


_INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A number for each byte, and for each place in a word; longer words are hashed by XXH64.
_SHORT = 256
_BYTE, _PLACE = np.random.default_rng(_SEED).integers(1, 1 << 63, (2, _SHORT), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of some texts between ASCII white space, A-Z in lower case: 64-bit hashes, and where their bytes are."""

    def __init__(self, texts: list[str]):
        from xxhash import xxh64_intdigest

        raw = [x.encode().lower() for x in texts]
        self.buffer = b"\n".join([*raw, b""])
        inside = np.append(False, _INSIDE.take(np.frombuffer(self.buffer, np.uint8)))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        ends = np.cumsum([len(x) + 1 for x in raw])
        #: Bytes and words of each text.
        self.bytes = np.array([len(x) for x in raw], np.int64)
        self.n = np.diff(np.searchsorted(self.starts, ends, "left"), prepend=0)
        size = self.ends - self.starts
        self.hash = np.zeros(len(size), np.uint64)
        whole = np.frombuffer(self.buffer, np.uint8)
        for low in range(0, len(size), _TOGETHER):
            sizes = np.minimum(size[low : low + _TOGETHER], _SHORT)
            first = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            chars = whole.take(place + np.repeat(self.starts[low : low + _TOGETHER], sizes))
            x = np.add.reduceat(_BYTE.take(chars) * _PLACE.take(place), first)
            x ^= sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.hash[low : low + _TOGETHER] = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        for i in np.flatnonzero(size > _SHORT).tolist():
            self.hash[i] = xxh64_intdigest(self.word(i), _SEED)

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.intp)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Coder:
    """Symbols of words and the contexts of their bits; symbols are ranks by frequency, then escape and end."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, escapes: int, ends: int):
        self.escape, self.end = len(words), len(words) + 1
        self.counts = np.concatenate([counts, [escapes, ends]]).astype(np.int64)
        self.tree = Tree(self.counts)
        # open addressing by the hashes' upper bits, a quarter full at most
        self._bits = max(4, (4 * len(words)).bit_length())
        self._keys, self._ranks = np.zeros(1 << self._bits, np.uint64), np.full(1 << self._bits, -1, np.int32)
        for rank, h in enumerate(words.view(np.uint64).tolist()):
            at = h >> 64 - self._bits
            while self._ranks[at] >= 0:
                at = (at + 1) & (1 << self._bits) - 1
            self._keys[at], self._ranks[at] = h, rank

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of words by their hashes, the escape for those that aren't in the tree."""
        at = (hashes >> np.uint64(64 - self._bits)).astype(np.intp)
        out = self._ranks.take(at).astype(np.intp)
        wrong = np.flatnonzero((self._keys.take(at) != hashes) & (out >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (1 << self._bits) - 1
            out[wrong] = self._ranks[at[wrong]]
            wrong = wrong[(self._keys[at[wrong]] != hashes[wrong]) & (out[wrong] >= 0)]
        return np.where(out < 0, self.escape, out)

    def symbols(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts in a row, each with its end; first place of each text; the words behind the escapes, in order."""
        found = self.ranks(words.hash)
        first = np.cumsum(words.n + 1) - words.n - 1
        out = np.full(len(found) + len(words.n), self.end, np.intp)
        inside = np.ones(len(out), bool)
        inside[first + words.n] = False
        out[inside] = found
        return out, first, np.flatnonzero(found == self.escape)

    def told(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each of the commonest words occurs in each text."""
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(symbols))))
        telling = symbols < min(_TELLING, self.escape)
        return np.bincount(doc[telling] * _TELLING + symbols[telling], minlength=len(first) * _TELLING).reshape(-1, _TELLING)

    def fit_kinds(self, n: np.ndarray, texts: np.ndarray) -> None:
        """A mixture of multinomials over the commonest words by expectation maximisation: n has their counts in groups of so many texts."""
        n, texts = (n[texts > 0], texts[texts > 0]) if texts.any() else (np.zeros((1, _TELLING)), np.ones(1))
        unit = n / np.maximum(1e-9, np.linalg.norm(n, axis=1, keepdims=True))
        seeds = [int(np.argmax(texts))]  # each the texts least like those before it
        while len(seeds) < min(KINDS, len(n)):
            apart = texts * (1 - (unit @ unit[seeds].T).max(axis=1))
            apart[seeds] = -1
            seeds.append(int(np.argmax(apart)))
        logs = np.log((n[seeds] + 0.1) / (n[seeds] + 0.1).sum(axis=1, keepdims=True))
        for _ in range(30):
            fit = n / texts[:, None] @ logs.T
            share = np.exp(fit - fit.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            m = share.T @ n + 0.1
            logs = np.log(m / m.sum(axis=1, keepdims=True))
        self.telling = np.zeros((len(self.counts), len(seeds)), np.float32)
        self.telling[: min(_TELLING, self.escape)] = (logs - logs.max(axis=0)).T[: min(_TELLING, self.escape)]

    def contexts(self, symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: the last common word before it (_COMMON at the start), and the kind of text by the words before it."""
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[first] = self.end
        last = lambda mark: np.maximum.accumulate(np.where(mark, np.arange(len(before)), 0))
        common = before[last((before < _COMMON) | (before == self.end))]
        common = np.where(common == self.end, _COMMON, common)
        at = np.flatnonzero((before < _TELLING) | (before == self.end))
        told = np.cumsum(self.telling[before[at]], axis=0, dtype=np.float64)
        starts = np.searchsorted(at, first)
        told -= np.repeat(told[starts], np.diff(np.append(starts, len(at))), axis=0)
        return common, np.repeat(told.argmax(axis=1), np.diff(np.append(at, len(before))))

    def letters(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every byte of some words, spelled with a terminator: number of the word, and in one number the byte, those before it in the word and its place."""
        size = words.ends[at] - words.starts[at] + 1
        last = np.cumsum(size) - 1
        of = np.repeat(np.arange(len(at)), size)
        place = np.arange(len(of)) - np.take(last + 1 - size, of)
        raw = np.frombuffer(words.buffer, np.uint8).take(place + words.starts[at].take(of))
        symbols = raw.astype(np.uint64)
        symbols[last] = 256
        key = symbols.copy()
        for back in range(1, max(_ORDERS) + 1):
            earlier = np.zeros(len(raw), np.uint64)
            earlier[back:] = symbols[: max(0, len(raw) - back)] + np.uint64(1)
            earlier[place < back] = 0
            key |= earlier << np.uint64(9 * back)
        return of, key | np.minimum(place, _PLACES - 1).astype(np.uint64) << np.uint64(60)

    def spelled(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """For every bit of bytes in such numbers: number of the byte, bit, place in the word; slots for each order."""
        n, packed = self.bytes.walk((keys & np.uint64(511)).astype(np.intp))
        salted = _node(packed) * _SALT
        slots, context = [], np.zeros(len(keys), np.uint32)
        for back in range(1, max(_ORDERS) + 1):
            context = context * np.uint32(0x01000193) + (keys >> np.uint64(9 * back) & np.uint64(511)).astype(np.uint32)
            if back in _ORDERS:
                slots.append(_slot(np.repeat(_mixed(context, back), n), salted, BYTE_SLOTS))
        return np.repeat(np.arange(len(keys)), n), _turn(packed), np.repeat((keys >> np.uint64(60)).astype(np.intp), n), slots


def _logit(n: np.ndarray) -> np.ndarray:
    """Of [slot, bit] counts."""
    return np.clip(np.log((n[..., 1] + 0.4) / (n[..., 0] + 0.4)), -_TOP, _TOP).astype(np.float32)


def _newton(x: np.ndarray, n: np.ndarray, gate: np.ndarray, gates: int, start: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression for each gate, drawn to start where there is little to learn from; n counts the bits 0 and 1 of each input."""
    out = np.tile(start, (gates, 1))
    for g in range(gates):
        a, ones, both = x[gate == g].astype(np.float64), n[gate == g, 1], n[gate == g].sum(axis=1)
        w = start.copy()
        for _ in range(12 if len(a) else 0):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (p * both - ones) + 10.0 * (w - start)
            step = np.linalg.solve((a * (p * (1 - p) * both)[:, None]).T @ a + 10.0 * np.eye(len(w)), grad)
            w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        out[g] = w
    return out.astype(np.float32)


def _lanes(first: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Tokens in the order of their places in segments, the segment of each, the bounds of the places, and the text of each segment."""
    length = np.diff(np.append(first, total))
    doc = np.repeat(np.arange(len(first)), length)
    place = np.arange(total) - first[doc]
    segments = -(-length // SEGMENT)
    lane = (np.cumsum(segments) - segments)[doc] + place // SEGMENT
    place = (place % SEGMENT).astype(np.int16)
    order = np.argsort(place, kind="stable")
    return order, lane[order], [0, *np.cumsum(np.bincount(place)).tolist()], np.repeat(np.arange(len(first)), segments)


def _steps(coder: Coder, tables: dict, symbols: np.ndarray, first: np.ndarray, lanes: tuple) -> Iterator[tuple[np.ndarray, ...]]:
    """For each place in the segments: every bit's segment, depth and own slot, the bit, and what the tables have of it."""
    order, lane, bounds, _ = lanes
    marks = (_mixed(np.arange(n), i) for i, n in ((1, _COMMON + 1), (2, KINDS)))
    common, kind = (m.take(c[order]) for m, c in zip(marks, coder.contexts(symbols, first), strict=True))
    symbols = symbols[order]
    for low, high in zip(bounds, bounds[1:], strict=False):
        n, packed = coder.tree.walk(symbols[low:high])
        node = _node(packed)
        salted = node * _SALT
        x = [tables[k].take(_slot(np.repeat(c[low:high], n), salted, WORD_SLOTS)) for k, c in (("common", common), ("kind", kind))]
        yield np.repeat(lane[low:high], n), packed & np.uint32(_GATES - 1), node & np.uint32(_OWN - 1), _turn(packed).astype(np.float32), x


class Mixer:
    """Log probabilities of texts, by the broadcast model."""

    def __init__(self, coder: Coder, model: dict):
        self.coder, self.model = coder, model
        # log probabilities of spelled words; an empty slot has a hash that belongs elsewhere
        self._hashes, self._spelled = ~(np.arange(1 << _WORDS_KEPT, dtype=np.uint64) << np.uint64(64 - _WORDS_KEPT)), np.zeros(1 << _WORDS_KEPT)
        # log probabilities of bytes after others, which come again and again
        self._keys, self._logs = np.full(1 << _BYTES_KEPT, (1 << 64) - 1, np.uint64), np.zeros(1 << _BYTES_KEPT)

    def spelled(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Natural log probability of the spelling of some of the words."""
        h = words.hash.take(at)
        slot = (h >> np.uint64(64 - _WORDS_KEPT)).astype(np.intp)
        out = self._spelled.take(slot)
        new = np.flatnonzero(self._hashes.take(slot) != h)
        if len(new):
            found, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = at[new[first]]
            size = np.cumsum(words.ends[one] - words.starts[one] + 1)
            made, low = np.zeros(len(one)), 0
            while low < len(one):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + _TOGETHER, "right")))
                made[low:high] = self.spelling(words, one[low:high])
                low = high
            out[new] = made[back]
            slot = slot[new[first]]
            self._hashes[slot], self._spelled[slot] = found, made
        return out

    def spelling(self, words: Words, which: np.ndarray) -> np.ndarray:
        word, keys = self.coder.letters(words, which)
        at = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BYTES_KEPT)).astype(np.intp)
        logs = self._logs.take(at)
        new = np.flatnonzero(self._keys.take(at) != keys)
        if len(new):
            found, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            of, bit, place, slots = self.coder.spelled(found)
            w = np.ascontiguousarray(self.model["bytes"].T)
            z = w[0].take(place)
            for i, (o, s) in enumerate(zip(_ORDERS, slots, strict=True)):
                z += w[i + 1].take(place) * self.model["logits"][f"order {o}"].take(s)
            made = np.bincount(of, _log_p(z, bit), len(found))
            logs[new] = made[back]
            self._keys[at[new[first]]], self._logs[at[new[first]]] = found, made
        return np.bincount(word, logs, len(which))

    def words(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log probability of the symbols of each text."""
        lanes = _lanes(first, len(symbols))
        n, total = len(lanes[3]), np.zeros(len(lanes[3]))
        recent = np.zeros(n * _OWN, np.float32)
        weights = [np.tile(w, n) for w in np.ascontiguousarray(self.model["words"].T)]
        refined = np.tile(np.linspace(-_APM_TOP, _APM_TOP, _STEPS, dtype=np.float32), n * _GATES)
        rate, fade, learn = np.float32(_RATE), np.float32(1 - _FADE), np.float32(_APM_RATE)
        scale, middle = np.float32((_STEPS - 1) / (2 * _APM_TOP)), np.float32(_STEPS / 2)
        for lane, depth, own, y, x in _steps(self.coder, self.model["logits"], symbols, first, lanes):
            own = lane * _OWN + own
            g = lane * _GATES + depth
            x.append(recent.take(own))
            w = [a.take(g) for a in weights]
            z = w[0] * x[0]
            z += w[1] * x[1]
            z += w[2] * x[2]
            p = _sigmoid(z)
            e = (y - p) * rate
            for k in range(3):
                weights[k][g] = w[k] + e * x[k]
            recent[own] = x[2] * fade + (2 * y - 1)
            z *= scale
            z += middle
            j = np.clip(z, 0, _STEPS - 1, out=z).astype(np.intp)
            j += g * _STEPS
            r = refined.take(j)
            q = _sigmoid(r)
            refined[j] = r + learn * (y - q)
            # the mixed probability with a quarter of the refined one, for the bit that came
            p *= 0.75
            p += 0.25 * q
            total += np.bincount(lane, np.log(np.maximum(np.abs(1 - y - p), 1e-7)), n)
        return np.bincount(lanes[3], total, len(first))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    p = np.exp(-z)
    p += 1
    return np.reciprocal(p, out=p)


def _log_p(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return np.log(_sigmoid(np.where(bit == 1, z, -z)))


def _parts(texts: list[str]) -> Iterator[tuple[int, int, Words]]:
    """Runs of texts of a bounded size, with the places of the first and the last; a longer text stands alone."""
    low = size = 0
    for i, x in enumerate(texts):
        if i > low and size + len(x) > 8 * _TOGETHER:
            yield low, i, Words(texts[low:i])
            low, size = i, 0
        size += len(x) + 8
    if texts:
        yield low, len(texts), Words(texts[low:])


def _halves(texts: list[str]) -> Iterator[tuple[int, Words]]:
    """Runs of the texts of either half of a corpus, with the number of the half; copies lie in the same."""
    half = [zlib.crc32(x.encode()) & 1 for x in texts]
    for h in (0, 1):
        for _, _, words in _parts([x for x, y in zip(texts, half, strict=True) if y == h]):
            yield h, words


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows h, c: how often each word (by its 64-bit hash) occurs in the column text; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["h", "n"])
        for batch in batches:
            for _, _, words in _parts(batch.column(0).to_pylist()):
                held.append(np.unique(words.hash, return_counts=True))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [_sums(*map(np.concatenate, zip(*held, strict=True)))]
                    if (size := len(held[0][0])) > 1_000_000:
                        yield row()
                        held, size = [], 0
        if held:
            held = [_sums(*map(np.concatenate, zip(*held, strict=True)))]
            yield row()

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, by count and then hash: all above the least count that leaves no more than most.

    Words that occur once aren't among them: to a text outside the corpus they
    are as good as new, and tell how often new words come. Counts of 1024 and
    more are cut in steps of a hundredth. Only these words and a table of counts
    come to the driver.
    """
    counts = counts.where("c > 1")
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(F.log2(F.col("c") / 1024) * 64)).cast("long")
    sizes = sorted(((r.s, r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        if total + n > most:
            break
        total, least = total + n, s
    found = [] if least is None else counts.where(step >= least).collect()
    found.sort(key=lambda r: (-r.c, r.h))
    return np.array([r.h for r in found], np.int64), np.array([r.c for r in found], np.int64)


#: A word outside the tree in a text: its hash, and its log probability if it were new.
_RARE = np.dtype([("h", "<u8"), ("new", "<f4")])

#: Tables of hashed contexts and their slots.
_TABLES = {"common": WORD_SLOTS, "kind": WORD_SLOTS} | {f"order {o}": BYTE_SLOTS for o in _ORDERS}


class _Spelled:
    """Hands on the letters of words outside the tree, each different one once with its count, when there are many."""

    def __init__(self, coder: Coder, use: Callable[[np.ndarray, np.ndarray], None]):
        self.coder, self.use = coder, use
        self._held: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, words: Words, escaped: np.ndarray) -> None:
        _, at, n = np.unique(words.hash[escaped], return_index=True, return_counts=True)
        letters = np.cumsum((words.ends - words.starts)[escaped[at]] + 1)
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(letters, (letters[low - 1] if low else 0) + _TOGETHER, "right")))
            word, keys = self.coder.letters(words, escaped[at[low:high]])
            self._held.append(_sums(keys, n[low:high][word]))
            low = high
        if sum(len(k) for k, _ in self._held) > _LETTERS:
            self.flush()

    def flush(self) -> None:
        if self._held:
            keys, n = _sums(*map(np.concatenate, zip(*self._held, strict=True)))
            for low in range(0, len(keys), _TOGETHER):
                self.use(keys[low : low + _TOGETHER], n[low : low + _TOGETHER])
            self._held.clear()


def tally(coder: Coder, runs: Iterator[tuple[int, Words]]) -> dict[str, np.ndarray]:
    """Counts ([half, 2 * slot + bit]) of every table over runs of texts; symbols are counted by context and then walked."""
    total = {k: np.zeros((2, 2 * n), np.int64) for k, n in _TABLES.items()}
    size, tokens = len(coder.counts), 0
    met = {"common": np.zeros((2, (_COMMON + 1) * size), np.int32), "kind": np.zeros((2, KINDS * size), np.int32)}

    def add(name: str, half: int, slot: np.ndarray, bit: np.ndarray, n: np.ndarray) -> None:
        np.add.at(total[name][half], 2 * slot.astype(np.intp) + bit, n)

    def spell(half: int, keys: np.ndarray, n: np.ndarray) -> None:
        of, bit, _, slots = coder.spelled(keys)
        for o, s in zip(_ORDERS, slots, strict=True):
            add(f"order {o}", half, s, bit, n[of])

    def walk() -> None:
        for turn, (name, found) in enumerate(met.items(), 1):
            for half, n in enumerate(found):
                there = np.flatnonzero(n)
                for low in range(0, len(there), _TOGETHER):
                    context, symbol = np.divmod(there[low : low + _TOGETHER], size)
                    bits, packed = coder.tree.walk(symbol)
                    add(name, half, _slot(np.repeat(_mixed(context, turn), bits), _node(packed) * _SALT, WORD_SLOTS), _turn(packed), np.repeat(n[there[low : low + _TOGETHER]].astype(np.int64), bits))
                n[there] = 0

    spelled = [_Spelled(coder, lambda keys, n, half=half: spell(half, keys, n)) for half in (0, 1)]
    for half, words in runs:
        symbols, first, escaped = coder.symbols(words)
        spelled[half].add(words, escaped)
        tokens += len(symbols)
        if tokens >= 1 << 31:
            walk()
            tokens = len(symbols)
        for name, context in zip(met, coder.contexts(symbols, first), strict=True):
            key, n = np.unique(context * size + symbols, return_counts=True)
            met[name][half, key] += n.astype(np.int32)
    for x in spelled:
        x.flush()
    walk()
    return total


def fit_cells(coder: Coder, codes: list[dict[str, np.ndarray]], runs: Iterator[tuple[int, Words]]) -> dict[str, np.ndarray]:
    """Bits of runs of texts by gate, inputs and bit (_WORD_CELLS, _BYTE_CELLS); codes are the logits that each half meets, in steps."""
    total = {"words": np.zeros(_WORD_CELLS, np.int64).ravel(), "bytes": np.zeros(_BYTE_CELLS, np.int64).ravel()}

    def spell(half: int, keys: np.ndarray, n: np.ndarray) -> None:
        of, bit, cell, slots = coder.spelled(keys)
        for i, (o, s) in enumerate(zip(_ORDERS, slots, strict=True), 1):
            cell = cell * _BYTE_CELLS[i] + codes[half][f"order {o}"].take(s)
        np.add.at(total["bytes"], 2 * cell + bit, n[of])

    spelled = [_Spelled(coder, lambda keys, n, half=half: spell(half, keys, n)) for half in (0, 1)]
    for half, words in runs:
        symbols, first, escaped = coder.symbols(words)
        spelled[half].add(words, escaped)
        lanes = _lanes(first, len(symbols))
        recent = np.zeros(len(lanes[3]) * _OWN, np.float32)
        for lane, depth, own, y, x in _steps(coder, codes[half], symbols, first, lanes):
            own = lane * _OWN + own
            shown = recent.take(own)
            cell = (depth.astype(np.int32) * _WORD_CELLS[1] + x[0]) * _WORD_CELLS[2] + x[1]
            cell = (cell * _WORD_CELLS[3] + np.rint((shown + _OWN_TOP) / _OWN_STEP).astype(np.int32)) * 2 + y.astype(np.int32)
            np.add.at(total["words"], cell, 1)
            recent[own] = shown * np.float32(1 - _FADE) + (2 * y - 1)
    for x in spelled:
        x.flush()
    return total


def _summed(texts: DataFrame, sizes: dict[str, int], count: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums of what count gives in every task, flat; arrays leave the tasks in pieces and are summed by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, x in count(batches).items():
            x = x.ravel()
            at = [low for low in range(0, len(x), _CHUNK) if x[low : low + _CHUNK].any()]
            if at:
                yield pa.RecordBatch.from_arrays([pa.array([f"{low}:{k}" for low in at], pa.string()), pa.array([x[low : low + _CHUNK].astype("<i8").tobytes() for low in at], pa.binary())], names=["key", "data"])

    out = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    for r in sum_arrays(texts.mapInArrow(run, "key string, data binary")).toLocalIterator():
        low, k = r.key.split(":", 1)
        part = np.frombuffer(r.data, "<i8")
        out[k][int(low) : int(low) + len(part)] = part
    return out


def context_counts(texts: DataFrame, coder: Coder) -> dict[str, np.ndarray]:
    """[half, slot, bit] counts of every table over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(coder)
    found = _summed(texts.select("text"), {k: 4 * n for k, n in _TABLES.items()}, lambda batches: tally(shared.value, (x for batch in batches for x in _halves(batch.column(0).to_pylist()))))
    return {k: x.reshape(2, -1, 2) for k, x in found.items()}


def fit_weights(texts: DataFrame, coder: Coder, tables: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Starting weights of words' and bytes' bits, fitted to all texts; each meets the tables of the half that it isn't in."""
    step = {k: _STEP if n == WORD_SLOTS else _BYTE_STEP for k, n in _TABLES.items()}
    codes = [{k: np.rint((_logit(x[1 - half]) + _TOP) / step[k]).astype(np.uint8) for k, x in tables.items()} for half in (0, 1)]
    shared = texts.sparkSession.sparkContext.broadcast((coder, codes))
    shapes = {"words": _WORD_CELLS, "bytes": _BYTE_CELLS}
    found = _summed(texts.select("text"), {k: int(np.prod(x)) for k, x in shapes.items()}, lambda batches: fit_cells(*shared.value, (x for batch in batches for x in _halves(batch.column(0).to_pylist()))))
    n = found["words"].reshape(-1, 2)
    there = np.flatnonzero(n.any(axis=1))
    gate, common, kind, own = np.unravel_index(there, _WORD_CELLS[:-1])
    x = np.stack([common * _STEP - _TOP, kind * _STEP - _TOP, own * _OWN_STEP - _OWN_TOP], axis=1)
    out = {"words": _newton(x, n[there], gate, _GATES, np.array([0.4, 0.6, 0.1]))}
    n = found["bytes"].reshape(-1, 2)
    there = np.flatnonzero(n.any(axis=1))
    place, *orders = np.unravel_index(there, _BYTE_CELLS[:-1])
    x = np.stack([np.ones(len(there)), *(o * _BYTE_STEP - _TOP for o in orders)], axis=1)
    return out | {"bytes": _newton(x, n[there], place, _PLACES, np.array([0, 0.1, 0.2, 0.3, 0.4]))}


def _whole(n: np.ndarray) -> np.ndarray:
    """Rows of counts as whole numbers, brought to a length of 256: their sums are the same in any order."""
    return np.rint(256 * n / np.maximum(1e-9, np.linalg.norm(n, axis=1, keepdims=True)))


def fit_code(texts: DataFrame, coder: Coder) -> None:
    """Sets the coder's code of bytes, by those of all words outside the tree, and its kinds, by the commonest words of all texts.

    Texts on the same side of the mean in each of the principal directions of
    the commonest words' counts are one group; the kinds are fitted to the
    groups' sums, all texts of a group as one.
    """
    shared = texts.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda key, data: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([data], pa.binary())], names=["key", "data"])
        coder = shared.value
        spelled, moment = np.zeros(257, np.int64), np.zeros((_TELLING + 1, _TELLING), np.int64)
        texts = 0
        for batch in batches:
            for _, _, words in _parts(batch.column(0).to_pylist()):
                symbols, first, escaped = coder.symbols(words)
                outside = np.zeros(len(words.hash), bool)
                outside[escaped] = True
                raw = np.frombuffer(words.buffer, np.uint8)
                spelled[:256] += np.bincount(raw[_INSIDE.take(raw)][np.repeat(outside, words.ends - words.starts)], minlength=256)
                spelled[256] += len(escaped)
                for low in range(0, len(first), 4096):
                    high = min(len(first), low + 4096)
                    a, z = first[low], first[high] if high < len(first) else len(symbols)
                    n = coder.told(symbols[a:z], first[low:high] - a)
                    u = _whole(n)
                    moment[:-1] += (u.T @ u).astype(np.int64)
                    moment[-1] += u.sum(axis=0).astype(np.int64)
                    at = np.flatnonzero(n)
                    parts = np.count_nonzero(n, axis=1).astype("<u2"), (at % _TELLING).astype("u1"), n.ravel()[at].astype("<i8")
                    yield row("kinds", len(n).to_bytes(8, "little") + zlib.compress(b"".join(x.tobytes() for x in parts), 1))
                texts += len(first)
        if texts:
            yield row("bytes", spelled.tobytes())
            yield row("moment", moment.tobytes())
            yield row("texts", np.array([texts], "<i8").tobytes())

    made = checkpoint(texts.select("text").mapInArrow(run, "key string, data binary"))
    sums = {r.key: np.frombuffer(r.data, "<i8") for r in sum_arrays(made.where("key <> 'kinds'")).collect()}
    coder.bytes = Tree(1 + sums.get("bytes", np.zeros(257, np.int64)))
    moment, n_texts = sums.get("moment", np.zeros((_TELLING + 1) * _TELLING)).reshape(_TELLING + 1, _TELLING).astype(np.float64), max(1, int(sums.get("texts", [0])[0]))
    mean = moment[-1] / n_texts
    ways = np.rint(np.linalg.eigh(moment[:-1] / n_texts - np.outer(mean, mean))[1][:, -_DIRECTIONS:] * (1 << 20))
    middle = mean @ ways

    def group(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((1 << _DIRECTIONS, _TELLING + 1), np.int64)
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                size, raw = int.from_bytes(data[:8], "little"), zlib.decompress(data[8:])
                met = np.frombuffer(raw, "<u2", size)
                word = np.frombuffer(raw, "u1", int(met.sum()), 2 * size)
                n = np.zeros((size, _TELLING), np.int64)
                n[np.repeat(np.arange(size), met), word] = np.frombuffer(raw, "<i8", len(word), 2 * size + len(word))
                np.add.at(total, (_whole(n) @ ways > middle) @ (1 << np.arange(_DIRECTIONS)), np.append(n, np.ones((size, 1), np.int64), axis=1))
        return {"groups": total}

    groups = _summed(made.where("key = 'kinds'").select("data"), {"groups": (_TELLING + 1) << _DIRECTIONS}, group)["groups"].reshape(-1, _TELLING + 1)
    coder.fit_kinds(groups[:, :-1].astype(np.float64), groups[:, -1].astype(np.float64))


def fit_sample(texts: DataFrame) -> list[str]:
    """The pieces of FIT_DOCS distinct texts, chosen by their hashes; of a longer text whole words of FIT_CHARS characters somewhere in it.

    A look into a corpus; the model learns nothing from it.
    """
    by = F.xxhash64("text")
    least = [r.h for r in texts.select(by.alias("h")).distinct().orderBy("h").limit(FIT_DOCS).collect()]
    piece = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(text, {_SEED}), greatest(1, char_length(text) - {FIT_CHARS - 1})) as int), {FIT_CHARS})")
    rows = texts.where(by.isin(least)).groupBy(by.alias("h")).agg(F.min(F.struct(piece.alias("piece"), (F.char_length("text") > FIT_CHARS).alias("cut"))).alias("p")).select("h", "p.*")
    # the words at both ends of a piece may be cut
    return [" ".join(re.split(r"[\x20\x09-\x0D]+", r.piece)[1:-1]) if r.cut else r.piece for r in rows.orderBy("h").collect()]


def train(docs: DataFrame, *, words: int = WORDS, text_col: str = "text") -> dict:
    """The model of the rows' texts (null: empty): coder, logits, weights, and of the word model N, V, ends and the counts (a DataFrame h, c).

    All that is learned comes from all rows, other columns are ignored, and no
    rows give a model that holds all words alike. The starting weights are
    fitted to every text by the tables of the half of the corpus that it isn't
    in. outside holds what a word outside the tree needs: the occurrences of
    such words in training, the discount that each of their counts has, and the
    share of new words that all discounts make.
    """
    texts = docs.select(text_or_empty(text_col).alias("text"))
    counts = checkpoint(word_counts(texts))
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    ends = texts.count()
    names, n = frequent(counts, words)
    escapes, discount = int(seen.n - n.sum()), (seen.once + 0.5) / (seen.once + 2 * seen.twice + 1)
    outside = {"n": escapes, "discount": discount, "new": discount * (seen.v - len(names)) / escapes if escapes else 1.0}
    coder = Coder(names, n, escapes, ends)
    fit_code(texts, coder)
    tables = context_counts(texts, coder)
    model = fit_weights(texts, coder, tables)
    model["logits"] = {k: _logit(x.sum(axis=0)) for k, x in tables.items()}
    return {"coder": coder, "mixer": model, "n": int(seen.n) + ends, "v": int(seen.v) + (ends > 0), "ends": ends, "counts": counts, "outside": outside}


def score(docs: DataFrame, model: dict, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Rows of keep, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, one for each row of docs.

    score and base_score are log10 probabilities of the text's tokens by the
    mixing model and by the add-one word model; bits_per_byte is the former's
    cost over the text's UTF-8 bytes (null for a text of none). n_known counts
    the tokens that occur in training. Null and empty texts are the end alone.
    Repeated rows and null ids stay; whole texts count, however long; columns
    not in keep are ignored, no rows give none. An untrained model spells all.

    Counts of words outside the tree come back by a join on their hashes, so
    nothing that grows with the corpus is broadcast; with them come both words'
    parts in base_score and the share of a known word in the mixture.
    """
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("row of the text"), text_or_empty(text_col).alias("text of the row"))
    shared = docs.sparkSession.sparkContext.broadcast((model["coder"], model["mixer"], model["ends"], float(np.log(model["outside"]["new"]))))
    made = T.StructType([*(docs.schema[c] for c in keep), T.StructField("row of the text", T.LongType()), *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("known", T.LongType()), ("logs", T.DoubleType()), ("score", T.DoubleType()), ("bytes", T.LongType()), ("rare", T.BinaryType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, numbers, ends, log_new = shared.value
        mixer = Mixer(coder, numbers)
        log_count = np.log10(np.where(np.arange(len(coder.counts)) == coder.escape, 0, coder.counts) + 1.0)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for low, high, words in _parts(texts):
                symbols, first, escaped = coder.symbols(words)
                doc = np.repeat(np.arange(high - low), words.n + 1)
                of = np.repeat(np.arange(high - low), words.n)[escaped]
                count = lambda x, w=None: np.bincount(x, w, high - low)  # noqa: B023, E731
                rare = np.zeros(len(escaped), _RARE)
                rare["h"], rare["new"] = words.hash[escaped], log_new + mixer.spelled(words, escaped)
                logs = mixer.words(symbols, first) + count(of, rare["new"])
                known = words.n - count(of) + (ends > 0)
                bounds = np.append(0, np.cumsum(count(of)))
                cols = [words.n + 1, known.astype(np.int64), count(doc, log_count[symbols]), logs / np.log(10), words.bytes]
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns[:-1], *map(pa.array, cols), pa.array([rare[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=made.names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                raws = part.column(1).to_pylist()
                rare = np.frombuffer(b"".join(raws), _RARE)
                row = np.repeat(part.column(0).to_numpy(), [len(x) // _RARE.itemsize for x in raws])
                order = np.lexsort((rare["h"], row))
                h, new, row = rare["h"][order].view(np.int64), rare["new"][order], row[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(h[first]), pa.array(np.diff(np.append(first, len(h))).astype(np.int64)), pa.array(new[first])], names=["row of the text", "h", "times", "new"])

    scored = checkpoint(rows.mapInArrow(run, made))
    rare = scored.select("row of the text", "rare").mapInArrow(unpack, "`row of the text` long, h long, times long, new float")
    # of log(known + new), with both as logs, what is over log(new)
    apart = F.log((F.col("c") - model["outside"]["discount"]) / float(model["outside"]["n"] or 1)) - F.col("new").cast("double")
    gained = F.greatest(apart, F.lit(0.0)) + F.log1p(F.exp(-F.abs(apart)))
    found = rare.join(model["counts"], "h").groupBy("row of the text").agg(F.sum("times").alias("known here"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs here"), F.sum(F.col("times") * gained).alias("gained here"))
    out = scored.join(found, "row of the text", "left").withColumn("score", F.col("score") + F.coalesce("gained here", F.lit(0.0)) / float(np.log(10)))
    none = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    base = F.col("logs") + none("logs here", 0.0) - F.col("n_tokens") * float(np.log10(model["n"] + model["v"] + 1))
    return out.select(
        *keep,
        "n_tokens",
        (F.col("known") + none("known here", 0)).alias("n_known"),
        F.lit(model["n"]).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        F.when(F.col("bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte"),
    )
