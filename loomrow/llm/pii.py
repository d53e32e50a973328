"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field looks at the regions around digits and at-signs that no base span
covers. Candidate segments are scored as wholes (digits, checksum, grouping,
surroundings, a cue word before them); a dynamic programme over segments of
bounded length chooses boundaries and types jointly. Its weights are fitted by
maximum likelihood to a bounded, seeded sample of written examples.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: Tokens and characters of a segment at most.
MOST_TOKENS, MOST_CHARS = 24, 80
#: Characters from which a stretch is scored for all its segments at once.
_LONG = 400
#: Tokens scored at once.
_AT_ONCE = 4096
#: Written examples that the weights are fitted to, and rounds over them.
EXAMPLES, ROUNDS = 700, 5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches, leftmost and non-overlapping in each kind; found in linear time."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                size = sum(map(len, four)) + 3
                if all(map(_small, four)):
                    out.append(("ip", at, at + size))
                at += size + 1
    for m in _CARD.finditer(text):
        if 13 <= len(m[0]) <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# a bracketed at or dot is one token with the blanks around it, so that no address is too long for a segment's tokens
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+| ?[\[(] ?(?:at|dot) ?[\])] ?|\s|[^A-Za-z0-9\s]", re.I)
_NUMERIC = re.compile(r"[+(]?[0-9](?:[ ().\-/:\[\]+]{0,3}+[0-9])+")
_ANCHOR = re.compile(r"@|[\[(] ?at ?[\])]", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*(?:@| @ |@ | ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)+", re.I)
_IP = re.compile(r"[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|\(\.\))[0-9]{1,3}){3}")
_CARDLIKE = re.compile(r"[0-9]+(?:[ .-][0-9]+)*")
_PHONELIKE = re.compile(r"(?:\+ ?)?\(?[0-9]+\)?(?:[ .\-/]{0,2}\(?[0-9]+\)?)*")
#: Characters before a segment that cue words are looked for in.
_CONTEXT = 24
#: What goes on behind an address that is cut too early, within so many characters.
_GOES_ON, _BEHIND = re.compile(r" ?[\[(] ?dot ?[\])] ?\w", re.I), 10
_CUES = {"phone": {"tel", "phone", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "whatsapp"}, "card": {"card", "visa", "mastercard", "karte", "carte", "tarjeta", "credit"}, "ip": {"ip", "host", "server", "address", "ping"}, "email": {"email", "mail", "e-mail", "contact", "correo"}}


def candidates(kind: str, span: str) -> bool:
    """Whether a segment can be of a kind at all."""
    if kind == "email":
        return bool(_EMAIL.fullmatch(span))
    if kind == "ip":
        return bool(_IP.fullmatch(span)) and all(map(_small, re.findall("[0-9]+", span)))
    n = len(_digits(span))
    if kind == "card":
        return 13 <= n <= 19 and bool(_CARDLIKE.fullmatch(span))
    return 7 <= n <= 15 and bool(_PHONELIKE.fullmatch(span))


def _beside(c: str, far: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "join" if c in "+-./:_@#=" and far[:1].isalnum() else "other"


def features_before(kind: str, text: str, start: int) -> list[str]:
    """Of what stands before a segment."""
    words = re.findall(r"[^\W\d_]+", text[max(0, start - _CONTEXT) : start].lower())[-2:]
    out = ["bias", f"left {_beside(text[start - 1 : start], text[max(0, start - 2) : start - 1] if start > 1 else '')}"]
    return out + ["cue"] * any(w in _CUES[kind] for w in words) + ["other cue"] * any(w in c for k, c in _CUES.items() if k != kind for w in words)


def features_behind(text: str, end: int) -> list[str]:
    if _GOES_ON.match(text, end, end + _BEHIND):
        return ["right goes on"]
    return [f"right {_beside(text[end : end + 1], text[end + 1 : end + 2])}"]


def features_of_shape(kind: str, span: str) -> list[str]:
    """Of a segment itself, as far as its digits' values don't count."""
    groups = [len(x) for x in re.findall("[0-9]+", span)]
    seps = {x for x in re.findall(r"[^0-9]+", span.strip("+()"))}
    shape = "-".join(map(str, groups)) if len(groups) < 6 else "many"
    if kind == "email":
        return [f"plain {'@' in span}", f"long tail {len(span.rsplit('.', 1)[-1]) > 8}"]
    if kind == "ip":
        return []
    n = sum(groups)
    out = [f"digits {n}", f"seps {len(seps)}", f"groups {shape}" if n > 6 else "few", f"plus {span[0] == '+'}", f"bracket {'(' in span}"]
    return out + [f"lone group {len(groups) == 1} {span[0] == '+'}"] * (kind == "phone")


def feature_of_check(n: int, good: bool) -> str:
    return f"luhn {good} {n in (13, 14, 15, 16, 19)}"


def features_of_value(kind: str, span: str) -> list[str]:
    if kind == "card":
        return [feature_of_check(len(_digits(span)), luhn(_digits(span)))]
    if kind == "ip":
        return [f"dots {'.'.join(re.findall('[0-9]+', span)) == span}", f"zeros {any(x[0] == '0' and len(x) > 1 for x in re.findall('[0-9]+', span))}"]
    return []


def features(kind: str, text: str, start: int, end: int) -> list[str]:
    """Of a whole segment; all are on or off."""
    span = text[start:end]
    return [f"{kind} {x}" for x in (*features_before(kind, text, start), *features_behind(text, end), *features_of_shape(kind, span), *features_of_value(kind, span))]


class Region:
    """Tokens of a stretch of text and its candidate segments, listed by the token they end before."""

    def __init__(self, text: str, start: int, end: int):
        self.at = [start + m.start() for m in _TOKEN.finditer(text[start:end])] + [end]
        n = len(self.at) - 1
        self.ending: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(n + 1)]
        can_start = [text[a].isalnum() or text[a] in "+(" for a in self.at[:-1]]
        can_end = [text[a - 1].isalnum() or text[a - 1] == ")" for a in self.at[1:]]
        for j in range(1, n + 1):
            for i in range(max(0, j - MOST_TOKENS), j) if can_end[j - 1] else ():
                if can_start[i] and 7 <= self.at[j] - self.at[i] <= MOST_CHARS:
                    span = text[self.at[i] : self.at[j]]
                    self.ending[j] += [(i, k, features(k, text, self.at[i], self.at[j])) for k in KINDS if candidates(k, span)]

    def best(self, weights: dict[str, float]) -> list[Span]:
        """The segmentation of highest score; single tokens are outside for 0."""
        return best_segments(self.at, [[(i, kind, sum(weights.get(f, 0.0) for f in fs)) for i, kind, fs in x] for x in self.ending])

    def expected(self, weights: dict[str, float]) -> tuple[float, list[tuple[float, list[str]]]]:
        """Log of the sum over all segmentations, and each segment's probability with its features."""
        n, add = len(self.ending), lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
        value = [[(i, sum(weights.get(f, 0.0) for f in fs), fs) for i, _, fs in x] for x in self.ending]
        ahead = [0.0]
        for segments in value[1:]:
            total = ahead[-1]
            for i, s, _ in segments:
                total = add(total, ahead[i] + s)
            ahead.append(total)
        behind = [-math.inf] * n
        behind[-1] = 0.0
        for j in range(n - 1, 0, -1):
            for i, s in [(j - 1, 0.0), *((i, s) for i, s, _ in value[j])]:
                behind[i] = add(behind[i], behind[j] + s) if behind[i] > -math.inf else behind[j] + s
        return ahead[-1], [(math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[-1])), fs) for j in range(1, n) for i, s, fs in value[j]]


def best_segments(at: list[int], ending: list[list[tuple[int, str, float]]]) -> list[Span]:
    """The segmentation of highest score among scored segments (first token, kind, score) by the token they end before."""
    score, back = [0.0], [None]
    for segments in ending[1:]:
        top, how = score[-1], None
        for i, kind, s in segments:
            if score[i] + s > top:
                top, how = score[i] + s, (i, kind)
        score.append(top)
        back.append(how)
    out, j = [], len(score) - 1
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((kind, at[i], at[j]))
            j = i
    return out[::-1]


_ANY_DIGIT = str.maketrans("0123456789", "1" * 10)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def best_of_long(text: str, start: int, end: int, weights: dict[str, float]) -> list[Span]:
    """What Region(text, start, end).best(weights) gives, for many tokens at once.

    Numbers of digits and checksums of segments come from prefix sums, and what
    depends on a segment's shape (its characters, digits alike) or on its
    surroundings is worked out once for each shape. Segments of no positive
    score can't be in the best segmentation and are left out.
    """
    shapes = text.translate(_ANY_DIGIT)
    w = lambda kind, names: sum(weights.get(f"{kind} {x}", 0.0) for x in names)
    known: dict[str, tuple[int, ...]] = {}
    names: dict[str, int] = {}
    at_, told = [], []
    for m in _TOKEN.finditer(text, start, end):
        at_.append(m.start())
        x = m[0]
        if x not in known:
            number = "0" <= x[0] <= "9"
            code = names.setdefault(x.translate(_ANY_DIGIT), len(names) + 1)
            known[x] = (code, len(x) if number else 0, x[0].isalnum() or x[0] in "+(", x[-1].isalnum() or x[-1] == ")", _ANCHOR.search(x) is not None)
        told.append(known[x])
    n = len(at_)
    at = np.array([*at_, end], np.int64)
    code, size, can_start, can_end, mark = np.array(told, np.int64).reshape(n, 5).T
    can_start, can_end = can_start > 0, can_end > 0
    digits, groups, marks = (np.append(0, np.cumsum(x)) for x in (size, size > 0, mark))
    values = np.frombuffer(text[start:end].encode("utf-8"), np.uint8)
    values = values[(values >= 48) & (values <= 57)].astype(np.int64) - 48
    twice = np.where(values > 4, 2 * values - 9, 2 * values)
    odd = np.arange(len(values)) % 2 == 1
    # sums with every other digit doubled: those at odd places, those at even ones
    sums = np.stack([np.append(0, np.cumsum(np.where(odd, twice, values))), np.append(0, np.cumsum(np.where(odd, values, twice)))])
    # a number of each run of tokens, from which that of any segment follows
    powers = np.append(np.uint64(1), np.cumprod(np.full(n, _FACTOR)))
    run = np.append(np.uint64(0), np.cumsum(code.astype(np.uint64) * powers[:-1]))
    inverse = np.append(np.uint64(1), np.cumprod(np.full(n, np.uint64(pow(int(_FACTOR), -1, 1 << 64)))))
    checked = np.zeros((20, 2))
    for k in range(13, 20):
        checked[k] = [w("card", [feature_of_check(k, x)]) for x in (False, True)]

    ending: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    before: dict[tuple[str, str], float] = {}
    behind: dict[tuple[str, str], float] = {}

    def left(kind: str, i: int) -> float:
        low = max(0, int(at[i]) - _CONTEXT)
        key = (kind, shapes[low : at[i]] if low else "^" + shapes[: at[i]])
        if key not in before:
            before[key] = w(kind, features_before(kind, text, int(at[i])))
        return before[key]

    def right(kind: str, j: int) -> float:
        key = (kind, shapes[at[j] : at[j] + _BEHIND])
        if key not in behind:
            behind[key] = w(kind, features_behind(text, int(at[j])))
        return behind[key]

    shaped: dict[tuple[str, str], float] = {}

    def of_shape(kind: str, x: str) -> float:
        """Score of a shape, -inf where it can't be of the kind."""
        if (kind, x) not in shaped:
            fits = bool(_IP.fullmatch(x)) if kind == "ip" else candidates(kind, x)
            shaped[kind, x] = w(kind, features_of_shape(kind, x)) if fits else -math.inf
        return shaped[kind, x]

    for low in range(0, n, _AT_ONCE):
        found = []
        for by in range(1, min(MOST_TOKENS, n) + 1):
            j = np.arange(max(low + 1, by), min(low + _AT_ONCE, n) + 1)
            i = j - by
            chars, d = at[j] - at[i], digits[j] - digits[i]
            ok = can_start[i] & can_end[j - 1] & (chars >= 7) & (chars <= MOST_CHARS)
            ok &= ((d >= 7) & (d <= 19)) | ((groups[j] - groups[i] == 4) & (d <= 12)) | (marks[j] > marks[i])
            found.append((i[ok], j[ok]))
        i, j = map(np.concatenate, zip(*found, strict=True))
        if not len(i):
            continue
        d = digits[j] - digits[i]
        _, first, of = np.unique((run[j] - run[i]) * inverse[i], return_index=True, return_inverse=True)
        spans = [shapes[at[i[x]] : at[j[x]]] for x in first.tolist()]
        parity = (digits[j] + 1) % 2
        good = (sums[parity, digits[j]] - sums[parity, digits[i]]) % 10 == 0
        for kind in KINDS:
            score = np.array([of_shape(kind, x) for x in spans], np.float64)[of]
            here = np.flatnonzero(score > -math.inf)
            if not len(here):
                continue
            a, z, score = i[here], j[here], score[here]
            for place, part in ((a, left), (z, right)):
                each, back = np.unique(place, return_inverse=True)
                score += np.array([part(kind, x) for x in each.tolist()])[back]
            if kind == "card":
                score += checked[d[here], good[here].astype(int)]
            elif kind == "ip":
                values_ = [text[at[x] : at[y]] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                score += [w(kind, features_of_value(kind, x)) if candidates(kind, x) else -math.inf for x in values_]
            keep = np.flatnonzero(score > 0)
            for x, y, v in zip(a[keep].tolist(), z[keep].tolist(), score[keep].tolist(), strict=True):
                ending[y].append((x, kind, v))
    for x in ending:
        x.sort(key=lambda e: (e[0], KINDS.index(e[1])))
    return best_segments(at.tolist(), ending)


def regions(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Stretches that can hold more: runs of seven digits or more and what is around at-signs, without taken spans."""
    found = [m.span() for m in _NUMERIC.finditer(text) if m.end() - m.start() >= 7 and len(_digits(m[0])) >= 4] if _DIGIT.search(text) else []
    if "@" in text or "at)" in (low := text.lower()) or "at]" in low or "at ]" in low or "at )" in low:
        for m in _ANCHOR.finditer(text):
            a, z = max(0, m.start() - 40), min(len(text), m.end() + 60)
            while a > 0 and m.start() - a < 64 and text[a - 1].isalnum() and text[a].isalnum():
                a -= 1
            while z < len(text) and z - m.end() < 80 and text[z - 1].isalnum() and text[z].isalnum():
                z += 1
            found.append((a, z))
    merged: list[list[int]] = []
    for a, z in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    if not taken:
        return [(a, z) for a, z in merged]
    out, held = [], sorted((a, z) for _, a, z in taken)
    k = 0
    for a, z in merged:
        while k < len(held) and held[k][1] <= a:
            k += 1
        i = k
        while i < len(held) and held[i][0] < z:
            if held[i][0] > a:
                out.append((a, held[i][0]))
            a = max(a, held[i][1])
            i += 1
        if a < z:
            out.append((a, z))
    return [x for x in out if x[1] - x[0] >= 7]


def written_example(rng: random.Random) -> tuple[str, list[Span]]:
    """A line with numbers and addresses, and which of them are personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("er", "an", "ti", "lo", "me", "su", "ka")) for _ in range(rng.randrange(1, 4)))
    num = lambda top: str(rng.randrange(top))

    def card(good: bool = True) -> str:
        while luhn(x := rng.choice("3456") + d(rng.choice((14, 15, 15, 15)))) != good:
            pass
        cut = rng.choice(("", " ", "-", "."))
        return cut.join(x[i : i + 4] for i in range(0, len(x), 4))

    def phone() -> str:
        a, b, c = str(rng.randrange(200, 999)), str(rng.randrange(200, 999)), d(4)
        return rng.choice((f"+{rng.randrange(1, 99)} {a} {b} {c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randrange(10, 99)}{a}{b}{c}", f"+{rng.randrange(10, 99)} ({a}) {b} {c}", f"{a}.{b}.{c}", f"({a}) {b} {c}"))

    def email() -> str:
        at, dot = rng.choice((("@", "."), (" @ ", "."), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) ")))
        return f"{word()}{rng.choice(('', '.' + word(), d(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'example' + dot + 'com'))}"

    def ip() -> str:
        return rng.choice((".", ".", " . ", "[.]", "(.)")).join(num(256) for _ in range(4))

    def other() -> str:
        return rng.choice(
            (
                lambda: card(False), lambda: d(16), lambda: d(rng.randrange(7, 13)), lambda: d(rng.randrange(13, 30)),
                lambda: f"20{d(2)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} {rng.randrange(24):02}:{d(2)}:{d(2)}", lambda: f"{rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.20{d(2)}", lambda: f"20{d(2)}-20{d(2)}",
                lambda: ".".join(num(30) for _ in range(rng.choice((3, 5, 6)))), lambda: " ".join(num(999) for _ in range(rng.randrange(3, 9))), lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{num(9)}.{d(8)}", lambda: f"{word()}{d(9)}",
                lambda: f"{d(5)}-{d(4)}", lambda: f"{num(99)}/{num(99)}/{d(6)}", lambda: f"{word()} at {word()}", lambda: f"{word()}@{word()}", lambda: f"#{d(8)}-{d(3)}", lambda: f"{d(3)},{d(3)},{d(3)}.{d(2)}",
            )
        )()

    text, gold = "", []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice((*KINDS, "phone", "card", None, None, None, None))
        lead = rng.choice((*(_CUES[kind] if kind else ("order", "no", "since", "version", "id")), "", "", "", "")) if rng.random() < 0.6 else ""
        text += rng.choice(("", word() + " ", word() + ", ")) + (f"{lead}{rng.choice((' ', ': '))}" if lead else "")
        item = {"email": email, "ip": ip, "card": card, "phone": phone, None: other}[kind]()
        if kind:
            gold.append((kind, len(text), len(text) + len(item)))
        text += item + rng.choice((" ", " ", ", ", ". ", f" {word()} ", f" {word()} {word()}. "))
    return text, gold


@cache
def trained(examples: int = EXAMPLES, rounds: int = ROUNDS, seed: int = 7) -> dict[str, float]:
    """Weights fitted by maximum likelihood with an adaptive step and a small L2 penalty; the same for the same arguments."""
    rng = random.Random(seed)
    data = []
    for _ in range(examples):
        text, gold = written_example(rng)
        for a, z in regions(text, []):
            region = Region(text, a, z)
            own = {(s, e, k) for k, s, e in gold}
            hit = [fs for j in range(len(region.ending)) for i, k, fs in region.ending[j] if (region.at[i], region.at[j], k) in own]
            if any(region.ending):
                data.append((region, hit))
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(rounds):
        rng.shuffle(data)
        for region, hit in data:
            step: dict[str, float] = {}
            for fs in hit:
                for f in fs:
                    step[f] = step.get(f, 0.0) + 1
            for p, fs in region.expected(weights)[1]:
                for f in fs:
                    step[f] = step.get(f, 0.0) - p
            for f, g in step.items():
                g -= 0.002 * weights.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                weights[f] = weights.get(f, 0.0) + 0.4 * g / math.sqrt(squares[f])
    return weights


def added_spans(text: str, base: list[Span], weights: dict[str, float]) -> list[Span]:
    """What the field finds besides the base spans; nothing overlaps them."""
    out: list[Span] = []
    for a, z in regions(text, base):
        out += Region(text, a, z).best(weights) if z - a < _LONG else best_of_long(text, a, z, weights)
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with <KIND> for each span; overlapping spans go under the first one's kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(z, merged[-1][2])
        else:
            merged.append([kind, a, z])
    for kind, a, z in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = z
    return "".join([*out, text[at:]])


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def find(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", weights: dict[str, float] | None = None, with_redacted: bool = False) -> DataFrame:
    """Rows of the columns in keep, spans (kind, start, end, base) and redacted (with_redacted only, else null).

    spans go by kind as in KINDS, then by start; offsets are code points, the
    end exclusive; base tells the base patterns' from those that the field adds,
    which never overlap a base span. Null and empty texts have no spans (a null
    text's redacted form is null). Whole texts count, however long: the patterns
    take linear time, and segments are bounded. Repeated rows and null ids stay,
    columns not in keep are ignored, no rows give none.
    """
    fitted = docs.sparkSession.sparkContext.broadcast(trained() if weights is None else weights)
    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("redacted", T.StringType())])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fitted.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                spans, redacted = [], []
                for x in part.column(part.num_columns - 1):
                    text = x.as_py()
                    base = base_spans(text or "")
                    more = added_spans(text or "", base, w)
                    own = set(base)
                    spans.append([{"kind": k, "start": a, "end": z, "base": (k, a, z) in own} for k, a, z in ordered(base + more)] if base or more else [])
                    redacted.append(redact(text, base + more) if with_redacted and text is not None else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(spans, kinds), pa.array(redacted, pa.string())], names=out.names)

    text = F.col(text_col).cast("string") if with_redacted else text_or_empty(text_col)
    return docs.select(*keep, text.alias("text of the row")).mapInArrow(run, out)
