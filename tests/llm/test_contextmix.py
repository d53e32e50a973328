import math
import random
import re
from collections import Counter

import numpy as np

from loomrow.llm import contextmix as cm


def texts(seed, n):
    rng = random.Random(seed)
    kinds = [[f"{a}{i}" for i in range(40)] for a in ("an", "bel")]
    return [" ".join(rng.choices(rng.choice(kinds), weights=range(40, 0, -1), k=rng.randrange(0, 120))) for _ in range(n)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_score(model, text, counts):
    """The text's log probability, bit after bit with plain numbers; counts of all words in training."""
    coder, m = model["coder"], model["mixer"]
    words = [w.encode() for w in tokens(text)]
    rank = {int(h): int(r) for h, r in zip(coder._keys, coder._ranks, strict=True) if r >= 0}
    symbols = [rank.get(int(cm.Words([w.decode()]).hash[0]), coder.escape) for w in words] + [coder.end]
    total, kinds, common = 0.0, np.zeros(coder.telling.shape[1]), cm._COMMON
    sig = lambda z: 1 / (1 + math.exp(-z))

    def bits(tree, s):
        at = tree.packed[tree.start[s] : tree.start[s] + tree.length[s]].tolist()
        return [(x >> 6, x >> 5 & 1, x & 31) for x in at]

    def slot(context, node, slots):
        x = (int(context) + node * 0x9E3779B1) * 0x7FEB352D & 0xFFFFFFFF
        return x >> 33 - slots.bit_length()

    for t, s in enumerate(symbols):
        if t % cm.SEGMENT == 0:
            w = {g: [float(x) for x in m["words"][g]] for g in range(cm._GATES)}
            own, apm = Counter(), {}
        kind = int(kinds.argmax())
        step = []
        for node, bit, depth in bits(coder.tree, s):
            marks = [int(cm._mixed(np.array([c]), i)[0]) for i, c in ((1, common), (2, kind))]
            x = [m["logits"]["common"][slot(marks[0], node, cm.WORD_SLOTS)], m["logits"]["kind"][slot(marks[1], node, cm.WORD_SLOTS)], own[node % cm._OWN]]
            z = sum(a * b for a, b in zip(w[depth], x, strict=True))
            p = sig(z)
            j = int(min(max(z * (cm._STEPS - 1) / (2 * cm._APM_TOP) + cm._STEPS / 2, 0), cm._STEPS - 1))
            r = apm.setdefault((depth, j), -cm._APM_TOP + j * 2 * cm._APM_TOP / (cm._STEPS - 1))
            q = sig(r)
            both = 0.75 * p + 0.25 * q
            total += math.log(max(both if bit else 1 - both, 1e-7))
            step.append((node, bit, depth, j, x, p, r, q))
        for node, bit, depth, j, x, p, r, q in step:
            w[depth] = [a + cm._RATE * (bit - p) * b for a, b in zip(w[depth], x, strict=True)]
            own[node % cm._OWN] = x[2] * (1 - cm._FADE) + 2 * bit - 1
            apm[depth, j] = r + cm._APM_RATE * (bit - q)
        if s == coder.escape:
            spelling, spelled = [*words[t], 256], 0.0
            for place, c in enumerate(spelling):
                context, marks = 0, []
                for back in range(1, max(cm._ORDERS) + 1):
                    context = (context * 0x01000193 + (spelling[place - back] + 1 if place >= back else 0)) & 0xFFFFFFFF
                    if back in cm._ORDERS:
                        marks.append((back, int(cm._mixed(np.array([context]), back)[0])))
                for node, bit, _ in bits(coder.bytes, c):
                    x = [1.0, *(m["logits"][f"order {o}"][slot(h, node, cm.BYTE_SLOTS)] for o, h in marks)]
                    z = sum(a * b for a, b in zip(m["bytes"][min(place, cm._PLACES - 1)], x, strict=True))
                    spelled += math.log(sig(z if bit else -z))
            outside = {w: c for w, c in counts.items() if w and int(cm.Words([w]).hash[0]) not in rank}
            once, twice = (sum(c == k for w, c in counts.items() if w) for k in (1, 2))
            less = (once + 0.5) / (once + 2 * twice + 1)
            n = sum(outside.values())
            known = outside.get(words[t].decode(), 0)
            total += math.log((max(0, known - less) / n if known else 0) + (less * len(outside) / n if n else 1) * math.exp(spelled))
        if s < cm._TELLING or s == coder.end:
            kinds = kinds + coder.telling[s]
        if s < cm._COMMON:
            common = s
    return total / math.log(10)


def test_against_brute_force(spark):
    held = [*texts(2, 12), None, "", " \x1c\x85 É é", "word " * 700 + "nEVER before", "an1 an1 an1"]
    rows = [(i, t, False) for i, t in enumerate(texts(1, 120))] + [(200 + i, t, True) for i, t in enumerate(held)] + [(None, "an1", True), (7, "twice", True), (7, "twice", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("n_tokens", cm.F.lit("clash"))
    model = cm.train(docs.filter("not held_out"), words=50)
    got = cm.score(docs, model, keep=("doc_id", "held_out")).collect()
    counts = Counter(w for _, t, h in rows if not h for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and model["n"] == n and model["v"] == v
    want = {}
    for i, t, _ in rows:
        all_ = [*tokens(t), None]
        want.setdefault(i, (len(all_), sum(w in counts for w in all_), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in all_), t))
    for r in got:
        w = want[r.doc_id] if r.doc_id != 7 or not r.held_out else None
        if w is None:
            continue
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and abs(r.base_score - w[3]) < 1e-6
        if r.held_out:
            assert abs(r.score - slow_score(model, w[4], counts)) < 1e-3 * max(1, abs(r.score))
    first = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 212]
    assert sum(r.score for r in first) > sum(r.base_score for r in first)


def test_probabilities_add_up(spark):
    model = cm.train(spark.createDataFrame([(t,) for t in texts(3, 60)], "text string"), words=20)
    mixer, coder = cm.Mixer(model["coder"], model["mixer"]), model["coder"]
    before, first, _ = coder.symbols(cm.Words(["an1 an2 an1"]))
    logs = []
    for s in range(len(coder.counts)):
        symbols = before.copy()
        symbols[-1] = s
        logs.append(mixer.words(symbols, first)[0])
    assert abs(np.exp(logs).sum() / np.exp(mixer.words(before[:-1], first)[0]) - 1) < 1e-4


def test_known_and_new_words_share_the_escape(spark):
    rare = [f"rare{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, "a b c " * 5 + " ".join(rare[i : i + 1 + i % 3])) for i in range(58)], "doc_id long, text string")
    model = cm.train(docs, words=3)
    outside = model["outside"]
    counts = Counter(w for r in docs.collect() for w in tokens(r.text) if w.startswith("rare"))
    assert outside["n"] == sum(counts.values()) and 0 < outside["new"] < 1
    shares = [(c - outside["discount"]) / outside["n"] for c in counts.values()]
    assert min(shares) > 0 and abs(sum(shares) + outside["new"] - 1) < 1e-9
    scores = {r.doc_id: r.score for r in cm.score(spark.createDataFrame([(1, "a b rare30"), (2, "a b rarq30")], "doc_id long, text string"), model).collect()}
    assert scores[1] > scores[2]


def test_the_sample_has_long_texts_and_copies_once(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(x,) for x in [long, *["copy of one"] * 400, "", "x" * 20_000]], "text string")
    got = cm.fit_sample(docs)
    assert sorted(len(x) for x in got)[:3] == [0, 0, 11] and len(got) == 4
    piece = max(got, key=len)
    assert 10_000 < len(piece) < cm.FIT_CHARS and set(piece.split()) <= set(long.split())


def test_all_texts_teach_not_only_a_sample(spark):
    """Kinds, byte code and starting weights know what occurs only in texts that fit_sample leaves out."""
    rng = random.Random(9)
    an = [" ".join(rng.choices([f"an{i}" for i in range(20)], k=40)) for _ in range(400)]
    bel = [" ".join([*rng.choices([f"bel{i}" for i in range(20)], k=40), "".join(rng.choices("qx", k=9))]) for _ in range(60)]
    sample = set(cm.fit_sample(spark.createDataFrame([(t,) for t in an + bel], "text string")))
    docs = [t for t in an + bel if t in sample and t in an] + [t for t in an + bel if t not in sample]
    assert len([t for t in docs if t in sample]) < len(docs) - 100 and any(t in bel for t in docs)
    df = spark.createDataFrame([(t,) for t in docs], "text string")
    sampled = " ".join(cm.fit_sample(df))
    model = cm.train(df, words=40)
    coder = model["coder"]
    spelled = [w for t in docs for w in tokens(t) if coder.ranks(cm.Words([w]).hash)[0] == coder.escape]
    assert spelled and sum(w in sampled for w in spelled) < len(spelled) / 2
    # the code is that of all spelled words
    want = np.ones(257, np.int64)
    for w in spelled:
        np.add.at(want, [*w.encode(), 256], 1)
    assert (cm.Tree(want).packed == coder.bytes.packed).all()
    # both kinds of texts are told apart
    last = lambda t: int(coder.contexts(*coder.symbols(cm.Words([t]))[:2])[1][-1])
    assert not {last(t) for t in docs if t in an} & {last(t) for t in docs if t in bel}
    # and the rows' spread changes nothing
    again = cm.train(df.repartition(7), words=40)
    assert all((again["mixer"][k] == model["mixer"][k]).all() for k in ("words", "bytes")) and (again["coder"].telling == coder.telling).all()


def test_weights_are_fitted_to_every_bit(spark):
    """The counts that the starting weights come from, against plain Python over all of more texts than fit_sample has."""
    held = [*texts(5, 330), "", "an1 " * 600, "rare1 rare2", "rare1 rare2"]
    df = spark.createDataFrame([(t,) for t in held], "text string")
    coder = cm.train(df, words=40)["coder"]
    tables = cm.context_counts(df, coder)
    half = [cm.zlib.crc32(t.encode()) & 1 for t in held]
    codes = [{k: np.rint((cm._logit(x[1 - h]) + 8) / (0.5 if k in ("common", "kind") else 1)).astype(np.uint8) for k, x in tables.items()} for h in (0, 1)]
    got = cm.fit_cells(coder, codes, cm._halves(held))
    want = {"words": Counter(), "bytes": Counter()}
    slot = lambda context, node, slots: (int(context) + node * 0x9E3779B1) * 0x7FEB352D % 2**32 >> 33 - slots.bit_length()
    mark = lambda c, i: int(cm._mixed(np.array([c]), i)[0])
    bits = lambda tree, s: [(int(x) >> 6, int(x) >> 5 & 1, int(x) & 31) for x in tree.packed[tree.start[s] : tree.start[s] + tree.length[s]]]
    counted = {k: np.zeros_like(x) for k, x in tables.items()}
    for t, h in zip(held, half, strict=True):
        words = cm.Words([t])
        symbols, first, _ = coder.symbols(words)
        common, kind = coder.contexts(symbols, first)
        for at, (s, c, k) in enumerate(zip(symbols, common, kind, strict=True)):
            if at % cm.SEGMENT == 0:
                own = Counter()
            marks = mark(c, 1), mark(k, 2)
            for node, bit, depth in bits(coder.tree, s):
                a, b = (slot(m, node, cm.WORD_SLOTS) for m in marks)
                counted["common"][h, a, bit] += 1
                counted["kind"][h, b, bit] += 1
                shown = own[node % cm._OWN]
                want["words"][depth, codes[h]["common"][a], codes[h]["kind"][b], round((shown + 7) / 0.5), bit] += 1
                own[node % cm._OWN] = shown * (1 - cm._FADE) + 2 * bit - 1
            if s == coder.escape:
                spelling = [*words.word(at), 256]
                for place, c in enumerate(spelling):
                    context, cells = 0, []
                    for back in cm._ORDERS:
                        context = (context * 0x01000193 + (spelling[place - back] + 1 if place >= back else 0)) & 0xFFFFFFFF
                        cells.append((back, mark(context, back)))
                    for node, bit, _ in bits(coder.bytes, c):
                        at_ = [slot(m, node, cm.BYTE_SLOTS) for _, m in cells]
                        for (o, _), x in zip(cells, at_, strict=True):
                            counted[f"order {o}"][h, x, bit] += 1
                        want["bytes"][min(place, 7), *(codes[h][f"order {o}"][x] for (o, _), x in zip(cells, at_, strict=True)), bit] += 1
    assert all((counted[k] == x).all() for k, x in tables.items())
    for name, shape in (("words", cm._WORD_CELLS), ("bytes", cm._BYTE_CELLS)):
        there = np.flatnonzero(got[name])
        cells = dict(zip(zip(*(x.tolist() for x in np.unravel_index(there, shape)), strict=True), got[name][there].tolist(), strict=True))
        assert sum(cells.values()) == sum(want[name].values()) > 0
        assert sum(abs(cells.get(k, 0) - n) for k, n in want[name].items()) <= 1e-3 * sum(want[name].values())


def test_words():
    rng = random.Random(4)
    held = ["", " ", "A b\tc\x0bd\x0ce\rf", "É\x85\x1c İ", "x" * 300 + " " + "x" * 301, *(" ".join("".join(rng.choices("abC", k=rng.randrange(1, 5))) for _ in range(rng.randrange(0, 400))) for _ in range(30))]
    words = cm.Words(held)
    want = [[w.encode() for w in tokens(t)] for t in held]
    assert words.n.tolist() == [len(x) for x in want] and words.bytes.tolist() == [len(t.encode()) for t in held]
    flat = [w for x in want for w in x]
    assert [words.word(i) for i in range(len(flat))] == flat
    assert len(set(zip(flat, words.hash.tolist(), strict=True))) == len(set(flat)) == len(set(words.hash.tolist()))
    assert len(cm.Words([]).hash) == 0


def test_untrained_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = cm.train(docs.limit(0))
    got = cm.score(docs, model).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.base_score) for r in got] == [(3, 0, 0.0), (1, 0, 0.0)] and all(r.score < 0 for r in got)
    assert cm.score(docs.limit(0), model).count() == 0
