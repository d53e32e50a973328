"""I-Match document fingerprints, in DataFrame functions only.

Terms are the distinct lower-case words of a text, known by their XXH64. The
lexicon holds those whose share of the documents lies within a band; several
random subsets of it, from all to one in 512, each give a hash of the sorted
terms that a document has in it. Small subsets survive edits, large ones tell
documents apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrow.llm._shared import checkpoint

#: Share of documents that a lexicon term is found in; common terms say little, and a floor bounds the lexicon.
LOW, HIGH = 0.001, 0.05
#: Terms of a lexicon that is broadcast; a larger one is joined.
LEXICON = 1 << 20
#: One subset for each: 2^-e of the lexicon.
EXPONENTS = (0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 7, 8, 8, 8, 8, 8, 9)
#: Documents with fewer lexicon terms are known by subsets of all their terms.
FEW = 16
_DIGITS = 16
_EMPTY = "-" * _DIGITS
#: Ranges of ids found by quantiles, and documents in each part of a range at the expected size.
_RANGES, _PART = 128, 250
#: Parts whose first ids may be broadcast.
_GUESTS = 200_000


def term_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of the distinct lower-case words between ASCII white space."""
    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, by_class: bool = False) -> DataFrame:
    """Rows h: terms found in a share of at least low and at most high of all rows.

    By class, a group of copies counts as one row, the one with the least terms:
    texts are of a class that have the least term in each of three orders in common.

    A share of low is reached by at most (mean distinct terms) / low terms,
    whatever the number of documents. Null, empty and blank texts count as rows
    without terms (one class of them); repeated rows count each, unless by
    class. Whole texts count, however long; other columns are ignored, whatever
    their names; no rows give no terms.
    """
    sets = docs.select(term_hashes(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hs"))
    if by_class:
        order = lambda i: F.array_min(F.transform("hs", lambda h: F.xxhash64(h, F.lit(i))))
        sets = sets.select(F.xxhash64(*map(order, range(3))).alias("class"), F.sort_array("hs").alias("hs"))
        sets = sets.groupBy("class").agg(F.min("hs").alias("hs"))
    # a null in front of each row's terms counts the rows, so the texts are read once
    each = F.explode(F.concat(F.array(F.lit(None).cast("long")), "hs")).alias("h")
    counts = checkpoint(sets.select(each).groupBy("h").agg(F.count(F.lit(1)).alias("df")))
    n = counts.filter("h is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return checkpoint(counts.filter(F.col("h").isNotNull() & F.col("df").between(low * n, high * n)).select("h"))


def _bounded(lex: DataFrame) -> DataFrame:
    """The lexicon, to be broadcast if its size allows."""
    return F.broadcast(lex) if lex.limit(LEXICON + 1).count() <= LEXICON else lex


def _let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _member(s: int, h: Column) -> Column:
    e, at = EXPONENTS[s], (11 * s) % (64 - max(EXPONENTS))
    mask, bits = (1 << e) - 1 << at, ((0x9E3779B9 >> s % 16) & (1 << e) - 1) << at
    return h.bitwiseAND(F.lit(mask).cast("long")) == F.lit(bits).cast("long")


def _digits(h: Column) -> Column:
    return F.substr(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit(1), F.lit(_DIGITS))


def subset_hashes(terms: Column, otherwise: Column, least: int = 1) -> Column:
    """Hash of each subset's terms, dashes where there are none; terms are sorted lexicon hashes.

    A text with fewer than `least` lexicon terms has `otherwise`.
    """
    subset = lambda s: F.filter(terms, lambda h: _member(s, h)) if EXPONENTS[s] else terms
    kept = F.array(*map(subset, range(len(EXPONENTS))))
    each = F.transform(kept, lambda k: F.when(F.size(k) > 0, _digits(F.xxhash64(k))).otherwise(_EMPTY))
    return F.when(F.size(terms) >= least, each).otherwise(otherwise)


def _own(hashes: Column, few: int) -> Column:
    """What stands for a text with few lexicon terms: subsets of all its terms, or with few = 0 their one hash everywhere."""
    whole = lambda every: F.array_repeat(_digits(F.xxhash64(every)), len(EXPONENTS))
    return _let(F.sort_array(hashes), lambda every: subset_hashes(every, whole(every)) if few else whole(every))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either has terms."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(both, lambda x: (x["a"] != _EMPTY) | (x["b"] != _EMPTY)))
    same = F.size(F.filter(both, lambda x: (x["a"] == x["b"]) & (x["a"] != _EMPTY)))
    return F.when(either > 0, same / either).otherwise(0.0)


def _with_terms(rows: DataFrame, lex: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds for each {new: old} the sorted lexicon terms among the hashes in old.

    Rows lie by the first of keys, all of which name a row; so nothing is
    shuffled unless the lexicon is too large to be broadcast.
    """
    rest = F.struct(*(c for c in rows.columns if c not in keys))
    # one row without a term keeps those that have none; it alone holds the other columns, which aren't multiplied
    made = lambda k, h, r: F.struct(F.lit(k).alias("k"), h.alias("h"), r.alias("rest"))
    none = F.when(F.lit(False), rest)
    numbered = lambda c, i: F.transform(c, lambda h: made(i, h, none))
    every = F.concat(F.array(made(-1, F.lit(0).cast("long"), F.when(F.lit(True), rest))), *(numbered(c, i) for i, c in enumerate(columns.values())))
    flat = rows.select(*keys, F.inline(every))
    hit = flat.join(_bounded(lex.select(F.col("h"), F.lit(True).alias("in"))), "h", "left").filter("in or k < 0")
    lists = [F.sort_array(F.collect_list(F.when(F.col("k") == i, F.col("h")))).alias(c) for i, c in enumerate(columns)]
    return hit.groupBy(*keys).agg(F.max(F.when(F.col("k") < 0, F.col("rest"))).alias("head"), *lists).select(*keys, "head.*", *columns)


def fingerprints(docs: DataFrame, lex: DataFrame, *, few: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, hashes (one for each subset), one for each row of docs.

    A text with fewer than `few` lexicon terms has the subsets of all its terms:
    terms of a large group of copies are too common for the lexicon. With few = 0
    a text without any has the hash of all its terms everywhere.

    Equal texts have equal hashes. Null, empty and blank texts are alike, without
    terms. Null ids and repeated rows stay; whole texts count, however long;
    other columns are ignored, whatever their names; no rows give none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), term_hashes(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hs"))
    kept = rows.withColumn("row", F.monotonically_increasing_id())
    return _with_terms(kept, lex, ["row"], {"terms": "hs"}).select("doc_id", subset_hashes(F.col("terms"), _own(F.col("hs"), few), max(1, few)).alias("hashes"))


def _parts(docs: DataFrame) -> DataFrame:
    """Adds part: numbers that grow with doc_id, each for a bounded number of rows as far as ids are spread."""
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    shares = [i / _RANGES for i in range(1, _RANGES)]
    seen = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.percentile_approx("doc_id", shares, 20_000).alias("q")).first()
    sub = max(1, -(-seen.n // (_RANGES * _PART)))
    marks = [seen.a or 0, *(seen.q or []), seen.z or 0]
    bounds = F.array(*(F.lit(x).cast("long") for x in marks))
    at = F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in marks[1:-1])), lambda b: b <= id_))
    low, high = (F.element_at(bounds, F.col("range") + i).cast("double") for i in (1, 2))
    share = F.when(high > low, (id_.cast("double") - low) / (high - low)).otherwise(0.0)
    inner = F.least(F.lit(sub - 1), F.greatest(F.lit(0), F.floor(share * sub))).cast("long")
    return docs.withColumn("range", at).withColumn("part", F.col("range") * F.lit(sub).cast("long") + inner)


def edited_likeness(docs: DataFrame, lex: DataFrame, *, few: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, n_chars, edited_sha256, hashes, edited_hashes, near_edited, near_next, one for each row of docs.

    The next document is that of the next larger id (equal ids by text; a null
    id is smaller than any), after the last the first; a text alone is its own
    next. edited (known by its SHA-256) is the text with its last floor(n / 2)
    code points replaced by the next text's first as many, or all if fewer.

    `few` is as in fingerprints. Null texts count as empty; texts without terms
    are alike to no other (0). Repeated rows stay, each the next of the one
    before it. Whole texts count, however long; other columns are ignored,
    whatever their names; no rows give none.

    Rows are dealt to parts of the id range with their texts once; each part
    gets the first row of the part behind it as a guest, so every next document
    is at hand.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed = _parts(base)
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63)))
    firsts = placed.groupBy("range", "part").agg(F.min(id_).alias("first"))
    ranges = firsts.groupBy("range").agg(F.min("first").alias("first"))
    # at most _RANGES rows
    follow = ranges.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy())).alias("after"))
    behind = checkpoint(firsts.withColumn("next", F.lead("first").over(Window.partitionBy("range").orderBy("part"))).join(follow, "range").select("part", F.coalesce("next", "after").alias("first")))
    # a row for each part: up to a bound they go to the texts, beyond it the texts are dealt by id
    asked = F.broadcast(behind) if behind.limit(_GUESTS + 1).count() <= _GUESTS else behind
    guests = base.withColumn("first", id_).join(asked, "first").groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    rows = placed.select("part", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests.select("part", F.lit(1).alias("guest"), "doc_id", "text"))
    by = Window.partitionBy("part").orderBy("guest", "doc_id", "text")
    n = F.length("text")
    rows = rows.select("part", "guest", "doc_id", "text", F.row_number().over(by).alias("place"), F.lead("text").over(by).alias("next"))
    edited = F.when(F.col("guest") == 0, F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substr("next", F.lit(1), F.floor(n / 2).cast("int"))))
    rows = rows.select("part", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), term_hashes(F.col("text")).alias("hs"), term_hashes(edited).alias("es"))
    rows = rows.select("part", "place", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "hs", F.coalesce("es", F.array().cast("array<bigint>")).alias("es"))
    rows = _with_terms(rows, lex, ["part", "place"], {"terms": "hs", "edited_terms": "es"})
    lists = [subset_hashes(F.col(t), _own(F.col(o), few), max(1, few)).alias(h) for t, o, h in (("terms", "hs", "hashes"), ("edited_terms", "es", "edited_hashes"))]
    rows = rows.select("part", "place", "guest", "doc_id", "n_chars", "edited_sha256", "hs", "es", (F.size("terms") < few).alias("low"), (F.size("edited_terms") < few).alias("edited_low"), *lists)
    by = Window.partitionBy("part").orderBy("place")
    rows = rows.withColumns({"next_hashes": F.lead("hashes").over(by), "next_low": F.lead("low").over(by), "last_low": F.lag("low").over(by)})
    # subsets of all terms are worked out for the texts that are compared by them alone
    asked = lambda *c: F.greatest(*(F.coalesce(x, F.lit(False)) for x in c))
    rows = rows.withColumns({"own": F.when(asked("low", "edited_low", "next_low", "last_low"), _own(F.col("hs"), few)), "edited_own": F.when(asked("low", "edited_low"), _own(F.col("es"), few))}).drop("hs", "es")
    rows = rows.withColumn("next_own", F.lead("own").over(by)).filter("guest = 0")
    # two texts are compared by all their terms if one has few of the lexicon
    near = lambda c: F.when(F.col("low") | F.col(f"{c}_low"), likeness(F.col("own"), F.col(f"{c}_own"))).otherwise(likeness(F.col("hashes"), F.col(f"{c}_hashes")))
    return rows.select("doc_id", "n_chars", "edited_sha256", "hashes", "edited_hashes", near("edited").alias("near_edited"), near("next").alias("near_next"))
