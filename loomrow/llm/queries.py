"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from loomrow.llm import chat, contextmix, imatch, langid, packing, pii, sentencepiece, simhash, topk, warc
from loomrow.llm._shared import read, scratch

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, sequence=4096).drop("ids")


@query
def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by the mixing model and by the word model, learned from six sevenths of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out("doc_id", 7, 2).alias("held_out"))
    model = contextmix.train(docs.filter("not held_out"))
    return contextmix.score(docs, model, keep=("doc_id", "held_out"))


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts they decode to, as digests."""
    both = sentencepiece.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), end_id=2)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, seed=42, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors, 20)


ORACLE_SQL["op3_exact_top_k"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
    where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), s as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out("doc_id", 4, 2).alias("held_out"))
    model = langid.train(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model, keep=("doc_id", "held_out")).drop("spans")


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, as read back from their formatted text."""
    odd = spark.sql("select -1L as conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    masked = F.array_join(F.transform("loss_spans", lambda s: chat.unescape_text(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.format_conversations(rows).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL["op9_chat_format"] = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e as (
    select *, regexp_matches(text, '<\\*\|') or contains(role, chr(10)) or contains(role, '<|') or regexp_matches(role, '%(25|3C|0A)') as odd from c
), f as (
    select *, case when odd then replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A') else role end as out_role,
        case when odd then regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') else text end as out_text
    from e
)
select conv_id, count(*)::bigint as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(12 + length(out_role) + 1 + length(out_text) + 11)::bigint as formatted_chars
from f group by conv_id
"""


@query
def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, as read back from the archives."""
    written = warc.write_archives(read(spark, sf_dir, "pages"), scratch(spark, "warc"), least=1000)
    return warc.read_archives(written, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op10_warc_archives"] = """
with p as (
    select page_id, coalesce(html, '') as payload from pages
), k as (
    select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest, max(page_id) over (partition by payload) as keeper from p
)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 1000 and keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id is distinct from keeper then keeper end as refers_to
from k
"""


@query
def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = read(spark, sf_dir, "documents")
    text = lambda c: F.array_join(c, "")
    near = imatch.edited_likeness(docs, imatch.lexicon(docs, by_class=True), few=imatch.FEW)
    return near.select("doc_id", "n_chars", "edited_sha256", text("hashes").alias("fingerprint"), text("edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
