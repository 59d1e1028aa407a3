"""The ten operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, media, packing, paragraphs, passages, secrets, simhash, token_counts, toxicity, warc
from .common import table, written

PROBE = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary or tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of whole paragraphs, and exact copies wherever they lie; the latter have no ``para_no``."""
    docs = table(spark, sf_dir, "documents")
    exact = passages.repeated_passages(docs).withColumn("para_no", F.lit(None).cast("long"))
    return paragraphs.repeated_paragraphs(docs).unionByName(exact)


def op5_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary or tokenizer_path())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.samples_from(docs)))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.conversation_digests(chat.format_turns(rows.unionByName(probe)))


def damaged(pages: DataFrame) -> DataFrame:
    """Pages of which some have one byte of the body changed."""
    hit = F.pmod("page_id", F.lit(97)) == 0
    return pages.withColumn("html", F.when(hit & (F.length("html") > 0), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def damaged_at_rest(replica: DataFrame) -> DataFrame:
    """A copy of a stored replica in which the first byte of some bodies has been overwritten."""
    hit = (F.pmod("page_id", F.lit(97)) == 0) & (F.octet_length("raw") > F.col("body_at") + 4)
    worn = F.expr("concat(substring(raw, 1, cast(body_at as int)), X'23', substring(raw, cast(body_at as int) + 2))")
    return written(replica.withColumn("raw", F.when(hit, worn).otherwise(F.col("raw"))), "warc-copy")


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    shape = warc.geometry(pages)
    primary = warc.write_replica(pages, shape)
    found = warc.compare(primary, damaged_at_rest(primary), shape).filter("copies > 0")  # the query lists the primary's records
    return found.select("page_id", "record_bytes", "copies", "record_sha256", "corrupt")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_media_chunks, op2_token_counts, op3_toxicity, op4_substring_dedup, op5_packing, op6_simhash, op7_secrets, op8_chat_format, op9_warc_fixity, op10_decontamination)}

# What SQL can express.  Other operators are tested against brute force.
ORACLE_SQL = {
    "op8_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
                        + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
        FROM rows GROUP BY conv_id
    """,
    "op9_warc_fixity": r"""
        WITH records AS (
            SELECT page_id, coalesce(html, '') AS body,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'null') || '>' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                   || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
                   || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM pages)
        SELECT page_id, CAST(strlen(record) AS BIGINT) AS record_bytes, CAST(count(*) AS BIGINT) AS copies,
               sha256(record) AS record_sha256,
               coalesce(page_id % 97 = 0 AND body <> '' AND substr(body, 1, 1) <> '#', false) AS corrupt
        FROM records GROUP BY page_id, body, record
    """,
    "op10_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
            FROM i, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p) WHERE len(w) > 0),
        dw AS (
            SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
            FROM d, (SELECT DISTINCT n FROM iw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p)),
        h AS (SELECT rid, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
        covered AS (SELECT rid, CAST(count(DISTINCT p + k) AS BIGINT) AS n_hit FROM h, LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY rid),
        named AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
    """,
}
