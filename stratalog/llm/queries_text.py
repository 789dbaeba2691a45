"""Queries of the numbered operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language, media, mixing, near_dedup, personal, quality, substrings, warc

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def remainder(parts: int) -> Column:
    """crc32 of doc_id as text, modulo `parts`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cleaned(table(spark, sf_dir, "documents")).drop("kept")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(personal.detected(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return quality.scored(docs, weights).withColumn("held_out", F.coalesce(remainder(3) == 1, F.lit(False)))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, remainder(4) != 2)
    return language.identified(docs, model).withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), like=near_dedup.Likeness(shingle=2))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.schedule(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken", F.round("virtual_finish", 4).alias("virtual_finish"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).drop("locator")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(spark, table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
SQL = {
    "op7_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op6_source_mixing": rf"""
        WITH d AS (SELECT doc_id, source, {WORDS_SQL}::BIGINT AS size, sha256(doc_id::VARCHAR) AS shuffle FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER r AS place,
                (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
              FROM s WINDOW r AS (ORDER BY source_size / weight, source NULLS LAST)),
        h AS (SELECT arg_min(level, place) AS horizon FROM o WHERE level * weight <= source_size * 3),
        t AS (SELECT source, source_size, weight, least(horizon * weight, (source_size * 3)::DOUBLE) AS target FROM s, h),
        p AS (SELECT d.doc_id, size, source_size, weight, target,
                (sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, round(target, 4) AS target, round((start + size) / weight, 4) AS virtual_finish,
          (greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size))
           + greatest(0, least(size, floor(target) - start - 2 * source_size)))::BIGINT AS taken
        FROM p""",
    "op8_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        k AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY sha256(payload)) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM k""",
}
