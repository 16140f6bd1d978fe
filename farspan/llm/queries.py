"""The registered queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, license_scan, line_dedup, media, ngram_jaccard, packing, sentencepiece_sampling, sharding, toxicity
from .common import table


def fold(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs, fold(3) != 1)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "_language.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_crc(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85).select("doc_id", "n_shingles", "n_links", "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.find_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = toxicity.with_score(docs, model)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no pictures: each vector of `embeddings` is drawn as one. Queries are edited and cropped copies
    of every vector whose id is divisible by 20, searched for among all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    edited = media.pictures_of(vectors.where(F.col("vec_id") % 20 == 0), edited=True)
    return media.find_copies(edited, media.pictures_of(vectors))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segmentations of every turn of `conversations`, with the check that they decode to the very text."""
    out = sentencepiece_sampling.sample_segmentations(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], tokenizer_path("piece_bpe_32k.model"), k=3)
    return out.select("conv_id", "turn", "rank", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "exact", "log_prob", "inclusion")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_packing, op4_ngram_jaccard, op5_license_scan, op6_exact_dedup, op7_toxicity, op8_media_copies, op9_sharding, op10_sentencepiece)}

SPACES = r"[\x20\x09-\x0D]"
ORACLE_SQL = {
    "op2_line_dedup": rf"""
        WITH lines AS (SELECT doc_id, i, line, regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^{SPACES}+|{SPACES}+$', '', 'g') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        bad AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT l.*, b.k IS NOT NULL AND l.doc_id <> b.keeper AS gone FROM lines l LEFT JOIN bad b ON l.k = b.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op6_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}+', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
}
