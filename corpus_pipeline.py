"""A training-corpus pipeline over `documents`: toxicity, language, repeated lines, near duplicates, packing.

Stages take null, empty, very long and repeated texts whole, and empty tables; all but the last return the columns they
were given, whatever further ones there are. Where a stage's result for such rows is its own, its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farspan.llm import language_id, line_dedup, ngram_jaccard, packing, toxicity
from farspan.llm.common import column_free_name, staged, table
from farspan.llm.queries import tokenizer_path

#: Rejected: documents scored at least this toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC. The model learns from all labels, on the texts of this stage's input. Null and
    empty texts score by the model's bias alone; rows that repeat go or stay together; without labels all stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.with_score(docs, model).where(F.col(column_free_name(docs, "_toxicity")) < TOXIC).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Those without letters go (`und`), and those that lie between codewords: flagged
    as ambiguous, with under half of the weight on the nearest (of 10,000 labelled documents at sf0.1 two). Null and
    empty texts have no letters. Where no row has a lang nothing is learned, and all stay."""
    model = language_id.learn(docs, F.lit(True))
    if model is None:
        return docs
    found = F.col(column_free_name(docs, "_language"))
    between = found["ambiguous"] & (found["score"] < 0.5)
    return language_id.identify(docs, model).where((found["lang_pred"] != language_id.NONE) & ~between).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. A document that loses all its lines stays, empty; rows that repeat a
    doc_id keep a line together where that id is the largest."""
    out = line_dedup.drop_repeated_lines(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest doc_id stays; rows that
    repeat it go too, and rows without doc_id, which are in no group, stay."""
    groups = ngram_jaccard.near_duplicates(docs, size=5, percent=80, count_links=False)
    name = column_free_name(docs, "gone")
    gone = staged(groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row's tokens, as `packing.pack_documents` says; an empty text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("language_id", keep_languages), ("line_dedup", drop_lines), ("ngram_jaccard", keep_one_of_near), ("packing", pack)]

#: Learned models and the packing can't be said in SQL: tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
