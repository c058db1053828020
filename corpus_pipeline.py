"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each stage's rows to the shared folder and hands the next stage what it reads back. Parts of this file that can't be
imported make it fail as a whole; only ``__spark_entry__`` guards against its absence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, langid, line_dedup, ngram_join, pieces
from palimpsest.llm.common import persist, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MOST_BITS = 8.0  # a text that no language's model shortens at all is in none of the languages


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; ``lang`` becomes the predicted one. Texts without a letter, and texts that every
    model makes longer than their bytes, are rejected. The models learn from the labelled documents of the input table."""
    model = langid.train(langid.training_sample(docs))
    found = langid.predict(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that another place of the corpus keeps, and documents of which no line is left. ``n_chars`` follows the text."""
    found = line_dedup.dedup_lines(docs)
    kept = found.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n", " ")) != ""))
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", "text", "lang", "source", size.alias("n_chars"))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class of near duplicates, by (doc_id, hash of the text), ids that are null first. Rows
    that repeat both are one document here."""
    away = ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == F.col("first_copy")))
    gone = ngram_join.join_rows(docs).where(away).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_copy"))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti").select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage within a tenth of its length of a benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled SentencePiece ids of each document: doc_id, n_pieces, pieces, and whether decoding gave the text back."""
    return pieces.encode_texts(docs, check=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None  # language models, MinHash, the embedding and the sampler have no SQL; tests compare stages with brute force
