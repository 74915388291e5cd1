"""Corpus pipeline: quality filter, near-duplicate removal, PII removal, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The last
returns the training data: doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import mixing, near_copies, pieces, pii, queries
from rowtide.sources.shared import new_folder, remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts score what the model's bias says; rows without an id are scored like others; repeated rows share a score.
    """
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return queries.quality_scores(spark, docs, sf_dir, name).where(F.col(name) >= queries.GOOD_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8. Documents without words, and those without an
    id, stay; of rows with the same id and text one stays."""
    return near_copies.without_near_copies(docs, words=5, percent=80)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it, generalised; n_chars follows the text. Null texts stay null, all rows stay."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their weights; a null source is one, texts without words add nothing and are
    taken a whole number of times."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, repeats included; a null or empty text is its end id alone."""
    coded = pieces.encode_texts(docs.select("doc_id", "source", "text"), queries.tokenizer_path("piece_bpe_32k.model"), ids=True)
    return coded.drop("text")


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("PII", remove_pii),
    ("mixing sources", mix_sources),
    ("piece encoding", encode),
]

#: SQL cannot express the classifier's training or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from documents. What a stage keeps is written to the shared folder before the next one
    reads it, and deleted when that one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
