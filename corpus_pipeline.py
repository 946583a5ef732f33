"""Corpus pipeline: quality, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import bpe, crf, mixing, secrets, simhash
from lodestore.session import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good; rows are unchanged. Null and empty texts are scored as one empty line."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return crf.keep_good(docs, crf.train(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Of rows that repeat an id one stays.
    Texts without words, null ones too, are one group; of a group of null ids alone one row stays.

    Linked are texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, and those whose fingerprints op9 links.
    """
    return simhash.keep_representatives(docs, similarity=0.8)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars brought up to date. Null and empty texts stay as they are; rows that repeat an id are each treated alike."""
    return secrets.redact_table(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights, in slot order: a document has a row for each time it is taken, up to three.

    Documents without words (null, empty) are in no mixture. A null source is a source; null and repeated ids are documents of their own.
    """
    return mixing.mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, with checksums of the ids and of what they decode to. A null text is encoded as an empty one; null ids keep their row."""
    return bpe.bpe_encode(docs).select(F.col("id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: SQL can express neither the classifier nor XXH64 nor BPE; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
