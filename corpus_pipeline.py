"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and returns the
columns of documents, but for the last.  Labels and vocabularies come from ``sf_dir``
and the tokenizer folder; nothing else is read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import bpe, exact_dedup, mixing, quality, simhash
from foliomill.llm.queries import vocabulary
from foliomill.llm.shared import fold, in_order, materialise, with_row_key

#: SQL has no counterpart of stages 1, 3 and 5; tests compare them with brute force.
ORACLE_SQL = None


def _keep(docs: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``docs`` whose key is in ``rows`` (one row for each key), without the key."""
    return docs.join(rows, key, "left_semi").drop(*key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects (score under 0.3)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, labels, fold(F.col("doc_id"), 5) != 0, threshold=0.3)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) one row stays, that with the largest doc_id; found against a digest index."""
    docs, key = with_row_key(docs)
    return _keep(docs, exact_dedup.distinct_rows(docs, key), key)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates (five-word shingles, similarity 0.8 or more) of a row that stays go; of two such rows that with the smaller doc_id stays."""
    docs, key = with_row_key(docs)
    return _keep(docs, simhash.similar_rows(docs, key), key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in an order that interleaves the sources by target weight (rows to the power 0.5)."""
    return mixing.in_mixed_order(docs, alpha=0.5)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as counts and digests, in the stored (mixed) order.

    ``position`` (from 0) counts rows in the order of the files' names and of the rows in
    them, which is the order that a sorted table was written in; rows that are in no files
    are stored first.  Rows are told apart by file and place, so none is lost, repeated
    or mixed up, however many files, folders or tables ``docs`` was read from.
    """
    columns = [
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    ]
    try:
        texts = docs.select(*columns)
    except AnalysisException:  # no files straight behind these rows
        texts = materialise(docs, "tokens").select(*columns)
    # Written first, or sorting by ranges would encode every text twice.
    encoded = materialise(bpe.encode_documents(texts, vocabulary(), digests=True, carried=["file", "row"]), "tokens")
    return in_order(encoded, ["file", "row"], "position").drop("file", "row").orderBy("position")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
