"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row for each
distinct text ever admitted.  A batch is reduced to its distinct digests (with
partial aggregation, so a text that makes up a third of the rows shuffles as one
row per task).  They meet the index once, in a sort-merge join by bucket that does not
shuffle the index; what has no partner there (the anti join) is new and is appended.
``compact`` rewrites an index of many appends as one sorted file for each bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh_path, join_classes, materialise


def create_index(spark: SparkSession, table: str, path: str | None = None, buckets: int | None = None) -> str:
    """Register the digest index ``table``; its files stay under ``path``.

    An index whose files exist already at ``path`` (written with the same number of
    buckets) is opened as it is, so it outlives the session's catalog.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = f"LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT) USING parquet {where} "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
    )
    return table


def _buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def deduplicate(
    docs: DataFrame, index: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Verdict for each row of ``docs`` and, as a side effect, the index extended by its new texts.

    Texts are equal when identical after lower-casing A-Z.  Of the equal texts of a
    batch the row with the largest id stays, unless the index already holds the text:
    then the id in the index stays and every row of the batch is a copy of it.

    Returns doc_id, keep_id, group_size (rows of this batch with the text), kept,
    text_sha256 (lowercase hex of the normalised text).

    Of batches that append at the same time to one index, or of one that is tried again
    after its append, a text can enter twice; ``compact`` leaves the first.  Run one
    batch at a time.

    Defined cases: a null text is the empty text; rows repeated with equal id and text
    share one verdict (``distinct_rows`` keeps one of them); rows with a null id can stay
    only if no row of their text has an id (keep_id is then null and kept true); an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(F.col(text_col)).alias("digest")), "digests")
    groups = materialise(settle(rows, spark.table(index), _buckets(spark, index)), "digest-groups")
    _append(groups.filter(~F.col("earlier")).select("digest", "keep_id"), index)
    # Only texts with copies, in the batch or in the index, need a partner: all other rows decide alone.
    shared = groups.filter(F.col("earlier") | (F.col("group_size") > 1)).select("digest", "keep_id", "group_size")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    single = groups.filter(~F.col("earlier") & (F.col("group_size") == 1))
    alone = single.select(F.col("keep_id").alias("doc_id"), "digest", "keep_id", "group_size")
    out = join_classes(rows, shared, "digest", "group_size", total).unionByName(alone)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def _digest(text: Column) -> Column:
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def settle(rows: DataFrame, known: DataFrame, buckets: int, *more: Column) -> DataFrame:
    """(digest, keep_id, group_size, earlier) and the aggregates ``more`` of the distinct digests of ``rows``, the ids of those in the index ``known`` as there."""
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *more)
    others = groups.columns[3:]
    # By bucket, so without a shuffle; a digest occurs once in an index that nothing disturbed.
    held = known.groupBy("digest").agg(F.min("keep_id").alias("earlier_id")).withColumn("held", F.lit(True))
    both = groups.repartition(buckets, "digest").join(held.hint("merge"), "digest", "left")
    earlier = F.coalesce("held", F.lit(False))
    return both.select("digest", F.when(earlier, F.col("earlier_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", earlier.alias("earlier"), *others)


def _append(fresh: DataFrame, index: str) -> None:
    spark = fresh.sparkSession
    n = _buckets(spark, index)
    fresh.repartition(n, "digest").write.mode("append").insertInto(index)


def compact(spark: SparkSession, index: str, table: str, path: str | None = None) -> str:
    """A new index ``table`` with the rows of ``index``, one sorted file for each bucket and one row for each digest."""
    create_index(spark, table, path, _buckets(spark, index))
    _append(spark.table(index).groupBy("digest").agg(F.min("keep_id").alias("keep_id")), table)
    return table


def distinct_rows(docs: DataFrame, row_key: list[str], index: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key) of exactly one row of each text that is not in ``index``, that with the largest id: of equal ids too, and of null ids if there is no other.

    As in ``deduplicate``, the distinct digests meet the index in its sort-merge join and the
    new ones are appended.  Without ``index`` that is one of its own, which the catalog does not keep.
    """
    spark = docs.sparkSession
    own = None if index else create_index(spark, f"digest_index_{uuid.uuid4().hex}", fresh_path(spark, "digest-index"))
    index = index or own
    rank = F.struct(F.col(id_col).isNotNull(), F.col(id_col), *row_key)
    rows = docs.select(_digest(F.col(text_col)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"), rank.alias("rank"))
    groups = materialise(settle(rows, spark.table(index), _buckets(spark, index), F.max("rank").alias("rank")), "digest-groups")
    fresh = groups.filter(~F.col("earlier"))
    _append(fresh.select("digest", "keep_id"), index)
    if own:
        spark.sql(f"DROP TABLE {own}")  # its files stay until the shared folder goes
    return fresh.select(*[F.col("rank")[c].alias(c) for c in row_key])


def deduplicate_once(docs: DataFrame) -> DataFrame:
    """``deduplicate`` of one table against an index of its own in the shared folder, which the catalog does not keep."""
    spark = docs.sparkSession
    table = create_index(spark, f"digest_index_{uuid.uuid4().hex}", fresh_path(spark, "digest-index"))
    out = deduplicate(docs, table)
    spark.sql(f"DROP TABLE {table}")  # its files stay until the shared folder goes
    return out
