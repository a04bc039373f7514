"""An index of finished outputs, for billions of them: joined where it lies.

The index is a table bucketed and sorted by project and name, so a plan is shuffled to
its buckets and the index is not.  Keys are stored as text that tells a null from every
string, since a join that treats nulls as equal would not use the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import free_name

KEYS = ("project_key", "name_key")


def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


class FinishedIndex:
    """Finished outputs (project, output_name) in the catalog table ``table``; ``buckets`` counts for a new table.

    One writer at a time.  Outputs that are added twice are kept once by ``compact`` and
    count once in any case.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def _write(self, rows: DataFrame, table: str) -> None:
        dealt = rows.repartition(self.buckets, *KEYS)  # a file for each bucket
        dealt.write.mode("append").bucketBy(self.buckets, *KEYS).sortBy(*KEYS).format("parquet").saveAsTable(table)

    def add(self, outputs: DataFrame) -> None:
        rows = outputs.select(_key("project").alias(KEYS[0]), _key("output_name").alias(KEYS[1])).distinct()
        if self.spark.catalog.tableExists(self.table):
            self._write(rows.join(self.spark.table(self.table), list(KEYS), "left_anti"), self.table)
        else:
            self._write(rows, self.table)

    def compact(self) -> None:
        """Rewrites the index with one file for each bucket."""
        new = f"{self.table}_new"
        self._write(self.spark.table(self.table).distinct(), new)
        self.spark.sql(f"DROP TABLE {self.table}")
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.table}")

    def skip_existing(self, plan: DataFrame) -> DataFrame:
        """The rows of ``plan`` (project, output_name) that are not finished."""
        names = [free_name(plan, k) for k in KEYS]
        there = self.spark.table(self.table).select(*[F.col(k).alias(n) for k, n in zip(KEYS, names, strict=True)])
        keyed = plan.withColumns({n: _key(c) for n, c in zip(names, ("project", "output_name"), strict=True)})
        # The index may be as large as it likes, so it is never the side that is sent to all tasks.
        return keyed.join(there.hint("merge"), names, "left_anti").drop(*names)
