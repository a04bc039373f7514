"""A sink that writes one file for each row, in two phases, as a Python data source.

Tasks write parts and a manifest of what each part will be called; the job's commit
writes down which manifests count, one name for each task.  Then the renames run as
tasks too.  A run that died before its commit leaves parts under names of their own and
one that died after it is finished by ``recover_payloads``, so neither a retry nor a
failure leaves part of a file, or a gap, under final names.  The folder must be one
that driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

RUN = ".parts-"
COMMITTED = "committed"


@dataclass
class Written(WriterCommitMessage):
    manifest: str


class PayloadWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, os.path.join(folder, RUN + run)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.run, exist_ok=True)
        manifest, n = uuid.uuid4().hex, 0
        with open(os.path.join(self.run, f"{manifest}.manifest"), "w", encoding="utf-8") as listed:
            for batch in iterator:
                for row in zip(*(batch.column(c) for c in ("project", "output_name", "payload")), strict=True):
                    project, name, payload = (x.as_py() for x in row)
                    name = os.path.basename(name or "")
                    if not name:
                        raise ValueError("an output name is empty")
                    part = f"{manifest}-{n}.part"
                    listed.write(json.dumps([part, os.path.join(os.path.basename(project or ""), name)]) + "\n")
                    with open(os.path.join(self.run, part), "wb") as f:
                        f.write(payload or b"")
                    n += 1
        return Written(manifest)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.run, exist_ok=True)
        path = os.path.join(self.run, COMMITTED)
        with open(path + ".new", "w", encoding="utf-8") as f:
            f.write("\n".join(m.manifest for m in messages if m))
        os.replace(path + ".new", path)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.run, ignore_errors=True)


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def schema(self) -> str:
        return "project string, output_name string, payload binary"

    def writer(self, schema: object, overwrite: bool) -> PayloadWriter:
        return PayloadWriter(self.options["path"], self.options["run"])


def _settle(spark: SparkSession, run: str) -> None:
    """Gives the parts of a committed run their names, a task for each manifest; what a task before has done stays done."""
    with open(os.path.join(run, COMMITTED), encoding="utf-8") as f:
        manifests = f.read().split()
    folder = os.path.dirname(run)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for manifest in batch.column(0).to_pylist():
                n = 0
                with open(os.path.join(run, f"{manifest}.manifest"), encoding="utf-8") as listed:
                    for part, name in map(json.loads, listed):
                        if os.path.exists(at := os.path.join(run, part)):
                            os.makedirs(os.path.dirname(final := os.path.join(folder, name)), exist_ok=True)
                            os.replace(at, final)
                        n += 1
                done.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["n"])

    if manifests:
        rows = spark.createDataFrame([(m,) for m in manifests], "manifest string")
        rows.repartition(min(len(manifests), 10_000)).mapInArrow(rename, "n long").agg({"n": "sum"}).collect()
    shutil.rmtree(run)


def write_payloads(df: DataFrame, folder: str) -> None:
    """One file for each row of (output_name, payload), in a folder of its own for each ``project`` if there is that column.

    An existing file is replaced.  Only base names are used, so no row can leave the
    folder.  Of rows that share a name, one wins; settle them before (``latest_per_output``).
    """
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(PayloadSource)
    run = uuid.uuid4().hex
    project = "project" if "project" in df.columns else "cast(null as string) project"
    rows = df.selectExpr(project, "output_name", "payload")
    rows.write.format("payload_files").mode("append").option("run", run).save(folder)
    _settle(spark, os.path.join(folder, RUN + run))


def recover_payloads(spark: SparkSession, folder: str) -> None:
    """Finishes the runs that died after their commit and removes the parts of those that died before; none may be going on."""
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if entry.is_dir() and entry.name.startswith(RUN):
            if os.path.exists(os.path.join(entry.path, COMMITTED)):
                _settle(spark, entry.path)
            else:
                shutil.rmtree(entry.path)


def write_payload_table(df: DataFrame, path: str) -> None:
    """The table form: rows of (project, output_name, payload) as Parquet, a folder for each project."""
    df.write.mode("append").partitionBy("project").parquet(path)
