"""Calls that are paid once: a journal of results by request, kept while a job runs.

Every call's result is appended to a file of its task, and reaches the disk before the
next call begins.  A task that is run again, after a lost executor or for a second
action, reads what the tasks before it have written for its rows; a new run reads the
successes of all runs as a table and calls only for the rest.  A call is paid twice only
if its task died between the answer and the write.
"""

from __future__ import annotations

import glob
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import free_name

RESULT = "digest string, body string, status string, error string"


def request_digest(columns: list[str], label: str = ""):
    """SHA-256 of a request: the values of ``columns`` in their order, and a label (a model's name and version, say)."""
    values = F.to_json(F.struct(*[F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.lit(f"{label}\n"), values).cast("binary"), 256)


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, body) of the successful calls of all runs; a line that was cut off when its task died is passed over."""
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "digest string, body string")
    lines = spark.read.schema(f"{RESULT}, _corrupt_record string").json(folder)
    good = lines.filter("digest is not null and status = 'success'")
    # A call that was paid twice has either answer.
    return good.groupBy("digest").agg(F.min_by(F.struct("body"), F.coalesce("body", F.lit(""))).alias("x")).select("digest", "x.body")


def compact_journal(spark: SparkSession, folder: str, files: int = 8) -> None:
    """The journal's successes in a few files; no run may be writing to it."""
    old = glob.glob(os.path.join(glob.escape(folder), "*.jsonl"))
    part = os.path.join(folder, f".compact-{uuid.uuid4().hex}")
    rows = read_journal(spark, folder).withColumns({"status": F.lit("success"), "error": F.lit(None).cast("string")})
    rows.coalesce(files).write.json(part)
    for i, name in enumerate(sorted(glob.glob(os.path.join(glob.escape(part), "part-*")))):
        os.replace(name, os.path.join(folder, f"compact-{uuid.uuid4().hex}-{i}.jsonl"))
    for name in old:
        os.remove(name)


def apply_pages_once(
    df: DataFrame, make_function: Callable[[], Callable[[dict], object]], input_columns: list[str], journal: str,
    output: str = "body", label: str = "", tasks: int | None = None,
) -> DataFrame:
    """As ``apply_pages``, but with a journal: ``df`` with the function's text (``output``), status and error.

    A request is the values of ``input_columns`` and ``label``.  Requests that succeeded in
    an earlier run are not called again; those that failed are, once in each run.  Rows
    with the same request share one call.  ``tasks`` sets how many tasks call at once.

    ``journal`` is a folder that driver and executors share.  The result may be used in
    several actions: rows are dealt to tasks by request, so each finds its own results.
    """
    spark = df.sparkSession
    os.makedirs(journal, exist_ok=True)
    columns = [c for c in df.columns if c not in (output, "status", "error")]
    digest, body, known_digest = (free_name(df, f"journal_{x}") for x in ("digest", "body", "known"))
    rows = df.withColumn(digest, request_digest(input_columns, label))
    known = read_journal(spark, journal).select(F.col("digest").alias(known_digest), F.col("body").alias(body))
    done = rows.join(known, F.col(digest) == F.col(known_digest))
    done = done.select(*[f"`{c}`" for c in columns], F.col(body).alias(output), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"))
    open_ = rows.join(known, F.col(digest) == F.col(known_digest), "left_anti")
    n = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = uuid.uuid4().hex
    names = [*open_.columns]
    kept = [names.index(c) for c in columns]
    at = names.index(digest)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        mine = os.path.join(journal, f"{run}-{context.partitionId()}")
        found: dict[str, tuple] = {}
        for name in glob.glob(f"{glob.escape(mine)}-*.jsonl"):
            with open(name, encoding="utf-8") as f:
                for line in f:
                    if line.endswith("}\n"):
                        x = json.loads(line)
                        found[x["digest"]] = (x["body"], x["status"], x["error"])
        function, log = None, None
        try:
            for batch in batches:
                results = []
                inputs = batch.select(input_columns)
                for i, key in enumerate(batch.column(at).to_pylist()):
                    if key not in found:
                        if log is None:
                            function = make_function()
                            log = open(f"{mine}-{uuid.uuid4().hex}.jsonl", "w", encoding="utf-8")  # noqa: SIM115
                        try:
                            answer = function({c: inputs.column(c)[i].as_py() for c in input_columns})
                            found[key] = (None if answer is None else str(answer), "success", None)
                        except Exception as e:
                            found[key] = (None, "failed", str(e) or type(e).__name__)
                        log.write(json.dumps(dict(zip(("digest", "body", "status", "error"), (key, *found[key]), strict=True))) + "\n")
                        log.flush()
                        os.fsync(log.fileno())
                    results.append(found[key])
                new = [pa.array([r[j] for r in results], pa.string()) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *new], [*columns, output, "status", "error"])
        finally:
            if log:
                log.close()

    schema = StructType([*(open_.schema.fields[i] for i in kept), *(StructField(c, StringType()) for c in (output, "status", "error"))])
    return done.unionByName(open_.repartition(n, digest).mapInArrow(call, schema))
