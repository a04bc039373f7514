"""Scans of page folders, finished outputs and settings files."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import PAGE_GLOB, base_name, is_page
from ..functions.text import newlines

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def scan_pages(spark: SparkSession, folder: str, missing_ok: bool = False) -> DataFrame:
    """Page files right in ``folder``: path, file_name, length, content.

    Content is read only if selected, and a filter on length reaches the scan.  Files
    whose names begin with a dot or underscore are hidden to Spark's file sources; give
    ``scan_pages_listing`` a listing that has them.  A missing folder is an error, or
    with ``missing_ok`` an empty result.
    """
    if missing_ok and not _exists(spark, folder):
        return spark.createDataFrame([], PAGE_SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", PAGE_GLOB).load(folder)
    return scan_pages_listing(files.select("path", "length", "content"))


def scan_pages_listing(files: DataFrame) -> DataFrame:
    """Page files of a listing with the column ``path``: the same rule, whatever made the listing."""
    named = files.withColumn("file_name", base_name(F.col("path"))).filter(is_page(F.col("file_name")))
    return named.select("path", "file_name", *[c for c in files.columns if c not in ("path", "file_name")])


def scan_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files in ``folder`` (output_name); no file is opened.  A missing folder is empty."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "output_name string")
    return outputs_listing(spark.read.format("binaryFile").load(folder))


def outputs_listing(files: DataFrame) -> DataFrame:
    """Names of the files (output_name) of a listing with the column ``path``, whatever made it."""
    return files.select(base_name(F.col("path")).alias("output_name"))


def decode_configs(files: DataFrame) -> DataFrame:
    """(config_id, content, error) of rows (path, content binary): strict UTF-8 with line ends made LF.

    A file that is not UTF-8 gives an empty setting and an error text, not a failed run.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, newlines(F.col("content").cast("string"))).otherwise("")
    error = F.when(~valid, F.lit("not UTF-8"))
    return files.select(F.col("path").alias("config_id"), text.alias("content"), error.alias("error"))


#: Bytes of files that are passed on together.
READ_BYTES = 4 << 20


def _files_in_tasks(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path, content) of the files of a local ``folder`` whose names fit; one task lists them and all tasks read them."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matching() -> Iterator[str]:
            for e in os.scandir(folder) if os.path.isdir(folder) else ():
                if fnmatch.fnmatchcase(e.name, name) and e.name[0] not in "._":
                    if e.is_file():
                        yield e.path
                    for at, _, inside in os.walk(e.path) if e.is_dir() else ():
                        yield from (os.path.join(at, x) for x in inside if x[0] not in "._")

        for _ in batches:
            held: list[str] = []
            for path in matching():
                held.append(path)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["path"])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths: list[str] = []
            contents: list[bytes] = []
            size = 0
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    contents.append(f.read())
                paths.append(f"file:{path}")
                size += len(contents[-1])
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = spark.range(0, 1, 1, 1).mapInArrow(names, "path string")
    return listed.repartition(tasks).mapInArrow(read, "path string, content binary")


def scan_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """(config_id, content, error) of the settings files that match; a path that matches none is empty.

    Files of one local folder (which all machines share, if there are several) are listed
    and read in tasks, so the driver holds none of their names; other patterns, and other
    stores, go by Spark's file source, which lists them on the driver.
    """
    folder, _, name = pattern.rpartition("/")
    local = pattern.startswith("file:") or (pattern.startswith("/") and spark._jsc.hadoopConfiguration().get("fs.defaultFS").startswith("file:"))
    if local and "*" in name and not set(name) & set("[]{}\\") and not set(folder) & set("*?[]{}\\"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
        return decode_configs(_files_in_tasks(spark, folder, name))
    if not _exists(spark, pattern):
        return spark.createDataFrame([], "config_id string, content string, error string")
    return decode_configs(spark.read.format("binaryFile").load(pattern).select("path", "content"))
