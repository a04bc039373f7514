"""Listing of very many folders, as a Python data source whose tasks list them.

The driver reads the names of the folders only.  Names that begin with a dot are seen,
and a folder that cannot be read gives a row with an error and not a failed job.  Limits
on length are pushed into the listing (``spark.sql.python.filterPushdown.enabled``).
The folders must be on a path that driver and executors share.
"""

from __future__ import annotations

import json
import operator
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

PAGES = (".png", ".jpg", ".jpeg", ".webp")
#: Folders of one task at most, and tasks at most (then each has more).
FOLDERS_PER_TASK, MAX_TASKS = 64, 10_000
COMPARED = {ds.LessThanOrEqual: operator.le, ds.LessThan: operator.lt, ds.GreaterThanOrEqual: operator.ge, ds.GreaterThan: operator.gt, ds.EqualTo: operator.eq}


@dataclass
class Folders(ds.InputPartition):
    names: list[str]


class FolderReader(ds.DataSourceReader):
    def __init__(self, root: str, suffixes: tuple[str, ...] | None):
        self.root, self.suffixes = root, suffixes
        self.limits: list[tuple[type, int]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            if type(f) in COMPARED and f.attribute == ("length",) and isinstance(f.value, int):
                self.limits.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Folders]:
        names = sorted(e.name for e in os.scandir(self.root) if e.is_dir())
        size = max(FOLDERS_PER_TASK, -(-len(names) // MAX_TASKS))
        return [Folders(["", *names[:size]]), *(Folders(names[i : i + size]) for i in range(size, len(names), size))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for name in partition.names:
            folder = os.path.join(self.root, name)
            try:
                for e in os.scandir(folder):
                    if e.is_file() and (self.suffixes is None or e.name.lower().endswith(self.suffixes)):
                        length = e.stat().st_size
                        if all(COMPARED[kind](length, value) for kind, value in self.limits):
                            yield name or None, e.name, e.path, length, None
            except OSError as e:
                if not self.limits:
                    yield name or None, None, folder, None, type(e).__name__


class FolderSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_folders"

    def schema(self) -> str:
        return "project string, file_name string, path string, length long, error string"

    def reader(self, schema: object) -> FolderReader:
        suffixes = json.loads(self.options.get("suffixes", "null"))
        return FolderReader(self.options["path"], tuple(suffixes) if suffixes is not None else None)


def scan_folders(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = PAGES) -> DataFrame:
    """(project, file_name, path, length, error) of the files in ``root`` (project null) and in each folder right in it.

    ``suffixes`` are compared without regard to case; None takes every file.  A folder
    that cannot be read has a row with its error and no file.  Turns on the session's
    setting for filters in Python data sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    return spark.read.format("page_folders").option("suffixes", json.dumps(suffixes)).load(root)


def scan_project_outputs(spark: SparkSession, root: str) -> DataFrame:
    """(project, output_name) of what is finished in the folders of all projects."""
    files = scan_folders(spark, root, None).filter("file_name is not null")
    return files.selectExpr("project", "file_name output_name")
