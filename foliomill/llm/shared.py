"""What the operators share: the shared scratch folder and plain byte arrays of texts."""

from __future__ import annotations

import math
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one only where that is unset in a local session (tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    Cuts the lineage without executor-local storage, so that a lost executor
    costs a re-read and not a recomputation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two columns that tell its rows apart, equal ones too: its file (as a hash) and its place there.

    The key is the same whenever the files are read; rows that do not come straight from
    files are stored first.  Returns the names of the two columns as well.
    """
    names = [free_name(df, "row_file"), free_name(df, "row_at")]
    place = {names[0]: F.xxhash64("_metadata.file_path"), names[1]: F.col("_metadata.row_index")}
    try:
        return df.withColumns(place), names
    except AnalysisException:  # no files behind these rows
        return materialise(df, "rows").withColumns(place), names


def in_order(df: DataFrame, by: list[str | Column], at: str) -> DataFrame:
    """``df`` stored in the order of ``by``, each row with its place in that order (column ``at``, from 0).

    Sorted by ranges in many tasks and written once, so a place is the number of rows in
    the files before and in front of it in its own; Spark numbers the files of one write
    by task, so by range.  Rows with equal ``by`` fall to one task: give a last column
    that tells them apart.
    """
    file, row, n, start = (free_name(df, x) for x in ("order_file", "order_row", "order_n", "order_start"))
    rows = materialise(df.orderBy(*by), "ordered")
    part, piece = (F.coalesce(F.regexp_extract("_metadata.file_name", p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)"))
    placed = rows.withColumns({file: F.shiftleft(part, 24) + piece, row: F.col("_metadata.row_index")})
    # A row for each file written, of which there are as many as shuffle partitions.
    files = placed.groupBy(file).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(file, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    placed = placed.join(F.broadcast(starts), file).withColumn(at, F.col(start) + F.col(row))
    return placed.drop(file, row, start)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of every row with its class, in which no class, however large, is read by one task.

    Classes that hold over one row in ``MOST_LARGE`` of all ``total`` (column ``size``) are
    ``MOST_LARGE`` at most and sent to all tasks; the rest meet their rows by ``key``.
    """
    is_large = F.col(size) * MOST_LARGE > total
    large, rest = F.broadcast(classes.filter(is_large)), classes.filter(~is_large)
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(rest, key))


MOST_LARGE = 1_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does that for pure ASCII texts, in less time."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id: int, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def text_slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole texts of about ``most`` bytes.

    Yields first row, last row + 1, the UTF-8 bytes of those rows end to end, and
    their offsets (one more than rows).  Null texts are empty.  A text longer than
    ``most`` forms a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to, whole[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


#: Lower-cases A-Z, leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that separate words, \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each word."""
    inside = ~IS_SPACE[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end with one space after each, and where each begins."""
    lengths = ends - starts + 1
    begins = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=begins[1:])
    if not len(starts):
        return np.zeros(0, np.uint8), begins
    source = np.ones(begins[-1], np.int64)
    source[0] = starts[0]
    source[begins[1:-1]] = starts[1:] - ends[:-1]
    out = data[np.minimum(np.cumsum(source), len(data) - 1)]
    out[begins[1:] - 1] = 32
    return out, begins


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each run of bytes, equal for equal runs (wrapping polynomial over random byte values)."""
    rng = np.random.default_rng(20)
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(step), -1, 1 << 64))
        power = np.full(len(data) + 1, step)
        power[0] = 1
        power = np.multiply.accumulate(power)
        back = np.full(len(data) + 1, inverse)
        back[0] = 1
        back = np.multiply.accumulate(back)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[:-1], out=total[1:])
        return (total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)


class SortedIndex:
    """Look-ups in a sorted array of hashes.

    A table over the top bits says where to start, so two probes settle nearly all.
    """

    def __init__(self, keys: np.ndarray, slots_per_entry: int = 4):
        self.keys = keys
        bits = max(1, math.ceil(math.log2(max(2, slots_per_entry * len(keys)))))
        self.shift = np.uint64(64 - bits)
        self.slots = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the sorted keys, -1 for those not in it."""
        out = np.full(len(h), -1)
        if not len(self.keys):
            return out
        top, rows, at = len(self.keys) - 1, np.arange(len(h)), self.slots[h >> self.shift]
        while len(rows):
            here = self.keys[np.minimum(at, top)]
            hit = here == h
            out[rows[hit]] = at[hit]
            go = (here < h) & (at < top)
            rows, at, h = rows[go], at[go] + 1, h[go]
        return out
