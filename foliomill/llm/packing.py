"""Packing documents into sequences of fixed length by cutting-stock column generation.

A document longer than a sequence gives whole sequences (its body) and a rest.  The
rests are the items of a cutting-stock problem over the histogram of their lengths, in
classes of ``GRAIN`` tokens: a linear program over patterns, whose columns a knapsack
programme prices, solved on the driver, where neither the number of classes nor that of
patterns depends on the data.  Rounded down, with what is left packed by largest first,
the patterns cover every item.  Items are ranked within their class, in many hashed
splits, and a rank says which copy of which pattern an item goes to.

What the patterns leave open is filled to the last token with pieces cut from bodies,
and from items of the last sequences where bodies do not suffice: open places and
fillers are laid end to end on one line, and every stretch of the line between two
boundaries is a piece.  Of all documents only the fillers are cut elsewhere than at
multiples of the sequence length.  What remains at the end goes to sequences of powers
of two, which need no padding.

Tokens are not stored: a document's count and the CRCs of its aligned chunks come from
one pass over the texts, and only the fillers are encoded again.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .shared import materialise, with_row_key

CAPACITY = 2048
#: Tokens of a class of lengths.
GRAIN = 16
ROWS_PER_SPLIT = 512
MAX_SPLITS = 20_000
#: Tokens of a block of the line in which pieces are cut.
LINE_BLOCK = 1 << 16
#: Fixed value: how byte-level vocabularies cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids by a byte-level BPE tokenizer file, as the tokenizers library gives them without special tokens added."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model, level = spec["model"], spec["pre_tokenizer"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = spec["normalizer"] is None and level["type"] == "ByteLevel" and level["use_regex"] and not level["add_prefix_space"]
        ranked = plain and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        self.fast = None
        # The faster library takes a token's id for its rank, so both must agree.
        if ranked and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            byte = {c: i for i, c in enumerate(byte_symbols())}
            special = {x["content"]: x["id"] for x in spec["added_tokens"]}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
            except BaseException as e:  # its pattern engine gives up on very long runs of white space, with an error of no common type
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def document_ids(text: str | None, path: str, end: int) -> np.ndarray:
    return np.append(encoder(path)(text or ""), np.uint32(end))


# Patterns: the driver's part, over a histogram.


def _knapsack(values: np.ndarray, units: int) -> np.ndarray:
    """How many of each class (1 to ``units`` units wide) to take for the largest value in ``units``."""
    best, take = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for w in range(1, units + 1):
        gain = values[1 : w + 1] + best[w - 1 :: -1][:w]
        c = int(np.argmax(gain))
        best[w], take[w] = best[w - 1], 0
        if gain[c] > best[w] + 1e-12:
            best[w], take[w] = gain[c], c + 1
    out, w = np.zeros(units + 1, np.int64), units
    while w > 0:
        if take[w]:
            out[take[w]] += 1
            w -= take[w]
        else:
            w -= 1
    return out


def patterns(counts: np.ndarray, units: int, rounds: int = 5_000) -> list[tuple[np.ndarray, int]]:
    """(items by class, copies) of patterns that hold ``counts[c]`` items of each class c, fullest first.

    A class's items are c units wide and a pattern holds ``units``.  The linear program
    (fewest patterns) is solved by the revised simplex method from patterns of one class
    each; a stop after ``rounds`` costs patterns, not items.
    """
    counts = np.asarray(counts, np.int64)
    there = np.flatnonzero(counts)
    if not len(there):
        return []
    m = len(there)
    columns = np.zeros((m, units + 1), np.int64)
    columns[np.arange(m), there] = units // there
    inverse = np.diag(1.0 / (units // there))
    x = counts[there] / (units // there)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        values = np.zeros(units + 1)
        values[there] = np.maximum(duals, 0)
        column = _knapsack(values, units)
        if column[there] @ duals <= 1 + 1e-9:
            break
        way = inverse @ column[there]
        up = way > 1e-9
        step = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(np.argmin(step))
        x = np.maximum(x - step[out] * way, 0)
        x[out] = step[out]
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        columns[out] = column
    copies = np.floor(x + 1e-9).astype(np.int64)
    found: dict[tuple, int] = {}
    left = counts.copy()
    for column, n in zip(columns, copies, strict=True):
        # Rounding errors must not use an item twice.
        n = min([int(n), *(left[column > 0] // column[column > 0])])
        if n:
            found[tuple(column)] = found.get(tuple(column), 0) + n
            left -= n * column
    while left.any():
        column, room = np.zeros(units + 1, np.int64), units
        for c in np.flatnonzero(left)[::-1]:
            column[c] = min(left[c], room // c)
            room -= column[c] * c
        n = int((left[column > 0] // column[column > 0]).min())
        found[tuple(column)] = found.get(tuple(column), 0) + n
        left -= n * column
    width = np.arange(units + 1)
    return sorted(((np.array(c), n) for c, n in found.items()), key=lambda p: (-(p[0] @ width), tuple(p[0])))


# The distributed part.


def _split(key: list[str], n: int) -> Column:
    splits = max(1, min(MAX_SPLITS, -(-n // ROWS_PER_SPLIT)))
    return F.pmod(F.xxhash64(*key), F.lit(splits)).cast("int")


def laid(rows: DataFrame, size: str, key: list[str], n: int, start: str, group: str | None = None) -> DataFrame:
    """``rows`` with ``start``: the sum of ``size`` of all rows (of the group) before, in an order by hash of ``key``; ``n``: about how many rows.

    Rows are summed in hashed splits, so no group is one task's.
    """
    by = [group] if group else []
    rows = rows.withColumn("lay_split", _split(key, n))
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy("lay_split").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "lay_split").agg(F.sum(size).alias("lay_sum"))
    sums = sums.select(*by, "lay_split", F.coalesce(F.sum("lay_sum").over(before), F.lit(0)).alias("lay_from"))
    within = Window.partitionBy(*by, "lay_split").orderBy(F.xxhash64(*key, F.lit(1)), *key).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("lay_in", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return inner.join(sums, [*by, "lay_split"]).withColumn(start, F.col("lay_from") + F.col("lay_in")).drop("lay_from", "lay_in")


def _measured(docs: DataFrame, key: list[str], path: str, end: int, capacity: int) -> DataFrame:
    """(key, tokens, crcs): tokens of each document and the CRC of each of its aligned chunks."""
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in key) + ", tokens long, crcs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, crcs = [], []
            for text in batch.column(len(key)):
                ids = document_ids(text.as_py(), path, end)
                tokens.append(len(ids))
                crcs.append([crc(ids[i : i + capacity]) for i in range(0, len(ids), capacity)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], [*key, "tokens", "crcs"])

    return docs.mapInArrow(run, schema)


def _cut(slots: DataFrame, fillers: DataFrame, end: int) -> DataFrame:
    """Pieces (key_0, key_1, start, length, sequence_id, offset) of the line from 0 to ``end``.

    ``slots`` (at, length, sequence_id, offset) and ``fillers`` (at, length, key_0, key_1,
    start) each cover the line without gaps.
    """
    block = F.explode(F.sequence(F.floor(F.col("at") / LINE_BLOCK), F.floor((F.col("at") + F.col("length") - 1) / LINE_BLOCK))).alias("block")
    slot = F.struct("at", "sequence_id", "offset")
    filler = F.struct("at", "key_0", "key_1", "start")
    none_slot, none_filler = (F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType) for df, c in ((slots, slot), (fillers, filler)))
    marks = slots.select(block, "at", slot.alias("slot"), none_filler.alias("filler")).unionByName(fillers.select(block, "at", none_slot.alias("slot"), filler.alias("filler")))
    marks = marks.withColumn("at", F.greatest(F.col("at"), F.col("block") * LINE_BLOCK))
    order = Window.partitionBy("block").orderBy("at", F.col("slot").isNull())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    until = F.least(F.lit(end), (F.col("block") + 1) * LINE_BLOCK)
    pieces = marks.select(
        "at", (F.coalesce(F.lead("at").over(order), until) - F.col("at")).alias("length"),
        F.last("slot", ignorenulls=True).over(so_far).alias("slot"), F.last("filler", ignorenulls=True).over(so_far).alias("filler"),
    ).filter("length > 0")
    # A piece that a block's edge has cut in two is put together again.
    whole = pieces.groupBy("slot", "filler").agg(F.min("at").alias("at"), F.sum("length").alias("length"))
    return whole.select(
        "filler.key_0", "filler.key_1", (F.col("filler.start") + F.col("at") - F.col("filler.at")).alias("start"), "length",
        "slot.sequence_id", (F.col("slot.offset") + F.col("at") - F.col("slot.at")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Pieces (doc_id, row_file, row_at, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all ``docs``.

    A document is the ids of its text and the id ``end``; row_file and row_at tell rows
    apart whose ids are equal.  Sequences are numbered from 0 without gaps and filled from
    offset 0 without gaps; all are full, but for the last few, which are powers of two.
    A document of up to ``capacity`` tokens stays whole unless it serves as filler.

    Defined cases: a null text is empty, so its document is one token; null or repeated
    ids are packed row by row; an empty table gives an empty result; further columns,
    whatever their names, are passed over.
    """
    if capacity % grain or capacity & (capacity - 1):
        raise ValueError("the sequence length is a power of two and a multiple of the grain")
    spark = docs.sparkSession
    docs, place = with_row_key(docs)
    docs = docs.select(F.col(place[0]).alias("key_0"), F.col(place[1]).alias("key_1"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = ["key_0", "key_1"]
    known = materialise(_measured(docs.select(*key, "text"), key, path, end, capacity), "pack-measured")
    rest = F.col("tokens") % capacity
    items = known.select(*key, "tokens", rest.alias("length"), F.ceil(rest / grain).cast("int").alias("size"), F.element_at("crcs", -1).alias("crc")).filter("length > 0")
    histogram = {r["size"]: (r["n"], r["sum"]) for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("sum")).collect()}
    bodies = known.select(*key, "crcs", (F.col("tokens") - rest).alias("length")).filter("length > 0")
    body_sums = bodies.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("sum")).first()
    units = capacity // grain
    counts = np.zeros(units + 1, np.int64)
    for size, (n, _) in histogram.items():
        counts[size] = n
    n_items, in_items = int(counts.sum()), sum(s for _, s in histogram.values())
    chosen = patterns(counts, units)
    n_sequences = sum(n for _, n in chosen)
    n_kept = min(n_sequences, (in_items + body_sums["sum"]) // capacity)

    # Ranks within the classes say which copy of which pattern an item goes to.
    ranges, base, taken = [], 0, np.zeros(units + 1, np.int64)
    for column, n in chosen:
        for c in np.flatnonzero(column):
            ranges.append((int(c), int(taken[c]), int(taken[c] + n * column[c]), int(column[c]), base))
        taken += n * column
        base += n
    # As many rows as patterns have classes: independent of the data.
    table = spark.createDataFrame(ranges, "size int, rank_from long, rank_to long, per_copy long, base long")
    ranked = laid(items.withColumn("one", F.lit(1).cast("long")), "one", key, n_items, "rank", "size")
    placed = ranked.join(F.broadcast(table), "size").filter("rank >= rank_from and rank < rank_to")
    placed = placed.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("per_copy")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *key)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = materialise(placed.select(*key, "tokens", "length", "crc", "sequence_id", "offset"), "pack-placed")
    kept, dissolved = placed.filter(F.col("sequence_id") < n_kept), placed.filter(F.col("sequence_id") >= n_kept)

    # The line: open places of the kept sequences and then new sequences, against dissolved items and then bodies.
    fills = kept.groupBy("sequence_id").agg(F.sum("length").alias("offset")).withColumn("length", F.lit(capacity) - F.col("offset")).filter("length > 0")
    open_ = n_kept * capacity - (kept.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])
    loose = dissolved.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("sum")).first()
    crcs_type = known.schema["crcs"].dataType
    lone = laid(dissolved.select(*key, "length", (F.col("tokens") - F.col("length")).alias("start"), F.lit(None).cast(crcs_type).alias("crcs")), "length", key, loose["n"], "at")
    long = laid(bodies.select(*key, "length", F.lit(0).cast("long").alias("start"), "crcs"), "length", key, body_sums["n"], "at")
    line = materialise(lone.unionByName(long.withColumn("at", F.col("at") + loose["sum"])), "pack-line")
    whole = loose["sum"] + body_sums["sum"]
    if n_kept < n_sequences:
        stop = whole
    else:
        at_open = line.filter((F.col("at") < open_) & (F.col("at") + F.col("length") > open_)).select((F.col("at") + F.col("length")).alias("x")).first()
        stop = at_open[0] if at_open else open_
    slots = laid(fills, "length", ["sequence_id"], n_kept, "at").select("at", "length", "sequence_id", "offset")
    full, left = divmod(stop - open_, capacity)
    more = spark.range(full).select((F.col("id") * capacity + open_).alias("at"), F.lit(capacity).cast("long").alias("length"), (F.col("id") + n_kept).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    powers, at = [], open_ + full * capacity
    for power in range(capacity.bit_length(), -1, -1):
        if left >> power & 1:
            powers.append((at, 1 << power, n_kept + full + len(powers), 0))
            at += 1 << power
    more = more.unionByName(spark.createDataFrame(powers, "at long, length long, sequence_id long, offset long"))
    used = line.filter(F.col("at") < stop)
    cut = materialise(_cut(slots.unionByName(more), used.select("at", "length", *key, "start"), stop), "pack-cut")
    last = used.agg(F.max("lay_split").alias("split"), F.max(F.col("crcs").isNull()).alias("any")).first()
    # The line is in order of splits, so bodies that were cut lie in the first of them.
    fillers = docs if last["any"] else docs.filter(_split(key, body_sums["n"]) <= F.lit(last["split"] if last["split"] is not None else -1))
    by_doc = cut.groupBy(*key).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts"))
    pieces_cut = _cut_crcs(fillers.drop("doc_id").join(by_doc, key).select(*key, "text", "parts"), key, path, end)

    aligned = line.filter(F.col("at") >= stop).select(*key, "at", F.posexplode("crcs").alias("chunk", "ids_crc32"), "length").filter(F.col("chunk") * capacity < F.col("length"))
    first_aligned = n_kept + full + len(powers)
    pieces_aligned = aligned.select(
        *key, (F.col("chunk") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32",
        (F.floor((F.col("at") - stop) / capacity) + F.col("chunk") + first_aligned).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    pieces_kept = kept.select(*key, (F.col("tokens") - F.col("length")).alias("start"), "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
    pieces = pieces_kept.unionByName(pieces_aligned).unionByName(pieces_cut)
    ids = docs.select(*key, "doc_id").join(known.select(*key, F.col("tokens").alias("doc_tokens")), key)
    return pieces.join(ids, key).select("doc_id", F.col("key_0").alias("row_file"), F.col("key_1").alias("row_at"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _cut_crcs(rows: DataFrame, key: list[str], path: str, end: int) -> DataFrame:
    """Pieces with ids_crc32 of rows (key, text, parts)."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, crcs = [], []
            parts = batch.column("parts")
            for i, (text, mine) in enumerate(zip(batch.column("text"), parts, strict=True)):
                ids = document_ids(text.as_py(), path, end)
                for p in mine.as_py():
                    row.append(i)
                    crcs.append(crc(ids[p["start"] : p["start"] + p["length"]]))
            flat = parts.flatten()
            columns = [batch.column(k).take(pa.array(row, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, *(flat.field(c) for c in ("start", "length")), pa.array(crcs, pa.int64()), *(flat.field(c) for c in ("sequence_id", "offset"))], [*key, "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows.mapInArrow(run, f"{kinds}, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(docs: DataFrame, pieces: DataFrame, path: str, text_col: str = "text", end: int = 1) -> DataFrame:
    """(sequence_id, ids): the token ids of every sequence of ``pack(docs, ...)``, without padding."""
    docs, place = with_row_key(docs)
    texts = docs.select(F.col(place[0]).alias("row_file"), F.col(place[1]).alias("row_at"), F.col(text_col).cast("string").alias("text"))
    by_doc = pieces.groupBy("row_file", "row_at").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mine in zip(batch.column("text"), batch.column("parts"), strict=True):
                ids = document_ids(text.as_py(), path, end)
                rows += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tolist()) for p in mine.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["sequence_id", "offset", "ids"])

    parts = texts.join(by_doc, ["row_file", "row_at"]).select("text", "parts").mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    # A sequence has as many tokens as fit in it.
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
