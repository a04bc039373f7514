"""Glossaries of any size: all terms found in one walk over a text.

Terms of up to ``PART_BYTES`` form a trie with failure links, so the time for a text grows
with the text and with what is found, not with the number of terms.  A task builds the
automaton from the broadcast terms, once.  More terms stay a table: a filter of at most
``FILTER_BITS`` bits, which is broadcast, says where a text may hold a term; those places
meet the terms by an equi join and then their text by its row.  The filter may pass a place
too many, never one too few, and the join compares whole terms.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import free_name
from ..sources.scratch import stored

#: UTF-8 bytes of terms in an automaton; its memory is about a hundred times that in the worst case.
PART_BYTES = 2 << 20
#: Bits of the filter for more terms, at most (32 MB).
FILTER_BITS = 1 << 28
#: Bytes of text whose places are looked at together.
BLOCK = 1 << 19
#: Bytes of found runs that a worker passes on together (one longer run goes alone).
RUN_BYTES = 4 << 20
#: A place is tried for long terms only if its first so many bytes begin one.
GATES = [8 << i for i in range(20)]

Pair = tuple[str, str | None]


class Terms:
    """The terms of a part as an automaton; index i stands for the i-th pair."""

    def __init__(self, pairs: list[Pair]):
        self.pairs = pairs
        self.lengths = [len(t) for t, _ in pairs]
        self.automaton = ahocorasick.Automaton()
        for i, (term, _) in enumerate(pairs):
            self.automaton.add_word(term, i)
        if pairs:
            self.automaton.make_automaton()

    def all(self, text: str) -> Iterator[tuple[int, int]]:
        """(end, term) of every occurrence, overlapping ones too."""
        return self.automaton.iter(text) if self.pairs and text else iter(())

    def longest(self, text: str) -> dict[int, int]:
        """For each place where a term begins, the longest that does."""
        found: dict[int, int] = {}
        for end, i in self.all(text):
            found[end - self.lengths[i] + 1] = i  # a later end is a longer term
        return found

    def taken(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(from, to, term) of what a walk takes that tries the longest term first and goes on behind it."""
        return one_pass({at: (self.lengths[i], i) for at, i in self.longest(text).items()})

    def replaced(self, text: str) -> str:
        pieces, free = [], 0
        for at, to, i in self.taken(text):
            if (translation := self.pairs[i][1]) is not None:
                pieces += [text[free:at], translation]
                free = to
        return "".join([*pieces, text[free:]])


def one_pass(found: dict[int, tuple[int, object]]) -> Iterator[tuple[int, int, object]]:
    """Of (length, what) by place those that a walk takes which goes on behind what it took: (from, to, what)."""
    free = 0
    for at in sorted(found):
        if at >= free:
            length, what = found[at]
            free = at + length
            yield at, free, what


@dataclass
class Part:
    """Terms on their way to the tasks, under a name by which a worker knows that it has them."""

    name: str
    sent: Broadcast


_built: dict[str, Terms] = {}


def _terms(part: Part) -> Terms:
    if part.name not in _built:
        _built.clear()  # one automaton in a worker
        _built[part.name] = Terms(part.sent.value)
    return _built[part.name]


def terms_of(glossary: DataFrame) -> Part | DataFrame:
    """The terms (original, translation), broadcast if they are of bounded size, as a stored table with a number for each if not.

    Empty and null terms are left out; of a term given twice the largest translation counts.
    """
    spark = glossary.sparkSession
    translation = F.max("translation") if "translation" in glossary.columns else F.lit(None).cast("string")
    unlike = glossary.filter("original <> ''").groupBy("original").agg(translation.alias("translation"))
    terms = stored(unlike.withColumn("number", F.monotonically_increasing_id()), "terms")
    size = terms.agg(F.coalesce(F.sum(F.octet_length("original") + F.coalesce(F.octet_length("translation"), F.lit(0))), F.lit(0))).first()[0]
    if size > 2 * PART_BYTES or terms.agg(F.coalesce(F.sum(F.octet_length("original")), F.lit(0))).first()[0] > PART_BYTES:
        return terms
    return Part(uuid.uuid4().hex, spark.sparkContext.broadcast([(r[0], r[1]) for r in terms.drop("number").toLocalIterator()]))


class Hashes:
    """A 64-bit value for each run of the bytes, by differences of one running sum."""

    step, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    table = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    power = back = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        with np.errstate(over="ignore"):
            if len(Hashes.power) < n:
                Hashes.power, Hashes.back = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x)]) for x in (self.step, self.inverse))
            self.sums = np.zeros(n, np.uint64)
            np.cumsum(self.table[data] * self.power[: n - 1], out=self.sums[1:])

    def at(self, places: np.ndarray, length: int | np.ndarray, gate: bool) -> np.ndarray:
        """The value of the run of ``length`` at each place: its high and its low bits choose two bits of the filter."""
        with np.errstate(over="ignore"):
            h = (self.sums[places + length] - self.sums[places]) * self.back[places]
            h += np.asarray(2 * length + gate, np.uint64) * self.step
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
            return h ^ (h >> np.uint64(32))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values end to end, and where each begins (one more than values); nulls are empty."""
    values = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = values.buffers()
    begins = np.frombuffer(offsets, np.int64, len(values) + 1 + values.offset)[values.offset :] if len(values) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[begins[0] : begins[-1]], begins - begins[0]


@dataclass
class Filter:
    """Where terms may be: two bits for each term and for each gate that it passes."""

    bits: Broadcast
    shift: int
    lengths: list[int]

    def passing(self, places: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of the places those whose value has both its bits."""
        bits = self.bits.value
        for at in (lambda h: h >> np.uint64(self.shift), lambda h: h & np.uint64((1 << (64 - self.shift)) - 1)):
            bit = at(h)
            there = np.flatnonzero((bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
            places, h = places[there], h[there]
        return places

    def places(self, data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(value, first byte in ``data``, length) of all runs that may be terms, none across two values; a block at a time."""
        most = self.lengths[-1]
        for low in range(0, len(data), BLOCK):
            part = data[low : low + BLOCK + most]
            hashes, left, gates = Hashes(part), np.arange(min(BLOCK, len(part))), iter(GATES)
            gate, all_found = next(gates), []
            for length in self.lengths:
                while gate <= length:
                    left = left[left + gate <= len(part)]
                    left = self.passing(left, hashes.at(left, gate, True))
                    gate = next(gates)
                left = left[left + length <= len(part)]
                if not len(left):
                    break
                all_found.append(self.passing(left, hashes.at(left, length, False)) + low)
            if all_found:
                found = np.concatenate(all_found)
                length = np.repeat(self.lengths[: len(all_found)], [len(x) for x in all_found])
                value = np.searchsorted(begins, found, "right") - 1
                inside = found + length <= begins[value + 1]
                yield value[inside], found[inside], length[inside]


def filter_of(terms: DataFrame) -> Filter:
    """The filter of a table of terms; its bits are put together by tasks, a word of 64 at a time."""
    spark = terms.sparkSession
    size = F.octet_length("original")
    lengths = sorted(r[0] for r in terms.select(size).distinct().toLocalIterator())
    shift = 64 - max(16, min(FILTER_BITS, 64 * terms.count()).bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begins = _bytes_of(batch.column(0))
            hashes, first, n = Hashes(data), begins[:-1], np.diff(begins)
            values = [hashes.at(first, n, False)]
            for gate in GATES:
                first, n = first[n >= gate], n[n >= gate]
                if not len(n):
                    break
                values.append(hashes.at(first, gate, True))
            h = np.concatenate(values)
            at = np.unique(np.r_[h >> np.uint64(shift), h & np.uint64((1 << (64 - shift)) - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64))], ["at"])

    at = terms.select("original").mapInArrow(run, "at long")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    made = words.toArrow()
    bits = np.zeros(1 << (64 - shift - 6), np.int64)
    bits[made["word"].to_numpy()] = made["bits"].to_numpy()
    return Filter(spark.sparkContext.broadcast(bits.view(np.uint8)), shift, lengths)


def _pieces(value: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs in pieces of ``RUN_BYTES``: terms within terms have more bytes in all than the text that holds them."""
    ends, low = np.cumsum(length), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - length[low] + RUN_BYTES, "right")))
        yield value[low:high], first[low:high], length[low:high]
        low = high


def occurrences(rows: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, at, length, original, translation, number) of every occurrence of a term, overlapping ones too; places in bytes."""
    sent = filter_of(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begins = _bytes_of(batch.column(1))
            for value, first, length in (x for found in sent.places(data, begins) for x in _pieces(*found)):
                ends = np.r_[0, np.cumsum(length)].astype(np.int32)
                whole = data[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
                runs = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(whole.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(value)), pa.array((first - begins[value]).astype(np.int32)), pa.array(length.astype(np.int32)), runs], [key, "at", "length", "run"]
                )

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(key, text).mapInArrow(run, f"{key} {kind}, at int, length int, run binary")
    # As bytes, so that a run which cuts a character in two is no text, and no term.
    return found.join(terms.withColumn("run", F.col("original").cast("binary")), "run").drop("run")


def _by_row(df: DataFrame, text: str, terms: DataFrame, pair: list[str]) -> tuple[DataFrame, DataFrame, str]:
    """``df`` stored with a number for each row, and (number, found) of the rows with terms: at, length and ``pair`` by place."""
    key = free_name(df, "term_row")
    rows = stored(df.withColumn(key, F.monotonically_increasing_id()), "texts")
    # The longest at a place; of the terms there one has that length.
    best = occurrences(rows, key, text, terms).select(key, F.struct("at", "length", *pair).alias("x"))
    return rows, best.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("found")), key


def _taken(found: list[dict] | None) -> Iterator[tuple[int, int, dict]]:
    # A later one at the same place is longer.
    return one_pass({x["at"]: (x["length"], x) for x in found or ()})


def substituted(df: DataFrame, text: str, glossary: DataFrame, output: str) -> DataFrame:
    """``df`` with the terms of ``text`` replaced by their translations in one pass, the longest term at a place first.

    What was put in is not looked at again; a term without a translation stays; a null text stays null.
    """
    kept = [c for c in df.columns if c != output]
    sent = known = terms_of(glossary)
    if isinstance(known, Part):
        source, at, before = df, df.columns.index(text), None
    else:
        sent = None
        rows, found, key = _by_row(df, text, known, ["translation"])
        column = free_name(rows, "found")
        source = rows.join(found.withColumnRenamed("found", column), key, "left").drop(key)
        at, before = source.columns.index(text), source.columns.index(column)
    places = [source.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str | bytes | None] = []
            for n, value in enumerate(batch.column(at)):
                body = value.as_py()
                if body is None:
                    out.append(None)
                elif sent:
                    out.append(_terms(sent).replaced(body))
                else:
                    out.append(_put_in(body.encode(), [(x, y, t["translation"]) for x, y, t in _taken(batch.column(before)[n].as_py())]).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(out, pa.string())], [*kept, output])

    return source.mapInArrow(run, T.StructType([*(source.schema.fields[i] for i in places), T.StructField(output, T.StringType())]))


def fits(listed: DataFrame) -> bool:
    """Whether the settings' arrays (column ``terms``) are of a size in all that may be sent to every task."""
    bytes_of = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t["original"]) + F.octet_length(t["translation"]))
    return listed.agg(F.coalesce(F.sum(bytes_of), F.lit(0))).first()[0] <= PART_BYTES


def settings_of(listed: DataFrame, key: str, df: DataFrame) -> Broadcast | None:
    """The terms of each setting (key, terms), broadcast; nothing if they are too large for that or ``df`` has keys that only Spark compares with these."""
    kinds = [x.schema[key].dataType for x in (listed, df)]
    if not any(all(isinstance(k, kind) for k in kinds) for kind in (T.StringType, T.IntegralType)) or not fits(listed):
        return None
    pairs = {r[0]: [(t["original"], t["translation"]) for t in r[1]] for r in listed.select(key, "terms").filter(F.col(key).isNotNull()).toLocalIterator()}
    return listed.sparkSession.sparkContext.broadcast(pairs)


def substituted_by_setting(df: DataFrame, text: str, settings: Broadcast, key: str, output: str) -> DataFrame:
    """``df`` with each text's terms replaced by ``substituted``'s rule, those of the row's own setting."""
    places = [i for i, c in enumerate(df.columns) if c != output]
    names = [df.columns[i] for i in places]
    at, setting = df.columns.index(text), df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, built = settings.value, {}
        for batch in batches:
            out: list[str | None] = []
            for body, which in zip(batch.column(at), batch.column(setting), strict=True):
                body, which = body.as_py(), which.as_py()
                if body and which in pairs:
                    if which not in built:
                        built[which] = Terms(pairs[which])
                    body = built[which].replaced(body)
                out.append(body)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), pa.array(out, pa.string())], [*names, output])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in places), T.StructField(output, T.StringType())]))


def _put_in(body: bytes, taken: list[tuple[int, int, str | None]]) -> bytes:
    pieces, free = [], 0
    for at, to, translation in taken:
        if translation is not None:
            pieces += [body[free:at], translation.encode()]
            free = to
    return b"".join([*pieces, body[free:]])


def _walked(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``one_pass`` over places in ascending order: which of them are taken.  Only those that reach into one another are looked at singly."""
    taken = np.ones(len(at), bool)
    inside = np.flatnonzero(at[1:] < np.maximum.accumulate(ends)[:-1]) + 1
    free, last = 0, -1
    for i in inside.tolist():
        if last != i - 1:
            free = ends[i - 1]  # nothing reaches into that one, so it is taken
        taken[i] = at[i] >= free
        if taken[i]:
            free = ends[i]
        last = i
    return taken


def _sums(found: pa.ListArray) -> list[np.ndarray]:
    """(number, rows, occurrences) of the terms that the one-pass rule takes, of rows whose (at, length, number) are listed by place."""
    flat = found.flatten()
    at, length, number = (flat.field(name).to_numpy() for name in ("at", "length", "number"))
    row = np.repeat(np.arange(len(found), dtype=np.int64), found.value_lengths().to_numpy())
    place = (row << 32) + at
    if not len(place):
        return [place] * 3
    longest = np.r_[place[1:] != place[:-1], True]  # a later one at the same place is longer
    row, place, length, number = (x[longest] for x in (row, place, length, number))
    taken = _walked(place, place + length)
    row, number = row[taken], number[taken]
    order = np.lexsort((row, number))
    row, number = row[order], number[order]
    term = np.r_[True, number[1:] != number[:-1]]
    first = np.flatnonzero(term)
    pair = term | np.r_[True, row[1:] != row[:-1]]
    return [number[first], np.add.reduceat(pair, first, dtype=np.int64), np.diff(np.r_[first, len(number)])]


def counted(df: DataFrame, text: str, glossary: DataFrame) -> DataFrame:
    """(original, rows, occurrences) of all terms: how often the one-pass rule takes them in ``text``; added up in each batch first.

    Of terms that are a table only numbers travel with the places found, and what they
    come to meets the terms at the end.
    """
    known = terms_of(glossary)
    if isinstance(known, Part):
        listed, by = glossary.select("original").filter("original <> ''").distinct(), "original"
        sums = df.select(text).mapInArrow(_count_by_automaton(known), "original string, n_rows long, n_times long")
    else:
        listed, by = known.select("original", "number"), "number"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _sums(batch.column(0))], ["number", "n_rows", "n_times"])

        found = _by_row(df.select(text), text, known, ["number"])[1]
        sums = found.select("found").mapInArrow(run, "number long, n_rows long, n_times long")
    added = sums.groupBy(by).agg(F.sum("n_rows").alias("rows"), F.sum("n_times").alias("occurrences"))
    zero = F.lit(0).cast("long")
    return listed.join(added, by, "left").select("original", *(F.coalesce(c, zero).alias(c) for c in ("rows", "occurrences")))


def _count_by_automaton(part: Part) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_with, times = Counter(), Counter()
            for value in batch.column(0):
                terms = _terms(part)
                here = Counter(terms.pairs[i][0] for _, _, i in terms.taken(value.as_py() or ""))
                rows_with.update(here.keys())
                times.update(here)
            names = list(times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([rows_with[x] for x in names], pa.int64()), pa.array([times[x] for x in names], pa.int64())], ["original", "n_rows", "n_times"]
            )

    return run


def violations(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, original, translation, missing, kept) of the terms in ``source`` that ``target`` does not treat as the glossary says.

    ``target`` is walked twice, for terms that are still there and for translations; a
    null target or translation violates nothing.
    """
    known = terms_of(glossary)
    if isinstance(known, DataFrame):
        rows = stored(pairs.select("id", "source", "target", F.monotonically_increasing_id().alias("row")), "pairs")
        there = occurrences(rows.filter("target is not null"), "row", "source", known).select("row", F.struct("original", "translation").alias("x"))
        return judged(rows.join(there.groupBy("row").agg(F.collect_set("x").alias("terms")), "row"), "terms")
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _terms(known)
        wanted = sorted({t for _, t in terms.pairs if t})
        number = {t: i for i, t in enumerate(wanted)}
        translations = Terms([(t, None) for t in wanted])
        for batch in batches:
            out: list[tuple] = []
            for n, (source, target) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                source, target = source.as_py(), target.as_py()
                there = {i for _, i in terms.all(source)} if source and target is not None else ()
                if there:
                    left, made = {i for _, i in terms.all(target)}, {i for _, i in translations.all(target)}
                    for i in there:
                        original, translation = terms.pairs[i]
                        missing = None if translation is None else translation != "" and number[translation] not in made
                        if missing or i in left:
                            out.append((n, original, translation, missing, i in left))
            took, *columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(took, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "original", "translation", "missing", "kept"])

    return pairs.select("id", "source", "target").mapInArrow(run, f"id {kind}, original string, translation string, missing boolean, kept boolean")


def judged(pairs: DataFrame, listed: str) -> DataFrame:
    """(id, original, translation, missing, kept) of the terms in the array ``listed`` that ``target`` does not treat as they say."""
    target = F.col("target")
    checked = F.transform(
        listed, lambda t: F.struct(t["original"].alias("original"), t["translation"].alias("translation"), (~F.contains(target, t["translation"])).alias("missing"), F.contains(target, t["original"]).alias("kept")),
    )
    return pairs.select("id", F.explode(F.filter(checked, lambda t: t["missing"] | t["kept"])).alias("term")).select("id", "term.*")
