"""Language-model scores by context-tree weighting, with a word-frequency base line.

The model reads a text as its lower-cased words with one space between them and an end
mark, byte by byte, each byte as eight binary decisions.  For every decision (the bits
of the byte so far) there is a context tree over the bytes before, up to ``DEPTH``;
each node has Krichevsky-Trofimov counts of the whole training corpus, and the
weights of all depths follow from the corpus by the context-tree recursion: a node's
weighted probability is half its own estimate and half the product of its branches'.

Every context that the corpus holds is in the model, so the model grows with the corpus.
A gram is a byte with the ``DEPTH`` bytes before it.  Grams are counted by task, dealt by
their last three context bytes (``PARTS`` parts), so that a subtree of depth three lies
in one part, and settled there from the leaves up.  What remains, the depths two, one
and none, is small: its grams are runs of two to four bytes of UTF-8.  Then the weights
go down again, in one more pass over the parts, and leave one number for each gram.
Grams that only texts outside the training have are counted with zero, which changes no
estimate; so each gram of a text has its number.

The most frequent grams and words (``HEAVY_GRAMS`` and ``HEAVY`` at most) are sent to all
tasks; all others reach their numbers by a join, in which no key is hot.

A task holds the grams of one part: one in ``PARTS`` of all unlike grams, or those of the
most frequent run of three bytes if that is more (half a percent of them here).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SortedIndex, materialise, run_hashes, spaced, text_slices, word_bounds

DEPTH = 6
#: Depth of the subtrees' roots, and the parts that they are dealt to.
ROOTS, PARTS = 3, 1024
#: Words and grams that are sent to all tasks at most, the most frequent ones.
HEAVY, HEAVY_GRAMS = 1 << 20, 1 << 21
#: Stands for the end of a text among word hashes, and among bytes (no word holds it).
END_WORD, END_BYTE = 0, 10
WORD, GRAM, TOP, TEXT = 0, 1, 2, 3
#: Distinct keys that a task gathers before it passes them on.
KEEP_KEYS = 1 << 21
#: Bytes of text that a task works on at once.
SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = range(8)


@dataclass
class Prepared:
    """A run of texts as words and as the bytes that the model reads."""

    n: int
    words: np.ndarray  # hash of each word
    rows: np.ndarray  # text of each word
    text: np.ndarray
    text_rows: np.ndarray  # text of each byte
    place: np.ndarray  # place of each byte in its text


def prepare(data: np.ndarray, offsets: np.ndarray) -> Prepared:
    n = len(offsets) - 1
    starts, ends, rows = word_bounds(data, offsets)
    text, begins = spaced(LOWER[data], starts, ends)
    words = run_hashes(text, begins[:-1], begins[1:] - 1)
    words &= np.uint64((1 << 63) - 1)  # one bit is for the count of training texts
    words[words == END_WORD] = 1
    last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True]) if len(rows) else np.zeros(0, np.int64)
    text[begins[last + 1] - 1] = END_BYTE
    sizes = np.bincount(rows, (begins[1:] - begins[:-1]).astype(float), n).astype(np.int64)
    empty = np.flatnonzero(sizes == 0)  # a text without words is its end mark
    text = np.insert(text, (np.cumsum(sizes) - sizes)[empty], END_BYTE)
    sizes[empty] = 1
    text_rows = np.repeat(np.arange(n), sizes)
    place = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[text_rows]
    return Prepared(n, words, rows, text, text_rows, place)


def grams(p: Prepared, depth: int) -> np.ndarray:
    """Each byte (lowest) with the ``depth`` bytes before it; before a text lie end marks."""
    out = p.text.astype(np.uint64)
    for k in range(1, depth + 1):
        back = np.full(len(p.text), END_BYTE, np.uint64)
        back[k:] = p.text[:-k] if k < len(p.text) else p.text[:0]
        back[p.place < k] = END_BYTE
        out |= back << np.uint64(8 * k)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0 (Stirling's series after a shift by eight)."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - np.log(np.pi) - _log_gamma(a + b + 1)


def _hashed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return keys * _ODD


def _index(keys: np.ndarray, *columns: np.ndarray) -> tuple:
    h = _hashed(keys)
    order = np.argsort(h)
    return SortedIndex(h[order], 2), *(c[order] for c in columns)


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unlike keys, sorted, with how often they occur in all texts and in those to learn from."""
    both, times = np.unique((keys << np.uint64(1)) | learn.astype(np.uint64), return_counts=True)
    keys = both >> np.uint64(1)
    if not len(keys):
        return keys, times, times
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first), np.add.reduceat(times * (both & np.uint64(1)).astype(np.int64), first)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    keys = np.concatenate([p[0] for p in parts])
    if not len(keys):
        return parts[0]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], *(np.add.reduceat(np.concatenate([p[i] for p in parts])[order], first) for i in range(1, len(parts[0])))


def _context(keys: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before the byte of each gram."""
    return (keys >> 8) & ((1 << (8 * depth)) - 1)


def _lists(bounds: np.ndarray, *columns: np.ndarray, width: tuple[int, ...] = ()) -> list[pa.Array]:
    """Each column as an array of lists that end at ``bounds``; ``width``: numbers for each entry of a column."""
    width = width or (1,) * len(columns)
    return [pa.ListArray.from_arrays(pa.array((bounds * w).astype(np.int32)), pa.array(c)) for c, w in zip(columns, width, strict=True)]


class _Gathered:
    """Counts by key, merged in a task and passed on, by part, before they grow too many."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.size = kind, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > KEEP_KEYS:
            self.parts = [_merged(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > KEEP_KEYS // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, every, train = _merged(self.parts)
            self.parts, self.size = [], 0
            keys = keys.view(np.int64)
            root = _context(keys, ROOTS) if self.kind == GRAM else keys
            part = (_hashed(root.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % PARTS
            order = np.argsort(part, kind="stable")  # keys stay in order within a part
            keys, part = keys[order], part[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            # Differences of neighbours are small and pack well.
            step = np.r_[0, keys[1:] - keys[:-1]]
            step[first] = keys[first]
            columns = _lists(np.r_[first, len(keys)], step, every[order].astype(np.int32), train[order].astype(np.int32))
            kind = pa.array(np.full(len(first), self.kind, np.int32))
            yield pa.RecordBatch.from_arrays([kind, pa.array(part[first]), *columns], ["kind", "part", "keys", "every", "train"])


def _entries(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _mixed(key: np.ndarray, n: np.ndarray, below: list[np.ndarray]) -> tuple[list[np.ndarray], ...]:
    """For the eight decisions of each gram of whole contexts, in order of their keys:

    the log weighted probability of the node (at the first gram of the node, else zero),
    the weight of the node's own estimate times that of the gram's bit, and the weight
    left to the branches.  ``below``: log probability of the branches, to be added up over
    the grams of a node; empty at the deepest.
    """
    weighted, own_share, left = [], [], []
    for bit in _BITS:
        node = key >> (8 - bit)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        is_one = (key >> (7 - bit)) & 1 == 1
        ones = np.add.reduceat(n * is_one, first).astype(float)
        zeros = np.add.reduceat(n, first) - ones
        own = log_kt(zeros, ones)
        whole, weight = own, np.ones(len(first))
        if below:
            whole = np.logaddexp(own, np.add.reduceat(below[bit], first)) - np.log(2)
            weight = np.exp(np.minimum(own - np.log(2) - whole, 0))
        at_first = np.zeros(len(key))
        at_first[first] = whole
        weighted.append(at_first)
        own_share.append(weight[of] * (np.where(is_one, ones[of], zeros[of]) + 0.5) / (zeros + ones + 1)[of])
        left.append((1 - weight)[of])
    return weighted, own_share, left


def _parents(keys: np.ndarray, n: np.ndarray, weighted: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The grams of ``depth`` above those of the next: keys, counts, log probability of their branches; and whose parent each is."""
    up, of = np.unique(keys & ((1 << (8 * (depth + 1))) - 1), return_inverse=True)
    n = np.bincount(of, n, len(up)).astype(np.int64)
    return up, n, [np.bincount(of, w, len(up)) for w in weighted], of


def settle(keys: np.ndarray, n: np.ndarray, depth: int = DEPTH) -> tuple[list[tuple], tuple]:
    """Whole subtrees from the leaves up to the depth of their roots.

    ``keys``: sorted grams, ``n``: their counts.  Returns for each depth from the
    roots' down the shares of the nodes' own estimates, what is left to the branches
    and the parent of each gram; and the roots' grams, counts and log probabilities.
    """
    levels, below, of = [], [], None
    for d in range(depth, ROOTS - 1, -1):
        weighted, own, left = _mixed(keys, n, below)
        levels.append((own, left, of))
        if d > ROOTS:
            keys, n, below, of = _parents(keys, n, weighted, d - 1)
    return levels[::-1], (keys, n, weighted)


def descend(levels: list[tuple], sure: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte, from what is settled above the roots (8 numbers for each root gram)."""
    for own, rest, of in levels:  # the roots first
        sure, left = sure + left * np.stack(own), left * np.stack(rest)
        if of is not None:
            sure, left = sure[:, of], left[:, of]
    return np.log10(sure).sum(axis=0)


def count_corpus(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Counts of words and grams, in all texts and in those to learn from, as packs of sorted keys.

    ``rows``: learn (boolean), text.  Returns kind, part, keys, every, train (arrays);
    for rows of the kind TOP, part is the last two context bytes, keys the roots' grams
    after them, train their counts and w the log weighted probabilities of their nodes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bytes_ = _Gathered(WORD), _Gathered(GRAM)
        for batch in batches:
            learn = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for at, to, data, offsets in text_slices(batch.column(1), SLICE):
                p, own = prepare(data, offsets), learn[at:to]
                h = np.concatenate([p.words, np.full(p.n, END_WORD, np.uint64)])
                yield from words.add(*_counted(h, np.concatenate([own[p.rows], own])))
                yield from bytes_.add(*_counted(grams(p, depth), own[p.text_rows]))
        yield from words.flush()
        yield from bytes_.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "part", "keys", "every", "train", "w"]

        def packed(kind: int, parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            keys, every, train = _merged(parts)
            none = pa.nulls(1, pa.list_(pa.float64()))
            bounds = np.array([0, len(keys)])
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([0], pa.int64()), *_lists(bounds, keys, every, train), none], names)
            if kind == GRAM:
                top, n, weighted = settle(keys, train, depth)[1]
                order = np.argsort(_context(top, ROOTS - 1), kind="stable")
                top, n, w = top[order], n[order], np.stack(weighted, axis=1)[order].ravel()
                context = _context(top, ROOTS - 1)
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                columns = _lists(np.r_[first, len(top)], top, n, n, w, width=(1, 1, 1, 8))
                kinds = pa.array(np.full(len(first), TOP, np.int32))
                yield pa.RecordBatch.from_arrays([kinds, pa.array(context[first]), *columns], names)

        at, parts, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                group = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if group != at and parts:
                    yield from packed(at[0], parts)
                    parts, size = [], 0
                at = group
                keys, every, train = (_entries(batch.column(c).slice(i, 1)).astype(np.int64) for c in (2, 3, 4))
                parts.append((np.cumsum(keys), every, train))
                size += len(keys)
                if len(parts) > 1 and size > 2 * len(parts[0][0]) + KEEP_KEYS:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
        if parts:
            yield from packed(at[0], parts)

    some = rows.select("learn", "text").mapInArrow(count, "kind int, part long, keys array<long>, every array<int>, train array<int>")
    dealt = some.repartition("kind", "part").sortWithinPartitions("kind", "part")
    return dealt.mapInArrow(merge, "kind int, part long, keys array<long>, every array<long>, train array<long>, w array<double>")


def _level(packs: DataFrame, depth: int) -> DataFrame:
    """The grams of ``depth``, 2 or 1, from packs (part, keys, n, w) of the next, one pack or more for each context.

    Returns part (their last ``depth`` - 1 context bytes), keys, n, w, own and rest (eight numbers for each key).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(packs: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            keys, n, w = (np.concatenate(c) for c in zip(*packs, strict=True))
            keys, n, below, _ = _parents(keys, n, list(w.reshape(-1, 8).T), depth)
            weighted, own, rest = _mixed(keys, n, below)
            context = _context(keys, depth - 1)
            order = np.argsort(context, kind="stable")
            first = np.flatnonzero(np.r_[True, context[order][1:] != context[order][:-1]])
            flat = [np.stack(x, axis=1)[order].ravel() for x in (weighted, own, rest)]
            columns = _lists(np.r_[first, len(keys)], keys[order], n[order], *flat, width=(1, 1, 8, 8, 8))
            return pa.RecordBatch.from_arrays([pa.array(context[order][first]), *columns], ["part", "keys", "n", "w", "own", "rest"])

        at, kept, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if part != at and size > KEEP_KEYS // 8:
                    yield settled(kept)
                    kept, size = [], 0
                at = part
                kept.append(tuple(_entries(batch.column(c).slice(i, 1)) for c in (1, 2, 3)))
                size += len(kept[-1][0])
        if kept:
            yield settled(kept)

    dealt = packs.select("part", "keys", "n", "w").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "part long, keys array<long>, n array<long>, w array<double>, own array<double>, rest array<double>")


def _table(packs: DataFrame, columns: tuple[str, ...]) -> list[np.ndarray]:
    """Packs brought to the driver, sorted by key: the keys, and the columns with eight rows of numbers for each key."""
    found = packs.select("keys", *columns).toArrow()
    if not found.num_rows:
        return [np.zeros(0, np.int64), *(np.zeros((8, 0)) for _ in columns)]
    keys = _entries(found.column(0).combine_chunks())
    order = np.argsort(keys)
    rest = [_entries(found.column(c).combine_chunks()).reshape(len(keys), -1)[order].T for c in columns]
    return [keys[order], *rest]


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, every, logp): log10 probability of the byte of each gram of ``counts`` by the model of the training texts."""
    tops = counts.filter(F.col("kind") == TOP).select("part", "keys", F.col("train").alias("n"), "w")
    two = materialise(_level(tops, 2), "grams-2")
    one = materialise(_level(two, 1), "grams-1")
    # Grams of two bytes: 65,536 at most.
    keys, n, w, own, rest = _table(one, ("n", "w", "own", "rest"))
    zero, n_0, below, of = _parents(keys, n[0] if len(keys) else keys, list(w), 0)
    sure, left = np.zeros((8, 0)), np.zeros((8, 0))
    if len(keys):
        _, own_0, left_0 = _mixed(zero, n_0, below)
        sure, left = np.stack(own_0)[:, of], np.stack(left_0)[:, of]
    sure, left = sure + left * own, left * rest
    # Grams of three bytes of UTF-8: well under five million, 72 bytes each.
    key_2, own, rest = _table(two, ("own", "rest"))
    of = np.searchsorted(keys, key_2 & 0xFFFF)
    sure, left = sure[:, of] + left[:, of] * own, left[:, of] * rest
    shared = counts.sparkSession.sparkContext.broadcast((key_2, sure.astype(np.float32), left.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_2, sure, left = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                keys, every, train = (_entries(batch.column(c).slice(i, 1)) for c in (0, 1, 2))
                levels, (top, _, _) = settle(keys, train, depth)
                at = np.searchsorted(key_2, top & 0xFFFFFF)
                logp = descend(levels, sure[:, at].astype(float), left[:, at].astype(float))
                for k in range(0, len(keys), 100_000):
                    s = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[s]), pa.array(every[s]), pa.array(logp[s])], ["key", "every", "logp"])

    grams_ = counts.filter(F.col("kind") == GRAM).select("keys", "every", "train")
    return materialise(grams_.mapInArrow(run, "key long, every long, logp double"), "gram-scores")


def frequent(rows: DataFrame, most: int) -> int:
    """The least count (column every) such that at most ``most`` rows reach it, to within a sixteenth of an octave."""
    level = F.floor(F.log2("every") * 16)
    found = rows.filter("every > 0").groupBy(level.alias("level")).agg(F.min("every").alias("least"), F.count(F.lit(1)).alias("n")).collect()  # 1,024 rows at most
    total, least = 0, 1 << 62
    for r in sorted(found, key=lambda r: -r["level"]):
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return least


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text by models of the texts for which ``learn`` holds.

    Lower-cases A-Z; tokens are the words between white space and one end.  Returns
    doc_id, n_tokens, n_known (tokens that training texts have), train_tokens,
    base_score (sum over the tokens of log10((c + 0.1) / (N + 0.1 (V + 1))) from the
    counts c in the N training tokens of V kinds), score (log10 probability of the
    tokens by the weighted context tree), bits_per_byte of that score.

    Defined cases: a null text is the empty text (its end is its one token); a null
    ``learn`` counts as false; null and repeated ids give a row each; with no training
    text every decision has probability one half; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    counts = materialise(count_corpus(rows), "corpus-counts")
    words = counts.filter(F.col("kind") == WORD).select(F.inline(F.arrays_zip("keys", "every", "train"))).withColumnRenamed("keys", "key")
    sums = words.agg(F.sum("train").alias("train"), F.count_if(F.col("train") > 0).alias("kinds")).first()
    train, kinds = sums["train"] or 0, sums["kinds"] or 0
    whole = train + 0.1 * (kinds + 1)
    often = frequent(words, HEAVY)
    is_heavy = (F.col("every") >= often) | (F.col("key") == END_WORD)
    found = words.filter(is_heavy).select("key", "train").toArrow()
    h = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    c = found.column("train").to_numpy()[order].astype(float)
    heavy = (SortedIndex(h[order]), np.log10((c + 0.1) / whole), c > 0)
    scores = gram_scores(counts)
    often_grams = frequent(scores, HEAVY_GRAMS)
    found = scores.filter(F.col("every") >= often_grams).select("key", F.col("logp").cast("float").alias("logp")).toArrow()
    heavy_grams = _index(found.column("key").to_numpy().astype(np.int64).view(np.uint64), found.column("logp").to_numpy())
    shared = spark.sparkContext.broadcast((heavy, heavy_grams))
    end = np.uint64(END_WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (index, log_share, known), (gram_index, gram_logp) = shared.value
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        names = ["row", "kind", "key", "n", "doc_id", "tokens", "known", "base", "score", "size"]

        def pairs(row: np.ndarray, rows: np.ndarray, keys: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
            pair = np.empty(len(keys), [("row", np.int64), ("key", np.uint64)])
            order = np.lexsort((keys, rows))
            pair["row"], pair["key"] = rows[order], keys[order]
            if len(pair):
                first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                times = np.diff(np.r_[first, len(pair)])
                some = pair[first]
                for k in range(0, len(some), 100_000):
                    s = slice(k, k + 100_000)
                    m = len(some[s])
                    ints, reals = pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())
                    columns = [pa.array(row[some["row"][s]]), pa.array(np.full(m, kind, np.int32)), pa.array(some["key"][s].view(np.int64)), pa.array(times[s]), ints, ints, ints, reals, reals, ints]
                    yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1), SLICE):
                p = prepare(data, offsets)
                row = number + np.arange(p.n)
                number += p.n
                place = index.find(p.words)
                hit = place >= 0
                mark = index.find(np.array([end]))[0]
                base = np.bincount(p.rows[hit], log_share[place[hit]], p.n) + log_share[mark]
                n_known = np.bincount(p.rows[hit], known[place[hit]], p.n).astype(np.int64) + int(known[mark])
                tokens = np.bincount(p.rows, minlength=p.n) + 1
                gram = grams(p, DEPTH)
                at_gram = gram_index.find(_hashed(gram))
                met = at_gram >= 0
                total = np.bincount(p.text_rows[met], gram_logp[at_gram[met]], p.n).astype(float)
                size = np.bincount(p.text_rows, minlength=p.n)
                none = pa.nulls(p.n, pa.int64())
                # The row of a text has a key of its own, by which it joins nothing.
                columns = [row, np.full(p.n, TEXT, np.int32), none, none, batch.column(0).slice(at, to - at), tokens, n_known, base, total, size]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)
                yield from pairs(row, p.rows[~hit], p.words[~hit], WORD)
                yield from pairs(row, p.text_rows[~met], gram[~met], GRAM)

    schema = "row long, kind int, key long, n long, doc_id long, tokens long, known long, base double, score double, size long"
    marked = rows.select("doc_id", "text").mapInArrow(run, schema)
    rare = words.filter(~is_heavy).select(F.lit(WORD).alias("kind"), F.col("key").alias("word"), F.col("train").alias("c"), F.lit(0.0).alias("logp"))
    rare_grams = scores.filter(F.col("every") < often_grams).select(F.lit(GRAM).alias("kind"), F.col("key").alias("word"), F.lit(0).cast("long").alias("c"), "logp")
    joined = marked.withColumn("word", F.coalesce("key", F.xxhash64("row"))).join(rare.union(rare_grams), ["kind", "word"], "left")
    is_word, is_gram = F.col("kind") == WORD, F.col("kind") == GRAM
    met = F.coalesce("c", F.lit(0))
    share = F.log10((met + 0.1) / F.lit(whole))
    joined = joined.select(
        "row", "doc_id", "tokens", "size",
        F.when(is_gram, F.col("n") * F.col("logp")).otherwise(F.col("score")).alias("score"),
        F.when(is_word, F.col("n") * share).otherwise(F.col("base")).alias("base"),
        F.when(is_word, F.when(met > 0, F.col("n")).otherwise(0)).otherwise(F.col("known")).alias("known"),
    )
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.max("size").alias("size"),
    )
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.col("size")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
