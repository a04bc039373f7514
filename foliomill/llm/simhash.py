"""SimHash near-duplicates, found by anchor-point covering.

A fingerprint of 64 bits is seen as two halves of 32.  Two fingerprints that differ in
at most three bits differ in at most one bit in one of the halves.  The anchors of a
half are the words of the perfect Hamming code [31, 26] over its first 31 bits: every
value lies within 1 (the covering radius) of exactly one anchor.  A fingerprint is
filed as the owner of its own anchor and replicated to every anchor within radius plus
threshold, that is 1 + 1 = 2: one or sixteen anchors of a half.  If x and y differ in
at most one bit of a half, y is a replica at the anchor that x owns, so comparing
owners with replicas at each anchor finds every pair; whole fingerprints are compared,
so nothing else is found.

Equal fingerprints are one class before the search.  What a task finds at its anchors
is reduced to a spanning forest before it is emitted, so a dense group costs edges in
proportion to its members; an anchor with more members than ``MEMBERS`` is dealt out as
pairs of parts.

``similar_rows`` is the form for looser likeness: wider fingerprints, of which many
sampled pieces are the words that serve as anchors (a code of covering radius zero,
threshold zero within a piece).  Its large anchors are dealt out in the same way, and what
it finds is checked by the exact sets of shingles.  The perfect code would need over a
thousand replicas of a fingerprint for the same share of pairs found at a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import LOWER, join_classes, materialise, spaced, text_slices, word_bounds
from .xxh import xxh64

BITS, DISTANCE = 64, 3
#: Members of an anchor that one group holds; larger anchors are split into parts of this size.
MEMBERS = 2048
LANES = np.uint64(0x0101010101010101)


def shingles_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of every shingle, the text it is in, and the number of shingles of each text."""
    n = len(offsets) - 1
    starts, ends, rows = word_bounds(data, offsets)
    text, begins = spaced(LOWER[data], starts, ends)
    words = np.bincount(rows, minlength=n)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    first_word = np.cumsum(words) - words
    doc = np.repeat(np.arange(n), count)
    before = np.cumsum(count) - count
    head = first_word[doc] + np.arange(len(doc)) - before[doc]
    tail = head + np.minimum(shingle, words[doc]) - 1
    return xxh64(text, begins[head], begins[tail + 1] - 1), doc, count


def majority(hashes: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that are set in over half of its hashes."""
    # Eight bits at a time: each byte of a sum counts one bit over at most 255 hashes.
    ones = np.zeros((len(count), BITS), np.int64)
    if len(hashes):
        nth = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        cuts = np.flatnonzero(nth % 255 == 0)
        owner = doc[cuts]
        runs = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for bit in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
            by_byte = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
            ones[owner[runs], bit::8] = np.add.reduceat(by_byte, runs, axis=0)
    bits = (2 * ones > count[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprint of each text: bit k is 1 if it is set in over half of the shingle hashes."""
    return majority(*shingles_of(data, offsets, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(1)):
                fp = fingerprints_of(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, "doc_id long, fp long")


#: Syndrome of each byte of a 31-bit word, by the byte's place: XOR of the positions (1 to 31) of its bits.
SYNDROME = np.array(
    [[np.bitwise_xor.reduce([8 * place + k + 1 for k in range(8) if b >> k & 1] or [0]) & 31 for b in range(256)] for place in range(4)],
    np.uint8,
)


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The anchor that owns each 31-bit value; and (index, anchor) of those at distance exactly two.

    The anchor at distance 0 or 1 is the value with the bit named by its syndrome
    flipped.  Those at distance two flip two bits whose positions XOR to the syndrome;
    a value that is an anchor has none, as anchors are three bits apart.
    """
    half = half.astype(np.int64)
    s = np.zeros(len(half), np.int64)
    for place in range(4):
        s ^= SYNDROME[place][(half >> (8 * place)) & 255]
    flip = np.r_[0, 1 << np.arange(31)]
    own = half ^ flip[s]
    away = []
    for i in range(1, 32):
        j = s ^ i
        at = np.flatnonzero((s > 0) & (j > i))
        away.append((at, half[at] ^ flip[i] ^ flip[j[at]]))
    return own, away


def placements(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor key (half in its lowest bit), fingerprint and whether it owns the anchor, for all placements."""
    keys, who, owns = [], [], []
    u = fps.view(np.uint64)
    for side in range(2):
        half = (u >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)
        own, away = anchors_of(half)
        keys.append(own * 2 + side)
        who.append(fps)
        owns.append(np.ones(len(fps), bool))
        for at, anchor in away:
            keys.append(anchor * 2 + side)
            who.append(fps[at])
            owns.append(np.zeros(len(at), bool))
    return np.concatenate(keys), np.concatenate(who), np.concatenate(owns)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the components that the edges a-b form."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def pairs_within(key: np.ndarray, fp: np.ndarray, owns: np.ndarray, part: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the owner-replica pairs within ``distance`` bits; rows sorted by key.

    ``part`` -1: compare with all of the group; else only rows of unlike parts 0 and 1.
    """
    u = fp.view(np.uint64)
    left = np.arange(len(key) - 1)
    found_a, found_b, size, k = [], [], 0, 1
    while len(left):
        left = left[left + k < len(key)]
        left = left[key[left] == key[left + k]]
        right = left + k
        near = np.bitwise_count(u[left] ^ u[right]) <= distance
        near &= (owns[left] | owns[right]) & ((part[left] < 0) | (part[left] != part[right]))
        if near.any():
            found_a.append(fp[left[near]])
            found_b.append(fp[right[near]])
            size += int(near.sum())
            if size > 1 << 20:
                a, b = _forest(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, size = [a], [b], len(a)
        k += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _forest(np.concatenate(found_a), np.concatenate(found_b))


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span every link within ``distance`` bits."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the covering holds up to three bits")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                key, fp, owns = placements(np.asarray(batch.column(0).slice(at, 20_000)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(owns)], ["key", "fp", "owns"])

    placed = distinct.select("fp").mapInArrow(place, "key long, fp long, owns boolean")
    placed = materialise(placed, "anchors")
    large = placed.groupBy("key").count().filter(F.col("count") > MEMBERS)
    large = materialise(large.select("key", F.ceil(F.col("count") / MEMBERS).cast("int").alias("parts")), "large-anchors")
    if large.isEmpty():
        cells = placed.select("key", F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(-1).alias("part"), "fp", "owns")
    else:
        marked = placed.join(large, "key", "left")
        small = marked.filter("parts is null").select("key", F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(-1).alias("part"), "fp", "owns")
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        split = marked.filter("parts is not null").withColumn("mine", mine)
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1)
        cells = small.union(
            split.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), side.alias("part"), "fp", "owns")
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "x", "y", "fp", "owns", "part"]
        kept = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool), np.zeros(0, np.int64)]
        kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool, np.int64)]
        for batch in batches:
            new = [np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) for c in names]
            rows = [np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(kept, new, strict=True)]
            cell = _cells(rows)
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            yield from report(rows, cell, cut)
            kept = [r[cut:] for r in rows]
        yield from report(kept, _cells(kept), len(kept[0]))

    def report(rows: list[np.ndarray], cell: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        if n:
            a, b = pairs_within(cell[:n], rows[3][:n], rows[4][:n], rows[5][:n], distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    keys = ["key", "x", "y"]
    dealt = cells.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, "a long, b long")


def _cells(rows: list[np.ndarray]) -> np.ndarray:
    """A number for each run of equal (key, x, y), the first three of ``rows``."""
    key, x, y = rows[:3]
    change = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return np.cumsum(np.r_[0, change]) if len(key) else np.zeros(0, np.int64)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row.

    Lower-cased A-Z, words between white space, shingles of ``shingle`` words (a shorter
    text is one shingle, a text without words has fingerprint zero).  Rows whose
    fingerprints differ in at most ``distance`` bits are linked; a component is what
    links reach.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the
    component, null only if all its ids are null).

    Defined cases: a null text is empty; rows with a null id take part and give a row;
    repeated rows give a row each; other columns are ignored; an empty table gives an
    empty result.
    """
    rows = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")), "classes")
    roots = connected(links(classes, distance), "fp")
    # Only fingerprints with a link need a root: (fp, component).
    linked = classes.join(roots, "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = linked.join(lowest, "root").select("fp", "component_id")
    total = classes.agg(F.sum("size")).first()[0] or 0
    by_class = classes.join(of_fp, "fp", "left").select("fp", "size", F.coalesce("component_id", "low").alias("component_id"))
    by_class = materialise(by_class, "components")
    found = join_classes(rows, by_class, "fp", "size", total)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: 64-bit words of a wide fingerprint, and how many of its bits may differ: at a similarity of
#: 0.8 of the shingle sets 39 are expected to, at 0.85 33, at 0.6 59, each give or take 6.
WIDE, WIDE_DISTANCE = 4, 46
#: Pieces sampled from a wide fingerprint, and bits of a piece.  The bits set how many unlike
#: texts meet by chance (one in 2^24), the pieces how many like ones do at all: at 0.8 90 of
#: 100, at 0.85 and over 99.  Beyond some 10^8 texts take longer pieces, and more of them.
PIECES, PIECE_BITS = 128, 24
#: The least similarity of shingle sets at which a row goes, as a fraction.
SIMILAR = (4, 5)
#: Members of an anchor that are compared one with another at once.
FEW = 64
#: Rows of a group that one task settles, and rows that a larger group is held against at once.
SETTLED = 256
#: Bits that fingerprints of candidates within a group differ in at most: more than any of a similarity of 0.8 do.
LOOSE = 64
#: Members of a part of a large anchor, and pairs of fingerprints that are compared at once.
WIDE_MEMBERS, AT_ONCE = 8_192, 1 << 20
#: One class in this many is looked at to see which anchors are large; it decides how rows are dealt, not which meet.
GLANCE = 16


def wide_fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints of ``WIDE`` words for each text, from as many hashes of a shingle."""
    hashes, doc, count = shingles_of(data, offsets, shingle)
    out = [majority(hashes, doc, count)]
    with np.errstate(over="ignore"):
        for i in range(1, WIDE):
            # Another hash of the same shingle: a multiplication spreads upwards, a shift back down.
            more = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            more = (more ^ (more >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(majority(more ^ (more >> np.uint64(32)), doc, count))
    return np.stack(out, axis=1)


def pieces_of(fps: np.ndarray) -> np.ndarray:
    """The anchor of each fingerprint (rows) in each piece (columns); the piece's number is in the key."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    rng = np.random.default_rng(17)
    out = np.empty((len(fps), PIECES), np.int64)
    for piece in range(PIECES):
        some = bits[:, rng.choice(bits.shape[1], PIECE_BITS, replace=False)]
        out[:, piece] = some @ (1 << np.arange(PIECE_BITS)) + (piece << PIECE_BITS)
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def anchor_edges(ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links among the members of one large anchor.

    All members linked to one of them are connected, and only the rest has to be
    compared with them; so a dense anchor takes time in proportion to its members.
    """
    rest, out_a, out_b = np.arange(len(ids)), [], []
    while len(rest):
        near = _apart(fps[rest], fps[rest[0]]) <= WIDE_DISTANCE
        star, rest = rest[near], rest[~near]
        out_a.append(ids[star[1:]])
        out_b.append(np.full(len(star) - 1, ids[star[0]]))
        step = max(1, AT_ONCE // len(star))
        for at in range(0, len(rest), step):
            some = rest[at : at + step]
            i, first = np.unique(np.nonzero(_apart(fps[some][:, None], fps[star][None]) <= WIDE_DISTANCE)[0], return_index=True)
            out_a.append(ids[some[i]])
            out_b.append(np.full(len(i), ids[star[0]]))
    return np.concatenate(out_a), np.concatenate(out_b)


def near_edges(key: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links at each anchor; rows sorted by key."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left, end = np.arange(len(key)), np.repeat(first + size, size)
    left = left[np.repeat(size <= FEW, size)]
    for k in range(1, FEW):
        left = left[left + k < end[left]]
        if not len(left):
            break
        near = left[_apart(fps[left], fps[left + k]) <= WIDE_DISTANCE]
        out_a.append(ids[near])
        out_b.append(ids[near + k])
    for at, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        a, b = anchor_edges(ids[at : at + n], fps[at : at + n])
        out_a.append(a)
        out_b.append(b)
    return _forest(np.concatenate(out_a), np.concatenate(out_b))


def similar_rows(docs: DataFrame, row_key: list[str], shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key) of the rows that stay: no row goes unless one that stays has a similarity of ``SIMILAR`` or more with it.

    Candidates are rows whose texts' wide fingerprints, of shingles of ``shingle`` words
    (lower-cased A-Z; fewer words are one shingle), differ in at most ``WIDE_DISTANCE``
    bits and agree in one piece at least, which holds for nine in ten of those with a
    similarity of 0.8 and for nearly all from 0.85.  In what links of candidates reach,
    rows are taken by their ids (a null one last), and a row stays if none that stays so
    far is as similar, by the exact sets of their shingles (as 64-bit hashes).

    Defined cases: texts without a word (null ones too) form one group; equal rows are
    told apart by ``row_key``; other columns are ignored; an empty table gives an empty result.
    """
    names = [f"w{i}" for i in range(WIDE)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    carried = [id_col, *row_key]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(0), 1 << 20):
                fps = wide_fingerprints_of(data, offsets, shingle).view(np.int64)
                rest = [batch.column(1 + i).slice(at, to - at) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(fps[:, i].copy()) for i in range(WIDE))], [*carried, *names])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), *(f"{n} long" for n in names)])
    rows = materialise(docs.select(text_col, *carried).mapInArrow(mark, schema), "wide-rows")
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), *row_key)
    # A number for each unlike fingerprint; it is written down with it, so it stays.
    classes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n_class")).withColumn("node", F.monotonically_increasing_id())
    classes = materialise(classes, "wide-classes")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                fps = np.stack([batch.column(i).slice(at, 2_000).to_numpy() for i in range(WIDE)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pieces_of(fps).ravel())], ["key"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                fps = np.stack([some.column(1 + i).to_numpy() for i in range(WIDE)], axis=1)
                key = pieces_of(fps).ravel()
                of = np.repeat(np.arange(len(fps)), PIECES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(some.column(0).to_numpy()[of]), *(pa.array(fps[of, i]) for i in range(WIDE))], ["key", "node", *names]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the last cell, which may go on in the next batch
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            columns = [np.concatenate(c) for c in zip(kept, columns, strict=True)] if kept else columns
            cell = _cells(columns[:3])
            to = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if to:
                yield reported(cell[:to], [c[:to] for c in columns])
            kept = [c[to:] for c in columns]
        if kept and len(kept[0]):
            yield reported(_cells(kept[:3]), kept)

    def reported(cell: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        a, b = near_edges(cell, columns[3], np.stack(columns[4:], axis=1).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    words = ", ".join(f"{n} long" for n in names)
    placed = classes.select("node", *names).mapInArrow(place, f"key long, node long, {words}")
    seen = classes.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(GLANCE)) == 0).select(*names).mapInArrow(anchors, "key long")
    parts = F.ceil(F.col("count") * GLANCE / WIDE_MEMBERS).cast("int")
    large = materialise(seen.groupBy("key").count().filter(F.col("count") * GLANCE > WIDE_MEMBERS).select("key", parts.alias("parts")), "large-anchors")
    whole = ["key", F.lit(-1).alias("x"), F.lit(-1).alias("y"), "node", *names]
    if large.isEmpty():
        cells = placed.select(*whole)
    else:
        # Of a large anchor every two parts meet in a cell, and the members of a part with them.
        marked = placed.join(large, "key", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        others = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        met = marked.withColumn("other", F.explode(others)).filter("parts is null or mine <> other")
        cells = met.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "node", *names)
    dealt = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    roots = connected(dealt.mapInArrow(compare, "a long, b long"), "node")
    of_class = classes.join(roots, "node", "left").select(*names, "n_class", F.coalesce("root", "node").alias("group"))
    sizes = of_class.groupBy("group").agg(F.sum("n_class").alias("n_group"))
    of_class = materialise(of_class.join(sizes, "group"), "wide-groups")
    total = sizes.agg(F.coalesce(F.sum("n_group"), F.lit(0))).first()[0]
    placed_rows = join_classes(rows.select(*carried, *names), of_class, names, "n_class", total)
    placed_rows = materialise(placed_rows.select(*row_key, rank.alias("rank"), "group", "n_group", *names), "wide-placed")
    alone = placed_rows.filter("n_group = 1").select(*row_key)
    members = docs.select(*row_key, F.col(text_col).alias("text")).join(placed_rows.filter("n_group > 1").drop("n_group"), row_key)
    return alone.unionByName(_apart_rows(members, row_key, shingle))


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted hashes) have the similarity ``SIMILAR``; sets without members have."""
    part, whole = SIMILAR
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * whole >= (len(a) + len(b) - both) * part


def _first_alike(sets: list[np.ndarray], fps: np.ndarray, mine: np.ndarray, fp: np.ndarray) -> bool:
    """Whether one of ``sets`` is similar to ``mine``, the nearest by fingerprint looked at first."""
    far = _apart(fps, fp[None])
    return any(_alike(mine, sets[i]) for i in np.argsort(far, kind="stable")[: np.count_nonzero(far <= LOOSE)].tolist())


class _Kept:
    """Rows of a group that stay, with their fingerprints."""

    def __init__(self):
        self.sets, self.fps = [], np.zeros((16, WIDE), np.uint64)

    def has(self, mine: np.ndarray, fp: np.ndarray) -> bool:
        return bool(self.sets) and _first_alike(self.sets, self.fps[: len(self.sets)], mine, fp)

    def add(self, mine: np.ndarray, fp: np.ndarray) -> None:
        if len(self.sets) == len(self.fps):
            self.fps = np.concatenate([self.fps, np.zeros_like(self.fps)])
        self.fps[len(self.sets)] = fp
        self.sets.append(mine)


def _apart_rows(members: DataFrame, row_key: list[str], shingle: int) -> DataFrame:
    """(row_key) of the rows of each group that stay, by exact comparison; ``members``: row_key, text, rank, group, fingerprint.

    Groups of up to ``SETTLED`` rows are settled by a task each.  In a larger one the first
    rows of ``SETTLED`` parts are settled so, and those that stay go to all of the many
    cells that the group is dealt to, where each of its rows is held against them; rows
    that are like none of them go on to the next round.
    """
    names = [f"w{i}" for i in range(WIDE)]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            for first, to, data, offsets in text_slices(batch.column(at), 1 << 20):
                hashes, _, count = shingles_of(data, offsets, shingle)
                ends = np.cumsum(count)
                found = [np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
                rest = [c.slice(first, to - first) for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(found, pa.binary())], [*(x for x in batch.schema.names if x != "text"), "shingles"])

    kinds = {f.name: f.dataType.simpleString() for f in members.schema} | {"shingles": "binary"}
    carried = [*(c for c in members.columns if c != "text"), "shingles"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    rest = materialise(members.mapInArrow(sets, schema), "shingle-sets")

    def in_turn(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fps = np.stack([batch.column(n).to_numpy() for n in names], axis=1).view(np.uint64)
        for raw, fp in zip(batch.column("shingles"), fps, strict=True):
            yield np.frombuffer(raw.as_py(), np.uint64), fp

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, _Kept()
        for batch in batches:
            take = []
            for i, (g, (mine, fp)) in enumerate(zip(batch.column("group").to_pylist(), in_turn(batch), strict=True)):
                if g != group:
                    group, kept = g, _Kept()
                if not kept.has(mine, fp):
                    kept.add(mine, fp)
                    take.append(i)
            yield batch.take(pa.array(take, pa.int64()))

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept = None, _Kept()
        for batch in batches:
            take = []
            cells = zip(batch.column("group").to_pylist(), batch.column("cell").to_pylist(), batch.column("stays").to_pylist(), in_turn(batch), strict=True)
            for i, (g, c, stays, (mine, fp)) in enumerate(cells):
                if (g, c) != cell:
                    cell, kept = (g, c), _Kept()
                if stays:
                    kept.add(mine, fp)
                elif not kept.has(mine, fp):
                    take.append(i)
            yield batch.select(carried).take(pa.array(take, pa.int64()))

    def settle(rows: DataFrame) -> DataFrame:
        return rows.repartition("group").sortWithinPartitions("group", "rank").mapInArrow(settled, schema)

    found = None
    while True:
        groups = materialise(rest.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
        few = rest.join(groups.filter(F.col("n") <= SETTLED).select("group"), "group").select(*carried)
        now = settle(few).select(*row_key)
        found = now if found is None else found.unionByName(now)
        large = groups.filter(F.col("n") > SETTLED).select("group", F.ceil(F.col("n") / SETTLED).cast("int").alias("cells"))
        if large.isEmpty():
            return found
        total = groups.agg(F.sum("n")).first()[0]
        sized = join_classes(rest, groups.filter(F.col("n") > SETTLED), "group", "n", total).select(*carried, F.ceil(F.col("n") / SETTLED).cast("int").alias("cells"))
        part = F.pmod(F.xxhash64(*row_key, F.lit(3)), F.lit(SETTLED))
        firsts = sized.groupBy("group", part.alias("part")).agg(F.min("rank").alias("rank")).select(*[F.col("rank")[c].alias(c) for c in row_key])
        stay = materialise(settle(rest.join(firsts, row_key).select(*carried)), "group-firsts")
        found = found.unionByName(stay.select(*row_key))
        # A row that stays is met in every cell of its group, and by itself, so it goes no further.
        everywhere = stay.join(large, "group").select(*carried, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(True).alias("stays"))
        dealt = sized.select(*carried, F.pmod(F.xxhash64(*row_key, F.lit(5)), "cells").cast("int").alias("cell"), F.lit(False).alias("stays"))
        both = everywhere.unionByName(dealt).repartition("group", "cell").sortWithinPartitions("group", "cell", F.desc("stays"))
        rest = materialise(both.mapInArrow(unlike, schema), "shingle-sets")
