"""Repair of conversation structure with the fewest, and among these the first, edits.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles.  Rows are kept,
given another role or deleted, and empty turns are inserted; an audit is the string of
the edits' initials, and of the cheapest audits the least in ASCII order is taken.

The dynamic programme walks a run of rows with one best audit for each state of the
pattern.  Audits share their beginnings: an audit is a node that links to the one it
extends, with binary-lifting ancestors and a rolling hash, so a tie is settled by a
search for the longest common prefix in logarithmic steps.  What the hashes say is
verified: the ancestors there must be the same node, or else the texts are compared.

No conversation is one task's work.  All rows are put in order once and cut into chunks
of ``CHUNK_ROWS``; a piece of a conversation in a chunk is solved for every state that
it could be entered in, the pieces are joined by the same programme with audits of
pieces in place of letters, and each chunk then edits its own rows.  Only the digest of
a conversation that spans chunks reads its text in one task, as a stream of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_order, materialise, with_row_key

CHUNK_ROWS = 1024
#: Bytes of text that a piece of a long conversation has at least (but for its last one).
PIECE_BYTES = 1 << 20
#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The pattern as states (0 nothing yet, 1 after s, 2 after u, 3 after a) and what each may read.
READS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A role that edits can write in each state, and where it leads.
WRITES = [next((c, q) for c, q in reads.items() if c in ROLES) for reads in READS]
SPACE = " \t\n\x0b\x0c\r"
_BASE, _PRIME = 256, (1 << 61) - 45


class Trails:
    """Strings as linked nodes: node 0 is the empty one, every other extends its parent by a text."""

    def __init__(self):
        self.ups: list[list[int]] = [[]]
        self.depth, self.hash, self.text = [0], [0], [""]

    def add(self, parent: int, text: str) -> int:
        node, ups, k = len(self.depth), [parent], 0
        while k < len(self.ups[ups[k]]):
            ups.append(self.ups[ups[k]][k])
            k += 1
        self.ups.append(ups)
        self.depth.append(self.depth[parent] + len(text))
        self.hash.append(self._extend(self.hash[parent], text))
        self.text.append(text)
        return node

    @staticmethod
    def _extend(value: int, text: str) -> int:
        raw = text.encode()
        return (value * pow(_BASE, len(raw), _PRIME) + int.from_bytes(raw, "big")) % _PRIME

    def _at(self, node: int, length: int) -> int:
        """The ancestor of ``node`` (or itself) in whose text the first ``length`` characters end."""
        for k in range(len(self.ups[node]) - 1, -1, -1):
            if k < len(self.ups[node]) and self.depth[self.ups[node][k]] >= length:
                node = self.ups[node][k]
        return node

    def _prefix(self, node: int, length: int) -> int:
        node = self._at(node, length)
        if self.depth[node] == length:
            return self.hash[node]
        parent = self.ups[node][0]
        return self._extend(self.hash[parent], self.text[node][: length - self.depth[parent]])

    def string(self, node: int) -> str:
        parts = []
        while node:
            parts.append(self.text[node])
            node = self.ups[node][0]
        return "".join(reversed(parts))

    def _same(self, a: int, b: int, length: int) -> bool:
        """Whether both begin with the same ``length`` characters, by their nodes and not by hash."""
        a, b = self._at(a, length), self._at(b, length)
        while a != b and length:
            # Texts of both down to the nearer of the two parents.
            p, q = self.ups[a][0], self.ups[b][0]
            low = max(self.depth[p], self.depth[q])
            if self.text[a][low - self.depth[p] : length - self.depth[p]] != self.text[b][low - self.depth[q] : length - self.depth[q]]:
                return False
            length = low
            a, b = (p if self.depth[p] == low else a), (q if self.depth[q] == low else b)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of ``a`` comes before that of ``b``."""
        if a == b:
            return False
        lo, hi = 0, min(self.depth[a], self.depth[b])
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self._prefix(a, mid) == self._prefix(b, mid):
                lo = mid
            else:
                hi = mid - 1
        if not self._same(a, b, lo):
            return self.string(a) < self.string(b)
        if lo == min(self.depth[a], self.depth[b]):
            return self.depth[a] < self.depth[b]
        return self._char(a, lo) < self._char(b, lo)

    def _char(self, node: int, place: int) -> str:
        node = self._at(node, place + 1)
        return self.text[node][place - self.depth[self.ups[node][0]]]


Best = list[tuple[int, int] | None]  # by state: cost and node


def _offer(trails: Trails, best: Best, state: int, cost: int, parent: int, text: str) -> bool:
    """Takes the audit ``parent`` + ``text`` for ``state`` if it is the best so far; whether it was."""
    old = best[state]
    if old is not None and old[0] < cost:
        return False
    node = trails.add(parent, text)
    if old is not None and cost == old[0] and not trails.less(node, old[1]):
        return False
    best[state] = (cost, node)
    return True


def _inserted(trails: Trails, best: Best) -> Best:
    """The best audits after any insertions; more than two in a row lead round to where one was."""
    for _ in range(2):
        out = list(best)
        for state, (_, to) in enumerate(WRITES):
            if best[state] is not None:
                _offer(trails, out, to, best[state][0] + INSERT, best[state][1], "I")
        best = out
    return best


def solve(rows: Iterable[tuple[str, bool, bool]], entry: int) -> list[tuple[int, str] | None]:
    """By state after the rows: cost and audit of the best way from ``entry``.

    A row is its role's initial, whether it must go and whether it is truncated.
    Insertions come before a row, so none follows the last.
    """
    trails = Trails()
    best: Best = [None] * 4
    best[entry] = (0, 0)
    for initial, must_go, truncated in rows:
        before = _inserted(trails, best)
        best = [None] * 4
        for state in range(4):
            if before[state] is None:
                continue
            cost, node = before[state]
            _offer(trails, best, state, cost + DELETE, node, "D")
            if must_go:
                continue
            cost += TRUNCATED if truncated else 0
            if initial in READS[state]:
                _offer(trails, best, READS[state][initial], cost, node, "K")
            _offer(trails, best, WRITES[state][1], cost + REROLE, node, "R")
    return [b and (b[0], trails.string(b[1])) for b in best]


SEGMENT = (
    "conv {kind}, chunk long, at long, n long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string,"
    "first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"
)


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _segment(conv, chunk: int, first: bool, rows: list[tuple]) -> tuple:
    """The row of a piece of a conversation; rows: at, turn, initial, blank, duplicate, truncated."""
    faults = [("blank" if b else "duplicate" if d else "truncated" if t else "") for _, _, _, b, d, t in rows]
    roles = [r[2] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    moves = [(r, f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, faults, strict=True)]
    # Only the first piece of a chunk can begin within a conversation.
    found = [x for entry in (range(4) if first and chunk else (0,)) for x in solve(moves, entry)]
    return (
        conv, chunk, rows[0][0], len(rows), faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(map(_illegal, roles, roles[1:])), roles[0], roles[-1], turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
        [x and x[0] for x in found], [x and x[1] for x in found],
    )


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _in_arrow(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow with a function from an iterator of row tuples to one of row tuples."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(lambda batches: _batches(make(_rows(batches)), kind), schema)


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Segments of rows (conv, chunk, at, turn, initial, blank, duplicate, truncated) in order of chunk and at."""
    at, held, first = None, [], True
    for conv, chunk, *row in rows:
        if at != (conv, chunk) and held:
            yield _segment(*at, first, held)
            held, first = [], at[1] != chunk
        at = (conv, chunk)
        held.append(row)
    if held:
        yield _segment(*at, first, held)


PLAN = (
    "conv {kind}, chunk long, at long, entry int, piece string, whole boolean, last boolean, gaps long, blank long, duplicate long, truncated long,"
    "illegal long, cost long, audit string"
)


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Plan rows of segments in order of conversation and chunk."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][0] != row[0]:
            yield from _plan(held)
            held = []
        held.append(row)
    if held:
        yield from _plan(held)


def _plan(segments: list[tuple]) -> Iterator[tuple]:
    trails, source = Trails(), {}
    best: Best = [None] * 4
    best[0] = (0, 0)
    blank = duplicate = truncated = illegal = distinct = 0
    least = last_turn = last_role = None
    for i, (_, _, _, _, b, d, t, bad, first_role, end_role, first_turn, end_turn, turns, costs, audits) in enumerate(segments):
        blank, duplicate, truncated, illegal = blank + b, duplicate + d, truncated + t, illegal + bad
        if last_role is not None:
            illegal += _illegal(last_role, first_role)
        last_role = end_role
        if turns:
            distinct += turns - (first_turn == last_turn)
            least, last_turn = first_turn if least is None else least, end_turn
        out: Best = [None] * 4
        for entry in range(len(costs) // 4):
            for state in range(4):
                if best[entry] is not None and costs[entry * 4 + state] is not None:
                    cost, node = best[entry]
                    if _offer(trails, out, state, cost + costs[entry * 4 + state], node, audits[entry * 4 + state]):
                        source[out[state][1]] = (i, entry)
        best = out
    best = _inserted(trails, best)
    ends = [best[s] for s in ENDS if best[s] is not None]
    cost, node = ends[0]
    for other in ends[1:]:
        if other[0] < cost or (other[0] == cost and trails.less(other[1], node)):
            cost, node = other
    audit = trails.string(node)
    parts: list[tuple[int, str]] = [(0, "")] * len(segments)
    tail = ""
    while node:
        if node in source:
            i, entry = source[node]
            parts[i], tail = (entry, trails.text[node] + tail), ""
        else:  # an insertion behind the last row
            tail = trails.text[node] + tail
        node = trails.ups[node][0]
    gaps = 0 if least is None else last_turn - least + 1 - distinct
    for i, (segment, (entry, piece)) in enumerate(zip(segments, parts, strict=True)):
        last = i == len(segments) - 1
        sums = (gaps, blank, duplicate, truncated, illegal, cost, audit) if last else (None,) * 7
        yield (*segment[:3], entry, piece, len(segments) == 1, last, *sums)


def _edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, chunk, whole, None, None) for each segment, then (conv, chunk, whole, role, text) for each of its turns as repaired.

    ``rows``: (chunk, at, kind, conv, role, text, entry, piece, whole) in order; kind 0 is a
    segment's plan and kind 1 its rows.
    """
    head, state, piece, place = None, 0, "", 0

    def inserted() -> Iterator[tuple]:
        nonlocal state, place
        while piece[place : place + 1] == "I":
            letter, state = WRITES[state]
            place += 1
            yield (*head, ROLES[letter], "")

    for chunk, _, kind, conv, role, text, entry, new_piece, whole in rows:
        if kind == 0:
            if head:
                yield from inserted()
            head, state, piece, place = (conv, chunk, whole), entry, new_piece, 0
            yield (*head, None, None)
            continue
        yield from inserted()
        letter = piece[place]
        place += 1
        if letter == "K":
            state = READS[state][role[:1]]
            yield (*head, role, text)
        elif letter == "R":
            initial, state = WRITES[state]
            yield (*head, ROLES[initial], text)
    if head:
        yield from inserted()


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, chunk, place, role, text) of the turns as repaired."""
    n = 0
    for conv, chunk, _, role, text in _edited(rows):
        if role is None:
            n = 0
        else:
            yield conv, chunk, n, role, text
            n += 1


def _digested(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, chunk, piece, sha256, lines): the digest of a conversation that is whole here, else its lines in pieces."""
    head, sha, lines, size, n, empty = None, None, [], 0, 0, True

    def flushed() -> Iterator[tuple]:
        nonlocal lines, size, n
        if head and not head[2] and lines:
            yield head[0], head[1], n, None, "\n".join(lines)
            n += 1
        lines, size = [], 0

    def closed() -> Iterator[tuple]:
        if head and head[2]:
            yield head[0], head[1], 0, sha.hexdigest(), None
        yield from flushed()

    for conv, chunk, whole, role, text in _edited(rows):
        if role is None:
            yield from closed()
            head, sha, n, empty = (conv, chunk, whole), hashlib.sha256(), 0, True
        elif whole:
            sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        else:
            lines.append(f"{role}:{text}")
            size += len(text)
            if size >= PIECE_BYTES:
                yield from flushed()
    yield from closed()


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, sha256) of rows (conv, lines) in order."""
    at, sha = None, None
    for conv, lines in rows:
        if sha is None or at != conv:
            if sha:
                yield at, sha.hexdigest()
            at, sha = conv, hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(lines.encode())
    if sha:
        yield at, sha.hexdigest()


class Repair:
    """The repair of ``rows`` (conv, turn, role, text; any type of conv).

    The rows of a conversation stand in the order of turn (nulls first), then of a
    digest of role and text.  Null roles and texts count as one space.  A row is blank
    (no character but \\x20 and \\x09-\\x0D), else duplicate (role and text stood
    earlier), else truncated (the last such character is none of ``.!?``).  Blank and
    duplicate rows are deleted.  A row without a role's initial (an empty role), or with
    another initial than s, u and a, cannot be kept as it is.

    Defined cases: a null conv is a conversation of its own; repeated rows are
    duplicates; an empty table gives empty results; further columns are passed over.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        kind = rows.schema[conv].dataType.simpleString()
        rows, key = with_row_key(rows)
        role_text = [F.coalesce(F.col(c), F.lit(" ")) for c in (role, text)]
        rows = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), role_text[0].alias("role"), role_text[1].alias("text"), *[F.col(k).alias(f"key_{i}") for i, k in enumerate(key)])
        trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
        rows = rows.withColumns(
            {
                "content": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)),
                "blank": trimmed == "",
                "truncated": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
            }
        )
        self._kind = kind
        # A copy of a row that the caller has made has the same key and falls beside it.
        self.rows = in_order(rows, ["conv", "turn", "content", "key_0", "key_1"], "at").withColumn("chunk", F.floor(F.col("at") / CHUNK_ROWS).cast("long"))
        self.plans = self._plans()

    def _plans(self) -> DataFrame:
        small = self.rows.select("conv", "chunk", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "truncated", "content")
        firsts = small.groupBy("conv", "content").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
        marked = small.join(firsts, "at", "left").withColumn("duplicate", F.col("first").isNull())
        marked = marked.select("conv", "chunk", "at", "turn", "initial", "blank", "duplicate", "truncated")
        dealt = marked.repartition("chunk").sortWithinPartitions("chunk", "at")
        segments = _in_arrow(dealt, _pieces, SEGMENT.format(kind=self._kind))
        by_conv = segments.repartition("conv").sortWithinPartitions("conv", "chunk")
        return materialise(_in_arrow(by_conv, _joined, PLAN.format(kind=self._kind)), "repair-plans")

    def _with_plans(self) -> DataFrame:
        none = F.lit(None)
        texts = self.rows.select("chunk", "at", F.lit(1).alias("kind"), "conv", "role", "text", none.cast("int").alias("entry"), none.cast("string").alias("piece"), none.cast("boolean").alias("whole"))
        plans = self.plans.select("chunk", "at", F.lit(0).alias("kind"), "conv", none.cast("string").alias("role"), none.cast("string").alias("text"), "entry", "piece", "whole")
        return plans.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "at", "kind")

    def summary(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
        return self.plans.filter("last").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def turns(self) -> DataFrame:
        """(conv, chunk, place, role, text): the repaired turns, a conversation's in order of chunk and place."""
        return _in_arrow(self._with_plans(), _turns, f"conv {self._kind}, chunk long, place long, role string, text string")

    def digests(self) -> DataFrame:
        """(conv, repaired_sha256): SHA-256 of the repaired turns as ``role:text``, joined by newlines; none for a long conversation of which nothing is left."""
        found = _in_arrow(self._with_plans(), _digested, f"conv {self._kind}, chunk long, piece long, sha256 string, lines string")
        found = materialise(found, "repair-digests")
        parts = found.filter("sha256 is null").repartition("conv").sortWithinPartitions("conv", "chunk", "piece").select("conv", "lines")
        long = _in_arrow(parts, _hashed, f"conv {self._kind}, sha256 string")
        return found.filter("sha256 is not null").select("conv", "sha256").unionByName(long).withColumnRenamed("sha256", "repaired_sha256")
