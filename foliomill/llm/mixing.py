"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal size.  With weight w (its share of the
slots), its k-th block (k from 0) is released at floor(k / w) and due at
ceil((k + 1) / w); in each slot the released block with the earliest deadline goes
out.  Every source is then, at every slot, less than one block away from its target.
When a source runs out, the rest go on in the same proportions to each other, counted
from there.

Weights are taken as they are, as integers of 2^53 parts.  The driver schedules blocks
and not rows: a block holds ``block_rows`` rows, or one part in ``MAX_BLOCKS`` of all
rows if that is more, so the schedule has a bounded length; a row meets its slot by an
equi join on source and block, in which no key has more rows than a block.

Blocks come from numbering the rows of a source without gathering a source in one
task: rows are dealt into many splits by a hash of id and place in the file, the splits
are counted, and each split is numbered from where the ones before it end.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_name, with_row_key

#: More sources than this are refused, since a row for each is held on the driver.
MAX_SOURCES = 5_000
#: Blocks that are scheduled at most (and one for each source).
MAX_BLOCKS = 1 << 20
#: Parts of the whole that weights are counted in.
PARTS = 1 << 53
ROWS_PER_SPLIT = 512
MAX_SPLITS = 20_000


def in_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Positive weights as integers in proportion, of about ``PARTS`` in all, at least one each."""
    whole = sum(weights.values())
    return {s: max(1, round(w / whole * PARTS)) for s, w in weights.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[str, int]]:
    """For each slot the source and which of its blocks; all blocks of all sources, none before its turn.

    Integer arithmetic throughout: with a of T parts, block k is released at
    k*T // a and due at ceil((k+1)*T / a), counted from the last time a source ran out.
    """
    parts = in_parts(weights)
    sent = dict.fromkeys(blocks, 0)
    left = {s for s, n in blocks.items() if n > 0}
    slots: list[tuple[str, int]] = []
    while left:
        total = sum(parts[s] for s in left)
        coming = [(0, s, 0) for s in sorted(left)]
        ready: list[tuple[int, int, str, int]] = []
        slot, over = 0, False
        while not over:
            while coming and coming[0][0] <= slot:
                _, s, k = heapq.heappop(coming)
                heapq.heappush(ready, (-(-(k + 1) * total // parts[s]), -parts[s], s, k))
            due, _, s, k = heapq.heappop(ready)
            assert due > slot, "a block missed its deadline"
            slots.append((s, sent[s]))
            sent[s] += 1
            if sent[s] == blocks[s]:
                left.remove(s)
                over = True
            else:
                heapq.heappush(coming, ((k + 1) * total // parts[s], s, k + 1))
            slot += 1
    return slots


def _key(source: Column) -> Column:
    """A source as text that tells a null from every string."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    alpha: float = 0.5,
    block_rows: int = 64,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """Place of every row in the mixed order.

    ``weights``: target weight by source; without them the weight of a source is its
    number of rows to the power ``alpha``.  Sources without a positive weight come
    after all others, mixed among themselves by their rows.

    Returns the rows of ``docs`` (all its columns) with ``mix_block`` (block within the
    source, from 0), ``mix_slot`` (place of the block in the schedule, from 0, no gaps)
    and ``mix_pos`` (place within the block, from 0).  Ordered by (mix_slot, mix_pos)
    the rows are interleaved as scheduled.  No row is dropped or repeated.

    Defined cases: a null source is a source of its own; rows with null or repeated ids
    are placed one by one, by their place in the files; an empty table gives an empty
    result; input columns named mix_* are replaced, all other names are kept apart from
    what is computed here; a negative weight is an error.
    """
    spark = docs.sparkSession
    if weights is not None and min(weights.values(), default=0) < 0:
        raise ValueError("a weight is negative")
    docs = docs.drop("mix_block", "mix_slot", "mix_pos")
    columns = docs.columns
    docs, place = with_row_key(docs)
    s, split, start, n, nth = (free_name(docs, x) for x in ("mix_source", "mix_split", "mix_start", "mix_n", "mix_nth"))
    keyed = docs.withColumn(s, _key(F.col(source_col)))
    counts = {r[0]: r[1] for r in keyed.groupBy(s).agg(F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(counts.values())
    block_rows = max(block_rows, -(-total // MAX_BLOCKS))
    slots = _plan(counts, weights, alpha, block_rows)
    names = sorted(counts)
    number = {x: i for i, x in enumerate(names)}
    plan = pa.table(
        {
            s: pa.array(names, pa.string()).take(pa.array(np.fromiter((number[x] for x, _ in slots), np.int64, len(slots)))),
            "mix_block": pa.array(np.fromiter((k for _, k in slots), np.int64, len(slots))),
            "mix_slot": pa.array(np.arange(len(slots))),
        }
    )
    splits = max(1, min(MAX_SPLITS, -(-total // ROWS_PER_SPLIT)))
    keyed = keyed.withColumn(split, F.pmod(F.xxhash64(id_col, place[1]), F.lit(splits)).cast("int"))
    before = Window.partitionBy(s).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(s, split).agg(F.count(F.lit(1)).alias(n)).select(s, split, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(s, split).orderBy(F.xxhash64(id_col, F.lit(1)), id_col, place[1], place[0])
    numbered = keyed.withColumn(nth, F.row_number().over(within) - 1).join(starts, [s, split])
    at = F.col(start) + F.col(nth)
    numbered = numbered.withColumns({"mix_block": F.floor(at / block_rows).cast("long"), "mix_pos": (at % block_rows).cast("int")})
    out = numbered.join(spark.createDataFrame(plan), [s, "mix_block"])
    return out.select(*[F.col(f"`{c}`") for c in columns], "mix_block", "mix_slot", "mix_pos")


def _plan(counts: Mapping[str, int], weights: Mapping[str | None, float] | None, alpha: float, block_rows: int) -> list[tuple[str, int]]:
    """The schedule of the weighted sources, then that of the rest."""
    if weights is None:
        target = {s: n**alpha for s, n in counts.items()}
    else:
        by_key = {"null" if s is None else f"={s}": w for s, w in weights.items()}
        target = {s: by_key.get(s, 0.0) for s in counts}
    rest = {s: float(counts[s]) for s in counts if target[s] <= 0}
    slots = []
    for group in ({s: w for s, w in target.items() if w > 0}, rest):
        if group:
            slots += schedule({s: -(-counts[s] // block_rows) for s in group}, group)
    return slots


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` range-partitioned and sorted in the order of ``mix``; the columns of ``docs``."""
    mixed = mix(docs, **options)
    return mixed.orderBy("mix_slot", "mix_pos").select(*docs.columns)
