"""A Merkle manifest of a dataset: a tree of digests by group, with a proof for every row.

The rows of a group are numbered in their order without gathering the group (a range
sort, stored once).  Aligned blocks of ``2 ** BLOCK_LEVELS`` consecutive nodes are the
unit of work, so a group of any size is spread over many tasks.  In a block, for each
level, lag and lead columns at fixed offsets (the width of a node, and its multiples)
bring the siblings; where a node has none, by its slot and the length of its run, they
are masked.  The first child of a run hashes the parent and stands for it on the next
level.  The tops of the blocks are the leaves of a table some thousand times smaller,
which is treated the same way, until each group has one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import in_order, materialise, with_row_key

#: Levels of the tree that one block covers (at two children a node; fewer at more).
BLOCK_LEVELS = 10
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' text (UTF-8), one behind the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its length in bytes, ``:`` and its text."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf to the root and from left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, steps: Column) -> Column:
    """The root to which a leaf leads by a proof."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def _block(arity: int, most: int) -> tuple[int, int]:
    """Levels of a block and the leaves below its top, for groups of ``most`` nodes or fewer."""
    levels = 1
    while arity ** (levels + 1) <= 1 << BLOCK_LEVELS and arity**levels < most:
        levels += 1
    return levels, arity**levels


def _levels(nodes: DataFrame, group: str, arity: int, levels: int) -> DataFrame:
    """``nodes`` (group, node_at, node_n, node) with node_block, node_steps (siblings on the levels of its block) and node_top.

    node_top is the block's top, on its first row; a level counts while its group has more than one node.
    """
    width = arity**levels
    at, n = F.col("node_at"), F.col("node_n")
    rows = nodes.withColumn("node_block", F.floor(at / width).cast("long"))
    window = Window.partitionBy(group, "node_block").orderBy("node_at")
    names = []
    for level in range(levels):
        size = arity**level
        here = "node" if level == 0 else "node_up"
        index, count = F.floor(at / size).cast("long"), F.ceil(n / size).cast("long")
        slot = index % arity
        run = F.least(F.lit(arity), count - (index - slot))
        is_node, live = at % size == 0, count > 1
        others = range(1, arity)
        rows = rows.withColumns(
            {f"node_lag{j}": F.lag(here, j * size).over(window) for j in others} | {f"node_lead{j}": F.lead(here, j * size).over(window) for j in others}
        )
        before = [F.when(slot >= j, F.col(f"node_lag{j}")).otherwise("") for j in reversed(others)]
        after = [F.when(slot + j < run, F.col(f"node_lead{j}")).otherwise("") for j in others]
        step = F.struct(F.concat(*before).alias("before"), F.concat(*after).alias("after"))
        parent = F.when(live, digest(F.col(here), *after)).otherwise(F.col(here))
        names.append(f"node_step{level}")
        rows = rows.withColumns({names[-1]: F.when(is_node & live, step), "node_up": F.when(at % (size * arity) == 0, parent)})
    rows = rows.drop(*[f"node_{x}{j}" for x in ("lag", "lead") for j in range(1, arity)])
    # A row's ancestor on a level is the last node of that level up to it.
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({x: F.last(x, ignorenulls=True).over(so_far) for x in names})
    steps = F.filter(F.array(*names), lambda s: s.isNotNull()).cast(STEPS)
    return rows.withColumns({"node_steps": steps, "node_top": F.col("node_up")}).drop(*names, "node_up")


def _climb(nodes: DataFrame, group: str, arity: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with node_steps up to the single node of each group and that node, node_root; and (group, node_root) alone.

    ``most``: nodes of the largest group.
    """
    levels, width = _block(arity, most)
    rows = _levels(nodes, group, arity, levels)
    tops = rows.filter(F.col("node_at") % width == 0).select(
        group, F.col("node_block").alias("node_at"), F.ceil(F.col("node_n") / width).cast("long").alias("node_n"), F.col("node_top").alias("node")
    )
    tops = materialise(tops, "merkle-tops")
    most = -(-most // width)
    if most > 1:
        upper, roots = _climb(tops, group, arity, most)
    else:
        upper = tops.withColumns({"node_steps": F.array().cast(STEPS), "node_root": F.col("node")})
        roots = upper.select(group, "node_root")
    upper = upper.select(
        F.col(group).alias("upper_group"), F.col("node_at").alias("upper_at"), F.col("node_steps").alias("upper_steps"), "node_root"
    )
    same = F.col(group).eqNullSafe(F.col("upper_group")) & (F.col("node_block") == F.col("upper_at"))
    both = rows.join(upper, same).withColumn("node_steps", F.concat("node_steps", "upper_steps"))
    return both.drop("node_block", "node_top", "upper_group", "upper_at", "upper_steps"), roots


def build(rows: DataFrame, leaf: str, group: str, order: list[str], arity: int = 2) -> DataFrame:
    """``rows`` with subroot, root and steps, the proof of each row.

    ``leaf`` holds the digests of the rows.  In a group the leaves are ordered by
    ``order`` (nulls first; of equal ones the smaller leaf first, equal leaves in any
    order); while it has several nodes, every ``arity`` consecutive ones, the last ones
    perhaps fewer, become their digest.  The groups' tops, in the order of the groups
    (null first), become the root in the same way.  A step has the digests before and
    after the node; it has neither where the node is alone in its run, which still
    hashes.

    Defined cases: a null group is a group; repeated rows are leaves of their own; an
    empty table gives an empty result; columns named subroot, root or steps are
    replaced, all other names are kept apart from what is computed here.
    """
    if arity < 2 or arity > 1 << BLOCK_LEVELS:
        raise ValueError(f"a node has 2 to {1 << BLOCK_LEVELS} children")
    columns = [c for c in rows.columns if c not in ("subroot", "root", "steps")]
    own = {c: f"own_{i}" for i, c in enumerate(columns)}
    rows, key = with_row_key(rows.select(*[F.col(f"`{c}`").alias(x) for c, x in own.items()]))
    placed = in_order(rows, [own[group], *[own[c] for c in order], own[leaf], *key], "node_place").drop(*key)
    sizes = placed.groupBy(F.col(own[group]).alias("node_group")).agg(F.min("node_place").alias("node_first"), F.count(F.lit(1)).alias("node_n"))
    sizes = materialise(sizes, "merkle-groups")
    most = sizes.agg(F.max("node_n"), F.count(F.lit(1))).first()
    nodes = placed.join(sizes, F.col(own[group]).eqNullSafe(F.col("node_group"))).withColumns(
        {"node_at": F.col("node_place") - F.col("node_first"), "node": F.col(own[leaf])}
    )
    rows, tops = _climb(nodes.drop("node_place", "node_first", "node_group"), own[group], arity, most[0] or 1)
    rows = rows.withColumnRenamed("node_root", "subroot").drop("node_at", "node_n", "node")
    tops = in_order(tops.select(F.col(own[group]).alias("node_group"), F.col("node_root").alias("node")), ["node_group"], "node_at")
    tops, _ = _climb(tops.withColumns({"node_all": F.lit(0), "node_n": F.lit(most[1]).cast("long")}), "node_all", arity, max(1, most[1]))
    tops = tops.select("node_group", F.col("node_steps").alias("upper_steps"), F.col("node_root").alias("root"))
    both = rows.join(tops, F.col(own[group]).eqNullSafe(F.col("node_group")))
    return both.select(*[F.col(x).alias(c) for c, x in own.items()], "subroot", "root", F.concat("node_steps", "upper_steps").alias("steps"))


def manifest(docs: DataFrame, fields: list[str], group: str, order: list[str], other_leaf: Column | None = None, arity: int = 2) -> DataFrame:
    """(order columns, leaf, other_leaf, subroot, root, steps) of every row of ``docs``.

    The leaf is the digest of the ``fields``; ``other_leaf`` that of another state of the row, to be held against the proof.
    """
    leaf = leaf_digest(*[F.col(c) for c in fields])
    named = {"group": F.col(group), "leaf": leaf, "other_leaf": leaf if other_leaf is None else other_leaf}
    small = docs.select(*[F.col(c).alias(f"by_{i}") for i, c in enumerate(order)], *[c.alias(n) for n, c in named.items()])
    found = build(small, "leaf", "group", [f"by_{i}" for i in range(len(order))], arity)
    return found.select(*[F.col(f"by_{i}").alias(c) for i, c in enumerate(order)], "leaf", "other_leaf", "subroot", "root", "steps")
