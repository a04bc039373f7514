"""Planning a batch and settling its outcomes.

The order of pages in a project is binary file-name order.  An output is known by its
project and its name, as each project has a folder of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import free_name
from ..sources.scratch import stored

OUTPUT = ("project", "output_name")


def skip_existing(plan: DataFrame, outputs: DataFrame, keys: tuple[str, ...] = OUTPUT, mark: bool = False) -> DataFrame:
    """Pages whose output does not exist yet (anti join), or with ``mark`` all pages with action run or skip.

    A page without a project is finished if an output without one has its name.
    """
    names = tuple(free_name(plan, f"finished_{i}") for i in range(len(keys)))
    there = outputs.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    if not mark:
        return plan.join(there, _same(plan, there, keys, names), "left_anti")
    flag = free_name(plan, "finished")
    there = there.distinct().withColumn(flag, F.lit(True))
    action = F.when(F.col(flag), "skip").otherwise("run")
    both = plan.join(there, _same(plan, there, keys, names), "left").withColumn("action", action)
    return both.select(*[c for c in plan.columns if c != "action"], "action")


def plan_wave(plan: DataFrame, keys: tuple[str, ...] = OUTPUT, order: str = "file_name") -> DataFrame:
    """The first page of each output: what can run at once without two pages writing one file.

    Pages left out run in a later wave, if the first failed.  The first is found by a
    pre-aggregated minimum, so an output with very many pages costs a row for each task.
    A null ``order`` comes last.
    """
    whole = F.struct(order, *[c for c in plan.columns if c != order])
    first = plan.groupBy(*keys).agg(F.min_by(whole, F.struct(F.col(order).isNull(), F.col(order))).alias("first"))
    return first.select("first.*").select(*plan.columns)


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[n]) for k, n in zip(keys, names, strict=True)])


def settle_collisions(results: DataFrame, keys: tuple[str, ...] = OUTPUT, order: str = "seq") -> DataFrame:
    """``results`` (ok) with status: failed up to the first success of an output, then skip.

    The first success is a pre-aggregated minimum that the rows are joined with, so an
    output with very many rows is no task's alone.  A null ``order`` comes first; of
    rows in the same place none skips for another.
    """
    names = tuple(free_name(results, f"settled_{i}") for i in range(len(keys)))
    first = free_name(results, "settled_first")
    rank = F.struct(F.col(order).isNotNull(), F.col(order))
    good = results.filter("ok").groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(rank).alias(first))
    both = results.join(good, _same(results, good, keys, names), "left")
    done = F.coalesce(F.col(first) < rank, F.lit(False))
    status = F.when(done, "skip").when(F.col("ok"), "success").otherwise("failed")
    return both.withColumn("status", status).select(*[c for c in results.columns if c != "status"], "status")


def run_in_waves(plan: DataFrame, apply: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = OUTPUT, order: str = "file_name") -> DataFrame:
    """All pages of ``plan`` with status: an output's pages are tried in ``order`` until one succeeds, the rest skip.

    ``apply`` takes the first open page of each output and returns these rows with status
    (success, or anything else for a failure) and columns of its own, such as
    ``apply_pages`` adds; it is called on every page at most once.  Each wave is stored,
    and the next one has only the outputs that have failed so far, so there are as many
    waves as failures in a row.  Skipped pages have null in the columns that ``apply`` adds.
    """
    own = free_name(plan, "wave_row")
    columns = [c for c in plan.columns if c != "status"]
    left = stored(plan.select(*columns), "waves")
    left = stored(left.withColumn(own, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))), "waves")
    names = tuple(free_name(left, f"tried_{i}") for i in range(len(keys)))
    results: DataFrame | None = None
    while True:
        wave = stored(apply(plan_wave(left, keys, order)), "wave")
        results = wave if results is None else results.unionByName(wave)
        tried = wave.select(F.col(own).alias(names[0]))
        left = left.join(tried, F.col(own) == F.col(names[0]), "left_anti")
        good = wave.filter("status = 'success'").select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
        skipped = left.join(good, _same(left, good, keys, names), "left_semi").withColumn("status", F.lit("skip"))
        results = results.unionByName(skipped, allowMissingColumns=True)
        left = stored(left.join(good, _same(left, good, keys, names), "left_anti"), "waves")
        if left.isEmpty():
            return results.drop(own)


def with_progress(df: DataFrame, project: str = "project", order: str = "file_name") -> DataFrame:
    """``df`` with seq (from 1), total and percent of its project; percent is i / total * 100 in double precision, cut off.

    The rows are sorted by ranges and stored once; a row's number is its place in that
    order less the place of its project's first row, so a project may fill many tasks.
    A null ``order`` comes first, a null project is a project of its own, and columns
    seq, total and percent of the input are replaced.
    """
    columns = [c for c in df.columns if c not in ("seq", "total", "percent")]
    file, row, start, at, first, owner, n = (free_name(df, f"progress_{x}") for x in ("file", "row", "start", "at", "first", "owner", "n"))
    rows = stored(df.select(*columns).orderBy(project, order), "progress")
    part, piece = (F.coalesce(F.regexp_extract("_metadata.file_name", p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)"))
    placed = rows.withColumns({file: F.struct(part.alias("part"), piece.alias("piece")), row: F.col("_metadata.row_index")})
    # A row for each file written, of which there are as many as shuffle partitions.
    files = placed.groupBy(file).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(file, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    placed = placed.join(F.broadcast(starts), file).withColumn(at, F.col(start) + F.col(row))
    whole = placed.groupBy(F.col(project).alias(owner)).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("total"))
    both = placed.join(whole, F.col(project).eqNullSafe(F.col(owner)))
    seq = F.col(at) - F.col(first) + 1
    return both.select(*columns, seq.alias("seq"), "total", (seq / F.col("total") * 100).cast("int").alias("percent"))


def tally(results: DataFrame, project: str = "project") -> DataFrame:
    """(project, total, success, skip, failed): all that neither succeeded nor was skipped failed."""
    success, skip = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "skip")
    total = F.count(F.lit(1))
    return results.groupBy(project).agg(
        total.alias("total"), success.alias("success"), skip.alias("skip"), (total - success - skip).alias("failed")
    )


def store_with_tally(results: DataFrame, path: str) -> dict[str, int]:
    """Writes ``results`` to ``path`` and returns total, success, skip and failed of what was written.

    The counts are taken while the rows go by: counting afterwards would call a service again, or read the table twice.
    """
    seen = Observation()
    success, skip = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "skip")
    counted = results.observe(seen, F.count(F.lit(1)).alias("total"), success.alias("success"), skip.alias("skip"))
    counted.write.parquet(path)
    return seen.get | {"failed": seen.get["total"] - seen.get["success"] - seen.get["skip"]}


def latest_per_output(df: DataFrame, keys: str | tuple[str, ...] = OUTPUT, order: str = "ts") -> DataFrame:
    """The last write of each output: the row with the largest ``order``, one without only if there is no other."""
    keys = (keys,) if isinstance(keys, str) else keys
    rank = F.struct(F.col(order).isNotNull(), F.col(order))
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), rank).alias("last"))
    return last.select("last.*")
