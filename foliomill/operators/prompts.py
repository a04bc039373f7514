"""From a manifest and settings tables to one prompt and one request for each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import free_name
from ..functions.names import base_name, stem
from ..sources.scratch import stored
from .config import JOINER

# The headings around the glossary and the instructions, and the last line.
GLOSSARY_HEAD = "\n\n人名對照（必須遵守）：\n"
EXTRA_HEAD = "\n\n補充："
TAIL = "\n直接輸出翻譯後圖片。"
ARROW = "→"
REQUEST_MIME = "image/jpeg"


def lookup_file_prompt(manifest: DataFrame, file_prompts: DataFrame, key: str = "config_id") -> DataFrame:
    """``manifest`` with file_prompt: that of the base name, else that of its stem, else ''.

    Two left joins on (key, file key); the keys are unique in ``file_prompts``.
    """
    exact_key, stem_key, of_name, of_stem = (free_name(manifest, x) for x in ("prompt_exact", "prompt_stem", "prompt_of_name", "prompt_of_stem"))
    exact = file_prompts.select(key, F.col("file_key").alias(exact_key), F.col("prompt").alias(of_name))
    by_stem = file_prompts.select(key, F.col("file_key").alias(stem_key), F.col("prompt").alias(of_stem))
    name = base_name(F.col("file_name"))
    rows = manifest.drop("file_prompt").withColumns({exact_key: name, stem_key: stem(name)})
    rows = rows.join(exact, [key, exact_key], "left").join(by_stem, [key, stem_key], "left")
    found = F.coalesce(of_name, of_stem, F.lit(""))
    return rows.withColumn("file_prompt", found).select(*[c for c in manifest.columns if c != "file_prompt"], "file_prompt")


def compose_instructions(global_prompt: Column, file_prompt: Column, call_prompt: Column) -> Column:
    """Global, then the file's instruction or, without one, the call's; empty ones are left out."""
    own = F.coalesce(F.nullif(file_prompt, F.lit("")), call_prompt)
    return F.array_join(F.filter(F.array(global_prompt, own), lambda x: x != ""), JOINER)


def glossary_arrays(glossary: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, pairs): the glossary of each setting as one array in order, for ``render_prompt``."""
    order = [c for c in ("layer", "pos") if c in glossary.columns]
    entry = F.struct(*order, "original", "translation")
    pairs = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["original"].alias("original"), e["translation"].alias("translation")))
    return glossary.groupBy(key).agg(pairs.alias("pairs"))


def prompt_text(pairs: Column, instructions: Column, head: str, rules: str, tail: str = TAIL) -> Column:
    """Head, blank line, rules; the glossary and the instructions if there are any; the tail."""
    listed = F.array_join(F.transform(pairs, lambda p: F.concat(p["original"], F.lit(ARROW), p["translation"], F.lit("\n"))), "")
    glossary = F.when(F.size(pairs) > 0, F.concat(F.lit(GLOSSARY_HEAD), listed)).otherwise("")
    extra = F.when(instructions != "", F.concat(F.lit(EXTRA_HEAD), instructions, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(f"{head}\n\n{rules}"), glossary, extra, F.lit(tail))


def render_prompt(df: DataFrame, head: str, rules: str, tail: str = TAIL) -> DataFrame:
    """``df`` (pairs, instructions) with prompt."""
    return df.withColumn("prompt", prompt_text(F.col("pairs"), F.coalesce("instructions", F.lit("")), head, rules, tail))


def build_requests(df: DataFrame, model: str, options: str = "{}") -> DataFrame:
    """``df`` (content binary, prompt) with request: model, parts (image, text), options.

    The request is a struct; ``to_json`` of it is a line of an offline batch file, with
    the bytes in base64.  The image part always says image/jpeg.
    """
    none = F.lit(None)
    image = F.struct(F.lit(REQUEST_MIME).alias("mime_type"), F.col("content").alias("data"), none.cast("string").alias("text"))
    text = F.struct(none.cast("string").alias("mime_type"), none.cast("binary").alias("data"), F.col("prompt").alias("text"))
    request = F.struct(F.lit(model).alias("model"), F.array(image, text).alias("parts"), F.lit(options).alias("options"))
    return df.withColumn("request", request).drop("content")


def batch_files(requests: DataFrame, size: Column, limit: int, order: list[str], output: str = "file") -> DataFrame:
    """``requests`` with the number (from 0) of the offline batch file of each: in ``order``, at most ``limit`` bytes a file.

    ``size``: bytes of a request with its line end, none over ``limit``.  A request goes by
    the bytes before it, in steps of the limit less the longest request, so no file is
    looked at as a whole: the rows are sorted by ranges and stored once, and added up in
    blocks of ``ROWS_PER_BLOCK``.  A file has less than the limit by about the longest
    request; equal places in the order are told apart as they fall.
    """
    part, row, block, bytes_, start = (free_name(requests, f"batch_{x}") for x in ("part", "row", "block", "bytes", "start"))
    columns = [c for c in requests.columns if c != output]
    rows = stored(requests.withColumn(bytes_, size.cast("long")).orderBy(*order), "requests")
    longest = rows.agg(F.max(bytes_)).first()[0] or 0
    if longest > limit:
        raise ValueError(f"a request has {longest} bytes")
    number = [F.coalesce(F.regexp_extract("_metadata.file_name", p, 1).try_cast("long"), F.lit(0)) for p in (r"part-(\d+)", r"-c(\d+)")]
    rows = rows.withColumns({part: F.shiftleft(number[0], 24) + number[1], row: F.col("_metadata.row_index")})
    rows = rows.withColumn(block, F.floor(F.col(row) / ROWS_PER_BLOCK))
    sums = rows.groupBy(part, block).agg(F.sum(bytes_).alias("n"))
    # A row for each block.
    before = Window.orderBy(part, block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(part, block).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(row, F.coalesce(F.sum(bytes_).over(within), F.lit(0))).join(starts, [part, block])
    return placed.select(*columns, F.floor((F.col(start) + F.col(row)) / (limit - longest + 1)).cast("long").alias(output))


#: Rows whose bytes are added up together.
ROWS_PER_BLOCK = 4_096
