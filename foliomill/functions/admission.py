"""Ordered admission rules: the first that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import api_ext_ok, has_allowed_ext, is_valid_mime

#: Largest file for the service and the browser; largest form body.
MAX_FILE, MAX_BODY = 10 * 1024 * 1024, 16 * 1024 * 1024
#: Stands in for a key that was never filled in.
PLACEHOLDER_KEY = "YOUR_API_KEY_HERE"


def size_ok(length: Column, most: int = MAX_FILE) -> Column:
    return length <= most


def first_failure(rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(code, reason) of the first rule whose condition is not true; null where all hold."""
    code, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for holds, status, text in reversed(rules):
        fails = ~F.coalesce(holds, F.lit(False))
        code = F.when(fails, status).otherwise(code)
        reason = F.when(fails, text).otherwise(reason)
    return code, reason


def policy_rules(policy: str) -> list[tuple[Column, int, str]]:
    """Rules over the columns configured, has_file, file_name, mime, length (those that the policy looks at)."""
    name, length = F.col("file_name"), F.col("length")
    if policy == "api":
        return [
            (F.col("configured"), 400, "not configured"),
            (api_ext_ok(name), 400, "extension"),
            (size_ok(length), 413, "size"),
        ]
    if policy == "browser":
        return [(is_valid_mime(F.col("mime")), 400, "mime"), (size_ok(length), 400, "size")]
    if policy == "form":
        return [
            (F.col("configured"), 400, "no key"),
            (F.col("has_file"), 400, "no file"),
            (name != "", 400, "empty name"),
            (has_allowed_ext(name), 400, "extension"),
        ]
    raise ValueError(f"unknown policy {policy!r}")


def admit(df: DataFrame, policy: str) -> DataFrame:
    """``df`` with admitted, code and reason; a null counts as a failing rule."""
    code, reason = first_failure(policy_rules(policy))
    return df.withColumns({"admitted": code.isNull(), "code": code, "reason": reason})


def has_key(key: Column) -> Column:
    """A key counts when something is left after trimming and it is no placeholder.  The key itself is never kept."""
    trimmed = F.trim(key)
    return F.coalesce((trimmed != "") & (trimmed != PLACEHOLDER_KEY), F.lit(False))


def validate_runs(df: DataFrame) -> DataFrame:
    """First error of each run over has_key, input_dir, input_exists, output_dir; null if the run may start."""
    _, reason = first_failure(
        [
            (F.col("has_key"), 0, "key missing"),
            (F.col("input_dir") != "", 0, "input missing"),
            (F.col("input_exists"), 0, "input not found"),
            (F.col("output_dir") != "", 0, "output missing"),
        ]
    )
    return df.withColumn("error", reason)
