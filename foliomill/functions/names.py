"""File-name rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted suffixes and declared media types.
PAGE_SUFFIXES = ["png", "jpg", "jpeg", "webp"]
PAGE_MIMES = ["image/png", "image/jpeg", "image/jpg", "image/webp"]

#: A glob for the file source, which matches case by case.
PAGE_GLOB = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[wW][eE][bB][pP]}"


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def is_page(name: Column) -> Column:
    """Folder rule: the lower-cased name ends in one of the suffixes (``.png`` alone does)."""
    return F.lower(name).rlike(rf"\.({'|'.join(PAGE_SUFFIXES)})\z")


def has_allowed_ext(name: Column) -> Column:
    """Form rule: there is a dot, and what follows the last one is an accepted suffix."""
    return (F.instr(name, ".") > 0) & F.lower(F.substring_index(name, ".", -1)).isin(PAGE_SUFFIXES)


def path_suffix(name: Column) -> Column:
    """Suffix with its dot; '' where only the first character or nothing but the end holds a dot."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1)


def api_ext_ok(name: Column) -> Column:
    """Service rule: the suffix, lower-cased, is an accepted one (``.png`` alone has none)."""
    return F.lower(path_suffix(name)).isin([f".{s}" for s in PAGE_SUFFIXES])


def is_valid_mime(mime: Column) -> Column:
    return mime.isin(PAGE_MIMES)


def split_ext(name: Column) -> Column:
    """struct(stem, ext): cut at the last dot, unless only dots stand before it."""
    ext = F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)\z", 1)
    return F.struct(F.substring(name, F.lit(1), F.char_length(name) - F.char_length(ext)).alias("stem"), ext.alias("ext"))


def stem(name: Column) -> Column:
    return split_ext(name)["stem"]


def output_name(name: Column, policy: str) -> Column:
    """Name of the output: ``batch`` stem.jpg, ``api`` stem_translated with the lower-cased suffix, ``form`` 32 hex digits.

    Form names are random: write them once before using them twice.
    """
    if policy == "batch":
        return F.concat(stem(name), F.lit(".jpg"))
    if policy == "api":
        suffix = path_suffix(name)
        bare = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(suffix))
        return F.concat(bare, F.lit("_translated"), F.lower(suffix))
    if policy == "form":
        return F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(".jpg"))
    raise ValueError(f"unknown policy {policy!r}")


def output_url(name: Column) -> Column:
    return F.concat(F.lit("/api/outputs/"), name)


def media_type(name: Column) -> Column:
    """``image/`` and the suffix without its dot, as it is written."""
    return F.concat(F.lit("image/"), F.ltrim(path_suffix(name), F.lit(".")))
