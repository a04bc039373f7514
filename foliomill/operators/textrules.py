"""Checks and rewrites of text pairs against a glossary, numbers and scripts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_name
from ..sources.scratch import stored
from . import terms

#: Terms of a glossary that an expression of the plan tries one by one.
FEW_TERMS = 64
KANA = "\\u3040-\\u30ff"


#: The characters with a meaning of their own in patterns.
SPECIAL = r"([\\^$.|?*+()\[\]{}])"


def _pattern(terms: list[str]) -> str:
    # Longest first: the first alternative that fits is the one taken.
    return "|".join(re.sub(SPECIAL, r"\\\1", t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))


def glossary_column(text: Column, glossary: dict[str, str]) -> Column:
    """One pass over the text, longest terms first; what was put in is not looked at again."""
    usable = {k: v for k, v in glossary.items() if k}
    if not usable:
        return text
    # What cannot begin a term goes by in one piece.
    heads = "".join(rf"\x{{{ord(c):x}}}" for c in sorted({k[0] for k in usable}))
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)({_pattern(list(usable))}|[^{heads}]+|.)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in usable.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(table[p], p)), "")


def apply_glossary(df: DataFrame, text: str, glossary: dict[str, str] | DataFrame, output: str = "replaced") -> DataFrame:
    """``df`` with the glossary substituted in ``text``: one pass, longest terms first.

    A mapping of up to ``FEW_TERMS`` terms becomes an expression of the plan.  More, or a
    table (original, translation), go through an automaton, whatever their number.
    """
    if isinstance(glossary, dict):
        if len(glossary) <= FEW_TERMS:
            return df.withColumn(output, glossary_column(F.col(text), glossary))
        glossary = df.sparkSession.createDataFrame(list(glossary.items()), "original string, translation string")
    return terms.substituted(df, text, glossary, output)


def _terms_of(glossary: DataFrame, key: str) -> DataFrame:
    """(key, terms): the non-empty terms of each setting in one array, longest first; one row for each setting that has any."""
    entry = F.struct((-F.char_length("original")).alias("size"), "original", "translation")
    usable = glossary.filter("original <> '' and translation is not null")
    return usable.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("terms"))


def apply_glossaries(df: DataFrame, text: str, glossary: DataFrame, key: str = "config_id", output: str = "replaced") -> DataFrame:
    """``df`` with the glossary of each row's own setting (``key``) substituted in ``text``, by the rule of ``apply_glossary``.

    ``glossary`` (key, original, translation) may hold any number of settings; a setting's
    terms are unique by original.  Up to ``terms.PART_BYTES`` of terms in all are broadcast,
    an automaton for each setting, and no row moves.  More travel as one array for each setting, with the pattern and
    the table made from it once, and meet their rows by an equi join.
    Empty terms and null translations are passed over; a row whose setting is null or
    has no terms keeps its text.
    """
    listed = stored(_terms_of(glossary, key), "glossaries")
    if small := terms.settings_of(listed, key, df):
        return terms.substituted_by_setting(df, text, small, key, output)
    setting, table, pattern = (free_name(df, f"glossary_{x}") for x in ("setting", "table", "pattern"))
    quoted = F.transform("terms", lambda t: F.regexp_replace(t["original"], SPECIAL, r"\\$1"))
    heads = F.array_join(F.transform("terms", lambda t: F.regexp_replace(F.substring(t["original"], 1, 1), r"([\\\[\]^&-])", r"\\$1")), "")
    # Stored, so that they are not made again for every piece of a text.
    made = stored(
        listed.select(
            F.col(key).alias(setting), F.concat(F.lit("(?s)("), F.array_join(quoted, "|"), F.lit("|[^"), heads, F.lit("]+|.)")).alias(pattern),
            F.map_from_entries(F.transform("terms", lambda t: F.struct(t["original"], t["translation"]))).alias(table),
        ), "patterns",
    )
    rows = df.join(made, F.col(key) == F.col(setting), "left")
    pieces = F.regexp_extract_all(F.col(text), F.col(pattern), F.lit(1))
    changed = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(F.col(table), p), p)), "")
    whole = F.when(F.col(setting).isNull(), F.col(text)).otherwise(changed)
    return rows.withColumn(output, whole).select(*[c for c in df.columns if c != output], output)


def glossary_violations(pairs: DataFrame, glossary: DataFrame, key: str | None = None) -> DataFrame:
    """(id, original, translation, missing, kept) for each term in a source: is its translation absent, is the term still there?

    Only terms that violate are returned.  Without ``key`` the glossary (original,
    translation) is for all pairs, has any number of terms and is walked as an automaton,
    so each pair is looked at where it lies and nothing is shuffled (more than ``terms.PART_BYTES`` of terms are joined).
    With ``key``, a column of both, each pair is held against the terms of its own setting, which
    is sent to all tasks if the settings are of that size in all.
    """
    if not key:
        return terms.violations(pairs, glossary)
    setting, listed = free_name(pairs, "glossary_setting"), free_name(pairs, "glossary_terms")
    own = stored(_terms_of(glossary, key), "glossaries")
    small = terms.fits(own)
    own = own.select(F.col(key).alias(setting), F.col("terms").alias(listed))
    pairs = pairs.join(F.broadcast(own) if small else own, F.col(key) == F.col(setting))
    present = F.filter(F.col(listed), lambda t: F.contains(F.col("source"), t["original"]))
    return terms.judged(pairs.withColumn(listed, present), listed)


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def number_mismatches(pairs: DataFrame) -> DataFrame:
    """Rows (id, source, target) whose digit runs differ in number, order or spelling (1 is not 001)."""
    found = pairs.withColumns({"source_numbers": digit_runs(F.col("source")), "target_numbers": digit_runs(F.col("target"))})
    return found.filter(~F.col("source_numbers").eqNullSafe(F.col("target_numbers")))


def residual_script(df: DataFrame, text: str, char_class: str = KANA) -> DataFrame:
    """``df`` with residual (characters of the class) and residual_share (of all characters; 0 for an empty text)."""
    left = F.char_length(F.regexp_replace(F.col(text), f"[^{char_class}]", ""))
    n = F.char_length(F.col(text))
    return df.withColumns({"residual": left, "residual_share": F.when(n > 0, left / n).otherwise(0.0)})


def glossary_coverage(df: DataFrame, text: str, glossary: DataFrame) -> DataFrame:
    """(original, rows, occurrences) for every term of the glossary, terms that never occur included.

    Occurrences are those of the one-pass rule, so a term inside a longer one that was
    taken does not count.  The glossary has any number of terms; what a task finds is
    added up there before it is shuffled.
    """
    return terms.counted(df, text, glossary.select("original"))
