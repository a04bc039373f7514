"""Settings files as tables: sections, glossaries, instructions, overlays, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Section names, their notes, and the sign that joins instructions.
GLOBAL, PROMPT, FILES = "全域設定", "全域 Prompt", "特定圖片"
NOTE_MARKS = ["# 說明：", "# 格式："]
NOTES = {
    GLOBAL: ["# 說明：這裡的人名對照會套用到「所有圖片」", "# 格式：原文=中文（一行一個）"],
    PROMPT: ["# 說明：套用到「所有圖片」的額外翻譯指示"],
    FILES: ["# 說明：針對「個別圖片」設定額外的翻譯要求", "# 格式：檔名=額外要求（一行一個）"],
}
JOINER = "、"


def _split(text: Column, marker: str) -> Column:
    return F.split(text, rf"\Q{marker}\E", -1)


def split_sections_marker(
    df: DataFrame, global_mark: str = f"[{GLOBAL}]", prompt_mark: str = f"[{PROMPT}]", files_mark: str = f"[{FILES}]"
) -> DataFrame:
    """global_text, prompt_text and files_text of ``content``, cut where the markers occur (anywhere in the text).

    Without the global marker all three are empty.  The text up to the first prompt
    marker, less every global marker, is the global part; what follows up to a second
    prompt marker is cut at the files markers into prompt and files.  A files marker
    counts before the prompt marker only if there is no prompt marker.
    """
    text = F.coalesce(F.col("content"), F.lit(""))
    by_prompt = _split(text, prompt_mark)
    head, rest = by_prompt[0], F.get(by_prompt, 1)
    has_prompt = F.size(by_prompt) > 1
    in_rest, in_head = _split(rest, files_mark), _split(head, files_mark)
    head_split = ~has_prompt & (F.size(in_head) > 1)
    global_text = F.replace(F.when(head_split, in_head[0]).otherwise(head), F.lit(global_mark), F.lit(""))
    files_text = F.when(has_prompt, F.get(in_rest, 1)).when(head_split, F.get(in_head, 1))
    prompt_text = F.when(has_prompt, in_rest[0])
    open_ = F.contains(text, F.lit(global_mark))
    return df.withColumns(
        {
            name: F.when(open_, strip(F.coalesce(part, F.lit("")))).otherwise("")
            for name, part in (("global_text", global_text), ("prompt_text", prompt_text), ("files_text", files_text))
        }
    )


def lines_of(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """A row for each line: the keys, ln (from 0) and line."""
    return df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("ln", "line"))


#: Where a line begins that, trimmed, stands in square brackets; only LF ends a line.
_HEADER_AT = r"(?dmU)^(?=[\s\x1c-\x1f&&[^\n]]*\[[^\n]*\][\s\x1c-\x1f&&[^\n]]*$)"


def split_sections_line(df: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, section, body): sections opened by lines that, trimmed, stand in square brackets.

    Lines before the first header and the body of a nameless one are dropped; the last
    of several sections of a name replaces the others; note lines are left out; the
    body is trimmed as a whole.  A file is cut where it lies: nothing is shuffled.
    """
    parts = F.split(F.coalesce(F.col("content"), F.lit("")), _HEADER_AT, -1)

    def section(part: Column) -> Column:
        head = strip(F.substring_index(part, "\n", 1))
        named = head.startswith("[") & head.endswith("]") & (F.char_length(head) > 2)
        return F.when(named, F.struct(F.substring(head, F.lit(2), F.char_length(head) - 2).alias("section"), part.alias("part")))

    found = df.select(key, F.filter(F.transform(parts, section), lambda s: s.isNotNull()).alias("sections"))
    backwards = F.reverse(F.transform("sections", lambda s: s["section"]))
    # The last of a name is the first from behind.
    last = F.filter("sections", lambda s, i: i == F.size("sections") - F.array_position(backwards, s["section"]))
    rows = found.select(key, F.explode(last).alias("s")).select(key, "s.section", F.split("s.part", "\n", -1).alias("lines"))
    kept = F.filter(F.slice("lines", 2, F.size("lines")), lambda x: ~strip(x).startswith(NOTE_MARKS[0]) & ~strip(x).startswith(NOTE_MARKS[1]))
    return rows.select(key, "section", strip(F.array_join(kept, "\n")).alias("body"))


def clean_lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, ln, line): trimmed lines without blank ones and those that begin with #."""
    trimmed = lines_of(df, F.coalesce(F.col(text), F.lit("")), *keys).withColumn("line", strip(F.col("line")))
    return trimmed.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def parse_kv(lines: DataFrame) -> DataFrame:
    """Lines cut at their first ``=`` into k and v, both trimmed; lines where one is missing or empty are dropped."""
    parts = F.split("line", "=", 2)
    cut = lines.withColumns({"k": strip(parts[0]), "v": strip(F.get(parts, 1))})
    return cut.filter("k <> '' and v <> ''").drop("line")


def build_glossary(kv: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, pos, original, translation): of a repeated original the last translation, at the first position."""
    return kv.groupBy(key, F.col("k").alias("original")).agg(F.max_by("v", "ln").alias("translation"), F.min("ln").alias("pos"))


def _in_order(value: Column, order: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("x"))))
    return F.array_join(F.transform(pairs, lambda p: p["x"]), JOINER)


def build_global_prompt(lines: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, global_prompt): the lines in file order, joined.  Keys without a line have no row."""
    return lines.groupBy(key).agg(_in_order(F.col("line"), F.col("ln")).alias("global_prompt"))


def build_file_prompts(kv: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, file_key, prompt): the prompts of a file key in file order, joined."""
    return kv.groupBy(key, F.col("k").alias("file_key")).agg(_in_order(F.col("v"), F.col("ln")).alias("prompt"))


def overlay_glossary(base: DataFrame, over: DataFrame, key: str = "config_id") -> DataFrame:
    """Both glossaries; of a shared original the translation of ``over``, at the place in ``base``; new ones follow."""
    columns = [key, "pos", "original", "translation"]
    both = base.select(*columns, F.lit(0).alias("layer")).unionByName(over.select(*columns, F.lit(1).alias("layer")))
    rank = F.struct("layer", "pos")
    merged = both.groupBy(key, "original").agg(F.max_by("translation", rank).alias("translation"), F.min(rank).alias("at"))
    return merged.select(key, F.col("at.layer").alias("layer"), F.col("at.pos").alias("pos"), "original", "translation")


def override_config(file_cfg: DataFrame, service_cfg: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, name_mapping, global_prompt): what the service sets replaces what the file sets, if it is not empty."""
    service = service_cfg.select(key, F.col("name_mapping").alias("m"), F.col("global_prompt").alias("p"))
    return file_cfg.join(service, key, "left").select(
        key,
        F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("name_mapping")).alias("name_mapping"),
        F.coalesce(F.nullif("p", F.lit("")), F.col("global_prompt")).alias("global_prompt"),
    )


def render_config(sections: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, content): the three sections with their notes, body or an empty line, and a blank line after each."""
    body = {s: F.coalesce(F.max(F.when(F.col("section") == s, F.col("body"))), F.lit("")) for s in NOTES}
    parts = []
    for name, notes in NOTES.items():
        parts += [F.lit(f"[{name}]"), *map(F.lit, notes), body[name], F.lit("")]
    return sections.groupBy(key).agg(F.array_join(F.array(*parts), "\n").alias("content"))


def parsed_rows(df: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, part, k, v): what a settings file means by markers: glossary pairs, prompt, file prompts."""
    cut = split_sections_marker(df)
    glossary = build_glossary(parse_kv(clean_lines(cut, "global_text", key)), key)
    prompt = build_global_prompt(clean_lines(cut, "prompt_text", key), key)
    files = build_file_prompts(parse_kv(clean_lines(cut, "files_text", key)), key)
    return (
        glossary.select(key, F.lit("glossary").alias("part"), F.col("original").alias("k"), F.col("translation").alias("v"))
        .union(prompt.select(key, F.lit("prompt"), F.lit(""), "global_prompt"))
        .union(files.select(key, F.lit("files"), "file_key", "prompt"))
    )


def roundtrip_config(df: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, change, part, k, v): parsed rows that loading into the editor and saving again loses or adds."""
    sections = split_sections_line(df, key)
    saved = render_config(sections.unionByName(df.select(key, F.lit("").alias("section"), F.lit("").alias("body"))), key)
    before, after = parsed_rows(df, key), parsed_rows(saved, key)
    lost = before.exceptAll(after).select(key, F.lit("lost").alias("change"), "part", "k", "v")
    return lost.union(after.exceptAll(before).select(key, F.lit("added"), "part", "k", "v"))

