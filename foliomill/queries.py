"""The operators bound to the tables, each with the same question in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import admission, names
from .operators import apply, config, journal, prompts, settings, textrules
from .plans import batch
from .plans.finished import FinishedIndex
from .sources import folders, payloads, scan
from .sources.scratch import scratch_path
from .streaming import waves

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
EXT = [".png", ".JPG", ".jpeg", ".webp", ".txt", "", ".PNG", ".gif"]
MIMES = ["image/png", "image/jpeg", "image/gif", "image/webp", "text/plain"]
#: Code points that ``strip`` takes off, for SQL's trim.
_WS = "'" + "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])) + "'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: one of eight extensions by id, a kB for each character, a project for each source."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXT)), (F.col("doc_id") % 8 + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        "doc_id", "lang", F.lit("all").alias("config_id"), F.col("source").alias("project"),
        F.concat(F.lit("page"), F.col("doc_id").cast("string"), ext).alias("file_name"), mime.alias("mime"),
        (F.col("n_chars") * 1024).alias("length"),
    )


_M = f"""m AS (SELECT doc_id, lang, source AS project, 'page' || doc_id || ({EXT!r})[doc_id % 8 + 1] AS file_name,
              ({MIMES!r})[doc_id % 5 + 1] AS mime, n_chars * 1024 AS length FROM documents)"""
_NAMES = f"""{_M}, n AS (SELECT file_name AS name FROM m UNION ALL SELECT regexp_extract(url, '[^/]*$') FROM pages)"""
_BATCH_STEM = r"CASE WHEN {0} = '' THEN '' ELSE left({0}, length({0}) - length(regexp_extract({0}, '(?s)^\.*[^.].*?(\.[^.]*)$', 1))) END"
_SUFFIX = r"regexp_extract({0}, '(?s)^.+(\.[^.]+)$', 1)"


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(names.base_name(F.col("url")).alias("name"))
    return manifest(spark, sf_dir).select(F.col("file_name").alias("name")).unionAll(urls)


def _on_names(column: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: all_names(spark, sf_dir).select("name", column(F.col("name")).alias("value"))


def _name_query(name: str, column: Callable[[Column], Column], sql: str) -> None:
    QUERIES[name] = _on_names(column)
    ORACLE_SQL[name] = f"WITH {_NAMES} SELECT name, {sql} AS value FROM n"


_name_query("b1_is_page", names.is_page, r"regexp_matches(lower(name), '\.(png|jpg|jpeg|webp)$')")
_name_query("b2_form_ext", names.has_allowed_ext, "contains(name, '.') AND lower(string_split(name, '.')[-1]) IN ('png', 'jpg', 'jpeg', 'webp')")
_name_query("b3_path_suffix", names.path_suffix, _SUFFIX.format("name"))
_name_query("b3_api_ext", names.api_ext_ok, f"lower({_SUFFIX.format('name')}) IN ('.png', '.jpg', '.jpeg', '.webp')")
_name_query("b8_stem", names.stem, _BATCH_STEM.format("name"))
_name_query("b9_output_batch", lambda n: names.output_name(n, "batch"), f"({_BATCH_STEM.format('name')}) || '.jpg'")
_name_query(
    "b9_output_api", lambda n: names.output_name(n, "api"),
    f"left(name, length(name) - length({_SUFFIX.format('name')})) || '_translated' || lower({_SUFFIX.format('name')})",
)
_name_query("b10_output_url", names.output_url, "'/api/outputs/' || name")
_name_query("b10_media_type", names.media_type, f"'image/' || ltrim({_SUFFIX.format('name')}, '.')")


@query(f"WITH {_M} SELECT file_name, mime IN ('image/png', 'image/jpeg', 'image/jpg', 'image/webp') AS ok FROM m")
def b4_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).select("file_name", names.is_valid_mime(F.col("mime")).alias("ok"))


@query(f"WITH {_M} SELECT file_name, length FROM m WHERE length <= 10485760")
def b5_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).filter(admission.size_ok(F.col("length"))).select("file_name", "length")


@query(f"WITH {_M} SELECT file_name, length FROM m WHERE length <= 16777216")
def b5_form_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).filter(admission.size_ok(F.col("length"), admission.MAX_BODY)).select("file_name", "length")


def _admitted(policy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = manifest(spark, sf_dir).withColumns({"configured": F.col("doc_id") % 11 != 0, "has_file": F.col("doc_id") % 13 != 0})
        return admission.admit(m, policy).select("file_name", "admitted", "code", "reason")

    return run


_EXT_OK = f"lower({_SUFFIX.format('file_name')}) IN ('.png', '.jpg', '.jpeg', '.webp')"
_FORM_OK = "contains(file_name, '.') AND lower(string_split(file_name, '.')[-1]) IN ('png', 'jpg', 'jpeg', 'webp')"
_RULES = {
    "api": [("doc_id % 11 <> 0", 400, "not configured"), (_EXT_OK, 400, "extension"), ("length <= 10485760", 413, "size")],
    "browser": [("mime IN ('image/png', 'image/jpeg', 'image/jpg', 'image/webp')", 400, "mime"), ("length <= 10485760", 400, "size")],
    "form": [("doc_id % 11 <> 0", 400, "no key"), ("doc_id % 13 <> 0", 400, "no file"), ("file_name <> ''", 400, "empty name"), (_FORM_OK, 400, "extension")],
}
for _policy, _rules in _RULES.items():
    _case = " ".join(f"WHEN NOT ({c}) THEN {{{i}}}" for i, (c, _, _) in enumerate(_rules))
    _code = "CASE " + _case.format(*[code for _, code, _ in _rules]) + " END"
    _reason = "CASE " + _case.format(*[f"'{r}'" for _, _, r in _rules]) + " END"
    QUERIES[f"b6_admit_{_policy}"] = _admitted(_policy)
    ORACLE_SQL[f"b6_admit_{_policy}"] = f"WITH {_M} SELECT file_name, {_code} IS NULL AS admitted, {_code} AS code, {_reason} AS reason FROM m"


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'key missing' WHEN c_custkey % 3 = 0 THEN 'input missing'
              WHEN c_custkey % 4 = 0 THEN 'input not found' WHEN c_custkey % 11 = 0 THEN 'output missing' END AS error FROM customer"""
)
def b7_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    key = F.when(k % 5 == 0, "  ").when(k % 7 == 0, admission.PLACEHOLDER_KEY).otherwise(F.col("c_name"))
    runs = table(spark, sf_dir, "customer").select(
        "c_custkey", admission.has_key(key).alias("has_key"), F.when(k % 3 == 0, "").otherwise("in").alias("input_dir"),
        (k % 4 != 0).alias("input_exists"), F.when(k % 11 == 0, "").otherwise("out").alias("output_dir"),
    )
    return admission.validate_runs(runs).select("c_custkey", "error")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings file for each conversation: a section header and the text of each turn."""
    turn = F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", turn.alias("x"))))
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("config_id"))
    return talks.agg(F.array_join(F.transform(ordered, lambda t: t["x"]), "\n").alias("content"))


_FILES = """files AS (SELECT conv_id AS config_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) ORDER BY turn) AS content
                  FROM conversations GROUP BY 1)"""


@query(
    f"""WITH {_FILES}, a AS (SELECT *, string_split(content, '[assistant]') AS p FROM files),
    b AS (SELECT *, p[1] AS head, string_split(p[1], '[system]') AS h, string_split(p[2], '[system]') AS r, len(p) > 1 AS has FROM a)
    SELECT config_id,
      CASE WHEN contains(content, '[user]') THEN trim(replace(CASE WHEN NOT has AND len(h) > 1 THEN h[1] ELSE head END, '[user]', ''), {_WS}) ELSE '' END AS global_text,
      CASE WHEN contains(content, '[user]') AND has THEN trim(r[1], {_WS}) ELSE '' END AS prompt_text,
      CASE WHEN contains(content, '[user]') THEN trim(coalesce(CASE WHEN has THEN r[2] WHEN len(h) > 1 THEN h[2] END, ''), {_WS}) ELSE '' END AS files_text
    FROM b"""
)
def c1_sections_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = config.split_sections_marker(conversation_files(spark, sf_dir), "[user]", "[assistant]", "[system]")
    return cut.drop("content")


@query(
    f"""WITH {_FILES}, l AS (SELECT config_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM files),
    h AS (SELECT *, trim(line, {_WS}) LIKE '[%]' AS is_header FROM l),
    s AS (SELECT *, max(CASE WHEN is_header THEN ln END) OVER (PARTITION BY config_id ORDER BY ln) AS start FROM h),
    g AS (SELECT config_id, start, max(CASE WHEN is_header THEN trim(line, {_WS})[2:-2] END) AS section,
                 trim(coalesce(string_agg(CASE WHEN NOT is_header AND NOT starts_with(trim(line, {_WS}), '# 說明：') AND NOT starts_with(trim(line, {_WS}), '# 格式：')
                          THEN line END, chr(10) ORDER BY ln), ''), {_WS}) AS body
          FROM s WHERE start IS NOT NULL GROUP BY 1, 2)
    SELECT config_id, section, arg_max(body, start) AS body FROM g WHERE section <> '' GROUP BY 1, 2"""
)
def c2_sections_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.split_sections_line(conversation_files(spark, sf_dir))


_DOC_LINES = f"""l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {_WS}) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents)"""


@query(f"WITH {_DOC_LINES} SELECT doc_id, ln::INT AS ln, line FROM l WHERE line <> '' AND NOT starts_with(line, '#')")
def c3_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.clean_lines(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    f"""WITH {_DOC_LINES}, u AS (SELECT doc_id AS id, ln, line FROM l UNION ALL SELECT p_partkey, 0, p_name || '=' || p_brand FROM part),
    k AS (SELECT id, ln, trim(left(line, strpos(line, '=') - 1), {_WS}) AS k, trim(substr(line, strpos(line, '=') + 1), {_WS}) AS v
          FROM u WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, '='))
    SELECT id, ln::INT AS ln, k, v FROM k WHERE k <> '' AND v <> ''"""
)
def c4_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = config.clean_lines(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "text", "id")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("ln"), F.concat_ws("=", "p_name", "p_brand").alias("line"))
    return config.parse_kv(docs.unionByName(part))


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.lit("all").alias("config_id"), F.col("p_partkey").alias("ln"), F.col("p_name").alias("k"), F.col("p_brand").alias("v"), "p_type")


@query("SELECT 'all' AS config_id, p_name AS original, arg_max(p_brand, p_partkey) AS translation, min(p_partkey) AS pos FROM part GROUP BY 2")
def c5_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.build_glossary(part_pairs(spark, sf_dir))


@query("SELECT conv_id AS config_id, string_agg(text, '、' ORDER BY turn) AS global_prompt FROM conversations GROUP BY 1")
def c6_global_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return config.build_global_prompt(talks.select(F.col("conv_id").alias("config_id"), F.col("turn").alias("ln"), F.col("text").alias("line")))


def event_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    tail = F.when(F.col("event_type").isin("view", "click"), "").otherwise(".png")
    key = F.concat(F.lit("page"), F.col("user_id").cast("string"), tail)
    return config.build_file_prompts(events.select(F.lit("all").alias("config_id"), F.col("event_id").alias("ln"), key.alias("k"), F.col("event_type").alias("v")))


_PROMPTS = """fp AS (SELECT 'page' || user_id || CASE WHEN event_type IN ('view', 'click') THEN '' ELSE '.png' END AS file_key,
                     string_agg(event_type, '、' ORDER BY event_id) AS prompt FROM events GROUP BY 1)"""


@query(f"WITH {_PROMPTS} SELECT 'all' AS config_id, file_key, prompt FROM fp")
def c7_file_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_prompts(spark, sf_dir)


@query(
    """WITH b AS (SELECT p_name AS o, arg_max(p_brand, p_partkey) AS t, min(p_partkey) AS pos FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
    v AS (SELECT p_name AS o, arg_max(p_brand, p_partkey) AS t, min(p_partkey) AS pos FROM part WHERE p_type = 'PROMO' GROUP BY 1)
    SELECT 'all' AS config_id, CASE WHEN b.o IS NULL THEN 1 ELSE 0 END AS layer, coalesce(b.pos, v.pos) AS pos, coalesce(b.o, v.o) AS original,
           coalesce(v.t, b.t) AS translation FROM b FULL JOIN v ON b.o = v.o"""
)
def c8_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = part_pairs(spark, sf_dir)
    promo = F.col("p_type") == "PROMO"
    return config.overlay_glossary(config.build_glossary(pairs.filter(~promo)), config.build_glossary(pairs.filter(promo)))


@query(
    """SELECT c_custkey AS config_id, CASE WHEN n_nationkey % 2 = 0 THEN c_mktsegment ELSE n_name END AS mapped,
              CASE WHEN n_nationkey % 3 = 0 THEN c_name ELSE n_name END AS global_prompt FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def c9_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    both = both.withColumn("config_id", F.col("c_custkey"))
    of_file = both.select("config_id", F.create_map(F.lit("k"), "c_mktsegment").alias("name_mapping"), F.col("c_name").alias("global_prompt"))
    empty = F.create_map().cast("map<string,string>")
    of_service = both.select(
        "config_id", F.when(F.col("n_nationkey") % 2 == 0, empty).otherwise(F.create_map(F.lit("k"), "n_name")).alias("name_mapping"),
        F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")).alias("global_prompt"),
    )
    return config.override_config(of_file, of_service).select("config_id", F.col("name_mapping")["k"].alias("mapped"), "global_prompt")


def _role_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings files with the real section names: a header by role, then a key=value line and more from the turn."""
    name = F.create_map(*[F.lit(x) for pair in zip(("user", "assistant", "system"), config.NOTES, strict=True) for x in pair])
    line = F.concat(F.lit("["), name[F.col("role")], F.lit("]\nk"), F.col("turn").cast("string"), F.lit("="), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("x"))))
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("config_id"))
    return talks.agg(F.array_join(F.transform(ordered, lambda t: t["x"]), "\n").alias("content"))


def _c10_sql() -> str:
    g, p, f = (f"[{x}]" for x in config.NOTES)
    names = " ".join(f"WHEN '{r}' THEN '{x}'" for r, x in zip(("user", "assistant", "system"), config.NOTES, strict=True))
    rendered = " || chr(10) || ".join(
        part for x, notes in config.NOTES.items()
        for part in [f"'[{x}]'", *[f"'{n}'" for n in notes], f"coalesce(max(body) FILTER (section = '{x}'), '')", "''"]
    )
    return f"""files AS (SELECT conv_id AS config_id, string_agg('[' || CASE role {names} END || ']' || chr(10) || 'k' || turn || '=' || text, chr(10) ORDER BY turn) AS content
                 FROM conversations GROUP BY 1),
    l AS (SELECT config_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM files),
    h AS (SELECT *, trim(line, {_WS}) LIKE '[%]' AS is_header FROM l),
    s AS (SELECT *, max(CASE WHEN is_header THEN ln END) OVER (PARTITION BY config_id ORDER BY ln) AS start FROM h),
    b AS (SELECT config_id, start, max(CASE WHEN is_header THEN trim(line, {_WS})[2:-2] END) AS section,
                 trim(coalesce(string_agg(CASE WHEN NOT is_header AND NOT starts_with(trim(line, {_WS}), '# 說明：') AND NOT starts_with(trim(line, {_WS}), '# 格式：')
                          THEN line END, chr(10) ORDER BY ln), ''), {_WS}) AS body
          FROM s WHERE start IS NOT NULL GROUP BY 1, 2),
    o AS (SELECT config_id, section, arg_max(body, start) AS body FROM b WHERE section <> '' GROUP BY 1, 2),
    saved AS (SELECT config_id, {rendered} AS content FROM o GROUP BY 1),
    both_ AS (SELECT 'lost' AS change, * FROM files UNION ALL SELECT 'added', * FROM saved),
    a AS (SELECT *, string_split(content, '{p}') AS q FROM both_),
    c AS (SELECT *, len(q) > 1 AS has, string_split(q[1], '{f}') AS x, string_split(q[2], '{f}') AS r FROM a WHERE contains(content, '{g}')),
    t AS (SELECT change, config_id, 'glossary' AS part, replace(CASE WHEN NOT has AND len(x) > 1 THEN x[1] ELSE q[1] END, '{g}', '') AS text FROM c
          UNION ALL SELECT change, config_id, 'prompt', r[1] FROM c WHERE has
          UNION ALL SELECT change, config_id, 'files', CASE WHEN has THEN r[2] WHEN len(x) > 1 THEN x[2] END FROM c),
    n AS (SELECT change, config_id, part, trim(unnest(string_split(text, chr(10))), {_WS}) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM t),
    k AS (SELECT *, trim(left(line, strpos(line, '=') - 1), {_WS}) AS k, trim(substr(line, strpos(line, '=') + 1), {_WS}) AS v FROM n WHERE line <> '' AND NOT starts_with(line, '#')),
    parsed AS (SELECT change, config_id, part, k, arg_max(v, ln) AS v FROM k WHERE part = 'glossary' AND contains(line, '=') AND k <> '' AND v <> '' GROUP BY ALL
          UNION ALL SELECT change, config_id, part, '', string_agg(line, '、' ORDER BY ln) FROM k WHERE part = 'prompt' GROUP BY ALL
          UNION ALL SELECT change, config_id, part, k, string_agg(v, '、' ORDER BY ln) FROM k WHERE part = 'files' AND contains(line, '=') AND k <> '' AND v <> '' GROUP BY ALL)"""


@query(
    f"""WITH {_c10_sql()}, lost AS (SELECT config_id, part, k, v FROM parsed WHERE change = 'lost'), added AS (SELECT config_id, part, k, v FROM parsed WHERE change = 'added')
    SELECT 'lost' AS change, * FROM (SELECT * FROM lost EXCEPT ALL SELECT * FROM added)
    UNION ALL SELECT 'added', * FROM (SELECT * FROM added EXCEPT ALL SELECT * FROM lost)"""
)
def c10_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.roundtrip_config(_role_files(spark, sf_dir))


@query(f"WITH {_c10_sql()} SELECT config_id, content FROM saved")
def a5_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config.render_config(config.split_sections_line(_role_files(spark, sf_dir)))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"purchase": "add", "click": "add", "error": "remove", "signup": "clear", "view": "setGlobalPrompt"}
    op = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"), F.col("event_id").alias("seq"), op.alias("op"), F.get_json_object("props", "$.k").alias("key"),
        F.col("event_id").cast("string").alias("value"), F.lit(None).cast("map<string,string>").alias("mapping"),
    )


@query(
    """WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS reset FROM events),
    a AS (SELECT user_id, k, arg_max(event_type, event_id) AS last, max(event_id) AS last_id FROM e
          WHERE event_type IN ('purchase', 'click', 'error') AND (reset IS NULL OR event_id >= reset) GROUP BY 1, 2)
    SELECT user_id AS "user", k AS key, last_id::VARCHAR AS value FROM a WHERE last <> 'error'"""
)
def c11_fold_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.fold_settings(change_log(spark, sf_dir))[0].drop("pos")


def whole_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log with every kind of change; keys that are set to nothing too."""
    i, kind, key = F.col("event_id"), F.col("event_type"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))
    op = (
        F.when(kind.isin("purchase", "click"), "add").when(kind == "error", "remove").when(kind == "signup", F.when(i % 2 == 0, "clear").otherwise("replace"))
        .otherwise(F.when(i % 3 == 0, "setApiKey").otherwise("setGlobalPrompt"))
    )
    text = i.cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"), i.alias("seq"), op.alias("op"), key.alias("key"),
        F.when((op == "setApiKey") & (i % 2 == 0), "").otherwise(text).alias("value"),
        F.when(op == "replace", F.create_map(key, F.concat(F.lit("r"), text))).alias("mapping"),
    )


_LOG = """e AS (SELECT user_id, event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k,
                CASE WHEN event_type IN ('purchase', 'click') THEN 'add' WHEN event_type = 'error' THEN 'remove'
                     WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'clear' ELSE 'replace' END
                     WHEN event_id % 3 = 0 THEN 'setApiKey' ELSE 'setGlobalPrompt' END AS op FROM events)"""


def snapshot(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The change log in three stretches, each folded into a snapshot of those before."""
    folder = scratch_path(log.sparkSession, "settings")
    most = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    for i in range(3):
        stretch = log.filter((F.col("seq") > most * i // 3 - (i == 0)) & (F.col("seq") <= most * (i + 1) // 3))
        state = settings.advance_snapshot(stretch, f"{folder}/{i - 1}" if i else None, f"{folder}/{i}")
    return settings.settings_of(state)


@query(
    f"""WITH {_LOG}, r AS (SELECT *, max(CASE WHEN op IN ('clear', 'replace') THEN event_id END) OVER (PARTITION BY user_id) AS reset FROM e),
    a AS (SELECT user_id, k, arg_max(op, event_id) AS last, max(event_id) AS id FROM r WHERE op IN ('add', 'remove', 'replace') AND (reset IS NULL OR event_id >= reset) GROUP BY 1, 2)
    SELECT user_id AS "user", k AS key, CASE WHEN last = 'replace' THEN 'r' ELSE '' END || id AS value FROM a WHERE last <> 'remove'"""
)
def c11_snapshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(whole_log(spark, sf_dir))[0].drop("pos")


@query(
    f"""WITH {_LOG} SELECT user_id AS "user", coalesce(max(CASE WHEN op = 'setGlobalPrompt' THEN event_id END)::VARCHAR, '') AS global_prompt,
              coalesce(max(CASE WHEN op = 'setApiKey' THEN event_id END) % 2 = 1, false) AS has_key FROM e GROUP BY 1"""
)
def c11_snapshot_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(whole_log(spark, sf_dir))[1]


@query(
    """SELECT user_id AS "user", coalesce(max(CASE WHEN event_type = 'view' THEN event_id END)::VARCHAR, '') AS global_prompt, false AS has_key
       FROM events GROUP BY 1"""
)
def c11_fold_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.fold_settings(change_log(spark, sf_dir))[1]


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 3 THEN NULL ELSE '' END AS global_prompt,
              CASE WHEN event_id % 4 = 1 THEN event_type END AS mapped, event_id % 4 = 0 AS has_key FROM events"""
)
def a6_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, e = F.col("event_id") % 4, F.col("event_type")
    text = (
        F.when(i == 0, F.concat(F.lit('{"globalPrompt":"'), e, F.lit('","apiKey":"x"}')))
        .when(i == 1, F.concat(F.lit('{"nameMapping":{"k":"'), e, F.lit('"},"apiKey":""}')))
        .when(i == 2, F.lit("not json"))
        .otherwise(F.lit('{"globalPrompt":null}'))
    )
    loaded = settings.load_settings(table(spark, sf_dir, "events").withColumn("json", text))
    return loaded.select("event_id", "global_prompt", F.col("name_mapping")["k"].alias("mapped"), "has_key")


_LOOKUP = f"""{_M}, {_PROMPTS}, d AS (SELECT m.*, coalesce(x.prompt, s.prompt, '') AS file_prompt FROM m
    LEFT JOIN fp x ON x.file_key = m.file_name LEFT JOIN fp s ON s.file_key = {_BATCH_STEM.format("m.file_name")})"""


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.lookup_file_prompt(manifest(spark, sf_dir), event_prompts(spark, sf_dir))


@query(f"WITH {_LOOKUP} SELECT file_name, file_prompt FROM d")
def d1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looked_up(spark, sf_dir).select("file_name", "file_prompt")


_PARTS = """CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'g' END"""
_COMPOSED = f"""array_to_string(list_filter([{_PARTS}, CASE WHEN file_prompt <> '' THEN file_prompt ELSE lang END], lambda x: x <> ''), '、')"""


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.when(F.col("doc_id") % 3 == 0, "").otherwise("g")
    return looked_up(spark, sf_dir).withColumn("instructions", prompts.compose_instructions(g, F.col("file_prompt"), F.col("lang")))


@query(f"WITH {_LOOKUP} SELECT file_name, {_COMPOSED} AS instructions FROM d")
def d2_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composed(spark, sf_dir).select("file_name", "instructions")


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A row for each settings file.
    pairs = prompts.glossary_arrays(config.build_glossary(part_pairs(spark, sf_dir)))
    return prompts.render_prompt(composed(spark, sf_dir).join(pairs, "config_id", "left"), "HEAD", "RULES")


@query(
    f"""WITH {_LOOKUP}, g AS (SELECT p_name AS o, arg_max(p_brand, p_partkey) AS t, min(p_partkey) AS pos FROM part GROUP BY 1),
    l AS (SELECT string_agg(o || '→' || t || chr(10), '' ORDER BY pos) AS listed FROM g), i AS (SELECT file_name, {_COMPOSED} AS extra FROM d)
    SELECT file_name, md5('HEAD' || chr(10) || chr(10) || 'RULES' || chr(10) || chr(10) || '人名對照（必須遵守）：' || chr(10) || listed
           || CASE WHEN extra <> '' THEN chr(10) || chr(10) || '補充：' || extra || chr(10) ELSE '' END || chr(10) || '直接輸出翻譯後圖片。') AS prompt_md5 FROM i, l"""
)
def d3_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir).select("file_name", F.md5("prompt").alias("prompt_md5"))


@query(
    """SELECT doc_id, md5('{"model":"m","parts":[{"mime_type":"image/jpeg","data":"' || base64(encode(text)) || '"},{"text":"' || lang || '"}],"options":"{}"}') AS request_md5
       FROM documents"""
)
def d4_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.col("lang").alias("prompt"))
    return prompts.build_requests(docs, "m").select("doc_id", F.md5(F.to_json("request")).alias("request_md5"))


def finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of the labelled documents; those of every third lie in another project."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id")
    there = docs.join(labels, "doc_id", "left_semi")
    project = F.when(F.col("doc_id") % 3 == 0, "elsewhere").otherwise(F.col("source"))
    return there.select(project.alias("project"), F.concat(F.lit("page"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("output_name"))


_FINISHED = """f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'elsewhere' ELSE source END AS project, 'page' || doc_id || '.jpg' AS output_name
                     FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(
    """WITH r AS (SELECT doc_id, strlen('{"model":"m","parts":[{"mime_type":"image/jpeg","data":"' || base64(encode(text)) || '"},{"text":"' || lang || '"}],"options":"{}"}') + 1 AS n FROM documents),
    s AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, max(n) OVER () AS longest FROM r),
    f AS (SELECT *, (before // (1048576 - longest + 1))::BIGINT AS file FROM s)
    SELECT doc_id, file, sum(n) OVER (PARTITION BY file)::BIGINT AS file_bytes, sum(n) OVER (PARTITION BY file) <= 1048576 AS fits FROM f"""
)
def d4_batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests dealt to offline batch files of a megabyte at most."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.col("lang").alias("prompt"))
    lines = prompts.build_requests(docs, "m").select("doc_id", F.to_json("request").alias("line"))
    filed = prompts.batch_files(lines, F.octet_length("line") + 1, 1 << 20, ["doc_id"]).withColumn("n", F.octet_length("line") + 1)
    sums = filed.groupBy("file").agg(F.sum("n").alias("file_bytes"))
    return filed.join(sums, "file").select("doc_id", "file", "file_bytes", (F.col("file_bytes") <= 1 << 20).alias("fits"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).withColumn("output_name", names.output_name(F.col("file_name"), "batch"))


@query(f"WITH {_M}, {_FINISHED} SELECT file_name FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.project = m.project AND f.output_name = {_BATCH_STEM.format('file_name')} || '.jpg')")
def e1_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.skip_existing(planned(spark, sf_dir), finished(spark, sf_dir)).select("file_name")


@query(ORACLE_SQL["e1_skip_existing"])
def e1_finished_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of what is finished, to which outputs were added twice."""
    index = FinishedIndex(spark, f"finished_{uuid.uuid4().hex}", buckets=8)
    done = finished(spark, sf_dir)
    index.add(done.filter(F.crc32(F.col("output_name").cast("binary")) % 2 == 0))
    index.add(done)
    return index.skip_existing(planned(spark, sf_dir)).select("file_name")


@query(
    """WITH r AS (SELECT page_id, CASE WHEN page_id % 7 > 0 THEN regexp_extract(url, '[^/]*$') END AS name, page_id % 3 > 0 AS ok FROM pages),
    w AS (SELECT *, coalesce(max(ok::INT) OVER (PARTITION BY name ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r)
    SELECT page_id, CASE WHEN done = 1 THEN 'skip' WHEN ok THEN 'success' ELSE 'failed' END AS status FROM w"""
)
def e2_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 7 > 0, names.base_name(F.col("url")))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("output_name"), (F.col("page_id") % 3 > 0).alias("ok"))
    return batch.settle_collisions(rows, ("output_name",), "page_id").select("page_id", "status")


@query("SELECT regexp_extract(url, '[^/]*$') AS output_name, min(CASE WHEN page_id % 2 = 0 THEN page_id END) AS page_id FROM pages GROUP BY 1")
def e2_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page has no place in the order; outputs of such pages alone are in the wave too."""
    place = F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("page_id")
    rows = table(spark, sf_dir, "pages").select(place, names.base_name(F.col("url")).alias("output_name"))
    return batch.plan_wave(rows, ("output_name",), "page_id")


@query(ORACLE_SQL["e2_collisions"])
def e2_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of an output tried one after the other, in waves; every third call fails."""
    name = F.when(F.col("page_id") % 7 > 0, names.base_name(F.col("url")))
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("output_name"))
    ok = F.when(F.col("page_id") % 3 > 0, "success").otherwise("failed")
    return batch.run_in_waves(rows, lambda wave: wave.withColumn("status", ok), ("output_name",), "page_id").select("page_id", "status")


@query(
    """SELECT o_orderkey, row_number() OVER w AS seq, count(*) OVER (PARTITION BY o_custkey) AS total,
              trunc(row_number() OVER w::DOUBLE / count(*) OVER (PARTITION BY o_custkey) * 100)::INT AS percent
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def e3_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.with_progress(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "seq", "total", "percent")


@query(
    """SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'click')) AS success, count(*) FILTER (event_type = 'view') AS skip,
              count(*) FILTER (event_type NOT IN ('purchase', 'click', 'view')) AS failed FROM events GROUP BY 1"""
)
def e4_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type").isin("purchase", "click"), "success").when(F.col("event_type") == "view", "skip").otherwise("failed")
    return batch.tally(table(spark, sf_dir, "events").withColumn("status", status), "user_id")


@query(
    """WITH r AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name, page_id % 3 > 0 AS ok FROM pages),
    w AS (SELECT *, coalesce(max(ok::INT) OVER (PARTITION BY name ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM r)
    SELECT lpad(page_id::VARCHAR, 12, '0') AS file_name, CASE WHEN done = 1 THEN 'skip' WHEN ok THEN 'success' ELSE 'failed' END AS status FROM w"""
)
def e2_stream_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of an output tried one after the other by a stream that holds the waiting ones; every third call fails."""
    rows = table(spark, sf_dir, "pages").select(
        F.lit("p").alias("project"), names.base_name(F.col("url")).alias("output_name"), F.lpad(F.col("page_id").cast("string"), 12, "0").alias("file_name")
    )
    ok = F.when(F.col("file_name").cast("long") % 3 > 0, "success").otherwise("failed")
    return waves.run_waves(rows, lambda wave: wave.withColumn("status", ok), scratch_path(spark, "waves")).select("file_name", "status")


@query(
    """SELECT count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'click')) AS success, count(*) FILTER (event_type = 'view') AS skip,
              count(*) FILTER (event_type NOT IN ('purchase', 'click', 'view')) AS failed FROM events"""
)
def e4_run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tally of a run, taken while its results are written."""
    status = F.when(F.col("event_type").isin("purchase", "click"), "success").when(F.col("event_type") == "view", "skip").otherwise("failed")
    counts = batch.store_with_tally(table(spark, sf_dir, "events").withColumn("status", status), scratch_path(spark, "results"))
    return spark.createDataFrame([counts], "total long, success long, skip long, failed long")


def _shout() -> Callable[[dict], str]:
    def call(row: dict) -> str:
        if row["doc_id"] % 7 == 0:
            raise ValueError(f"page {row['doc_id']}")
        return f"{row['lang']}:{row['n_chars']}"

    return call


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang || ':' || n_chars END AS body, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
              CASE WHEN doc_id % 7 = 0 THEN 'page ' || doc_id END AS error, CASE WHEN doc_id % 2 = 0 THEN 1152921504606846976 + doc_id END AS ticket FROM documents"""
)
def e5_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticket = F.when(F.col("doc_id") % 2 == 0, F.lit(1 << 60) + F.col("doc_id")).alias("ticket")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", ticket)
    return apply.apply_pages(docs, _shout, ["doc_id", "lang", "n_chars"]).drop("lang", "n_chars")


def _unpaid() -> Callable[[dict], str]:
    def call(row: dict) -> str:
        raise RuntimeError("paid twice" if row["doc_id"] % 7 else f"page {row['doc_id']}")

    return call


@query("SELECT * EXCLUDE (ticket) FROM (" + ORACLE_SQL["e5_apply"] + ")")
def e5_apply_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over half of the documents, and one over all of them that finds the first one's results in the journal."""
    folder = scratch_path(spark, "journal").removeprefix("file:")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    inputs = ["doc_id", "lang", "n_chars"]
    journal.apply_pages_once(docs.filter("doc_id % 2 = 0"), _shout, inputs, folder).write.format("noop").mode("overwrite").save()
    again = journal.apply_pages_once(docs.filter("doc_id % 2 = 0"), _unpaid, inputs, folder)
    rest = journal.apply_pages_once(docs.filter("doc_id % 2 <> 0"), _shout, inputs, folder)
    return again.unionByName(rest).drop("lang", "n_chars")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each turn: user text alone, assistant text then image, system no candidate."""
    data = F.base64(F.encode(F.col("role"), "UTF-8"))
    text = F.concat(F.lit('{"text":"t'), F.col("turn").cast("string"), F.lit('"}'))
    image = F.concat(F.lit('{"inline_data":{"mime_type":"image/png","data":"'), data, F.lit('"}}'))
    head, tail = F.lit('{"candidates":[{"content":{"parts":['), F.lit("]}}]}")
    body = F.when(F.col("role") == "user", F.concat(head, text, tail)).when(F.col("role") == "assistant", F.concat(head, text, F.lit(","), image, tail))
    rows = table(spark, sf_dir, "conversations").withColumn("body", body.otherwise(F.lit('{"candidates":[]}')))
    return apply.parse_responses(rows).withColumn("output_name", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".jpg")))


@query(
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role END AS payload, role = 'assistant' AS success,
              CASE WHEN role IN ('user', 'assistant') THEN 't' || turn END AS text FROM conversations"""
)
def e6_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("conv_id", "turn", F.col("payload").cast("string").alias("payload"), "success", "text")


@query(
    """SELECT conv_id, turn, role = 'assistant' AS success, CASE WHEN role = 'assistant' THEN '/api/outputs/c' || conv_id || '_' || turn || '.jpg' END AS output_url,
              CASE WHEN role <> 'assistant' THEN 'no image produced' END AS error, 200 AS code FROM conversations"""
)
def e7_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.to_results(responses(spark, sf_dir)).select("conv_id", "turn", "success", "output_url", "error", "code")


@query(
    """SELECT user_id AS project, event_type AS output_name, arg_max(event_id, CASE WHEN event_id % 3 = 0 THEN ts END) AS event_id FROM events GROUP BY 1, 2
       HAVING max(CASE WHEN event_id % 3 = 0 THEN ts END) IS NOT NULL
       UNION ALL SELECT user_id, event_type, NULL FROM events GROUP BY 1, 2 HAVING max(CASE WHEN event_id % 3 = 0 THEN ts END) IS NULL"""
)
def e8_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three writes have no time; an output of such writes alone has one of them as its last (which is left open)."""
    timed = F.col("event_id") % 3 == 0
    writes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project"), F.col("event_type").alias("output_name"), F.when(timed, F.col("event_id")).alias("event_id"), F.when(timed, F.col("ts")).alias("ts")
    )
    return batch.latest_per_output(writes).drop("ts")


TERMS = {"the": "<T>", "then": "<TN>", "er": "<ER>", "de la": "<DL>", "und": "<U>", "no such term": "<N>"}
_ALT = "|".join(sorted(TERMS, key=len, reverse=True))
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TERMS.items()) + "}"
_REPLACED = f"array_to_string(list_transform(regexp_extract_all(text, '(?s)({_ALT}|.)', 1), lambda x: coalesce({_MAP}[x], x)), '')"


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textrules.apply_glossary(table(spark, sf_dir, "documents"), "text", TERMS)


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TERMS.items()), "original string, translation string")


@query(f"SELECT doc_id, md5({_REPLACED}) AS replaced_md5 FROM documents")
def f1_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(spark, sf_dir).select("doc_id", F.md5("replaced").alias("replaced_md5"))


@query(
    f"""WITH p AS (SELECT doc_id AS id, text AS source, CASE WHEN doc_id % 2 = 0 THEN {_REPLACED} ELSE text END AS target FROM documents), t AS (SELECT unnest(map_entries({_MAP})) AS e),
    c AS (SELECT id, e.key AS original, e.value AS translation, NOT contains(target, e.value) AS missing, contains(target, e.key) AS kept FROM p, t WHERE contains(source, e.key))
    SELECT * FROM c WHERE missing OR kept"""
)
def f2_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("doc_id") % 2 == 0, F.col("replaced")).otherwise(F.col("text"))
    pairs = replaced(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("source"), target.alias("target"))
    return textrules.glossary_violations(pairs, terms(spark))


#: Two settings by language: that of de and en has every term, that of fr and es has other translations of three; others have none.
_SETTING = {"de": "one", "en": "one", "fr": "two", "es": "two"}
_OF_SETTING = {"one": TERMS, "two": {"de la": "<2DL>", "de": "<2D>", "(e": "<2E>"}}


def setting_terms(spark: SparkSession) -> DataFrame:
    rows = [(s, o, t) for s, found in _OF_SETTING.items() for o, t in found.items()]
    return spark.createDataFrame(rows, "config_id string, original string, translation string")


def replaced_by_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    setting = F.create_map(*[F.lit(x) for pair in _SETTING.items() for x in pair])[F.col("lang")]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", setting.alias("config_id"))
    return textrules.apply_glossaries(docs, "text", setting_terms(spark))


_MAP_2 = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _OF_SETTING["two"].items()) + "}"
_REPLACED_2 = rf"array_to_string(list_transform(regexp_extract_all(text, '(?s)(de la|de|\(e|.)', 1), lambda x: coalesce({_MAP_2}[x], x)), '')"
_BY_SETTING = f"CASE WHEN lang IN ('de', 'en') THEN {_REPLACED} WHEN lang IN ('fr', 'es') THEN {_REPLACED_2} ELSE text END"


@query(f"SELECT doc_id, md5({_BY_SETTING}) AS replaced_md5 FROM documents")
def f1_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced_by_setting(spark, sf_dir).select("doc_id", F.md5("replaced").alias("replaced_md5"))


@query(
    f"""WITH p AS (SELECT doc_id AS id, CASE WHEN lang IN ('de', 'en') THEN {_MAP} WHEN lang IN ('fr', 'es') THEN {_MAP_2} END AS terms, text AS source,
                          CASE WHEN doc_id % 2 = 0 THEN {_BY_SETTING} ELSE text END AS target FROM documents),
    t AS (SELECT id, source, target, unnest(map_entries(terms)) AS e FROM p),
    c AS (SELECT id, e.key AS original, e.value AS translation, NOT contains(target, e.value) AS missing, contains(target, e.key) AS kept FROM t WHERE contains(source, e.key))
    SELECT * FROM c WHERE missing OR kept"""
)
def f2_violations_by_setting(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("doc_id") % 2 == 0, F.col("replaced")).otherwise(F.col("text"))
    pairs = replaced_by_setting(spark, sf_dir).select(F.col("doc_id").alias("id"), "config_id", F.col("text").alias("source"), target.alias("target"))
    return textrules.glossary_violations(pairs, setting_terms(spark), "config_id")


def word_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary as large as the data: the part names and the long words of documents, each to be written in angle brackets."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[a-zà-ÿ]{9,}"), F.lit(0)))
    words = table(spark, sf_dir, "documents").select(word.alias("original"))
    known = words.union(table(spark, sf_dir, "part").select("p_name")).distinct()
    return known.select("original", F.concat(F.lit("<"), "original", F.lit(">")).alias("translation"))


#: A word of nine letters or more is a term, and inside a longer run only whole runs are taken: the longest first.
_WORDS = "regexp_replace(text, '([a-zà-ÿ]{9,})', '<\\1>', 'g')"


@query(f"SELECT doc_id, md5({_WORDS}) AS replaced_md5 FROM documents")
def f1_large_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = textrules.apply_glossary(table(spark, sf_dir, "documents"), "text", word_glossary(spark, sf_dir))
    return found.select("doc_id", F.md5("replaced").alias("replaced_md5"))


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zà-ÿ]{9,}')) AS t FROM documents), c AS (SELECT t, count(DISTINCT doc_id) AS n, count(*) AS k FROM w GROUP BY 1),
    g AS (SELECT t FROM c UNION SELECT p_name FROM part)
    SELECT g.t AS original, coalesce(n, 0) AS "rows", coalesce(k, 0) AS occurrences FROM g LEFT JOIN c ON g.t = c.t"""
)
def f5_large_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textrules.glossary_coverage(table(spark, sf_dir, "documents"), "text", word_glossary(spark, sf_dir))


@query(
    """SELECT doc_id AS id, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS source_numbers,
              array_to_string(regexp_extract_all(replace(text, '1', '11'), '[0-9]+'), ',') AS target_numbers
       FROM documents WHERE regexp_extract_all(text, '[0-9]+') <> regexp_extract_all(replace(text, '1', '11'), '[0-9]+')"""
)
def f3_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.replace("text", F.lit("1"), F.lit("11")).alias("target"))
    found = textrules.number_mismatches(pairs)
    return found.select("id", F.array_join("source_numbers", ",").alias("source_numbers"), F.array_join("target_numbers", ",").alias("target_numbers"))


@query(
    """SELECT doc_id, length(regexp_replace(text, '[^À-ÿ]', '', 'g'))::INT AS residual, round(length(regexp_replace(text, '[^À-ÿ]', '', 'g')) / length(text), 6) AS residual_share
       FROM documents"""
)
def f4_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = textrules.residual_script(table(spark, sf_dir, "documents"), "text", "À-ÿ")
    return found.select("doc_id", "residual", F.round("residual_share", 6).alias("residual_share"))


@query(
    f"""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '({_ALT})', 1)) AS t FROM documents), c AS (SELECT t, count(DISTINCT doc_id) AS n, count(*) AS k FROM h GROUP BY 1)
    SELECT e.key AS original, coalesce(n, 0) AS "rows", coalesce(k, 0)::BIGINT AS occurrences FROM (SELECT unnest(map_entries({_MAP})) AS e) LEFT JOIN c ON t = e.key"""
)
def f5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textrules.glossary_coverage(table(spark, sf_dir, "documents"), "text", terms(spark))


@query(f"WITH {_M} SELECT project, file_name, length FROM m WHERE regexp_matches(lower(file_name), '\\.(png|jpg|jpeg|webp)$')")
def a1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page files in a listing of every project's folder."""
    m = manifest(spark, sf_dir)
    listing = m.select(F.concat_ws("/", F.lit("file:/pages"), "project", "file_name").alias("path"), "project", "length")
    return scan.scan_pages_listing(listing).select("project", "file_name", "length")


def page_tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each source with a file for each document, as large as the document has characters (every third name begins with a dot)."""
    root = scratch_path(spark, "tree").removeprefix("file:")
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, ".").otherwise(""), "file_name")
    files = manifest(spark, sf_dir).select("project", name.alias("output_name"), F.repeat(F.lit("x"), (F.col("length") / 1024).cast("int")).cast("binary").alias("payload"))
    payloads.write_payloads(files, root)
    return root


_TREE = f"""{_M}, t AS (SELECT project, CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END || file_name AS file_name, length // 1024 AS length FROM m)"""


@query(f"WITH {_TREE} SELECT project, file_name, length FROM t WHERE regexp_matches(lower(file_name), '\\.(png|jpg|jpeg|webp)$') AND length <= 2000")
def a1_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files of up to 2,000 bytes in all projects' folders, which are listed in tasks."""
    return folders.scan_folders(spark, page_tree(spark, sf_dir)).filter("length <= 2000").select("project", "file_name", "length")


@query(f"WITH {_TREE} SELECT project, file_name AS output_name FROM t")
def a2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is finished in all projects' folders."""
    return folders.scan_project_outputs(spark, page_tree(spark, sf_dir))


@query(
    """SELECT doc_id || '.cfg' AS name, md5(CASE WHEN doc_id % 10 = 0 THEN '' ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END) AS content_md5,
              CASE WHEN doc_id % 10 = 0 THEN 'not UTF-8' END AS error FROM documents"""
)
def a3_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as settings files, every tenth with a byte that is no UTF-8, and read again."""
    root = scratch_path(spark, "configs").removeprefix("file:")
    ended = F.replace("text", F.lit("\n"), F.lit("\r\n")).cast("binary")
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(ended, F.unhex(F.lit("FF")))).otherwise(ended)
    payloads.write_payloads(table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".cfg")).alias("output_name"), content.alias("payload")), root)
    return scan.scan_configs(spark, f"{root}/*.cfg").select(names.base_name(F.col("config_id")).alias("name"), F.md5("content").alias("content_md5"), "error")


@query("SELECT regexp_extract(url, '[^/]*$') AS output_name FROM pages")
def a2_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.outputs_listing(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query(
    """SELECT doc_id::VARCHAR AS config_id, md5(CASE WHEN doc_id % 10 = 0 THEN '' ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END) AS content_md5,
              CASE WHEN doc_id % 10 = 0 THEN 'not UTF-8' END AS error FROM documents"""
)
def a3_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as settings files, every second with other line ends and every tenth with a byte that is no UTF-8."""
    ended = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")).cast("binary")
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(ended, F.unhex(F.lit("FF")))).otherwise(ended)
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return scan.decode_configs(files).select("config_id", F.md5("content").alias("content_md5"), "error")


@query("SELECT page_id || '.html' AS output_name, md5(coalesce(html, '')) AS payload_md5 FROM pages")
def a4_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a file of its own and read again."""
    folder = scratch_path(spark, "payloads").removeprefix("file:")
    html = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("output_name"), F.col("html").cast("binary").alias("payload"))
    payloads.write_payloads(html, folder)
    files = spark.read.format("binaryFile").load(folder)
    return files.select(names.base_name(F.col("path")).alias("output_name"), F.md5("content").alias("payload_md5"))


@query(
    f"""WITH {_LOOKUP}, {_FINISHED} SELECT file_name, {_BATCH_STEM.format("file_name")} || '.jpg' AS output_name, {_COMPOSED} AS instructions FROM d
    WHERE doc_id % 11 <> 0 AND {_EXT_OK} AND length <= 10485760
      AND NOT EXISTS (SELECT 1 FROM f WHERE f.project = d.project AND f.output_name = {_BATCH_STEM.format("file_name")} || '.jpg')"""
)
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from manifest to plan: admission, naming, finished work, per-file prompts, instructions."""
    rows = composed(spark, sf_dir).withColumn("configured", F.col("doc_id") % 11 != 0)
    admitted = admission.admit(rows, "api").filter("admitted")
    named = admitted.withColumn("output_name", names.output_name(F.col("file_name"), "batch"))
    return batch.skip_existing(named, finished(spark, sf_dir)).select("file_name", "output_name", "instructions")
