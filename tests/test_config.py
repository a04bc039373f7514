import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators import config as C

G, P, S = "[全域設定]", "[全域 Prompt]", "[特定圖片]"


def by_marker(text):
    """The marker rule, restated for one text."""
    if G not in text:
        return "", "", ""
    parts = text.split(P)
    glob, prompt, files = parts[0], "", ""
    if len(parts) > 1:
        cut = parts[1].split(S)
        prompt, files = cut[0], cut[1] if len(cut) > 1 else ""
    elif S in glob:
        glob, files = glob.split(S)[:2]
    return glob.replace(G, "").strip(), prompt.strip(), files.strip()


def by_line(text):
    """The line rule, restated for one text."""
    found, name, body = {}, None, []
    for line in [*text.split("\n"), "[]"]:
        t = line.strip()
        if t[:1] == "[" and t[-1:] == "]":
            if name:
                found[name] = "\n".join(body).strip()
            name, body = t[1:-1], []
        elif not t.startswith(("# 說明：", "# 格式：")):
            body.append(line)
    return found


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = [G, P, S, "[x]", "[]", "[", "]", "a=b", "c = d=e", "# note", "# 說明：q", "", " ", "\n", "\n", "\n", "　k＝v"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)]


def test_marker_sections(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "config_id long, content string")
    found = {r["config_id"]: (r["global_text"], r["prompt_text"], r["files_text"]) for r in C.split_sections_marker(rows).collect()}
    assert found == {i: by_marker(t) for i, t in enumerate(texts)}


def test_line_sections(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "config_id long, content string")
    found = {}
    for r in C.split_sections_line(rows).collect():
        found.setdefault(r["config_id"], {})[r["section"]] = r["body"]
    assert found == {i: x for i, t in enumerate(texts) if (x := by_line(t))}


def test_lines_pairs_and_builds(spark):
    text = "a=1\n# a=9\n\n b = 2 \nk=\n=v\nnokey\na=3\nk=v # x\n　w　=y=z"
    rows = spark.createDataFrame([("c", text), ("null", None)], "config_id string, content string")
    kv = C.parse_kv(C.clean_lines(rows, "content", "config_id"))
    assert [(r["k"], r["v"]) for r in kv.orderBy("ln").collect()] == [("a", "1"), ("b", "2"), ("a", "3"), ("k", "v # x"), ("w", "y=z")]
    glossary = C.build_glossary(kv)
    assert [(r["original"], r["translation"]) for r in glossary.orderBy("pos").collect()] == [("a", "3"), ("b", "2"), ("k", "v # x"), ("w", "y=z")]
    assert {(r["file_key"], r["prompt"]) for r in C.build_file_prompts(kv).collect()} == {("a", "1、3"), ("b", "2"), ("k", "v # x"), ("w", "y=z")}
    prompt = C.build_global_prompt(C.clean_lines(rows, "content", "config_id")).collect()
    assert [r["global_prompt"] for r in prompt] == ["a=1、b = 2、k=、=v、nokey、a=3、k=v # x、w　=y=z"]


def test_overlay_keeps_the_first_place(spark):
    schema = "config_id string, pos int, original string, translation string"
    base = spark.createDataFrame([("c", 0, "a", "1"), ("c", 1, "b", "2")], schema)
    over = spark.createDataFrame([("c", 0, "c", "3"), ("c", 1, "a", "9")], schema)
    merged = C.overlay_glossary(base, over).orderBy("layer", "pos").collect()
    assert [(r["original"], r["translation"]) for r in merged] == [("a", "9"), ("b", "2"), ("c", "3")]


def test_override(spark):
    schema = "config_id int, name_mapping map<string,string>, global_prompt string"
    own = spark.createDataFrame([(i, {"k": "v"}, "own") for i in range(3)], schema)
    service = spark.createDataFrame([(0, {}, ""), (1, {"z": "1"}, "new")], schema)
    found = [(r["name_mapping"], r["global_prompt"]) for r in C.override_config(own, service).orderBy("config_id").collect()]
    assert found == [({"k": "v"}, "own"), ({"z": "1"}, "new"), ({"k": "v"}, "own")]


def test_round_trip_loses_what_the_editor_does_not_show(spark):
    text = f"x=0\n{G}\na=1\n{P}\np1\n{S}\nf=q\n{S}\ng=r"
    rows = spark.createDataFrame([("c", text)], "config_id string, content string")
    changes = {(r["change"], r["part"], r["k"], r["v"]) for r in C.roundtrip_config(rows).collect()}
    assert changes == {("lost", "glossary", "x", "0"), ("lost", "files", "f", "q"), ("added", "files", "g", "r")}
    same = spark.createDataFrame([("c", f"{G}\na=1\n{P}\np1\n{S}\nf=q")], "config_id string, content string")
    assert C.roundtrip_config(same).count() == 0


def test_rendered_shape(spark):
    rows = spark.createDataFrame([("c", C.GLOBAL, "a=1")], "config_id string, section string, body string")
    lines = C.render_config(rows).first()["content"].split("\n")
    assert lines[0] == G and lines[3] == "a=1" and lines[4:6] == ["", P] and lines[-2:] == ["", ""]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "config_id string, content string")
    assert C.split_sections_line(empty).count() == 0
    assert C.parsed_rows(empty).count() == 0
    assert C.roundtrip_config(empty).count() == 0
    assert empty.select(F.count("*")).first()[0] == 0
