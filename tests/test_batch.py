import json
import os
import random

import pytest
from pyspark.sql import functions as F

from foliomill.operators import apply, prompts, settings, textrules
from foliomill.plans import batch
from foliomill.sources import folders, payloads, scan
from foliomill.streaming.incremental import plan_stream


def test_lookup_and_precedence(spark):
    keys = spark.createDataFrame([("c", "page", "S"), ("c", "page.jpg", "E")], "config_id string, file_key string, prompt string")
    pages = spark.createDataFrame([("c", "page.jpg"), ("c", "page.png"), ("c", "Page.png"), ("d", "page.jpg")], "config_id string, file_name string")
    found = {(r["config_id"], r["file_name"]): r["file_prompt"] for r in prompts.lookup_file_prompt(pages, keys).collect()}
    assert found == {("c", "page.jpg"): "E", ("c", "page.png"): "S", ("c", "Page.png"): "", ("d", "page.jpg"): ""}
    rows = spark.createDataFrame([("g", "f", "c"), ("g", "", "c"), ("", "", "c"), ("", "", "")], "g string, f string, c string")
    out = rows.select(prompts.compose_instructions(F.col("g"), F.col("f"), F.col("c"))).collect()
    assert [r[0] for r in out] == ["g、f", "g、c", "c", ""]


def test_prompt_and_request(spark):
    glossary = spark.createDataFrame([("c", 1, "b", "2"), ("c", 0, "a", "1")], "config_id string, pos int, original string, translation string")
    pairs = prompts.glossary_arrays(glossary)
    rows = spark.createDataFrame([("c", "x"), ("d", "")], "config_id string, instructions string").join(pairs, "config_id", "left")
    made = {r["config_id"]: r["prompt"] for r in prompts.render_prompt(rows, "H", "R").collect()}
    assert made["c"] == "H\n\nR\n\n人名對照（必須遵守）：\na→1\nb→2\n\n\n補充：x\n\n直接輸出翻譯後圖片。"
    assert made["d"] == "H\n\nR\n直接輸出翻譯後圖片。"
    request = prompts.build_requests(spark.createDataFrame([(bytearray(b"i"), "p")], "content binary, prompt string"), "m").first()["request"]
    assert request["parts"][0]["mime_type"] == "image/jpeg" and bytes(request["parts"][0]["data"]) == b"i" and request["parts"][1]["text"] == "p"


def test_collisions_progress_and_tally(spark):
    rows = [("x", i, ok) for i, ok in enumerate([False, True, True])] + [("y", i, False) for i in range(2)]
    settled = batch.settle_collisions(spark.createDataFrame(rows, "output_name string, seq int, ok boolean").withColumn("project", F.lit("p")))
    assert [r["status"] for r in settled.orderBy("output_name", "seq").collect()] == ["failed", "success", "skip", "failed", "failed"]
    assert tuple(batch.tally(settled).first()) == ("p", 5, 1, 1, 3)
    pages = spark.range(100).select(F.lit("p").alias("project"), F.format_string("%03d", "id").alias("file_name"))
    percent = [r["percent"] for r in batch.with_progress(pages).orderBy("seq").collect()]
    assert percent == [int(i / 100 * 100) for i in range(1, 101)] and percent[28] == 28


def test_progress_over_many_files(spark):
    rows = [("hot", f"{i:04d}", i) for i in range(900)] + [(f"p{i}", "x", -1) for i in range(50)] + [(None, "b", 0), (None, None, 1)]
    pages = spark.createDataFrame(rows, "project string, file_name string, progress_row int").repartition(7)
    found = batch.with_progress(pages.withColumn("seq", F.lit(-5))).collect()
    assert [(r["file_name"], r["progress_row"]) for r in sorted((r for r in found if r["project"] == "hot"), key=lambda r: r["seq"])] == [(f"{i:04d}", i) for i in range(900)]
    assert sorted(r["seq"] for r in found if r["project"] == "hot") == list(range(1, 901)) and {r["total"] for r in found if r["project"] == "hot"} == {900}
    assert {(r["seq"], r["total"], r["percent"]) for r in found if str(r["project"]).startswith("p")} == {(1, 1, 100)}
    assert {(r["file_name"], r["seq"], r["total"], r["percent"]) for r in found if r["project"] is None} == {(None, 1, 2, 50), ("b", 2, 2, 100)}
    assert batch.with_progress(pages.limit(0)).collect() == []


def test_wave_skip_and_latest(spark):
    plan = spark.createDataFrame([("p", "a.png", "a.jpg"), ("p", "a.jpg", "a.jpg"), ("p", "b.png", "b.jpg")], "project string, file_name string, output_name string")
    assert {r["file_name"] for r in batch.plan_wave(plan).collect()} == {"a.jpg", "b.png"}
    done = spark.createDataFrame([("p", "b.jpg"), ("p", "b.jpg"), ("q", "a.jpg")], "project string, output_name string")
    left = batch.skip_existing(plan, done)
    assert {r["file_name"] for r in left.collect()} == {"a.png", "a.jpg"}
    assert "LeftAnti" in left._jdf.queryExecution().toString()
    assert {(r["file_name"], r["action"]) for r in batch.skip_existing(plan, done, mark=True).collect()} == {("a.png", "run"), ("a.jpg", "run"), ("b.png", "skip")}
    rows = [("p", "o", 1, "x"), ("p", "o", 2, "y"), ("p", "o", None, "z"), ("q", "o", 0, "q"), ("q", None, None, "only"), (None, "o", 5, "n")]
    writes = spark.createDataFrame(rows, "project string, output_name string, ts int, v string")
    assert sorted(r["v"] for r in batch.latest_per_output(writes).collect()) == ["n", "only", "q", "y"]
    assert sorted(r["v"] for r in batch.latest_per_output(writes, "project").collect()) == ["n", "q", "y"]
    first = batch.plan_wave(writes, order="ts").collect()
    assert sorted(r["v"] for r in first) == ["n", "only", "q", "x"]


def test_collisions_of_null_names_and_places(spark):
    rows = [("p", None, 1, True, "x"), ("p", None, 2, True, "x"), ("p", "a", None, False, "x"), ("p", "a", 1, True, "x"), ("p", "a", 2, False, "x"), (None, "a", 1, False, "x")]
    found = batch.settle_collisions(spark.createDataFrame(rows, "project string, output_name string, seq int, ok boolean, status string"))
    assert found.columns == ["project", "output_name", "seq", "ok", "status"]
    assert sorted(map(str, [(r[0], r[1], r[2], r["status"]) for r in found.collect()])) == sorted(
        map(str, [("p", None, 1, "success"), ("p", None, 2, "skip"), ("p", "a", None, "failed"), ("p", "a", 1, "success"), ("p", "a", 2, "skip"), (None, "a", 1, "failed")])
    )


def test_apply_captures_failures(spark):
    def make():
        def call(row):
            if row["i"] == 1:
                raise RuntimeError("no")
            return f"r{row['i']}"

        return call

    out = apply.apply_pages(spark.range(3).withColumnRenamed("id", "i"), make, ["i"], concurrency=2)
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(0, "r0", "success", None), (1, None, "failed", "no"), (2, "r2", "success", None)]


def test_apply_leaves_other_columns_as_they_are(spark):
    seen = lambda: lambda row: repr((row["k"], row["x"]))
    rows = [(2**60 + 1, None, [1, None], "a"), (None, 5, None, "b")]
    df = spark.createDataFrame(rows, "n long, k long, x array<int>, error string")
    out = apply.apply_pages(df, seen, ["k", "x"]).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(2**60 + 1, None, [1, None], "(None, [1, None])", "success", None), (None, 5, None, "(5, None)", "success", None)]
    none = apply.apply_pages(df, lambda: lambda row: None, ["k"], output="body").filter("body is null and status = 'success'")
    assert none.count() == 2 and apply.apply_pages(df.limit(0), seen, ["k", "x"]).count() == 0


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ('{"candidates":[{"content":{"parts":[{"text":"t"},{"inline_data":{"mime_type":"i","data":"QQ=="}},{"inline_data":{"data":"Qg=="}}]}}]}', b"A"),
        ('{"candidates":[]}', None),
        ('{"candidates":[{"content":{"parts":[{"text":"t"}]}}]}', None),
        ('{"candidates":[{"content":{"parts":[{"file_data":{"file_uri":"u"}}]}}]}', None),
        ("not json", None),
        (None, None),
    ],
)
def test_responses(spark, body, expected):
    rows = spark.createDataFrame([("o.jpg", body)], "output_name string, body string")
    r = apply.to_results(apply.parse_responses(rows)).first()
    assert (bytes(r["payload"]) if r["payload"] else None) == expected
    assert r["success"] == (expected is not None)
    assert (r["output_url"], r["error"]) == (("/api/outputs/o.jpg", None) if expected else (None, apply.NO_IMAGE))


def test_settings_defaults_and_fold(spark):
    texts = ['{"globalPrompt":null}', "broken", '{"apiKey":"k","nameMapping":{"a":"b"}}', None]
    rows = settings.load_settings(spark.createDataFrame([(t,) for t in texts], "json string")).collect()
    assert [(r["name_mapping"], r["global_prompt"], r["has_key"]) for r in rows] == [({}, None, False), ({}, "", False), ({"a": "b"}, "", True), ({}, "", False)]
    log = [
        ("u", 1, "add", "a", "1", None), ("u", 2, "replace", None, None, {"b": "2", "c": "3"}), ("u", 3, "remove", "b", None, None),
        ("u", 4, "add", "d", "4", None), ("u", 5, "setApiKey", None, "k", None), ("v", 1, "add", "x", "1", None), ("v", 2, "clear", None, None, None),
    ]
    pairs, scalars = settings.fold_settings(spark.createDataFrame(log, "user string, seq int, op string, key string, value string, mapping map<string,string>"))
    assert [(r["user"], r["key"], r["value"]) for r in pairs.orderBy("pos").collect()] == [("u", "c", "3"), ("u", "d", "4")]
    assert {tuple(r) for r in scalars.collect()} == {("u", "", True), ("v", "", False)}


def test_fold_agrees_with_a_replay(spark):
    rng, log = random.Random(3), []
    for user in ("hot", "hot", "hot", "u", None):
        for _ in range(60):
            op, key = rng.choice(["add"] * 5 + ["remove"] * 3 + ["replace", "clear"]), rng.choice(["a", "b", "c", None])
            log.append((user, len(log), op, key, str(len(log)), {"b": "y", "c": "x"} if op == "replace" else None))
    state: dict = {}
    for user, _, op, key, value, mapping in log:
        mine = state.setdefault(user, {})
        if op == "add":
            mine[key] = value
        elif op == "remove":
            mine.pop(key, None)
        else:
            mine.clear()
            mine.update(mapping or {})
    pairs, _ = settings.fold_settings(spark.createDataFrame(log, "user string, seq int, op string, key string, value string, mapping map<string,string>"))
    found: dict = {}
    for r in sorted(pairs.collect(), key=lambda r: r["pos"]):
        found.setdefault(r["user"], []).append((r["key"], r["value"]))
    assert found == {u: list(m.items()) for u, m in state.items() if m}


def test_glossaries_of_settings(spark):
    rows = [("one", "a.b [x] a-b \\E ab"), ("two", "a.b [x] a-b"), ("none", "a.b"), (None, "a.b"), ("one", None), ("one", ""), ("two", "^a 😀a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, config_id string, text string").withColumn("glossary_terms", F.lit(1))
    terms = [("one", "a.b", "1"), ("one", "[x]", "2"), ("one", "\\E", "3"), ("one", "a", "b"), ("one", "", "no"), ("one", "x", None), ("two", "a-b", "$1"), ("two", "-", "m"), ("two", "^", "c"), ("two", "😀", "face")]
    glossary = spark.createDataFrame(terms, "config_id string, original string, translation string")
    found = {r["id"]: (r["replaced"], r["glossary_terms"]) for r in textrules.apply_glossaries(df, "text", glossary).collect()}
    assert found == {i: (t, 1) for i, t in enumerate(["1 2 b-b 3 bb", "a.b [x] $1", "a.b", "a.b", None, "", "ca facea"])}
    same = textrules.apply_glossary(df, "text", {"a.b": "1", "[x]": "2", "\\E": "3", "a": "b"}).filter("id = 0").first()["replaced"]
    assert same == found[0][0]
    pairs = df.select("id", "config_id", F.col("text").alias("source"), F.lit("1 a $1").alias("target"))
    bad = {(r["id"], r["original"], r["missing"], r["kept"]) for r in textrules.glossary_violations(pairs, glossary, "config_id").collect()}
    assert bad == {(0, "a", True, True), (0, "[x]", True, False), (0, "\\E", True, False), (1, "-", True, False), (6, "^", True, False), (6, "😀", True, False)}


def test_text_rules(spark):
    rows = spark.createDataFrame([(1, "abc ab. a", "1 x 001")], "id int, source string, target string")
    out = textrules.apply_glossary(rows, "source", {"a": "b", "ab": "a", "abc": "X.Y", "": "never"}).first()
    assert out["replaced"] == "X.Y a. b"
    pairs = spark.createDataFrame([(1, "a1 b", "Z1 b"), (2, "a01", "Q1"), (3, None, "x")], "id int, source string, target string")
    glossary = spark.createDataFrame([("a", "Z"), ("b", "B")], "original string, translation string")
    bad = {(r["id"], r["original"], r["missing"], r["kept"]) for r in textrules.glossary_violations(pairs, glossary).collect()}
    assert bad == {(1, "b", True, True), (2, "a", True, False)}
    assert [r["id"] for r in textrules.number_mismatches(pairs).orderBy("id").collect()] == [2, 3]
    kana = textrules.residual_script(spark.createDataFrame([("あいa",), ("",)], "t string"), "t").collect()
    assert [(r["residual"], round(r["residual_share"], 3)) for r in kana] == [(2, 0.667), (0, 0.0)]
    texts = spark.createDataFrame([("a ab",), ("ab ab",)], "t string")
    terms = spark.createDataFrame([("a",), ("ab",), ("q",)], "original string")
    assert {tuple(r) for r in textrules.glossary_coverage(texts, "t", terms).collect()} == {("a", 1, 1), ("ab", 2, 3), ("q", 0, 0)}


def test_scans(spark, tmp_path):
    for name in ["a.png", "B.JPG", "c.txt", "日本 1.webp"]:
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(b"d")
    pages = scan.scan_pages(spark, str(tmp_path))
    assert {(r["file_name"], r["length"]) for r in pages.collect()} == {(n, len(n.encode())) for n in ["a.png", "B.JPG", "日本 1.webp"]}
    plan = pages.filter("length <= 10").select("file_name")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10)" in plan and "content" not in plan.split("ReadSchema")[-1]
    assert {r[0] for r in scan.scan_outputs(spark, str(tmp_path)).collect()} == {"a.png", "B.JPG", "c.txt", "日本 1.webp"}
    assert scan.scan_outputs(spark, str(tmp_path / "none")).count() == 0
    assert scan.scan_pages(spark, str(tmp_path / "none"), missing_ok=True).count() == 0
    (tmp_path / "x.cfg").write_bytes("甲=1\r\n乙=2\r".encode())
    (tmp_path / "y.cfg").write_bytes(b"\xff\xfe")
    found = {r["config_id"][-5:]: (r["content"], r["error"]) for r in scan.scan_configs(spark, f"{tmp_path}/*.cfg").collect()}
    assert found == {"x.cfg": ("甲=1\n乙=2\n", None), "y.cfg": ("", "not UTF-8")}
    assert scan.scan_configs(spark, f"{tmp_path}/*.none").count() == 0


def test_payload_sink(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.jpg", bytearray(b"1")), ("../b.jpg", bytearray(b"2")), ("c.jpg", None)], "output_name string, payload binary")
    payloads.write_payloads(rows, folder)
    assert {n: (tmp_path / "out" / n).read_bytes() for n in os.listdir(folder)} == {"a.jpg": b"1", "b.jpg": b"2", "c.jpg": b""}
    with pytest.raises(Exception, match="empty"):
        payloads.write_payloads(spark.createDataFrame([("d.jpg", bytearray(b"1")), ("", bytearray(b"2"))], "output_name string, payload binary").coalesce(1), folder)
    assert set(os.listdir(folder)) == {"a.jpg", "b.jpg", "c.jpg"}


def test_payload_runs_that_died(spark, tmp_path, monkeypatch):
    folder, settle = str(tmp_path / "out"), payloads._settle
    rows = spark.range(500).selectExpr("concat('p', id % 3) project", "concat(id, '.jpg') output_name", "cast(cast(id as string) as binary) payload")
    monkeypatch.setattr(payloads, "_settle", lambda *_: None)  # dies right after its commit
    payloads.write_payloads(rows, folder)
    run = next(os.scandir(folder)).path
    assert len(os.listdir(folder)) == 1
    manifest = sorted(n for n in os.listdir(run) if n.endswith(".manifest"))[0]
    with open(os.path.join(run, manifest)) as f:  # and a renaming task was killed halfway
        for part, name in [json.loads(x) for x in f][:20]:
            os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
            os.replace(os.path.join(run, part), os.path.join(folder, name))
    dead = os.path.join(folder, payloads.RUN + "dead")
    os.makedirs(dead)
    open(os.path.join(dead, "x-0.part"), "w").close()
    monkeypatch.setattr(payloads, "_settle", settle)
    payloads.recover_payloads(spark, folder)
    assert sorted(os.listdir(folder)) == ["p0", "p1", "p2"]
    found = {(r["project"], r["file_name"]) for r in folders.scan_folders(spark, folder, None).collect()}
    assert found == {(f"p{i % 3}", f"{i}.jpg") for i in range(500)}
    assert (tmp_path / "out" / "p1" / "301.jpg").read_bytes() == b"301"
    payloads.write_payload_table(rows, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).filter("project = 'p1'").count() == 167


def test_folders_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    for name in ("p/a.PNG", "p/.png", "p/b.txt", "q/c.jpg", "d.webp"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    (tmp_path / "q" / "sub.png").mkdir()
    found = folders.scan_folders(spark, str(tmp_path))
    assert {(r["project"], r["file_name"], r["length"], r["error"]) for r in found.collect()} == {("p", "a.PNG", 7, None), ("p", ".png", 6, None), ("q", "c.jpg", 7, None), (None, "d.webp", 6, None)}
    assert {r["file_name"] for r in found.filter("length > 6 and project = 'p'").collect()} == {"a.PNG"}
    reader = folders.FolderReader(str(tmp_path), None)
    at_most = folders.ds.LessThanOrEqual(("length",), 6)
    assert list(reader.pushFilters([at_most, folders.ds.EqualTo(("project",), "p")])) == [folders.ds.EqualTo(("project",), "p")]
    assert sorted(x[1] for x in reader.read(folders.Folders(["p"]))) == [".png"]
    assert list(folders.FolderReader(str(tmp_path), None).read(folders.Folders(["none"]))) == [("none", None, str(tmp_path / "none"), None, "FileNotFoundError")]
    monkeypatch.setattr(folders, "FOLDERS_PER_TASK", 1)
    assert [p.names for p in folders.FolderReader(str(tmp_path), None).partitions()] == [["", "p"], ["q"]]
    assert {tuple(r) for r in folders.scan_project_outputs(spark, str(tmp_path)).collect()} == {("p", "a.PNG"), ("p", ".png"), ("p", "b.txt"), ("q", "c.jpg"), (None, "d.webp")}


def test_plan_stream(spark, tmp_path):
    source, planned = str(tmp_path / "in"), []
    schema = "project string, file_name string, output_name string"
    spark.createDataFrame([("p", "a.png", "a.jpg"), ("p", "a.jpg", "a.jpg"), ("p", "b.png", "b.jpg")], schema).write.parquet(source)
    done = spark.createDataFrame([("p", "b.jpg")], "project string, output_name string")
    stream = spark.readStream.schema(schema).parquet(source)
    writer = plan_stream(stream, lambda: done, lambda df, _: planned.extend(r["file_name"] for r in df.collect()))
    writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert planned == ["a.jpg"]


def test_settings_files_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    from foliomill.sources import scan

    (tmp_path / "sub.cfg").mkdir()
    for name, content in (("a.cfg", b"x\r\ny"), ("b.cfg", b"\xff"), (".c.cfg", b"no"), ("d.txt", b"no"), ("sub.cfg/e", b"z"), ("f g%20.cfg", b"")):
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(scan, "_exists", lambda *_: pytest.fail("listed by the driver"))
    for start in ("", "file:"):
        found = scan.scan_configs(spark, f"{start}{tmp_path}/*.cfg").collect()
        assert {tuple(r) for r in found} == {(f"file:{tmp_path}/{n}", *x) for n, x in (("a.cfg", ("x\ny", None)), ("b.cfg", ("", "not UTF-8")), ("sub.cfg/e", ("z", None)), ("f g%20.cfg", ("", None)))}
    assert scan.scan_configs(spark, f"{tmp_path}/none/*.cfg").count() == 0
