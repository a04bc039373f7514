"""What runs again, what is never read twice, and glossaries that no pattern could hold."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomill.operators import apply, journal, settings, terms, textrules
from foliomill.plans import batch


def walk(text, glossary):
    """The one-pass rule, by trying every term at every place."""
    out, taken, at = [], [], 0
    while at < len(text):
        here = max((t for t in glossary if t and text.startswith(t, at)), key=len, default=None)
        if here is None:
            out.append(text[at])
            at += 1
        else:
            taken.append(here)
            out.append(glossary[here])
            at += len(here)
    return "".join(out), taken


@pytest.mark.parametrize("part_bytes", [1 << 20, 80])
def test_terms_by_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(terms, "PART_BYTES", part_bytes)
    rng = random.Random(part_bytes)
    letters = "abé😀 "
    glossary = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.choice(["", "a", "é😀", "zz"]) for _ in range(40)}
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(120)] + [None, ""]
    listed = spark.createDataFrame([*glossary.items(), ("", "x"), (None, "y")], "original string, translation string")
    df = spark.createDataFrame([(i, t, "old", 5) for i, t in enumerate(texts)], "id long, text string, replaced string, found int")
    got = {r["id"]: (r["replaced"], r["found"]) for r in textrules.apply_glossary(df, "text", listed).collect()}
    assert got == {i: (t if t is None else walk(t, glossary)[0], 5) for i, t in enumerate(texts)}
    seen = {r["original"]: (r["rows"], r["occurrences"]) for r in textrules.glossary_coverage(df, "text", listed).collect()}
    hits = [walk(t, glossary)[1] for t in texts if t]
    assert seen == {t: (sum(t in h for h in hits), sum(h.count(t) for h in hits)) for t in glossary}
    pairs = [(i, t, rng.choice([t, "zz a", None, ""])) for i, t in enumerate(texts)]
    bad = {tuple(r) for r in textrules.glossary_violations(spark.createDataFrame(pairs, "id long, source string, target string"), listed).collect()}
    assert bad == {
        (i, o, t, t not in target, o in target)
        for i, source, target in pairs if source and target is not None
        for o, t in glossary.items() if o in source and (t not in target or o in target)
    }


def test_a_hundred_thousand_terms(spark):
    many = {f"term{i}x": f"<{i}>" for i in range(100_000)}
    rows = spark.createDataFrame([(1, "a term7x and term99999x, term100000x"), (2, None)], "id long, text string")
    assert [r["replaced"] for r in textrules.apply_glossary(rows, "text", many).orderBy("id").collect()] == ["a <7> and <99999>, term100000x", None]
    few = {"a": "b", "": "never"}
    assert textrules.apply_glossary(rows, "text", few).orderBy("id").first()["replaced"] == "b term7x bnd term99999x, term100000x"
    assert textrules.apply_glossary(rows, "text", spark.createDataFrame([], "original string, translation string")).filter("replaced <=> text").count() == 2


def caller(folder, fails=()):
    """A function whose calls leave a mark each."""

    def make():
        def call(row):
            with open(os.path.join(folder, f"{row['k']}.calls"), "a") as f:
                f.write("x")
            if row["k"] in fails:
                raise ValueError(f"no {row['k']}")
            return f"r{row['k']}"

        return call

    return make


def calls(folder):
    return {int(n.split(".")[0]): os.path.getsize(os.path.join(folder, n)) for n in os.listdir(folder) if n.endswith(".calls")}


def test_a_call_is_paid_once(spark, tmp_path):
    log, marks = str(tmp_path / "journal"), str(tmp_path)
    df = spark.range(20).select((F.col("id") % 15).alias("k"), F.col("id").alias("journal_body"), F.lit("x").alias("status"))
    out = journal.apply_pages_once(df, caller(marks, {3}), ["k"], log, tasks=3)
    assert out.columns == ["k", "journal_body", "body", "status", "error"]
    first = sorted(map(tuple, out.collect()))
    assert sorted(map(tuple, out.collect())) == first  # a second action
    assert {(k, s, e) for k, _, _, s, e in first} == {(k, *(("failed", "no 3") if k == 3 else ("success", None))) for k in range(15)}
    assert calls(marks) == dict.fromkeys(range(15), 1)
    # A later run pays for what is new and what failed; a line that was cut off counts for nothing.
    with open(os.path.join(log, "torn-0.jsonl"), "w") as f:
        f.write('{"digest": "ab')
    more = spark.range(17).select(F.col("id").alias("k"))
    again = journal.apply_pages_once(more, caller(marks), ["k"], log)
    assert {(r["k"], r["body"], r["status"]) for r in again.collect()} == {(k, f"r{k}", "success") for k in range(17)}
    assert calls(marks) == dict.fromkeys(range(17), 1) | {3: 2}
    journal.compact_journal(spark, log, 2)
    assert journal.read_journal(spark, log).count() == 17 and len([n for n in os.listdir(log) if n.endswith(".jsonl")]) <= 2
    assert journal.apply_pages_once(more, caller(marks), ["k"], log).count() == 17 and sum(calls(marks).values()) == 18
    assert journal.apply_pages_once(more.limit(1), caller(marks), ["k"], log, label="other").collect()[0]["body"] == "r0" and sum(calls(marks).values()) == 19


def test_a_killed_task_goes_on_where_it_was(spark, tmp_path):
    log, marks = str(tmp_path / "journal"), str(tmp_path)

    marked = caller(marks)

    def make():
        call = marked()

        def once(row):
            if row["k"] == 5 and not os.path.exists(os.path.join(marks, "died")):
                open(os.path.join(marks, "died"), "w").close()
                os._exit(1)
            return call(row)

        return once

    df = spark.range(12).select(F.col("id").alias("k"))
    out = journal.apply_pages_once(df, make, ["k"], log, tasks=1)
    try:
        got = out.collect()
    except Exception:  # a local session does not run a task again: the next run does
        got = journal.apply_pages_once(df, make, ["k"], log, tasks=1).collect()
    assert {r["body"] for r in got} == {f"r{k}" for k in range(12)}
    assert calls(marks) == dict.fromkeys(range(12), 1)


def test_waves_go_on_to_the_next_page(spark, tmp_path):
    rows = [("p", "a.png", "a"), ("p", "a.jpg", "a"), ("p", "a.webp", "a"), ("p", "b.png", "b"), (None, "c.png", "c"), (None, "c.jpg", "c"), ("q", "a.jpg", "a"), ("q", None, "a")]
    plan = spark.createDataFrame(rows, "project string, file_name string, output_name string").withColumn("status", F.lit("old"))
    fails = {"a.jpg", "c.png", "c.jpg"}
    ok = F.when(F.coalesce(F.col("file_name"), F.lit("")).isin(*fails), "failed").otherwise("success")
    found = batch.run_in_waves(plan, lambda wave: wave.withColumns({"status": ok, "body": F.lit("x")}))
    assert found.columns == ["project", "file_name", "output_name", "status", "body"]
    assert sorted(map(str, found.select("project", "file_name", "status", "body").collect())) == sorted(
        str(r) for r in spark.createDataFrame(
            [("p", "a.jpg", "failed", "x"), ("p", "a.png", "success", "x"), ("p", "a.webp", "skip", None), ("p", "b.png", "success", "x"), (None, "c.jpg", "failed", "x"),
             (None, "c.png", "failed", "x"), ("q", "a.jpg", "failed", "x"), ("q", None, "success", "x")], "project string, file_name string, status string, body string",
        ).collect()
    )
    assert batch.run_in_waves(plan.limit(0), lambda wave: wave.withColumn("status", ok)).count() == 0
    real = batch.run_in_waves(plan, lambda wave: apply.apply_pages(wave, lambda: lambda row: row["file_name"], ["file_name"]))
    assert real.filter("status = 'success'").count() == 4 and real.filter("status = 'skip'").count() == 4


def test_finished_pages_without_a_project_and_clashing_names(spark):
    plan = spark.createDataFrame([(None, "1.jpg", 1), ("p", "1.jpg", 2), ("p", None, 3)], "project string, output_name string, finished_0 int").withColumn("finished", F.lit(0))
    done = spark.createDataFrame([(None, "1.jpg"), ("p", None)], "project string, output_name string")
    assert [r["finished_0"] for r in batch.skip_existing(plan, done).collect()] == [2]
    assert {(r["finished_0"], r["action"]) for r in batch.skip_existing(plan, done, mark=True).collect()} == {(1, "skip"), (2, "run"), (3, "skip")}
    rows = spark.createDataFrame([("p", "a", 1, True, "s", "f"), ("p", "a", 2, True, "s", "f")], "project string, output_name string, seq int, ok boolean, settled_0 string, settled_first string")
    assert [r["status"] for r in batch.settle_collisions(rows).orderBy("seq").collect()] == ["success", "skip"]


def test_tally_while_writing(spark, tmp_path):
    rows = spark.createDataFrame([("success",), ("skip",), ("failed",), (None,), ("success",)], "status string")
    assert batch.store_with_tally(rows, str(tmp_path / "r")) == {"total": 5, "success": 2, "skip": 1, "failed": 2}
    assert spark.read.parquet(str(tmp_path / "r")).count() == 5
    assert batch.store_with_tally(rows.limit(0), str(tmp_path / "n")) == {"total": 0, "success": 0, "skip": 0, "failed": 0}


LOG = "user string, seq int, op string, key string, value string, mapping map<string,string>"


def test_any_stretches_of_the_log_come_to_the_same(spark, tmp_path):
    rng, log = random.Random(7), []
    for i in range(160):
        op = rng.choice(["add"] * 6 + ["remove"] * 3 + ["replace", "clear", "setGlobalPrompt", "setApiKey"])
        log.append((rng.choice(["u", "v", None]), i, op, rng.choice(["a", "b", "c", None]), rng.choice([str(i), "", None]), {"b": "y", "c": "x"} if op == "replace" else None))
    whole = [sorted(map(str, x.select(sorted(x.columns)).collect())) for x in settings.fold_settings(spark.createDataFrame(log, LOG))]
    cuts = sorted(rng.sample(range(1, 160), 3))
    parts = [spark.createDataFrame(log[a:b], LOG) for a, b in zip([0, *cuts], [*cuts, 160], strict=True)]

    def same(state):
        assert [sorted(map(str, x.select(sorted(x.columns)).collect())) for x in settings.settings_of(state)] == whole

    same(settings.log_state(spark.createDataFrame(log, LOG)))
    a, b, c, d = map(settings.log_state, parts)
    same(settings.merge_states(settings.merge_states(a, b), settings.merge_states(c, d)))
    state, before = None, None
    for i, part in enumerate(parts):
        state = settings.advance_snapshot(part, before, str(tmp_path / str(i)))
        before = str(tmp_path / str(i))
    same(state)
    assert "LocalTableScan" not in state[1]._jdf.queryExecution().toString()  # what is left to read is the snapshot


def test_a_stream_holds_waiting_pages(spark, tmp_path):
    from foliomill.streaming import waves

    rows = [("p", "a", "1.png"), ("p", "a", "2.png"), ("p", "a", "3.png"), ("p", "b", "1.jpg"), (None, "a", "x"), ("p", "c", "1"), ("p", "c", "2")]
    pages = spark.createDataFrame(rows, "project string, output_name string, file_name string")
    ok = F.when(F.concat("output_name", "file_name").isin("a1.png", "c1", "c2"), "failed").otherwise("success")
    died: list = []

    def apply_(wave):
        if not died and wave.filter("file_name = '2.png'").count():
            died.append(1)
            raise RuntimeError("driver lost")
        return wave.withColumn("status", ok)

    folder = str(tmp_path / "w")
    with pytest.raises(Exception, match="driver lost"):
        waves.run_waves(pages, apply_, folder)
    found = waves.run_waves(pages, apply_, folder)
    assert sorted(map(str, (tuple(r) for r in found.select("project", "output_name", "file_name", "status").collect()))) == sorted(
        map(str, [("p", "a", "1.png", "failed"), ("p", "a", "2.png", "success"), ("p", "a", "3.png", "skip"), ("p", "b", "1.jpg", "success"), (None, "a", "x", "success"), ("p", "c", "1", "failed"), ("p", "c", "2", "failed")])
    )


def test_finished_index_is_joined_where_it_lies(spark):
    from foliomill.plans.finished import FinishedIndex

    index = FinishedIndex(spark, "finished_test", buckets=4)
    schema = "project string, output_name string"
    index.add(spark.createDataFrame([(None, "1"), ("p", "1"), ("p", "1")], schema))
    index.add(spark.createDataFrame([("p", "1"), ("", "1"), ("q", None)], schema))
    assert spark.table("finished_test").count() == 4
    plan = spark.createDataFrame([(None, "1", 0), ("p", "1", 1), ("p", "2", 2), ("", "1", 3), ("q", None, 4), ("q", "", 5), (None, None, 6)], schema + ", name_key int")
    for _ in range(2):
        left = index.skip_existing(plan)
        text = left._jdf.queryExecution().executedPlan().toString()
        assert left.columns == plan.columns and sorted(r["name_key"] for r in left.collect()) == [2, 5, 6]
        assert "SortMergeJoin" in text and text.count("Exchange") == 1, text
        index.compact()
    spark.sql("DROP TABLE finished_test")


def test_batch_files_are_never_over_the_limit(spark, monkeypatch):
    from foliomill.operators import prompts

    monkeypatch.setattr(prompts, "ROWS_PER_BLOCK", 7)
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 50), "old") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, line string, file string").repartition(5)
    found = prompts.batch_files(df, F.octet_length("line"), 300, ["id"]).orderBy("id").collect()
    assert [r["id"] for r in found] == list(range(600))
    sizes: dict = {}
    for r in found:
        sizes[r["file"]] = sizes.get(r["file"], 0) + len(r["line"])
    assert list(sizes) == sorted(sizes) and max(sizes.values()) <= 300
    assert len(sizes) <= sum(sizes.values()) / 251 + 1
    with pytest.raises(ValueError, match="bytes"):
        prompts.batch_files(df, F.octet_length("line"), 20, ["id"])
    assert prompts.batch_files(df.limit(0), F.octet_length("line"), 20, ["id"]).count() == 0


@pytest.mark.parametrize("run", ["apply_glossary", "glossary_coverage"])
def test_more_terms_take_no_more_workers(spark, monkeypatch, run):
    monkeypatch.setattr(terms, "PART_BYTES", 20)
    rows = spark.createDataFrame([(1, "xx term7 term11"), (2, None)], "id long, text string")
    steps = set()
    for n in (10, 100):
        many = spark.createDataFrame([(f"term{i}", f"<{i}>") for i in range(n)], "original string, translation string")
        plan = getattr(textrules, run)(rows, "text", many)._jdf.queryExecution().optimizedPlan().toString()
        steps.add(plan.count("MapInArrow"))
    # No worker holds the terms: what they find is joined.
    assert len(steps) == 1 and max(steps) <= 2 and "Join" in plan


def test_coverage_moves_numbers_and_reads_the_glossary_once(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART_BYTES", 20)
    many = spark.createDataFrame([(f"term{i}",) for i in range(30)] + [("",), (None,), ("term7",)], "original string")
    rows = spark.createDataFrame([(1, "term7 term11 term7"), (2, None), (3, "term1 term7")], "id long, text string")
    found = textrules.glossary_coverage(rows, "text", many)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    listed = next(line for line in plan.splitlines() if "struct(at" in line)
    assert "number" in listed and "original" not in listed and "LogicalRDD" not in plan and "LocalRelation" not in plan
    seen = {r["original"]: (r["rows"], r["occurrences"]) for r in found.collect()}
    assert seen == {f"term{i}": (0, 0) for i in range(30)} | {"term7": (2, 3), "term11": (1, 1), "term1": (1, 1)}


def test_found_runs_are_passed_on_in_pieces(monkeypatch):
    monkeypatch.setattr(terms, "RUN_BYTES", 100)
    length = np.r_[np.arange(1, 60), 500, 1, 99, 100, 3]  # terms within terms, and one longer than a piece
    runs = [np.arange(len(length)), np.arange(len(length)) * 2, length]
    pieces = list(terms._pieces(*runs))
    assert all(x.sum() <= 100 or len(x) == 1 for _, _, x in pieces)
    assert all((np.concatenate(x) == whole).all() for x, whole in zip(zip(*pieces), runs, strict=True))
    assert list(terms._pieces(*(x[:0] for x in runs))) == []


def test_sums_of_a_batch_by_brute_force():
    rng = random.Random(5)
    kind = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("number", pa.int64())]))
    for skip in [0, 1] * 300:
        rows = [[{"at": a, "length": n, "number": rng.randint(0, 3)} for a, n in sorted({(rng.randint(0, 12), rng.randint(1, 5)) for _ in range(rng.randint(0, 9))})] for _ in range(rng.randint(skip, 4))]
        wanted = {}
        for row in rows[skip:]:
            here = [x["number"] for _, _, x in terms.one_pass({x["at"]: (x["length"], x) for x in row})]
            for n in set(here):
                times = wanted.get(n, (0, 0))
                wanted[n] = (times[0] + 1, times[1] + here.count(n))
        got = terms._sums(pa.array(rows, kind).slice(skip))
        assert {n: (r, k) for n, r, k in zip(*(x.tolist() for x in got), strict=True)} == wanted


def test_settings_do_not_move_rows_or_make_tables_for_each_piece(spark, monkeypatch):
    glossary = spark.createDataFrame([("x", "a.", "<1>"), ("x", "a", "<2>"), ("y", "b]", "<3>"), (None, "c", "no")], "config_id string, original string, translation string")
    rows = [(1, "x", "a.ab]"), (2, "y", "a.ab]"), (3, None, "cab"), (4, "z", "a"), (5, "x", None)]
    df = spark.createDataFrame(rows, "id int, config_id string, text string")
    wanted = {1: "<1><2>b]", 2: "a.a<3>", 3: "cab", 4: "a", 5: None}
    small = textrules.apply_glossaries(df, "text", glossary)
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "map_from_entries" not in plan
    assert {r["id"]: r["replaced"] for r in small.collect()} == wanted
    monkeypatch.setattr(terms, "PART_BYTES", 0)
    large = textrules.apply_glossaries(df, "text", glossary)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "map_from_entries" not in plan
    assert {r["id"]: r["replaced"] for r in large.collect()} == wanted


def test_violations_by_setting_do_not_copy_texts(spark, monkeypatch):
    glossary = spark.createDataFrame([("x", "a", "<2>"), ("x", "b", "<b>"), ("y", "a", "c")], "config_id string, original string, translation string")
    rows = [(1, "x", "ab", "<2>b"), (2, "y", "aa", "c"), (3, None, "a", "a"), (4, "x", "b", None), (5, "y", "a", "")]
    pairs = spark.createDataFrame(rows, "id int, config_id string, source string, target string")
    for size in (1 << 20, 0):
        monkeypatch.setattr(terms, "PART_BYTES", size)
        bad = textrules.glossary_violations(pairs, glossary, "config_id")
        assert {tuple(r) for r in bad.collect()} == {(1, "b", "<b>", True, True), (5, "a", "c", True, False)}
        copied = next(line for line in bad._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line)
        assert "source#" not in copied and "target#" not in copied.split("explode")[0]


def test_an_output_of_one_page_costs_few_calls_to_state():
    import pandas as pd

    from foliomill.streaming import waves

    class State:
        def __init__(self):
            self.value, self.map, self.calls = None, {}, 0

        def __getattr__(self, name):
            self.calls += 1
            return {
                "get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v), "clear": lambda: (setattr(self, "value", None), self.map.clear()),
                "keys": lambda: iter(list(self.map)), "updateValue": self.map.__setitem__, "removeKey": self.map.pop,
            }[name]

    made = []

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            made.append(State())
            return made[-1]

        getMapState = getValueState  # noqa: N815

    def run(w, *events):
        return [tuple(r)[2:] for x in w.handleInputRows(("p", "a"), iter([pd.DataFrame(events, columns=["file_name", "kind"])]), None) for r in x.itertuples(index=False)]

    one = waves.Waves()
    one.init(Handle())
    assert run(one, ("1", "page")) == [("1", "run")] and run(one, ("1", "success")) == []
    assert sum(s.calls for s in made) <= 4
    more = waves.Waves()
    more.init(Handle())
    assert run(more, ("2", "page"), ("1", "page"), ("3", "page")) == [("1", "run")]
    assert run(more, ("0", "page"), ("1", "failed"), ("1", "failed")) == [("0", "run")]
    assert run(more, ("0", "failed")) == [("2", "run")] and run(more, ("3", "page")) == []
    assert run(more, ("2", "success"), ("9", "page")) == [("9", "skip"), ("3", "skip")]
    assert run(more, ("4", "page")) == [("4", "skip")]
