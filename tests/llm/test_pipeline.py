import os
import random
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from foliomill.llm.queries import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture
def corpus(spark, tmp_path):
    """Prose, junk, exact copies and near copies from three sources."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("mor", "tel", "gra", "win", "sol") for b in ("an", "ei", "ou") for c in ("d", "st", "ng", "l")]
    rows, labels, kinds = [], [], {}
    for i in range(240):
        body = " ".join(rng.choice(words) for _ in range(rng.randint(150, 300)))
        kinds[i] = "junk" if i % 5 == 1 else "prose"
        rows.append((i, "%%% ".join(body.upper().split()) if i % 5 == 1 else body.capitalize() + ".", "en", f"s{i % 3}", len(body)))
        labels.append((i, int(i % 5 != 1), 0))
    prose = [r for r in rows if kinds[r[0]] == "prose"]
    for k, r in enumerate(prose[:30]):
        rows.append((1000 + k, r[1].upper() if k < 3 else r[1], "en", "s0", r[4]))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([*rows, (5000, None, None, None, None)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), rows, kinds, prose


def test_stages_take_effect_in_turn(spark, corpus):
    folder, rows, kinds, prose = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), name)
        assert docs.columns == columns
        left[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(left[name]) == len(set(left[name]))
    assert not [i for i in left["quality"] if kinds.get(i) == "junk"]
    assert {r[0] for r in prose} <= set(left["quality"])
    # Exact copies: the larger id stays (an upper-cased copy may have gone as junk).
    for k, r in enumerate(prose[:30]):
        if 1000 + k in left["quality"]:
            assert r[0] not in left["exact_dedup"] and 1000 + k in left["exact_dedup"]
    assert sorted(left["mixing"]) == sorted(left["simhash_dedup"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(left["mixing"])


def test_mixed_order_reaches_the_last_stage(spark, tmp_path):
    # The longest texts are in the last part file, which Spark reads first.
    rows = [(i, f"w{i} " * (400 if i % 7 > 1 else 2), "en", "big" if i % 7 > 1 else f"s{i % 7}", 1) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        expected = [r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, "").select("doc_id").collect()]
        stored = corpus_pipeline.materialise(corpus_pipeline.mixing_stage(spark, docs, ""), "mixed")
        assert len(stored.inputFiles()) > 1
        out = corpus_pipeline.tokens_stage(spark, stored, "").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["doc_id"] for r in out] == expected
    positions = [r["position"] for r in out]
    assert positions == sorted(set(positions))


def test_tokens_of_files_that_share_a_name(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, ids in (("a", range(0, 6)), ("b", range(10, 16)), ("a", range(20, 26))):
        spark.createDataFrame([(i, "w " * (i + 1), "en", "s", 1) for i in ids], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    docs = spark.read.parquet(str(tmp_path / "a")).union(spark.read.parquet(str(tmp_path / "b")))
    out = corpus_pipeline.tokens_stage(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == [(i, i + 1) for i in (*range(6), *range(10, 16), *range(20, 26))]
    assert [r["position"] for r in out] == list(range(18))
    twice = docs.union(docs)
    assert Counter(r["doc_id"] for r in corpus_pipeline.tokens_stage(spark, twice, "").collect()) == Counter({r["doc_id"]: 2 for r in out})


def test_repeated_and_null_ids(spark, corpus, tmp_path):
    folder, rows, kinds, prose = corpus
    by_text = {r[0]: r[1] for r in prose[:6]}
    a, b, c, *_ = by_text.values()
    odd = [(5, a), (5, a), (5, b), (9, b), (None, c), (None, c), (None, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact_stage(spark, docs, folder)
    assert exact.columns == docs.columns
    assert sorted(map(str, ((r[0], r[1]) for r in exact.collect()))) == sorted(map(str, [(5, a), (9, b), (None, c), (None, c + " more")]))
    near = corpus_pipeline.near_stage(spark, exact, folder)
    assert Counter(r[0] for r in near.collect()) == {5: 1, 9: 1, None: 1}
    # Each row is judged by its own text: junk goes and prose stays, whatever ids they share.
    junk = next(r[1] for r in rows if kinds[r[0]] == "junk")
    extra = [(7000, junk, "en", "s0", 1), (7000, a, "en", "s0", 1), (7000, a, "en", "s0", 1), (None, junk, "en", "s0", 1), (None, b, "en", "s0", 1)]
    whole = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 1000").union(spark.createDataFrame(extra, docs.schema))
    left = Counter((r[0], r[1]) for r in corpus_pipeline.quality_stage(spark, whole, folder).collect())
    assert left[7000, a] == 2 and left[None, b] == 1 and left[7000, junk] == left[None, junk] == 0


def test_empty_documents(spark, corpus, tmp_path):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, str(DATA))
    result = db.execute(ORACLE_SQL[name])
    there = [d[0] for d in result.description]
    assert sorted(there) == sorted(df.columns)
    rows = [tuple(r[c] for c in there) for r in df.collect()]
    assert sorted(rows) == sorted(result.fetchall())
