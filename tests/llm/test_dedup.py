import hashlib
import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliomill.llm import components, exact_dedup, shared, simhash
from foliomill.llm.xxh import xxh64

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest string, fp string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "x", "y", "z") for i, t in rows], DOCS)


def lowered(text):
    return (text or "").encode().translate(bytes.maketrans(shared.UPPER.encode(), shared.UPPER.lower().encode()))


def test_exact_verdicts(spark):
    rows = [(1, "Ab É"), (5, "aB É"), (3, "ab é"), (4, None), (9, ""), (7, "x" * 300_000), (8, "X" * 300_000), (None, "n"), (2, "n"), (None, "alone")]
    out = exact_dedup.deduplicate_once(table(spark, rows)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(lowered(t)).hexdigest(), []).append(i)
    keep = {h: max([x for x in ids if x is not None], default=None) for h, ids in groups.items()}
    expected = sorted(((i, keep[h], len(groups[h]), i == keep[h], h) for i, t in rows for h in [hashlib.sha256(lowered(t)).hexdigest()]), key=str)
    assert sorted((tuple(r) for r in out), key=str) == expected


def test_index_carries_over_batches(spark, tmp_path):
    index = exact_dedup.create_index(spark, f"ix_{uuid.uuid4().hex}", str(tmp_path / "ix"), buckets=3)
    first = exact_dedup.deduplicate(table(spark, [(1, "a"), (2, "A"), (3, "b")]), index)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in first.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    second = exact_dedup.deduplicate(table(spark, [(10, "a"), (11, "c"), (12, "C")]), index)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in second.collect()} == {(10, 2, False), (11, 12, False), (12, 12, True)}
    again = exact_dedup.deduplicate(table(spark, [(11, "c"), (12, "C")]), index)
    assert {r["doc_id"] for r in again.filter("kept").collect()} == {12}
    assert spark.table(index).count() == 3
    assert exact_dedup.deduplicate(table(spark, []), index).count() == 0
    # Opened again by its files alone.
    other = exact_dedup.create_index(spark, f"ix_{uuid.uuid4().hex}", str(tmp_path / "ix"), buckets=3)
    assert spark.table(other).count() == 3


def test_the_index_is_read_once_and_without_a_shuffle(spark, tmp_path):
    index = exact_dedup.create_index(spark, f"ix_{uuid.uuid4().hex}", str(tmp_path / "ix"), buckets=3)
    for k in range(3):
        exact_dedup.deduplicate(table(spark, [(100 * k + i, f"t{i + k}") for i in range(50)]), index)
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, digest string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = exact_dedup.settle(rows, spark.table(index), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x)
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    # Of the shuffles, all are on the batch's side, which comes first.
    depth = {i: len(x) - len(x.lstrip(": +-*()0123456789")) for i, x in enumerate(lines)}
    chain, least = [], depth[scan]
    for i in range(scan - 1, join, -1):
        if depth[i] < least and not lines[i].lstrip().startswith(":"):
            chain.append(lines[i])
            least = depth[i]
    assert chain and not [x for x in chain if "Exchange" in x]
    assert plan.count("FileScan") == 1

    # Many appends, then one sorted file for each bucket; a digest that entered twice leaves its first id.
    exact_dedup._append(spark.table(index).limit(5).select("digest", (F.col("keep_id") + 1).alias("keep_id")), index)
    small = exact_dedup.compact(spark, index, f"ix_{uuid.uuid4().hex}", str(tmp_path / "small"))
    assert spark.table(small).count() == 52 == spark.table(index).select("digest").distinct().count()
    assert len(spark.table(small).inputFiles()) <= 3 < len(spark.table(index).inputFiles())
    again = exact_dedup.deduplicate(table(spark, [(7, "t0"), (8, "T1")]), small).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again} == {(7, 0, False), (8, 1, False)}


def test_repeated_rows_leave_one(spark, tmp_path):
    rows = [(5, "a"), (5, "a"), (5, "b"), (9, "B"), (None, "c"), (None, "C"), (None, "a"), (None, "")]
    table(spark, rows).write.parquet(str(tmp_path / "t"))
    docs, key = shared.with_row_key(spark.read.parquet(str(tmp_path / "t")).withColumnRenamed("lang", "row_at"))
    kept = docs.join(exact_dedup.distinct_rows(docs, key), key, "left_semi")
    assert sorted(map(str, ((r["doc_id"], r["text"].lower()) for r in kept.collect()))) == sorted(map(str, [(5, "a"), (9, "b"), (None, "c"), (None, "")]))


def test_large_classes_join_like_others(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    out = shared.join_classes(rows, classes, "k", "size", 5000)
    assert out.count() == 5000 and out.filter("k = 0 and size = 3000").count() == 3000


def test_xxh64_agrees_with_the_library():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8)
    starts = rng.integers(0, 15_000, 3000)
    ends = starts + np.r_[rng.integers(0, 90, 2990), rng.integers(500, 700, 10)]
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(starts, ends)]


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_covering_reaches_every_pair_within_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 400, dtype=np.int64)
    y = x.copy()
    for i in range(len(y)):
        for k in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1 << int(k)).view(np.int64)
    own, seen = {}, {}
    for into, fps in ((own, x), (seen, y)):
        for key, fp, owns in zip(*simhash.placements(fps)):
            if into is seen or owns:
                into.setdefault(fp, set()).add(key)
    assert all(own[a] & seen[b] for a, b in zip(x, y))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("members", [simhash.MEMBERS, 3])
def test_near_duplicates(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng = random.Random(2)
    words = [f"w{i}é" for i in range(400)]
    texts = [None, "", " \n\t", "one", "One", "two words", "x" * 5000]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    ids = list(range(100, 100 + len(texts)))
    out = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, list(zip(ids, texts)))).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [int(out[i]["fingerprint"], 16) for i in ids] == fps
    roots = brute_components(fps)
    low = {}
    for i, r in zip(ids, roots):
        low[r] = min(low.get(r, i), i)
    assert [out[i]["component_id"] for i in ids] == [low[r] for r in roots]
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    found = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {}
    for r in found:
        roots.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(51)), list(range(100, 140))]


def test_text_slices_keep_whole_texts():
    texts = pa.array(["abc", None, "", "d" * 50, "é"])
    got = []
    for _, _, data, offsets in shared.text_slices(texts, 10):
        got += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
    assert got == ["abc", "", "", "d" * 50, "é"]
    assert list(shared.text_slices(pa.array([], pa.string()))) == []


def test_ascii_lower_leaves_other_letters(spark):
    rows = spark.createDataFrame([("AÉz",), ("AZ",), (None,)], "t string")
    assert [r[0] for r in rows.select(shared.ascii_lower(F.col("t"))).collect()] == ["aÉz", "az", ""]


def five(text):
    w = lowered(text).split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("members", [simhash.WIDE_MEMBERS, 3])
def test_similar_rows_by_brute_force(spark, tmp_path, monkeypatch, members):
    monkeypatch.setattr(simhash, "WIDE_MEMBERS", members)
    monkeypatch.setattr(simhash, "GLANCE", 1 if members < simhash.FEW else simhash.GLANCE)
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("mor", "tel", "gra", "win", "sol", "ker") for b in ("an", "ei", "ou", "ist", "ul")]
    rows = []
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randint(120, 400))]
        rows.append((i, " ".join(body)))
        for share in (0.005, 0.01, 0.2, 0.03):  # words changed: similar by far, just so, not at all, or not quite
            other = [rng.choice(words) if rng.random() < share else w for w in body]
            rows.append((i + round(share * 200_000), " ".join(other).upper()))
    rows += [(90_000, None), (90_001, ""), (90_002, "one two"), (90_003, "one two"), (90_003, "one two"), (None, "one two")]
    table(spark, rows).write.parquet(str(tmp_path / "t"))
    docs, key = shared.with_row_key(spark.read.parquet(str(tmp_path / "t")))
    left = [r["doc_id"] for r in docs.join(simhash.similar_rows(docs, key), key, "left_semi").collect()]
    sets = {i: five(t) for i, t in rows[:600]}
    likeness = {}
    for i in range(120):
        for j in (i + 1000, i + 2000, i + 40_000):
            likeness[i, j] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    alike = [p for p, x in likeness.items() if x >= 0.8]
    assert len(alike) > 150 and sum(j not in left for _, j in alike) >= 0.95 * len(alike)
    assert set(range(120)) <= set(left)  # the smallest id of a group stays
    # Nothing goes without a row that stays and is as similar, and nothing near stays.
    stay = [i for i in left if i in sets]
    for j in set(sets) - set(stay):
        assert max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in stay) >= 0.8
    close = [x for n, i in enumerate(stay) for j in stay[n + 1 :] if (x := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.8]
    assert len(close) <= 0.05 * len(alike)
    assert sorted(i for i in left if i and i >= 90_000) == [90_000, 90_002] and len(left) == len(set(left))


def test_large_anchors_are_dealt_out_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = []
    for group in range(3):  # near copies that share most anchors
        body = [f"{group}w{rng.randrange(500)}" for _ in range(300)]
        for i in range(60):
            other = list(body)
            other[rng.randrange(300)] = f"new{i}"
            rows.append((1000 * group + i, " ".join(other)))
    table(spark, rows).write.parquet(str(tmp_path / "t"))
    docs, key = shared.with_row_key(spark.read.parquet(str(tmp_path / "t")))
    for members, glance in ((7, 1), (20, 2), (8_192, 16)):
        monkeypatch.setattr(simhash, "WIDE_MEMBERS", members)
        monkeypatch.setattr(simhash, "GLANCE", glance)
        monkeypatch.setattr(simhash, "AT_ONCE", 50)
        monkeypatch.setattr(simhash, "FEW", 4)
        monkeypatch.setattr(simhash, "SETTLED", 5)
        left = docs.join(simhash.similar_rows(docs, key), key, "left_semi").collect()
        assert sorted(r["doc_id"] for r in left) == [0, 1000, 2000]


def test_dense_anchor_finds_every_component():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    fps = base[rng.integers(0, 3, 700)]
    for row in fps:
        for bit in rng.choice(256, rng.integers(0, 30), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    ids = np.arange(700)
    a, b = simhash.near_edges(np.zeros(700, np.int64), ids, fps)
    near = simhash._apart(fps[:, None], fps[None]) <= simhash.WIDE_DISTANCE
    label = np.arange(700)
    for _ in range(20):
        label = np.where(near, label[None], 700).min(axis=1)
    root = np.arange(700)
    root[a] = b
    assert len(np.unique(label)) == 3 and all(len(np.unique(label[root == r])) == 1 for r in np.unique(root)) and len(np.unique(root)) == 3


def test_rows_of_a_stage_meet_the_index(spark):
    index = exact_dedup.create_index(spark, "stage_index", buckets=4)
    schema = "doc_id long, text string, k int"
    first = spark.createDataFrame([(1, "a", 0), (2, "A", 1), (2, "a", 2), (None, "c", 3)], schema)
    later = spark.createDataFrame([(9, "a", 4), (3, "b", 5), (None, "C", 6)], schema)
    assert sorted(r["k"] for r in exact_dedup.distinct_rows(first, ["k"], index).collect()) == [2, 3]
    assert [r["k"] for r in exact_dedup.distinct_rows(later, ["k"], index).collect()] == [5]
    assert spark.table(index).count() == 3
    before = {t.name for t in spark.catalog.listTables()}
    assert sorted(r["k"] for r in exact_dedup.distinct_rows(later, ["k"]).collect()) == [4, 5, 6]
    assert {t.name for t in spark.catalog.listTables()} == before
    spark.sql(f"DROP TABLE {index}")


def test_the_exact_stage_goes_by_an_index(spark, monkeypatch):
    import corpus_pipeline

    seen = []
    settle = exact_dedup.settle
    monkeypatch.setattr(exact_dedup, "settle", lambda rows, known, *more: seen.append(known.columns) or settle(rows, known, *more))
    docs = spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.exact_stage(spark, docs, "").collect()] == [2]
    assert seen == [["digest", "keep_id"]]
