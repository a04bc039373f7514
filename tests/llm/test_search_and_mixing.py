import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.llm import ann, mixing

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], VECTORS)


@pytest.mark.parametrize("block", [8192, 40])
def test_nearest_agrees_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block // 4)
    monkeypatch.setattr(ann, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[40:120] = x[40]  # a very common vector
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    bad = [(400, None), (420, []), (440, [0.0] * 16), (460, [math.nan] * 16), (480, [math.inf] + [1.0] * 15), (None, [1.0] * 16), (500, [None] + [1.0] * 15), (520, [1.0, 2.0])]
    out = ann.nearest(vectors(spark, rows + bad), F.col("vec_id") % 20 == 0, k=7).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 300, 20))
    y = x.astype(float)
    for q, got in found.items():
        scores = (y * y[q]).sum(axis=1)
        order = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:7]
        assert [v for v, _ in got] == order
        assert np.allclose([s for _, s in got], scores[order], rtol=0, atol=1e-9)


def test_one_id_on_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 20)
    sizes, search = spark.sparkContext.accumulator(0), ann.search_cell
    rng = np.random.default_rng(4)
    rows = [(7 if i % 3 else i, [float(v) for v in rng.normal(size=4)]) for i in range(240)] + [(9, [1.0, 0.0, 0.0, 0.0])] * 60
    vectors_ = vectors(spark, rows)

    def watched(query_ids, q, ids, c, k):
        if len(ids) > 60:  # blocks of 20 on average
            sizes.add(1)
        return search(query_ids, q, ids, c, k)

    monkeypatch.setattr(ann, "search_cell", watched)
    out = ann.nearest(vectors_, F.col("vec_id") == 0, k=9).orderBy("rank").collect()
    q = np.array(rows[0][1])
    best = sorted(((float((np.array(v) * q).sum()), -i) for n, (i, v) in enumerate(rows) if i != 0), reverse=True)[:9]
    assert [r["vec_id"] for r in out] == [-i for _, i in best] and np.allclose([r["score"] for r in out], [s for s, _ in best])
    assert sizes.value == 0


def test_few_candidates_and_none(spark):
    out = ann.nearest(vectors(spark, [(0, [1.0]), (1, [2.0]), (1, [2.0]), (0, [3.0])]), F.col("vec_id") == 0, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 1, 2.0), (0, 2, 1, 2.0)]
    assert ann.nearest(vectors(spark, []), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(vectors(spark, [(1, [1.0])]), F.col("vec_id") == 0).count() == 0


def worst(slots, weights):
    """Largest distance of a source from its given share of the slots, in blocks, over all prefixes."""
    order, total, out = np.array([s for s, _ in slots]), sum(weights.values()), 0.0
    slot = np.arange(1, len(order) + 1)
    for s, w in weights.items():
        out = max(out, np.abs(np.cumsum(order == s) - slot * (w / total)).max())
    return out


def test_every_source_is_less_than_a_block_from_the_given_weight():
    rng = random.Random(3)
    many = {"big": 1.0} | {f"s{i}": 1e-6 for i in range(400)}
    families = [
        {"a": 2 / 3, "b": 1 / 3}, {f"s{i}": rng.randint(1, 10**6) ** 0.5 for i in range(20)}, many, {"a": 1.0, "b": 1e-9},
        {f"s{i}": 1.618**-i for i in range(40)}, {f"s{i}": 1 for i in range(7)}, {"only": 0.1},
    ]
    families += [{f"s{i}": rng.random() ** 3 for i in range(rng.randint(2, 30))} for _ in range(8)]
    for weights in families:
        n = 100_000 if len(weights) < 30 or weights is many else 20_000
        # So many blocks of each that none runs out before slot n.
        total = sum(weights.values())
        slots = mixing.schedule({s: int(n * w / total) + 3 for s, w in weights.items()}, weights)[:n]
        assert worst(slots, weights) < 1, weights
        done = Counter()
        for s, k in slots:
            assert k == done[s]
            done[s] += 1


def test_the_rest_go_on_when_a_source_runs_out():
    weights = {"a": 0.61, "b": 0.3, "c": 0.09}
    slots = mixing.schedule({"a": 50, "b": 5, "c": 70}, weights)
    assert Counter(s for s, _ in slots) == {"a": 50, "b": 5, "c": 70}
    end = max(i for i, (s, _) in enumerate(slots) if s == "b") + 1
    assert worst(slots[:end], weights) < 1
    later = slots[end : max(i for i, (s, _) in enumerate(slots) if s == "a") + 1]
    assert worst(later, {"a": 0.61, "c": 0.09}) < 1
    assert mixing.schedule({}, {}) == [] == mixing.schedule({"a": 0}, {"a": 1.0})


DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix_pos string, __s int, mix_source string, row_at long"


def test_mix_keeps_all_rows_and_follows_the_schedule(spark):
    rng = random.Random(2)
    sources = ["a"] * 700 + ["b"] * 150 + ["c"] * 90 + [None] * 40 + [""] * 20
    rng.shuffle(sources)
    docs = spark.createDataFrame([(i, "t", "l", s, 1, "x", 1, "y", 2) for i, s in enumerate(sources)] + [(None, "t", None, "a", None, None, None, None, None)] * 2, DOCS)
    weights = {"a": 2.0, "b": 1.0, "c": 1.0}
    out = mixing.mix(docs, weights, block_rows=8).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((i, s) for i, s in [*enumerate(sources), (None, "a"), (None, "a")])
    slots = {}
    for r in out:
        slots.setdefault(r["mix_slot"], set()).add((r["source"], r["mix_block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    assert len({(r["mix_slot"], r["mix_pos"]) for r in out}) == len(out) and max(r["mix_pos"] for r in out) == 7
    order = [next(iter(slots[i]))[0] for i in sorted(slots)]
    # Brute force: until c runs out (12 blocks), earliest deadline first among released blocks, slot by slot.
    done, share = Counter(), {"a": 4, "b": 2, "c": 2}
    for at, s in enumerate(order):
        if done["c"] == 12:
            break
        done[s] += 1
        assert all(abs(done[x] - (at + 1) * a / 8) < 1 for x, a in share.items())
    assert set(order[-8:]) <= {None, "", "a"} and order.index(None) > max(i for i, s in enumerate(order) if s in weights)
    assert {"__s", "mix_source", "row_at"} <= set(out[0].asDict()) and {(r["__s"], r["row_at"]) for r in out} == {(1, 2), (None, None)}
    again = {(r["doc_id"], r["mix_slot"], r["mix_pos"]) for r in mixing.mix(docs, weights, block_rows=8).collect() if r["doc_id"] is not None}
    assert again == {(r["doc_id"], r["mix_slot"], r["mix_pos"]) for r in out if r["doc_id"] is not None}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_order_has_the_columns_of_the_input(spark):
    docs = spark.createDataFrame([(i, "t", "l", f"s{i % 3}", 1) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.in_mixed_order(docs, block_rows=4)
    assert out.columns == docs.columns and out.count() == 500
    first = [r["source"] for r in out.limit(60).collect()]
    assert Counter(first)["s0"] in range(16, 25)


def test_mix_runs_no_python_on_executors(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
