"""Merkle manifests, repair of conversations and packing against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliomill.llm import merkle, packing, repair
from foliomill.llm.queries import vocabulary


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(nodes, arity):
    """Digest of the top and, for each node, its (before, after) pairs."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a - a % arity
            run = nodes[lo : lo + arity]
            ways[i].append(("".join(run[: a - lo]), "".join(run[a - lo + 1 :])))
            at[i] = a // arity
        nodes = [sha(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], ways


@pytest.mark.parametrize(("arity", "levels"), [(2, 10), (2, 2), (3, 4), (5, 3)])
def test_manifest_by_brute_force(spark, monkeypatch, arity, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rng = random.Random(arity)
    rows = [(rng.choice([None, *range(30)]), rng.choice(["a", "b", None]), rng.choice(["en"] * 30 + ["de", "é", None, ""]), rng.choice([None, 1, 7]), rng.choice([None, "", "x é", "y" * 5000])) for _ in range(120)]
    rows += [(1000, None, "alone", None, None)] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(docs, fields, "lang", ["doc_id"], merkle.leaf_digest(*[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in fields]), arity)
    found = found.withColumns({"back": merkle.folded(F.col("leaf"), F.col("steps")), "other": merkle.folded(F.col("other_leaf"), F.col("steps"))})
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r)))
    tops, expected = {}, []
    for g, members in groups.items():
        leaves = [x for _, _, x in sorted(members)]
        tops[g] = climb(leaves, arity)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, up = climb([tops[g][0] for g in order], arity)
    for g, members in groups.items():
        for (there, i, leaf), way in zip(sorted(members), tops[g][1], strict=True):
            expected.append((i if there else None, leaf, tops[g][0], root, [*way, *up[order.index(g)]]))
    got = found.collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["steps"]]) for r in got), key=str) == sorted(expected, key=str)
    assert {r["back"] for r in got} == {root}
    assert all((r["other"] == root) == (r["other_leaf"] == r["leaf"]) for r in got)


def test_manifest_of_nothing_and_of_clashing_names(spark):
    schema = "doc_id long, lang string, text string"
    assert merkle.manifest(spark.createDataFrame([], schema), ["doc_id", "text"], "lang", ["doc_id"]).count() == 0
    rows = spark.createDataFrame([(1, "x", "n", "s", None), (2, "x", "m", "t", 3)], "node_at long, node_group string, node string, steps string, row_file int")
    found = merkle.build(rows, "node", "node_group", ["node_at"])
    assert found.columns == ["node_at", "node_group", "node", "row_file", "subroot", "root", "steps"]
    assert {(r["node_at"], r["root"], tuple(map(tuple, r["steps"]))) for r in found.collect()} == {(1, sha("n", "m"), (("", "m"),)), (2, sha("n", "m"), (("n", ""),))}
    one = merkle.build(rows.limit(1), "node", "node_group", ["node_at"]).first()
    assert one["steps"] == [] and one["root"] == one["subroot"] == one["node"]
    with pytest.raises(ValueError, match="children"):
        merkle.build(rows, "node", "node_group", ["node_at"], arity=1)


COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}


def brute_repair(rows):
    """(cost, audit, repaired) over every way to edit: rows of (role, text, must_go, truncated); the initials are a regular expression's."""
    best = (4 * len(rows), "D" * len(rows), [])

    def go(i, cost, audit, out, run):
        nonlocal best
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in out)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
            best = min(best, (cost, audit, out))
        if run < 2:
            for role in ("user", "assistant"):
                go(i, cost + 3, audit + "I", [*out, (role, "")], run + 1)
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            go(i + 1, cost + 4, audit + "D", out, 0)
            if not must_go:
                more = 3 * truncated
                if role[:1] and role[:1] in "sua":
                    go(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 3 + more, audit + "R", [*out, (new, text)], 0)

    go(0, 0, "", [], 0)
    return best


def expected_repair(rows):
    """The contract's row of a conversation from its rows (turn, role, text) in order."""
    seen, marked, faults = set(), [], []
    for _, role, text in rows:
        body = text.strip(repair.SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    roles = [r[:1] for _, r, _ in rows]
    cost, audit, out = brute_repair(marked)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def talks(rng, n, longest=5):
    rows = []
    for conv in [*range(n), None]:
        for turn in sorted(rng.sample(range(12), rng.randint(1, longest))):
            text = rng.choice(["Yes.", "No!", "é?", "open", " ", "", "\n\t", "Yes. ", "x" * 3000 + ".", None, "...", "!"])
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows


@pytest.mark.parametrize("chunk", [1024, 3])
def test_repair_by_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(repair, "PIECE_BYTES", 1)
    rows = [r for r in talks(random.Random(chunk), 60) if r[1] is not None]
    rows += [(1000, None, "user", "a."), (1000, None, "user", "a."), (1001, None, "assistant", None)]
    found = repair.Repair(spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, at int, chunk string"))
    got = {r["conv"]: tuple(r)[1:] for r in found.summary().collect()}
    sha256 = {r["conv"]: r["repaired_sha256"] for r in found.digests().collect()}
    by_conv: dict = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by_conv)
    lines: dict = {}
    for r in sorted(found.turns().collect(), key=lambda r: (r["chunk"], r["place"])):
        lines.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    for conv, mine in by_conv.items():
        mine = sorted(mine, key=lambda r: r[0] is not None and r[0])
        assert (*got[conv], sha256.get(conv, hashlib.sha256(b"").hexdigest())) == expected_repair(mine), (conv, mine)
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == expected_repair(mine)[-1]


def test_ties_take_the_least_audit():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 5))]
        moves = [(r[:1], go, cut) for r, _, go, cut in rows]
        segments = [repair._segment("c", k, True, [(k, k, *m[:1], m[1], False, m[2] and not m[1]) for m in [moves[k]]]) for k in range(len(rows))]
        plan = list(repair._plan(segments)) if segments else []
        cost, audit, _ = brute_repair(rows)
        assert not plan or (plan[-1][12], plan[-1][13], "".join(p[4] for p in plan)) == (cost, audit, audit)


def test_trails_with_colliding_hashes(monkeypatch):
    monkeypatch.setattr(repair, "_PRIME", 2)
    rng, trails, texts = random.Random(2), repair.Trails(), [""]
    for _ in range(300):
        parent = rng.randrange(max(0, len(texts) - 20), len(texts))
        text = "".join(rng.choice("DIKR") for _ in range(rng.randint(1, 4)))
        assert trails.add(parent, text) == len(texts)
        texts.append(texts[parent] + text)
    for _ in range(2000):
        a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert trails.string(a) == texts[a] and trails.less(a, b) == (texts[a] < texts[b])


def test_repair_of_a_hot_conversation_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 64)
    rows = [(1, i, rng_role, f"t{i // 3}.") for i, rng_role in enumerate(random.Random(1).choices(["user", "assistant", "system"], k=1500))]
    found = repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = repair.solve([(r[2][:1], (r[2], r[3]) in {(x[2], x[3]) for x in rows[max(0, i - 3) : i]}, False) for i, r in enumerate(rows)], 0)
    got = found.summary().first()
    assert got["cost"] <= min(x[0] for x in (whole[0], whole[3]) if x) + 6 and len(got["audit"].replace("I", "")) == 1500
    lines = [f"{r['role']}:{r['text']}" for r in sorted(found.turns().collect(), key=lambda r: (r["chunk"], r["place"]))]
    assert found.digests().first()["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    none = repair.Repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert none.summary().count() == none.digests().count() == none.turns().count() == 0


BYTES = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def check_packing(docs, library, pieces, capacity):
    """Every id in one piece, CRCs as the library's ids give them, sequences gapless and full but for powers of two; returns ids by sequence."""
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs}
    by_doc, by_sequence = {i: [] for i in ids}, {}
    for r in pieces:
        mine = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(mine) > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(mine, "<u4").tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], mine))
    for i, parts in by_doc.items():
        parts.sort()
        assert [s for s, _ in parts] == [0, *itertools.accumulate(n for _, n in parts)][:-1] and sum(n for _, n in parts) == len(ids[i])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    out = {}
    for s, parts in by_sequence.items():
        parts.sort(key=lambda p: p[0])
        assert [o for o, _ in parts] == [0, *itertools.accumulate(len(x) for _, x in parts)][:-1]
        out[s] = [x for _, p in parts for x in p]
        assert len(out[s]) == capacity or (len(out[s]) < capacity and len(out[s]).bit_count() == 1)
    assert sum(len(x) < capacity for x in out.values()) <= capacity.bit_length()
    return out


@pytest.mark.parametrize(("seed", "longest", "grain"), [(1, 300, 4), (2, 40, 4), (3, 63, 16), (4, 700, 1)])
def test_packing_by_brute_force(spark, monkeypatch, library, seed, longest, grain):
    monkeypatch.setattr(packing, "ROWS_PER_SPLIT", 8)
    monkeypatch.setattr(packing, "LINE_BLOCK", 100)
    rng = random.Random(seed)
    words = ["a", " the", "é", "\u4e2d", "  ", "\n", "<|endoftext|>", "\U0001f600", " x1", "'ll", "\x00"]
    docs = [(i, "".join(rng.choices(words, k=rng.randint(0, longest)))) for i in range(150)] + [(900, None), (901, "")]
    if seed == 1:
        docs.append((902, " \n" * 20_000 + "y" * 3_000))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"start": F.lit(1), "key_0": F.lit("x"), "row_at": F.lit(2)}).repartition(3)
    pieces = packing.pack(df, BYTES, capacity=64, grain=grain)
    check_packing(docs, library, pieces.collect(), 64)


def test_packed_sequences_hold_the_tokens(spark, tmp_path, library):
    docs = [(i, "some words " * (i % 90) + str(i)) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    pieces = packing.pack(df, BYTES, capacity=128, grain=4)
    expected = check_packing(docs, library, pieces.collect(), 128)
    assert {r["sequence_id"]: r["ids"] for r in packing.sequences(df, pieces, BYTES).collect()} == expected


def test_packing_of_equal_ids_and_of_nothing(spark):
    same = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x")], "doc_id long, text string")
    got = packing.pack(same, BYTES, capacity=8, grain=2).collect()
    assert sum(r["length"] for r in got) == 6 and {r["doc_tokens"] for r in got} == {2} and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(same.limit(0), BYTES).count() == 0
    with pytest.raises(ValueError, match="power"):
        packing.pack(same, BYTES, capacity=100)


def test_patterns_cover_all_items_with_few_copies():
    rng = np.random.default_rng(3)
    for units, classes, most in ((16, 16, 1000), (64, 40, 20), (128, 128, 100_000), (8, 1, 5), (128, 128, 2)):
        counts = np.zeros(units + 1, np.int64)
        counts[rng.choice(np.arange(1, units + 1), classes, replace=False)] = rng.integers(0, most, classes)
        found = packing.patterns(counts, units)
        width = np.arange(units + 1)
        assert all(c @ width <= units and n > 0 for c, n in found)
        assert (sum(c * n for c, n in found) == counts).all() if found else not counts.any()
        # No packing has fewer sequences than the items fill, or than there are items over half a sequence.
        least = max(-(-int(counts @ width) // units), int(counts[units // 2 + 1 :].sum()))
        assert sum(n for _, n in found) <= least * 1.02 + classes
    best = packing.patterns(np.array([0, 0, 0, 300, 300, 0, 0, 300, *[0] * 7]), 14)  # 3 + 4 + 7 fill a sequence
    assert sum(n for _, n in best) == 300
