"""The operators of this subpackage as queries over the tables, with production parameters."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, ctw, exact_dedup, langid, merkle, mixing, packing, pii, quality, repair, simhash, toxicity
from .shared import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; ``TOKENIZER_DIR`` overrides where it is looked for."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate_once(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = fold(F.col("doc_id"), 5) != 0
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn, threshold=0.3)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary(), digests=True)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(F.col("doc_id"), 5) != 0)
    return langid.identify(docs, model).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 10) == 0)


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = os.environ.get("SURROGATE_KEY", "").encode() or _RUN_KEY
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"), key)
    return found.select("doc_id", "text", "n_entities", F.to_json("kinds").alias("kinds"))


#: Without a key of the user's own, surrogates are those of this run alone.
_RUN_KEY = secrets.token_bytes(32)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_slot", "mix_pos")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, threshold=0.5)
    return scored.withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    # Tampering adds a character to the count of every seventh row.
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, 1).otherwise(0)
    tampered = merkle.leaf_digest(*[F.col(c) + more if c == "n_chars" else F.col(c) for c in fields])
    found = merkle.manifest(docs, fields, "lang", ["doc_id"], tampered)
    out = found.withColumn("folded_root", merkle.folded(F.col("other_leaf"), F.col("steps")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the rows after damage by crc32 of ``conv_id:turn`` (nulls: one space)."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    harm = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    changed = F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(harm == 0, F.array().cast("array<int>")).when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"), changed.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations")
    found = repair.Repair(damaged(talks))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    known = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    known += [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")]
    out = talks.select("conv_id").distinct()
    for part in (found.summary().withColumnRenamed("conv", "conv_a"), found.digests().withColumnRenamed("conv", "conv_b")):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(part.columns[0])), "left")
    return out.select("conv_id", *known)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_language": op4_language,
    "op5_context_tree": op5_context_tree,
    "op6_surrogates": op6_surrogates,
    "op7_nearest": op7_nearest,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_repair": op13_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH t AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
          FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    # The digests climb from level to level, then each leaf's siblings fold along its way.
    "op12_merkle": r"""
        WITH RECURSIVE polynomial AS (
          SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
                   CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
        d AS (
          SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
                   xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1]), 4294967295), 4294967295) % 7 = 0 AS hit
          FROM documents, polynomial),
        f AS (
          SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                 coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars + hit::INT AS m FROM d),
        l AS (
          SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                 sha256(head || coalesce(strlen(m::VARCHAR) || ':' || m, '-') || tail) AS other FROM f),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
        low AS (
          SELECT lang, 0 AS level, i, n, leaf AS h FROM placed
          UNION ALL
          SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, level, i // 2, n),
        sub AS (
          SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM low WHERE n = 1),
        high AS (
          SELECT 0 AS level, j, m, subroot AS h FROM sub
          UNION ALL
          SELECT level + 1, j // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM high WHERE m > 1 GROUP BY level, j // 2, m),
        way AS (
          SELECT p.doc_id, p.leaf, p.other, p.lang, p.i, p.n, s.subroot, s.j, s.m, 0 AS level, p.other AS fold, '' AS proof
          FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang
          UNION ALL
          SELECT w.doc_id, w.leaf, w.other, w.lang, w.i // 2, (w.n + 1) // 2, w.subroot, w.j, w.m, w.level + 1,
                 sha256(CASE WHEN w.i % 2 = 1 THEN x.h ELSE '' END || w.fold || CASE WHEN w.i % 2 = 0 THEN coalesce(x.h, '') ELSE '' END), w.proof || coalesce(x.h, '')
          FROM way w LEFT JOIN (SELECT * FROM low) x ON x.lang IS NOT DISTINCT FROM w.lang AND x.level = w.level AND x.i = xor(w.i, 1) WHERE w.n > 1),
        top AS (
          SELECT doc_id, leaf, subroot, j, m, 0 AS level, fold, proof FROM way WHERE n = 1
          UNION ALL
          SELECT t.doc_id, t.leaf, t.subroot, t.j // 2, (t.m + 1) // 2, t.level + 1,
                 sha256(CASE WHEN t.j % 2 = 1 THEN x.h ELSE '' END || t.fold || CASE WHEN t.j % 2 = 0 THEN coalesce(x.h, '') ELSE '' END), t.proof || coalesce(x.h, '')
          FROM top t LEFT JOIN (SELECT * FROM high) x ON x.level = t.level AND x.j = xor(t.j, 1) WHERE t.m > 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
        FROM top, (SELECT h AS root FROM high WHERE m = 1) WHERE top.m = 1
    """,
}
