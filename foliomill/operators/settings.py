"""Saved settings: JSON over defaults, and the state that a log of changes leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETTINGS = "apiKey string, nameMapping map<string,string>, globalPrompt string"


def load_settings(df: DataFrame, json_col: str = "json") -> DataFrame:
    """name_mapping, global_prompt and has_key of the JSON text, over the defaults ({}, '', no key).

    A key that is present and null wins over its default; text that is no JSON object
    gives the defaults.  The secret itself is not kept.
    """
    text = F.col(json_col)
    keys = F.json_object_keys(text)
    parsed = F.from_json(text, SETTINGS, {"mode": "PERMISSIVE"})
    usable = keys.isNotNull()

    def present(name: str) -> Column:
        return F.coalesce(usable & F.array_contains(keys, name), F.lit(False))

    empty = F.create_map().cast("map<string,string>")
    return df.withColumns(
        {
            "name_mapping": F.when(present("nameMapping"), parsed["nameMapping"]).otherwise(empty),
            "global_prompt": F.when(present("globalPrompt"), parsed["globalPrompt"]).otherwise(""),
            "has_key": F.coalesce(F.when(present("apiKey"), parsed["apiKey"] != "").otherwise(F.lit(False)), F.lit(False)),
        }
    )


def fold_settings(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State after a log of (user, seq, op, key, value, mapping).

    ops: setApiKey, setGlobalPrompt (value), add (key, value), remove (key), replace
    (mapping), clear.  Returns pairs (user, key, value, pos: place of first addition
    since the last reset) and scalars (user, global_prompt, has_key).

    The last reset of a user and the last removal of a key are pre-aggregated and joined
    back, so the log of a user, or of a key, is never gathered.
    """
    resets = log.filter(F.col("op").isin("clear", "replace")).groupBy(F.col("user").alias("reset_user")).agg(F.max("seq").alias("reset"))
    since = log.join(resets, F.col("user").eqNullSafe(F.col("reset_user")), "left")
    live = since.filter(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    single = live.filter(F.col("op").isin("add", "remove")).select("user", "seq", F.lit(0).alias("i"), "op", "key", "value")
    many = live.filter("op = 'replace'").select("user", "seq", F.posexplode("mapping").alias("i", "key", "value"))
    acts = single.unionByName(many.withColumn("op", F.lit("add")))
    gone = acts.filter("op = 'remove'").groupBy(F.col("user").alias("gone_user"), F.col("key").alias("gone_key")).agg(F.max("seq").alias("removed"))
    same = F.col("user").eqNullSafe(F.col("gone_user")) & F.col("key").eqNullSafe(F.col("gone_key"))
    adds = acts.filter("op = 'add'").join(gone, same, "left").filter(F.col("removed").isNull() | (F.col("seq") > F.col("removed")))
    place = F.struct("seq", "i")
    pairs = adds.groupBy("user", "key").agg(F.max_by("value", place).alias("value"), F.min(place).alias("pos"))
    scalars = log.groupBy("user").agg(
        F.coalesce(F.max_by("value", F.when(F.col("op") == "setGlobalPrompt", F.col("seq"))), F.lit("")).alias("global_prompt"),
        (F.coalesce(F.max_by("value", F.when(F.col("op") == "setApiKey", F.col("seq"))), F.lit("")) != "").alias("has_key"),
    )
    return pairs, scalars


def log_state(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a stretch of the log of ``fold_settings`` comes to: (of users, of keys), to be merged with what came before.

    Users: (user, reset, prompt, api_key); keys: (user, key, removed: its last removal,
    first: place of the first addition after that and the user's last reset, last and value).
    """
    users = log.groupBy("user").agg(
        F.max(F.when(F.col("op").isin("clear", "replace"), F.col("seq"))).alias("reset"),
        F.max(F.when(F.col("op") == "setGlobalPrompt", F.struct("seq", "value"))).alias("prompt"),
        F.max(F.when(F.col("op") == "setApiKey", F.struct("seq", "value"))).alias("api_key"),
    )
    resets = users.filter("reset is not null").select(F.col("user").alias("reset_user"), "reset")
    since = log.join(resets, F.col("user").eqNullSafe(F.col("reset_user")), "left").filter("reset is null or seq >= reset")
    single = since.filter(F.col("op").isin("add", "remove")).select("user", "seq", F.lit(0).alias("i"), "op", "key", "value")
    many = since.filter("op = 'replace'").select("user", "seq", F.posexplode("mapping").alias("i", "key", "value"))
    acts = single.unionByName(many.withColumn("op", F.lit("add")))
    gone = acts.filter("op = 'remove'").groupBy(F.col("user").alias("gone_user"), F.col("key").alias("gone_key")).agg(F.max("seq").alias("removed"))
    same = F.col("user").eqNullSafe(F.col("gone_user")) & F.col("key").eqNullSafe(F.col("gone_key"))
    live = acts.join(gone, same, "left").withColumn("lives", (F.col("op") == "add") & (F.col("removed").isNull() | (F.col("seq") > F.col("removed"))))
    place = F.when(F.col("lives"), F.struct("seq", "i"))
    keys = live.groupBy("user", "key").agg(
        F.max("removed").alias("removed"), F.min(place).alias("first"), F.max(place).alias("last"), F.max_by("value", place).alias("value")
    )
    return users, keys


def merge_states(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The state of two stretches of a log, all of ``old`` before all of ``new`` for each user.

    It is the state of the joined stretch, so stretches may be merged in any grouping.
    """
    users = old[0].unionByName(new[0]).groupBy("user").agg(F.max("reset").alias("reset"), F.max("prompt").alias("prompt"), F.max("api_key").alias("api_key"))
    resets = new[0].filter("reset is not null").select(F.col("user").alias("reset_user"))
    stay = old[1].join(resets, F.col("user").eqNullSafe(F.col("reset_user")), "left_anti")
    both = stay.withColumn("era", F.lit(0)).unionByName(new[1].withColumn("era", F.lit(1)))
    # A removal in the later stretch ends what the earlier one held.
    cut = F.max(F.when(F.col("era") == 1, F.col("removed")))
    held, added = (F.max(F.when(F.col("era") == e, F.struct("first", "last", "value"))) for e in (0, 1))
    keys = both.groupBy("user", "key").agg(F.max("removed").alias("removed"), cut.alias("cut"), held.alias("held"), added.alias("added"))
    live = F.col("cut").isNull()
    return users, keys.select(
        "user", "key", "removed",
        F.coalesce(F.when(live, F.col("held.first")), F.col("added.first")).alias("first"),
        F.coalesce(F.col("added.last"), F.when(live, F.col("held.last"))).alias("last"),
        F.when(F.col("added.last").isNotNull(), F.col("added.value")).otherwise(F.when(live, F.col("held.value"))).alias("value"),
    )


def settings_of(state: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pairs and scalars of a state, as ``fold_settings`` gives them for the whole log."""
    pairs = state[1].filter("first is not null").select("user", "key", "value", F.col("first").alias("pos"))
    scalars = state[0].select(
        "user", F.coalesce("prompt.value", F.lit("")).alias("global_prompt"), (F.coalesce("api_key.value", F.lit("")) != "").alias("has_key")
    )
    return pairs, scalars


def advance_snapshot(log: DataFrame, snapshot: str | None, to: str) -> tuple[DataFrame, DataFrame]:
    """The state after ``log`` on top of the one stored in ``snapshot`` (none: the beginning), stored in the new folder ``to``.

    Only new entries of the log are read; the old ones live on in the snapshot, which has a row for each user and key.
    """
    spark = log.sparkSession
    state = log_state(log)
    if snapshot:
        state = merge_states(tuple(spark.read.parquet(f"{snapshot}/{x}") for x in ("users", "keys")), state)
    for df, name in zip(state, ("users", "keys"), strict=True):
        df.write.parquet(f"{to}/{name}")
    return tuple(spark.read.parquet(f"{to}/{x}") for x in ("users", "keys"))
