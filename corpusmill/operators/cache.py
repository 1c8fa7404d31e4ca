"""Answer cache: lookup by the nearest question, and guarded upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .maintenance import upsert
from .vectors import dense_topk_asof

THRESHOLD = 0.95


def cache_lookup(nearest: DataFrame, entries: DataFrame, asked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """nearest(query_id, entry_id, similarity): the best entry of each question. It is a hit if it is similar enough and of the asked
    kb_version and model; the tests come after the choice, so a nearer entry of another model hides a valid one."""
    met = nearest.join(entries, "entry_id").join(asked.select("query_id", F.col("kb_version").alias("_v"), F.col("model").alias("_m")), "query_id")
    hit = (F.col("similarity") >= threshold) & (F.col("kb_version") == F.col("_v")) & (F.col("model") == F.col("_m"))
    return met.withColumn("hit", hit).drop("_v", "_m")


def cache_lookup_asof(entries: DataFrame, asked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """asked(query_id, embedding, ts, kb_version, model), entries(entry_id, embedding, ts, kb_version, model) -> query_id, entry_id, similarity, hit.

    Each question meets the nearest entry that was stored before it under its version and model, the smaller entry_id on ties; it is a hit if it is similar enough. A question
    without such an entry has a null entry and no hit. Null times, versions and models meet nothing. One scan of the entries, which are never moved.
    """
    same = ("kb_version", "model")
    near = dense_topk_asof(entries.withColumnRenamed("entry_id", "_id"), asked.withColumnRenamed("query_id", "_id"), 1, "_id", same=same)
    found = near.select(F.col("query_id").alias("_q"), F.col("_id").alias("entry_id"), "similarity")
    return asked.select("query_id").join(found, F.col("query_id") == F.col("_q"), "left").select("query_id", "entry_id", "similarity", F.coalesce(F.col("similarity") >= threshold, F.lit(False)).alias("hit"))


def cache_key(question: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(question), model), 256)


def exact_cache_key(question: Column, filters: Column) -> Column:
    """filters: a map; its entries count in the order of their keys."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(filters)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return F.sha2(F.concat_ws("|", F.lower(question), pairs), 256)


def cache_store(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with a question, an answer and citations replace or join the entries under their key."""
    good = answers.filter((F.trim("question") != "") & (F.trim("answer") != "") & (F.col("citations") > 0))
    keyed = good.withColumn("entry_id", cache_key(F.col("question"), F.col("model"))).dropDuplicates(["entry_id"])
    return upsert(entries, keyed.select(entries.columns), "entry_id")
