"""Index tables: change detection, upserts, deletes, consistency and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incremental_changes(current: DataFrame, indexed: DataFrame, key: str, digest: str = "content_hash") -> DataFrame:
    """current with change: new, changed or unchanged against the indexed (key, digest)."""
    old = indexed.select(F.col(key).alias("_k"), F.col(digest).alias("_old"))
    change = F.when(F.col("_k").isNull(), "new").when(F.col("_old") != F.col(digest), "changed").otherwise("unchanged")
    return current.join(old, current[key] == F.col("_k"), "left").withColumn("change", change).drop("_k", "_old")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace those of table with their key, others are added."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def delete_by(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def deleted_counts(table: DataFrame, gone: DataFrame, key: str, by: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("removed"))


def index_consistency(lexical: DataFrame, dense: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Keys that one index has and the other lacks."""
    a, b = lexical.select(F.col(key).alias("l")).distinct(), dense.select(F.col(key).alias("d")).distinct()
    both = a.join(b, F.col("l") == F.col("d"), "full")
    side = F.when(F.col("d").isNull(), "lexical_only").otherwise("dense_only")
    return both.filter(F.col("l").isNull() | F.col("d").isNull()).select(F.coalesce("l", "d").alias(key), side.alias("side"))


def collection_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"))


def metadata_filter(filters: dict) -> Column:
    """Scalars equal, lists any of; an array column contains or overlaps; null never matches; all must hold.

    A pair (column, "array") as the key says that the column holds arrays.
    """
    out = F.lit(True)
    for key, value in filters.items():
        column, array = (key[0], True) if isinstance(key, tuple) else (key, False)
        c = F.col(column)
        if array:
            test = F.arrays_overlap(c, F.array(*[F.lit(v) for v in value])) if isinstance(value, list) else F.array_contains(c, value)
        else:
            test = c.isin(*value) if isinstance(value, list) else c == value
        out = out & F.coalesce(test, F.lit(False))
    return out
