"""Appends and saved indexes as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import BUCKETS, SearchIndex, build_index, open_index

# The lengths to which feedback fields are cut.
QUESTION_CHARS, ANSWER_CHARS, COMMENT_CHARS = 2000, 4000, 500


def append_feedback(rows: DataFrame, path: str) -> None:
    cut = rows.withColumn("question", F.left("question", F.lit(QUESTION_CHARS))).withColumn("answer", F.left("answer", F.lit(ANSWER_CHARS)))
    if "comment" in rows.columns:
        cut = cut.withColumn("comment", F.left("comment", F.lit(COMMENT_CHARS)))
    cut.write.mode("append").parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").partitionBy("run_id").parquet(path)


def save_index(chunks: DataFrame, path: str, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> SearchIndex:
    """The index that bm25_search reads, at a path of one's own."""
    return build_index(chunks, path, key, text, buckets=buckets)


def load_index(spark: SparkSession, path: str) -> SearchIndex:
    return open_index(spark, path)
