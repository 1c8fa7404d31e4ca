"""Traces and feedback: windowed reports over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWEST = 1000


def trace_metrics(traces: DataFrame, newest: int = NEWEST) -> DataFrame:
    """One row: count and token sums over all; means, and the latency at index int(0.95 n), over the newest traces. traces has trace_id, ts, latency.

    Columns ttft, similarity and rerank (means of a trace), prompt_tokens and completion_tokens are optional; what is missing or null throughout is 0.
    Only the newest rows, a bounded number, meet in one task, found by a top-k that each task makes first.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in traces.columns else F.lit(None).cast(kind)
    columns = [has(c, "double").alias(c) for c in ("ttft", "similarity", "rerank")] + [has(c, "long").alias(c) for c in ("prompt_tokens", "completion_tokens")]
    traces = traces.select("trace_id", "ts", "latency", *columns)
    recent = traces.orderBy(F.desc("ts"), F.desc("trace_id")).limit(newest)
    stats = recent.agg(F.array_sort(F.collect_list("latency")).alias("l"), F.avg("latency").alias("mean"), *[F.avg(c).alias(c) for c in ("ttft", "similarity", "rerank")])
    at = F.least(F.floor(F.size("l") * 0.95), F.size("l") - 1).cast("int")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    counted = traces.agg(F.count(F.lit(1)).alias("total_queries"), *sums)
    mean = lambda c, digits: F.round(F.coalesce(F.col(c), F.lit(0.0)), digits)
    return counted.join(F.broadcast(stats)).select(
        "total_queries", mean("mean", 2).alias("avg_latency_ms"), mean("ttft", 2).alias("avg_ttft_ms"), F.round(F.coalesce(F.get("l", at), F.lit(0.0)), 2).alias("p95_latency_ms"),
        "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), mean("similarity", 4).alias("similarity_avg"), mean("rerank", 4).alias("rerank_avg"),
    )


def recent_traces(traces: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return traces.orderBy(F.desc("ts"), F.desc("trace_id")).offset(offset).limit(limit)


def feedback_summary(feedback: DataFrame, newest: int = 20) -> DataFrame:
    """up, down, total and, if feedback has id and timestamp, recent: the newest rows' ids, the newest last; a bounded number, found by a top-k that each task makes first."""
    counts = feedback.agg(F.count_if(F.col("rating") > 0).alias("up"), F.count_if(F.col("rating") < 0).alias("down"), F.count(F.lit(1)).alias("total"))
    if not {"id", "timestamp"} <= set(feedback.columns):
        return counts
    last = feedback.select("id", "timestamp").orderBy(F.desc("timestamp"), F.desc("id")).limit(newest)
    ids = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id"))), lambda x: x["id"]).alias("recent"))
    return counts.join(F.broadcast(ids))


def retrieval_trace(hits: DataFrame, query: str = "query_id", most: int = 12, preview: int = 120) -> DataFrame:
    """query, n_chunks, chunks: the first most hits with previews and rounded scores. hits has rank, score, text."""
    item = F.struct("rank", F.round("score", 4).alias("score"), F.left("text", F.lit(preview)).alias("preview"))
    return hits.groupBy(query).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, item))).alias("chunks"))


def list_documents(docs: DataFrame, category: Column, size: int = 20, page: int = 0) -> DataFrame:
    """A page of the documents of a category in the order of their ids, each with the total of all pages."""
    found = docs.filter(category)
    return found.orderBy("doc_id").offset(size * page).limit(size).join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


def trace_from_answers(answers: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """query, n_chunks, sources, scores, prompt_tokens, completion_tokens."""
    used = hits.groupBy(query).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set("source_file")).alias("sources"), F.transform(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 4).alias("score")))), lambda x: x["score"]).alias("scores"))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")
    return answers.select(query, words("question").alias("prompt_tokens"), words("answer").alias("completion_tokens")).join(used, query, "left")


def trace_by_id(traces: DataFrame, wanted: DataFrame, key: str = "trace_id") -> DataFrame:
    """The traces of which wanted holds the key; keys without a trace give no row."""
    return traces.join(wanted.select(key).distinct(), key, "left_semi")


def document_detail(chunks: DataFrame, file: str = "source_file", text: str = "text", snippet: int = 100) -> DataFrame:
    """One row a file: how many chunks it has, the longest one's characters, and the first of its snippets by their order."""
    return chunks.groupBy(file).agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length(text)).cast("long").alias("longest"), F.min(F.left(F.col(text), F.lit(snippet))).alias("first_snippet"))
