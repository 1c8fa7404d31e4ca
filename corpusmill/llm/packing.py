"""Packing into optimal length buckets.

The exact global histogram of lengths (one row a distinct length) goes to the driver, where dynamic programming chooses the
bucket boundaries with the least padding; Spark then forms batches under a token budget inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_rows

BUCKETS, TOKEN_BUDGET = 16, 32_768


def count_tokens(text: Column) -> Column:
    """Runs without white space and one end mark: a stand-in for a tokenizer's count that stays in the JVM."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) + 1).cast("long")


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """(length, rows) -> at most buckets upper bounds whose padding is the least; the largest length is always one.

    With C the rows up to a length, k buckets up to length j cost the least of cost(k-1, i) + L[j] * (C[j] - C[i]): lines in
    L[j] with falling slopes, asked at rising points, so a hull of lines answers each in constant time on average.
    """
    histogram = sorted(histogram)
    if not histogram:
        return []
    lengths = [x for x, _ in histogram]
    upto = [0]
    for _, n in histogram:
        upto.append(upto[-1] + n)
    m = len(lengths)
    cost = [0] + [None] * m
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        hull: list[int] = []
        at, new, came = 0, [None] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if cost[i] is not None:
                # Drop lines that the new one (slope -upto[i], height cost[i]) makes useless.
                while len(hull) >= 2 and (cost[i] - cost[hull[-2]]) * (upto[hull[-1]] - upto[hull[-2]]) <= (cost[hull[-1]] - cost[hull[-2]]) * (upto[i] - upto[hull[-2]]):
                    hull.pop()
                hull.append(i)
                at = min(at, len(hull) - 1)
            value = lambda i, x=lengths[j - 1]: cost[i] - x * upto[i]
            if hull:
                while at + 1 < len(hull) and value(hull[at + 1]) < value(hull[at]):
                    at += 1
                new[j], came[j] = value(hull[at]) + lengths[j - 1] * upto[j], hull[at]
        cost = new
        back.append(came)
    out, j = [], m
    for came in reversed(back):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = came[j]
    return out[::-1]


def pack(docs: DataFrame, tokens: Column | None = None, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, bucket, bucket_length, batch, place, padding for every row.

    bucket_length bounds the bucket's lengths; bucket_length times the rows of a batch stays within token_budget, but a row that is longer
    by itself has a batch of its own. batch counts from 0 in a bucket, place from 0 in a batch. Null and empty texts
    have the end mark only. Repeated rows are rows like others; an empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    sized = scratch.save(docs.select("doc_id", (count_tokens(F.col("text")) if tokens is None else tokens).alias("n_tokens")))
    histogram = [tuple(r) for r in sized.groupBy("n_tokens").count().collect()]
    bounds = optimal_boundaries(histogram, buckets)
    upper = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(upper, lambda b: b < F.col("n_tokens")))
    placed = sized.withColumn("bucket", bucket).withColumn("bucket_length", upper[F.col("bucket")])
    total = sum(n for _, n in histogram)
    each = F.greatest(F.lit(1).cast("long"), F.expr(f"{token_budget} div bucket_length"))
    numbered = number_rows(placed, "bucket", [F.col("doc_id"), F.col("n_tokens")], total).withColumn("_each", each)
    return numbered.select("doc_id", "n_tokens", "bucket", "bucket_length", F.expr("slot div _each").alias("batch"), F.expr("slot % _each").alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"))
