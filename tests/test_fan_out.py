"""Sub-questions through one search, the path of list questions, and quantile sketches of windows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusmill.operators import fusion as U
from corpusmill.streaming import jobs


def test_equal_sub_questions_are_searched_once(spark):
    subs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, " "), (3, None), (2, "a")], "query_id long, sub_query string")
    asked = []

    def search(texts):
        asked.extend(r["text"] for r in texts.collect())
        scores = spark.createDataFrame([("a", 7, 0.5), ("a", 8, 0.2), ("b", 8, 0.9)], "text string, chunk_id long, score double")
        return texts.join(scores, "text").select("query_id", "chunk_id", "score")

    got = U.fan_out(subs, search).collect()
    assert sorted(asked) == ["a", "b"]
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in got) == [(1, 1, 8, 0.9), (1, 2, 7, 0.5), (2, 1, 7, 0.5), (2, 2, 8, 0.2)]


def test_comprehensive_context(spark):
    merged = spark.createDataFrame([(1, i, 1 - i / 10, i + 1) for i in range(6)], "query_id long, chunk_id long, score double, rank int")
    canned = spark.createDataFrame([(1, 9, 0.3), (1, 8, 0.1), (2, 9, 0.3)], "query_id long, chunk_id long, score double")
    chunks = spark.createDataFrame([(i, "s" if i < 4 else str(i), i >= 8, 0 if i in (0, 4) else None) for i in range(10)], "chunk_id long, section string, wanted boolean, parent_id long")
    parents = spark.createDataFrame([(0, "whole")], "parent_id long, text string")
    run = lambda **x: U.comprehensive_context(merged, canned, chunks, F.col("wanted"), **x)
    got = {r["chunk_id"]: r["rank"] for r in run().collect()}
    assert got == {8: 1, 0: 2, 1: 3, 4: 4, 5: 5, 9: 6}  # two of section s; 8 falls below the threshold and comes back
    assert {r["chunk_id"] for r in run(top_n=3).collect()} == {8, 0, 1}
    with_parents = {r["chunk_id"]: (r["rank"], r["result_id"]) for r in run(parents=parents).collect()}
    assert with_parents == {8: (1, 8), 0: (2, 0), 1: (3, 1), 5: (4, 5), 9: (5, 9)}
    scored = run(score=F.col("chunk_id").cast("double")).filter("rank = 1").first()
    assert scored["chunk_id"] == 9


def test_quantile_sketches(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(seconds=rng.random() ** 3 * 20_000), rng.lognormvariate(3, 1)) for _ in range(30_000)] + [(start + timedelta(hours=9), None), (None, 1.0)]
    got = jobs.trace_quantiles(spark.createDataFrame(rows, "ts timestamp, latency double")).collect()
    assert len(got) > 20
    for r in got:
        held = sorted(v for t, v in rows if t is not None and v is not None and r["window_start"] <= t < r["window_end"])
        assert r["n"] == sum(t is not None and r["window_start"] <= t < r["window_end"] for t, _ in rows)
        if not held:
            assert r["p50"] is None and r["p95"] is None and r["mean"] is None
            continue
        for q in (50, 95):
            below, upto = sum(v < r[f"p{q}"] for v in held) / len(held), sum(v <= r[f"p{q}"] for v in held) / len(held)
            assert below - jobs.RANK_ERROR <= q / 100 <= upto + jobs.RANK_ERROR
