"""Evaluation runs: relevance, metrics, buckets, gates, agreement and latencies. One-pass grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import ABSTENTION
from ..functions.text import strip


def keyword_match(keyword: Column, searchable: Column, empty_matches: bool = False) -> Column:
    """The keyword occurs, or all its tokens longer than three letters do; empty_matches: so does one without such tokens."""
    needle = F.lower(strip(keyword))
    tokens = F.filter(F.split(needle, r"\W+"), lambda t: F.length(t) > 3)
    every = F.forall(tokens, lambda t: searchable.contains(t))
    return searchable.contains(needle) | (every if empty_matches else (F.size(tokens) > 0) & every)


def retrieval_metrics(hits: DataFrame, golden: DataFrame, query: str = "query_id") -> DataFrame:
    """hits(query, text), golden(query, keyword) -> hit_rate, context_precision, context_recall, relevant, expected.

    Recall counts a keyword over all retrieved texts, and one without a token of four letters always (the
    reference's rule). Questions without keywords have no relevant hits and recall 1, without hits 0 throughout.
    """
    wanted = golden.filter(F.trim(F.coalesce("keyword", F.lit(""))) != "")
    searchable = hits.select(query, F.lower("text").alias("s")).withColumn("id", F.monotonically_increasing_id())
    relevant = searchable.join(wanted, query).filter(keyword_match(F.col("keyword"), F.col("s"))).groupBy(query).agg(F.count_distinct("id").alias("relevant"))
    total = hits.groupBy(query).agg(F.count(F.lit(1)).alias("total"))
    told = searchable.groupBy(query).agg(F.array_join(F.array_sort(F.collect_list("s")), " ").alias("s"))
    recalled = wanted.join(told, query, "left").groupBy(query).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("s").isNotNull() & keyword_match(F.col("keyword"), F.coalesce("s", F.lit("")), True)).alias("matched"))
    every = golden.select(query).distinct().join(total, query, "left").join(relevant, query, "left").join(recalled, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    got = zero("total") > 0
    return every.select(
        query,
        F.when(zero("relevant") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.when(got, F.round(zero("relevant") / zero("total"), 6)).otherwise(0.0).alias("context_precision"),
        F.when(~got, 0.0).when(F.col("expected").isNull(), 1.0).otherwise(F.round(zero("matched") / zero("expected"), 6)).alias("context_recall"),
        zero("relevant").alias("relevant"),
        zero("expected").alias("expected"),
    )


def aggregate_metrics(cases: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    """Means over non-null values, for all and by each column of by: one pass of grouping sets.

    Cases with code_validation_triggered, code_validation_passed and fallback_reason also give code_validation_pass_rate, among the triggered with a verdict, and low_confidence_fallback_rate, among all.
    """
    if {"code_validation_triggered", "code_validation_passed", "fallback_reason"} <= set(cases.columns):
        passed = F.when(F.col("code_validation_triggered"), F.col("code_validation_passed").cast("double"))
        fallback = F.coalesce(F.col("fallback_reason") == "code_validation", F.lit(False)).cast("double")
        cases = cases.withColumn("code_validation_pass_rate", passed).withColumn("low_confidence_fallback_rate", fallback)
        metrics = [*metrics, "code_validation_pass_rate", "low_confidence_fallback_rate"]
    sets = ", ".join(["()", *[f"({c})" for c in by]])
    means = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics)
    names = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by)
    values = ", ".join(f"cast({c} AS string)" for c in by)
    return cases.sparkSession.sql(f"SELECT CASE {names} ELSE 'all' END AS dimension, coalesce({values}, 'all') AS value, count(*) AS cases, {means} FROM {{cases}} GROUP BY GROUPING SETS ({sets})", cases=cases)


def failure_buckets(cases: DataFrame, faith: float = 0.80, relevancy: float = 0.75, precision: float = 0.50) -> DataFrame:
    """case_id, bucket: a case may be in several of the eight."""
    tests = {
        "retrieval_miss": F.col("hit_rate") < 1.0,
        "low_context_precision": F.col("context_precision") < precision,
        "low_faithfulness": F.col("faithfulness") < faith,
        "low_relevancy": F.col("answer_relevancy") < relevancy,
        "faithfulness_guard_abstention": F.col("guard_modified"),
        "code_validation_fallback": F.col("fallback_reason") == "code_validation",
        "code_validation_failed": F.col("code_validation_triggered") & ~F.col("code_validation_passed"),
        "abstention_failure": (F.col("category") == "edge_case") & (F.col("answer_relevancy") < relevancy),
    }
    return cases.select("case_id", F.explode(F.filter(F.array(*[F.when(t, n) for n, t in tests.items()]), lambda x: x.isNotNull())).alias("bucket"))


def worst_cases(cases: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest by faithfulness, then relevancy; a missing or zero score counts as 1."""
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    return cases.orderBy(one("faithfulness"), one("answer_relevancy"), "case_id").limit(n)


def compare_runs(before: DataFrame, after: DataFrame, metrics: list[str], key: str = "case_id") -> DataFrame:
    """key, metric, before, after, delta."""
    long = lambda df, name: df.unpivot([key], metrics, "metric", name)
    return long(before, "before").join(long(after, "after"), [key, "metric"]).withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def metric_gate(aggregate: DataFrame, floors: dict[str, float]) -> DataFrame:
    """metric, value, floor of the metrics that are missing or below their floor; aggregate has one row."""
    table = aggregate.sparkSession.createDataFrame(list(floors.items()), "metric string, floor double")
    return table.join(aggregate.unpivot([], list(floors), "metric", "value"), "metric", "left").filter(F.col("value").isNull() | (F.col("value") < F.col("floor"))).select("metric", "value", "floor")


def agreement(pairs: DataFrame, a: str, b: str, tolerance: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """Pearson (0 if degenerate), mean absolute error, share within tolerance, Cohen's kappa at the threshold: one row, one pass."""
    x, y = F.col(a), F.col(b)
    hx, hy = (x >= threshold).cast("int"), (y >= threshold).cast("int")
    s = pairs.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), F.avg(F.abs(x - y)).alias("mae"), F.avg((F.abs(x - y) <= tolerance + 1e-12).cast("double")).alias("within"), F.avg((hx == hy).cast("double")).alias("po"), F.avg(hx).alias("px"), F.avg(hy).alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    r = F.when(F.isnan("r") | F.col("r").isNull(), 0.0).otherwise(F.col("r"))
    kappa = F.when(pe == 1.0, 1.0).otherwise((F.col("po") - pe) / (1 - pe))
    return s.select("n", F.round(r, 6).alias("pearson"), F.round("mae", 6).alias("mae"), F.round("within", 6).alias("within"), F.round(kappa, 6).alias("kappa"))


def latency_summary(samples: DataFrame, stage: str = "stage", value: str = "ms", warm_up: int = 0, iteration: str = "iteration") -> DataFrame:
    """Mean, p50 and p95 by stage, linear between ranks, without the first warm_up iterations."""
    return (samples.filter(F.col(iteration) >= warm_up) if warm_up else samples).groupBy(stage).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))


def _json_object(text: Column) -> Column:
    """The text if it is one JSON object as a whole, else null: Spark's JSON functions also take a value that other text follows, but not inside brackets and braces."""
    wrapped = lambda head, tail, path: F.get_json_object(F.concat(F.lit(head), text, F.lit(tail)), path).isNotNull()
    return F.when(text.startswith("{") & wrapped("[", "]", "$[0]") & wrapped('{"x":', "}", "$.x"), text)


def parse_judge_scores(raw: Column) -> Column:
    """struct<score, reasoning> of a judge's JSON object, whole or embedded; without one the text's first 300 characters are the reasoning."""
    text = strip(raw)
    given = F.coalesce(_json_object(text), _json_object(F.regexp_extract(text, r'(?s)(\{[^{}]*"score"[^{}]*\})', 1)))
    pick = lambda k: F.get_json_object(given, f"$.{k}")
    return F.struct(pick("score").try_cast("double").alias("score"), F.when(given.isNotNull(), pick("reasoning")).otherwise(F.left(text, F.lit(300))).alias("reasoning"))


def golden_candidates(chunks: DataFrame, kind: Column, most: int = 20, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, kind: the most longest chunks of each kind, from which golden cases are written; key on ties."""
    longest = Window.partitionBy("kind").orderBy(F.desc("_n"), key)
    marked = chunks.select(key, F.length(text).alias("_n"), kind.alias("kind"))
    return marked.withColumn("_r", F.row_number().over(longest)).filter(F.col("_r") <= most).select(key, "kind")


def case_results(cases: DataFrame, reports: DataFrame, key: str = "case_id") -> DataFrame:
    """One row a case that has a report: its scores, whether it passed, and guard_modified where the guard put an abstention in the answer's place (guarded)."""
    abstains = F.lower("answer").contains(ABSTENTION)
    told = reports.select(key, "faithfulness", "completeness", "passed", abstains.alias("_a"))
    return cases.join(told, key).withColumn("guard_modified", F.col("_a") & F.col("guarded")).drop("_a")


#: What a case holds when its file is silent.
CASE_DEFAULTS = {"category": "general", "expected_answer": "", "corpus": "policy", "source_file": ""}
GOLDEN = "id string, category string, question string, expected_answer string, relevant_sections array<string>, expected_key_points array<string>, corpus string, query_type string, source_file string"


def golden_cases(files: DataFrame, content: str = "content", corpus: str = "all") -> DataFrame:
    """files with a JSON object of cases in content -> one row a case with defaults filled in, those of corpus only unless it is all.

    A query_type that is missing is the case's category, or factual if that is missing too. Files that are no such object and cases without id or question give no row.
    """
    parsed = F.from_json(content, f"cases array<struct<{', '.join(f.replace(' ', ':', 1) for f in GOLDEN.split(', '))}>>")
    rows = files.select(F.explode(parsed["cases"]).alias("c")).select("c.*").filter("id is not null and question is not null")
    rows = rows.withColumn("query_type", F.coalesce("query_type", "category", F.lit("factual"))).fillna(CASE_DEFAULTS)
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("relevant_sections", F.coalesce("relevant_sections", empty)).withColumn("expected_key_points", F.coalesce("expected_key_points", empty))
    return rows if corpus.lower() == "all" else rows.filter(F.col("corpus") == corpus.lower())


def load_golden(spark: SparkSession, path: str, corpus: str = "all") -> DataFrame:
    """golden_cases of the JSON files under path."""
    return golden_cases(spark.read.text(path, wholetext=True).select(F.col("value").alias("content")), corpus=corpus)
