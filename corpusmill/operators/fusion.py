"""Ranked lists: fusion, thresholds, diversity, relaxation and parents. All are windows and grouped sums by query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.session import saved
from .questions import is_code_query

RRF_K, MIN_RATIO = 60, 0.40


def rank_by(query: str, *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(query).orderBy(*order))


def together(first: DataFrame, second: DataFrame, query: str = "query_id") -> DataFrame:
    """The rows of both, ready to be grouped by query."""
    return apart(first.unionByName(second), query)


def apart(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """rows dealt by a hash of query, so that what groups them deals them itself: of tables that were dealt alike and put together, adaptive execution may
    have merged unlike partitions, and Spark 4.1 takes the whole for dealt nevertheless (seen in hybrid_search: questions with both sides counted as one)."""
    return rows.repartition(F.xxhash64(query))


def rrf_fuse(lists: DataFrame, k: int = RRF_K, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """lists(query, key, list, rank, dense_score, sparse_score) -> score, rank; ties by first appearance (list, then rank)."""
    fused = apart(lists, query).groupBy(query, key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.max("dense_score").alias("dense_score"), F.max("sparse_score").alias("sparse_score"), F.min(F.struct("list", "rank")).alias("seen")
    )
    return fused.withColumn("rank", rank_by(query, F.desc("score"), "seen", key)).drop("seen")


def hybrid_search(dense: DataFrame, sparse: DataFrame, k: int = RRF_K, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Fuses the two sides; a query for which one side is empty gets the other's raw scores and ranks."""
    both = together(
        dense.select(query, key, F.lit(0).alias("list"), "rank", F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score")),
        sparse.select(query, key, F.lit(1).alias("list"), "rank", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("sparse_score")),
        query,
    )
    sides = F.size(F.collect_set("list").over(Window.partitionBy(query)))
    marked = both.withColumn("sides", sides)
    single = marked.filter("sides = 1").select(query, key, F.coalesce("dense_score", "sparse_score").alias("score"), "dense_score", "sparse_score", "rank")
    return rrf_fuse(marked.filter("sides = 2"), k, query, key).select(query, key, "score", "dense_score", "sparse_score", "rank").unionByName(single)


def subquery_merge(hits: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The best score of a chunk over a query's sub-queries."""
    return apart(hits, query).groupBy(query, key).agg(F.max("score").alias("score")).withColumn("rank", rank_by(query, F.desc("score"), key))


def filter_relaxation(filtered: DataFrame, unfiltered: DataFrame, queries: DataFrame, query: str = "query_id") -> DataFrame:
    """Filtered hits, and unfiltered ones for the queries that have none, with relaxed to tell them apart."""
    empty = queries.select(query).distinct().join(filtered.select(query).distinct(), query, "left_anti")
    return filtered.withColumn("relaxed", F.lit(False)).unionByName(unfiltered.join(empty, query, "left_semi").withColumn("relaxed", F.lit(True)))


def scope_filter(hits: DataFrame, corpus: Column, scope: Column) -> DataFrame:
    """Hits of the corpus that the question's scope names; a null scope or `all` keeps every hit. Ranks stay."""
    return hits.filter(scope.isNull() | (scope == "all") | (corpus == scope))


def relative_threshold(hits: DataFrame, ratio: Column | float = MIN_RATIO, min_keep: int = 1, query: str = "query_id", key: str = "chunk_id", score: str = "score") -> DataFrame:
    """Keeps scores of at least ratio times the query's best; if the best isn't positive or fewer than min_keep stay, the min_keep best."""
    all_of = Window.partitionBy(query)
    ratio = ratio if isinstance(ratio, Column) else F.lit(ratio)
    marked = hits.withColumn("_top", F.max(score).over(all_of)).withColumn("_n", rank_by(query, F.desc(score), key))
    marked = marked.withColumn("_ok", (F.col("_top") > 0) & (F.col(score) >= F.col("_top") * ratio)).withColumn("_kept", F.sum(F.col("_ok").cast("int")).over(all_of))
    return marked.filter(F.when(F.col("_kept") >= min_keep, F.col("_ok")).otherwise(F.col("_n") <= min_keep)).drop("_top", "_n", "_ok", "_kept")


def rerank(hits: DataFrame, score: Column | None = None, top_n: Column | int = 6, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Sorts by a scorer's column (default: the candidate score) and keeps each query's first top_n."""
    scored = hits.withColumn("rerank_score", F.col("score") if score is None else score)
    ranked = scored.withColumn("rank", rank_by(query, F.desc("rerank_score"), key))
    return ranked.filter(F.col("rank") <= (top_n if isinstance(top_n, Column) else F.lit(top_n)))


def diversify_sections(hits: DataFrame, per_section: int = 2, section: str = "section", query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query, section).orderBy(F.desc("score"), key))
    return hits.withColumn("_p", place).filter(F.col("_p") <= per_section).drop("_p")


def topic_boost(hits: DataFrame, marked: Column, query: str = "query_id") -> DataFrame:
    """Marked candidates get the larger of 1.2 times the query's best score and 10."""
    top = F.max("score").over(Window.partitionBy(query))
    return hits.withColumn("score", F.when(marked, F.greatest(top * 1.2, F.lit(10.0))).otherwise(F.col("score")))


def topic_reorder(hits: DataFrame, topic_class: Column, query: str = "query_id") -> DataFrame:
    """A stable order by class (0 primary, 1 secondary, 2 rest, 3 noise), then by the old rank."""
    return hits.withColumn("topic_class", topic_class).withColumn("rank", rank_by(query, "topic_class", "rank"))


def topic_ensure(kept: DataFrame, pool: DataFrame, marked: Column, limit: int = 2, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Puts up to limit marked candidates that were dropped back in front."""
    missing = pool.filter(marked).join(kept.select(query, key), [query, key], "left_anti")
    front = missing.withColumn("_p", rank_by(query, F.desc("score"), key)).filter(F.col("_p") <= limit)
    both = together(kept.select(query, key, "score", F.col("rank").alias("_p")), front.select(query, key, "score", (F.col("_p") - 1_000_000).alias("_p")), query)
    return both.withColumn("rank", rank_by(query, "_p")).drop("_p")


def parent_expand(hits: DataFrame, parents: DataFrame, query: str = "query_id", key: str = "chunk_id", drop_siblings: bool = True) -> DataFrame:
    """hits(query, key, parent_id, rank, score): a child becomes its parent, one for each parent at its best rank; rows without a parent pass.

    An unresolved parent keeps its first child and drops later ones, or keeps all with drop_siblings false.
    """
    place = F.row_number().over(Window.partitionBy(query, "parent_id").orderBy("rank"))
    known = parents.select(F.col("parent_id").alias("_pid"), F.col("text").alias("parent_text"))
    met = hits.join(known, hits.parent_id == F.col("_pid"), "left").withColumn("_p", place)
    keep = F.col("parent_id").isNull() | (F.col("_p") == 1) | (F.lit(not drop_siblings) & F.col("_pid").isNull())
    out = met.filter(keep).withColumn("result_id", F.coalesce("_pid", F.col(key)))
    return out.withColumn("rank", rank_by(query, "rank")).drop("_pid", "_p")


def topic_classify(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first topic of the rule table (name, marker phrases) of which a phrase occurs, else none."""
    q = F.lower(text)
    out = F.lit("none")
    for name, markers in reversed(rules):
        hit = F.lit(False)
        for m in markers:
            hit = hit | q.contains(m)
        out = F.when(hit, name).otherwise(out)
    return out


def topic_kind(question: Column, family: str) -> Column:
    """The first kind of a family of topics of which the question holds all words of an alternative, else none."""
    q = F.lower(question)
    asks = is_code_query(question) if family == "tool" else F.trim(question) != ""
    out = F.lit("none")
    for name, alternatives, *_ in reversed(R.TOPIC_FAMILIES[family]):
        hit = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & q.contains(w)
            hit = hit | every
        out = F.when(hit, name).otherwise(out)
    return F.when(asks, out).otherwise("none")


def topic_class_of(kind: Column, text: Column, family: str) -> Column:
    """0 for text that defines the kind's topic, 1 for one that mentions it, 3 for one that misleads, else 2."""
    low, out = F.lower(text), F.lit(2)
    holds = lambda markers: reduce(lambda a, b: a | b, [low.contains(m) for m in markers], F.lit(False))
    for name, _, primary, secondary, noise, _ in R.TOPIC_FAMILIES[family]:
        out = F.when(kind == name, F.when(holds(primary), 0).when(holds(secondary), 1).when(holds(noise), 3).otherwise(2)).otherwise(out)
    return out


def topic_reorder_by_rules(hits: DataFrame, family: str, query: str = "query_id", kind: str = "kind") -> DataFrame:
    """hits(query, kind, text, section, rank, ...): reordered by the family's markers in section and text; a question none of whose hits defines or mentions its topic keeps its order."""
    told = F.concat_ws(" ", F.coalesce("section", F.lit("")), F.coalesce("text", F.lit("")))
    classed = hits.withColumn("topic_class", topic_class_of(F.col(kind), told, family))
    best = F.min("topic_class").over(Window.partitionBy(query))
    return topic_reorder(classed, F.when(best < 2, F.col("topic_class")).otherwise(2), query)


def topic_searches(questions: DataFrame, family: str, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, text: the search that finds the chunks of each question's topic, for those whose kind has one; its hits are the canned ones of topic_inject."""
    table = [(name, search) for name, *_, search in R.TOPIC_FAMILIES[family] if search]
    kind = topic_kind(F.col(text), family)
    found = reduce(lambda rest, x: F.when(kind == x[0], x[1]).otherwise(rest), table, F.lit(None).cast("string"))
    return questions.select(query, found.alias("text")).filter("text is not null")


def topic_inject(hits: DataFrame, canned: DataFrame, marked: Column, minimum: int = 2, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """Where a question has fewer than minimum marked candidates, the best canned ones (query, key, score) that it lacks go in front with a boosted score.

    hits and canned carry the columns that marked reads; hits has rank.
    """
    all_of = Window.partitionBy(query)
    counted = hits.withColumn("_m", F.sum(marked.cast("int")).over(all_of)).withColumn("_boost", F.greatest(F.max("score").over(all_of) * 1.2, F.lit(10.0)))
    short = counted.groupBy(query).agg(F.max("_m").alias("_have"), F.max("_boost").alias("_boost")).filter(F.col("_have") < minimum)
    fresh = canned.join(short, query).join(hits.select(query, key), [query, key], "left_anti").withColumn("_n", rank_by(query, F.desc("score"), key)).filter(F.col("_n") <= F.lit(minimum) - F.col("_have"))
    both = together(hits.select(query, key, "score", F.col("rank").alias("_p")), fresh.select(query, key, F.col("_boost").alias("score"), (F.col("_n") - 1_000_000).alias("_p")), query)
    return both.withColumn("rank", rank_by(query, "_p")).drop("_p")


def comprehensive_retrieve(hits: DataFrame, section: str, ratio: float = 0.25, top_n: int = 12, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """The list-question path over the hits of all sub-queries (query, key, score, section): best score a chunk, two a section, threshold, the first top_n; a question
    that the threshold leaves empty keeps its order by score."""
    merged = apart(hits, query).groupBy(query, key, section).agg(F.max("score").alias("score"))
    spread = diversify_sections(merged, 2, section, query, key)
    kept = relative_threshold(spread, ratio, 1, query, key)
    rest = spread.join(kept.select(query).distinct(), query, "left_anti")
    both = together(kept, rest, query).withColumn("rank", rank_by(query, F.desc("score"), key))
    return both.filter(F.col("rank") <= top_n)


def fan_out(subs: DataFrame, search: Callable[[DataFrame], DataFrame], query: str = "query_id", text: str = "sub_query", key: str = "chunk_id") -> DataFrame:
    """subs(query, text) -> query, key, score, rank: the hits of a question's sub-questions, each chunk at its best score.

    search gets query_id (a number of the text), text and gives query_id, key, score: all sub-questions of all questions go through it together, so what it scans it scans once, and each
    distinct text is searched once, as rule tables give many questions the same one. Null and blank sub-questions have no hits.
    """
    asked = subs.filter(F.trim(text) != "").select(query, F.sha2(text, 256).alias("_t"), F.col(text).alias("_text"))
    texts = saved(asked.groupBy("_t").agg(F.first("_text").alias("text")).withColumn("_i", F.monotonically_increasing_id()), "sub-questions")
    found = search(texts.select(F.col("_i").alias("query_id"), "text")).select(F.col("query_id").alias("_i"), key, "score")
    pairs = asked.select(query, "_t").distinct().join(texts.select("_t", "_i"), "_t")
    return subquery_merge(pairs.select(query, "_i").join(found, "_i"), query, key)


def comprehensive_context(
    merged: DataFrame, canned: DataFrame, chunks: DataFrame, marked: Column, parents: DataFrame | None = None, section: str = "section", score: Column | None = None, ratio: float = 0.25, top_n: int = 12, minimum: int = 2, query: str = "query_id", key: str = "chunk_id"
) -> DataFrame:
    """The whole path of list questions over fan_out's hits: query, key, score, rank, and with parents parent_id and result_id.

    merged and canned: query, key, score, merged with rank; chunks: key, section, what marked and score read, and with parents parent_id. Canned hits make up for missing
    marked ones (topic_inject), a section keeps its two best, a scorer's column (default: the hit's own score) is held against ratio times the question's best, up to
    minimum marked candidates that this drops come back in front (topic_ensure), the first top_n stay and become their parents. A question without hits has no rows.
    """
    told = lambda rows: rows.join(chunks, key)
    own = together(merged.select(query, key, "score"), canned.select(query, key, "score"), query).groupBy(query, key).agg(F.max("score").alias("_own"))
    injected = topic_inject(told(merged), told(canned), marked, minimum, query, key).drop("rank")
    spread = diversify_sections(told(injected), 2, section, query, key).join(own, [query, key])
    spread = spread.withColumn("score", F.col("_own")).withColumn("score", F.col("score") if score is None else score).drop("_own")
    kept = relative_threshold(spread, ratio, 1, query, key).withColumn("rank", rank_by(query, F.desc("score"), key))
    final = topic_ensure(kept, spread, marked, minimum, query, key).filter(F.col("rank") <= top_n)
    if parents is None:
        return final
    return parent_expand(final.join(chunks.select(key, "parent_id"), key), parents, query, key).select(query, key, "score", "rank", "parent_id", "result_id")
