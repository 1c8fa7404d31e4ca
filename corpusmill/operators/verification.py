"""Answer verification and bounded retry: projections over (question, answer, context, citations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.session import saved
from ..functions.text import once, strip
from .fusion import apart, rank_by
from .questions import contains_any, word_count

GATES = {"composite": 0.70, "faithfulness": 0.65, "completeness": 0.50, "citations": 0.50}
# Claims that are known to be invented unless the context has them, and words of contrast.
AMOUNTS, FURNITURE = ("$5,000", "$5000"), ("unauthorized furniture", "furniture")
CONTRAST = ("whereas", "while", "differ", "versus", "contrast")


def content_words(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-zA-Z0-9]{3,}\b"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in R.STOP_WORDS]))


def abstains(answer: Column) -> Column:
    return F.lower(answer).contains(R.ABSTENTION)


def unverified_numbers(answer: Column, context: Column) -> Column:
    """Figures of the answer that the context lacks; citation tags and list numbers are no figures."""
    plain = F.regexp_replace(F.regexp_replace(answer, r"(?i)\[(?:Source\s*)?\d+(?:,\s*\d+)*\]", " "), r"(?:^|\n|\b)\(?\d+[\.\)]\s*", " ")
    told = F.struct(F.replace(F.lower(context), F.lit(" "), F.lit("")).alias("given"), F.array_distinct(F.regexp_extract_all(plain, F.lit(R.NUMBERS), F.lit(1))).alias("numbers"))
    return once(told, lambda t: F.filter(t["numbers"], lambda x: ~t["given"].contains(F.lower(F.replace(x, F.lit(" "), F.lit(""))))))


def faithfulness(answer: Column, context: Column, cited: Column) -> Column:
    """context null: no chunk was retrieved."""
    lower, given = F.lower(answer), F.lower(context)
    words = F.struct(content_words(F.regexp_replace(lower, r"\[(?:source\s*)?\d+(?:,\s*\d+)*\]", "")).alias("ours"), content_words(given).alias("theirs"))
    sizes = once(words, lambda w: F.struct(F.size(w["ours"]).alias("ours"), F.size(w["theirs"]).alias("theirs"), F.size(F.array_intersect(w["ours"], w["theirs"])).alias("shared")))

    def overlap(n: Column) -> Column:
        share = F.least(F.lit(1.0), 0.70 * n["shared"] / n["theirs"] + 0.30 * n["shared"] / n["ours"])
        known = F.when(n["shared"] >= F.least(F.lit(3), n["theirs"]), F.greatest(share, F.lit(0.85))).otherwise(share)
        return F.when((n["ours"] == 0) | (n["theirs"] == 0), 0.85).otherwise(known)

    lexical = once(sizes, overlap)
    amount = contains_any(answer, AMOUNTS) | lower.contains(FURNITURE[0])
    special = F.when(amount, ~contains_any(given, AMOUNTS)).otherwise(lower.contains(FURNITURE[1]) & ~given.contains(FURNITURE[1]))
    capped = F.when(F.size(unverified_numbers(answer, context)) > 0, F.least(lexical, F.lit(0.40))).otherwise(lexical)
    none = F.when(abstains(answer) | lower.contains("not contain sufficient information"), 1.0).when(cited, 0.20).otherwise(0.50)
    return F.when(context.isNull(), none).when(special, 0.35).otherwise(F.round(capped, 3))


def completeness(question: Column, answer: Column) -> Column:
    q, a = F.lower(question), F.lower(answer)
    words = F.array_distinct(F.regexp_extract_all(a, F.lit(r"\b[a-zA-Z0-9]{3,}\b"), F.lit(0)))
    met = lambda x: F.size(F.filter(x["asked"], lambda w: F.exists(x["said"], lambda y: y.contains(F.left(w, F.lit(4)))) | a.contains(w)))
    share = once(F.struct(content_words(q).alias("asked"), words.alias("said")), lambda x: F.when(F.size(x["asked"]) == 0, 0.90).otherwise(met(x) / F.size(x["asked"])))
    unlike = contains_any(q, ("compare", "difference")) & ~contains_any(a, CONTRAST)
    return F.when(abstains(answer), 1.0).when(q.contains("deadline") & ~a.contains("deadline"), 0.40).otherwise(F.round(F.when(unlike, F.least(share, F.lit(0.45))).otherwise(share), 3))


def citation_coverage(answer: Column, chunks: Column, citations: Column) -> Column:
    """chunks and citations are counts."""
    tags = F.regexp_extract_all(answer, F.lit(r"(?i)\[Source\s+(\d+)\]"), F.lit(1))
    good = F.size(F.filter(tags, lambda t: t.cast("long").between(F.lit(1), chunks)))
    return F.when(abstains(answer), 1.0).when((citations == 0) & (F.size(tags) == 0), 0.20).when((chunks > 0) & (F.size(tags) > 0), F.when(good == 0, 0.15).otherwise(F.round(0.80 + 0.20 * good / F.size(tags), 3))).otherwise(0.95)


def coherence(answer: Column) -> Column:
    text = strip(answer)
    return F.when(text == "", 0.0).when(word_count(text) < 5, 0.50).when(text.rlike(r"[.\]!?]$"), 0.95).otherwise(0.70)


SCORES = ("faithfulness", "completeness", "citation_coverage", "coherence")


def verify_answers(answers: DataFrame, gates: dict = GATES, scorer=None) -> DataFrame:
    """answers(question, answer, context, chunks, citations) with the four scores, composite, passed and critique.

    scorer(answers) -> answers with columns of SCORES: a judge in place of the rules; where one of its scores is null, the rule's score stands.
    """
    answer = F.coalesce("answer", F.lit(""))
    cited = (F.col("citations") > 0) | answer.rlike(r"\[Source \d+\]")
    empty = strip(answer) == ""
    scored = answers
    for name, column in (("faithfulness", faithfulness(answer, F.col("context"), cited)), ("completeness", completeness(F.col("question"), answer)), ("citation_coverage", citation_coverage(answer, F.col("chunks"), F.col("citations"))), ("coherence", coherence(answer))):
        scored = scored.withColumn(name, F.when(empty, 0.0).otherwise(column))
    if scorer is not None:
        judged = scorer(scored.withColumnsRenamed({c: f"_{c}" for c in SCORES}))
        scored = judged.withColumns({c: F.when(empty, 0.0).otherwise(F.coalesce(F.col(c), F.col(f"_{c}"))) for c in SCORES}).drop(*[f"_{c}" for c in SCORES])
    composite = F.round(0.35 * F.col("faithfulness") + 0.30 * F.col("completeness") + 0.20 * F.col("citation_coverage") + 0.15 * F.col("coherence"), 3)
    ok = (F.col("composite") >= gates["composite"]) & (F.col("faithfulness") >= gates["faithfulness"]) & (F.col("completeness") >= gates["completeness"]) & (F.col("citation_coverage") >= gates["citations"])
    said = F.concat_ws(
        " | ",
        F.when(F.col("faithfulness") < gates["faithfulness"], "Answer contains claims not grounded in retrieved context."),
        F.when(F.col("completeness") < gates["completeness"], "Answer fails to address all required aspects of user query."),
        F.when(F.col("citation_coverage") < gates["citations"], "Answer lacks required [Source N] bracketed citations."),
        F.when(F.col("coherence") < 0.70, "Answer coherence is below threshold."),
    )
    critique = F.when(empty, "Empty answer generated.").when(~F.col("passed"), F.when(said == "", "Answer quality fell below verification thresholds.").otherwise(said))
    return scored.withColumn("composite", F.when(empty, 0.0).otherwise(composite)).withColumn("passed", ~empty & (ok | abstains(answer))).withColumn("critique", critique)


def retry_adjust(reports: DataFrame) -> DataFrame:
    """The strategy of the next attempt beside a failed report's scores."""
    faith, comp = F.col("faithfulness") < 0.65, F.col("completeness") < 0.65
    return (
        reports.withColumn("min_score_ratio", F.when(faith, F.least(F.lit(0.60), F.round(F.col("min_score_ratio") + 0.10, 2))).otherwise(F.col("min_score_ratio")))
        .withColumn("temperature", F.when(faith, F.greatest(F.lit(0.0), F.round(F.col("temperature") - 0.05, 2))).otherwise(F.col("temperature")))
        .withColumn("dense_top_k", F.when(comp, F.col("dense_top_k") + 10).otherwise(F.col("dense_top_k")))
        .withColumn("bm25_top_k", F.when(comp, F.col("bm25_top_k") + 10).otherwise(F.col("bm25_top_k")))
        .withColumn("rerank_top_n", F.when(comp, F.least(F.lit(15), F.col("rerank_top_n") + 3)).otherwise(F.col("rerank_top_n")))
        .withColumn("multi_query", comp | F.col("multi_query"))
        .withColumn("parent_expansion", comp | F.col("parent_expansion"))
    )


# Why an answer is a fallback.
OFFLINE, EXHAUSTED, NO_FALLBACK = "llm_offline_fallback", "retry_exhausted_fallback", "none"


def fallback_reason(has_model: Column, passed: Column) -> Column:
    """Without a model the answer was extracted; with one, a best report (null: none) that didn't pass is all that the retries gave."""
    return F.when(~has_model, OFFLINE).when(~F.coalesce(passed, F.lit(True)), EXHAUSTED).otherwise(NO_FALLBACK)


def best_attempt(attempts: DataFrame, query: str = "query_id") -> DataFrame:
    """The first attempt that passed, else the best composite, the earliest on ties."""
    first = F.when(F.col("passed"), F.col("attempt")).otherwise(1_000_000)
    return attempts.withColumn("_n", rank_by(query, first, F.desc("composite"), "attempt")).filter("_n = 1").drop("_n")


def retry_rounds(answers: DataFrame, attempt_again, retries: int = 2, query: str = "query_id") -> DataFrame:
    """Verifies, and lets attempt_again(failing reports, attempt) -> answers try the failing ones again at most retries times.

    Each round's reports are written and read again, so that an answer is verified once however many rounds follow.
    """
    report = saved(verify_answers(answers).withColumn("attempt", F.lit(0)), "retry-reports")
    tried = report
    for n in range(1, retries + 1):
        report = saved(verify_answers(attempt_again(report.filter("not passed"), n)).withColumn("attempt", F.lit(n)), "retry-reports")
        tried = tried.unionByName(report, allowMissingColumns=True)
    return best_attempt(apart(tried, query), query)
