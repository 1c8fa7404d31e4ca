"""Contexts, answers, citations and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip
from .questions import word_count

TOKEN_BUDGET = 4096
NO_ANSWER = "I am unable to answer based on the provided documents."


def context_blocks(ranked: DataFrame, budget: int = TOKEN_BUDGET, query: str = "query_id", tagged: bool = False) -> DataFrame:
    """ranked(query, rank, source_file, section, page_number, text): the numbered blocks that fit; the first always, then up to the first overflow."""
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" | Page "), F.col("page_number").cast("string"))).otherwise("")
    name, part = F.coalesce("source_file", F.lit("document")), F.coalesce("section", F.lit("General Section"))
    if tagged:
        block = F.concat(F.lit('<source id="'), F.col("rank").cast("string"), F.lit('" file="'), name, F.lit('" section="'), part, F.lit('">\n'), strip(F.col("text")), F.lit("\n</source>"))
    else:
        block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] File: "), name, F.lit(" | Section: "), part, page, F.lit("\n"), strip(F.col("text")), F.lit("\n"))
    sized = ranked.withColumn("block", block).withColumn("tokens", F.floor(word_count(F.col("block")) * 1.3).cast("long"))
    before = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = sized.withColumn("_sum", F.sum("tokens").over(before))
    over = running.withColumn("_over", F.max(((F.col("_sum") > budget) & (F.col("rank") > 1)).cast("int")).over(before))
    return over.filter("_over = 0").drop("_sum", "_over")


def build_context(ranked: DataFrame, budget: int = TOKEN_BUDGET, query: str = "query_id", tagged: bool = False) -> DataFrame:
    """query, context, sources, tokens: one row a question; a question's blocks are bounded by the budget."""
    blocks = context_blocks(ranked, budget, query, tagged)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return blocks.groupBy(query).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("sources"), F.sum("tokens").alias("tokens"))


def snippet(text: Column) -> Column:
    """The first two sentences, closed by a full stop."""
    said = F.filter(F.transform(F.split(strip(text), r"\."), lambda s: strip(s)), lambda s: s != "")
    return F.when(F.size(said) > 0, F.concat(F.array_join(F.slice(said, 1, 2), ". "), F.lit("."))).otherwise(strip(text))


def extractive_answer(questions: DataFrame, context: DataFrame, query: str = "query_id") -> DataFrame:
    """The answer without a model: two sentences of each source with its tag, or the abstention."""
    parts = context.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(snippet(F.col("text")), F.lit(" [Source "), F.col("rank").cast("string"), F.lit("]")).alias("p")))).alias("_p"))
    told = questions.join(parts, query, "left")
    body = F.concat(F.lit("Based on the official documentation regarding '"), F.col("question"), F.lit("':\n\n"), F.array_join(F.transform("_p", lambda x: x["p"]), "\n\n"))
    return told.withColumn("answer", F.when(F.col("_p").isNull(), NO_ANSWER).otherwise(body)).drop("_p")


def source_tags(answer: Column) -> Column:
    """The distinct numbers inside [Source ...] tags, sorted."""
    tags = F.regexp_extract_all(answer, F.lit(r"(?i)\[Source\s+([^\]]+)\]"), F.lit(1))
    numbers = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(r"\b(\d+)\b"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def citation_confidence(score: Column, rerank_score: Column) -> Column:
    raw = F.coalesce(rerank_score, score)
    sigmoid = F.round(1 / (1 + F.exp(-raw)), 4)
    return (
        F.when(raw.isNull(), 0.75)
        .when(rerank_score.isNull() & raw.between(0, 1), F.greatest(F.lit(0.50), F.least(F.lit(0.99), raw)))
        .when(raw > 15, 0.99)
        .when(raw < -15, 0.15)
        .otherwise(F.greatest(F.lit(0.20), F.least(F.lit(0.99), sigmoid)))
    )


def select_citations(answers: DataFrame, context: DataFrame, ratio: float = 0.45, most: int = 3, query: str = "query_id", by_score: bool = False) -> DataFrame:
    """Cited sources that exist; for answers without one, sources of at least ratio times the best score, the first most in
    context order (by_score: in order of score). context has query, rank, score."""
    tags = answers.select(query, F.explode(source_tags(F.col("answer"))).alias("rank"))
    cited = context.join(tags, [query, "rank"], "left_semi").withColumn("reason", F.lit("cited_in_answer"))
    rest = context.join(answers.select(query), query, "left_semi").join(cited.select(query).distinct(), query, "left_anti")
    top = F.max("score").over(Window.partitionBy(query))
    floor = F.when(top > 0, top * ratio).otherwise(0.0)
    one = Window.partitionBy(query).orderBy(F.desc("score"), "rank")
    marked = rest.withColumn("_ok", F.col("score") >= floor).withColumn("_best", F.row_number().over(one)).withColumn("_any", F.max("_ok").over(Window.partitionBy(query)))
    kept = marked.filter(F.col("_ok") | (~F.col("_any") & (F.col("_best") == 1)))
    order = [F.desc("score"), F.col("rank")] if by_score else [F.col("rank")]
    fallback = kept.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("_n") <= most).drop("_ok", "_best", "_any", "_n")
    return cited.unionByName(fallback.withColumn("reason", F.lit("score_threshold_fallback")))


def dedupe_citations(citations: DataFrame, cap: int = 6, query: str = "query_id") -> DataFrame:
    """One for each file, page and section, the best score; then the cap best."""
    best = Window.partitionBy(query, "source_file", "page_number", "section").orderBy(F.desc("score"), "chunk_id")
    unique = citations.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return unique.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "chunk_id"))).filter(F.col("place") <= cap)


def citation_label(source_file: Column, section: Column, page: Column, section_first: bool = True) -> Column:
    name = F.initcap(F.regexp_replace(F.regexp_replace(source_file, r"\.[^.]*$", ""), "[_-]+", " "))
    at = F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string")))
    return F.concat_ws(" · ", section, name, at) if section_first else F.concat_ws(" · ", name, section, at)


def citation_primary(source_file: Column, page: Column, section_path: Column, section_title: Column, section_number: Column, document_first: bool = False) -> Column:
    """The one-line label of the older generation: the section and page, or the document's name, section and page."""
    stem = F.initcap(strip(F.regexp_replace(F.regexp_replace(source_file, r"(?<=.)\.[^.]*$", ""), "[_-]", " ")))
    name = F.when(stem == "", source_file).otherwise(stem)
    numbered = F.concat(F.lit("Section "), section_number)
    own = F.when(section_title.isNotNull() & section_number.isNotNull(), F.concat_ws(" ", numbered, section_title)).otherwise(F.coalesce(section_title, numbered))
    label = F.coalesce(section_path, own)
    if document_first:
        return F.concat_ws(" ", name, F.concat(F.lit("— "), label), F.concat(F.lit("(Page "), page.cast("string"), F.lit(")")))
    return F.concat_ws(" ", F.coalesce(label, name), F.concat(F.lit("(p."), page.cast("string"), F.lit(")")))


def split_thinking(text: Column) -> tuple[Column, Column]:
    """(thinking, answer): the think blocks taken out of an answer."""
    blocks = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1)), lambda b: strip(b)), lambda b: b != "")
    clean = F.regexp_replace(strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", "")), r"\n{3,}", "\n\n")
    return F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")), F.when(clean == "", strip(text)).otherwise(clean)


def parse_guard_verdict(raw: Column, strict: bool = False) -> Column:
    text = F.upper(strip(raw))
    if strict:
        return text.startswith("YES")
    return ~(text.contains("UNSUPPORTED") & ~F.split(text, "UNSUPPORTED")[0].contains("SUPPORTED"))


def parse_code_verdict(raw: Column) -> Column:
    """struct<passed, explanation>."""
    text = strip(raw)
    upper = F.upper(text)
    head = F.slice(F.filter(F.split(upper, r"\s+"), lambda w: w != ""), 1, 3)
    yes, no = upper.contains("VERDICT: YES") | upper.startswith("YES"), upper.contains("VERDICT: NO") | upper.startswith("NO")
    told = F.filter(F.split(text, "\n"), lambda x: F.upper(x).startswith("EXPLANATION:"))
    explanation = F.when(F.size(told) > 0, strip(F.regexp_replace(F.element_at(told, -1), r"^[^:]*:", ""))).otherwise("")
    known = yes | no | F.array_contains(head, "YES") | F.array_contains(head, "NO")
    passed = F.when(yes, True).when(no, False).otherwise(F.array_contains(head, "YES"))
    return F.struct(passed.alias("passed"), F.when(known, explanation).otherwise(F.left(text, F.lit(200))).alias("explanation"))


def code_grounding(answers: DataFrame, context: DataFrame, query: str = "query_id", minimum: float = 0.8) -> DataFrame:
    """query, code_lines, grounded, share, passed: the lines of an answer's fences that occur in the question's context, white space aside."""
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    fences = F.regexp_extract_all(F.col("answer"), F.lit(r"(?s)```[a-zA-Z]*\n(.*?)```"), F.lit(1))
    lines = F.filter(F.flatten(F.transform(fences, lambda f: F.split(f, "\n"))), lambda x: (F.length(squeeze(x)) > 2) & ~x.rlike(r"^\s*#"))
    told = context.groupBy(query).agg(F.array_join(F.array_sort(F.collect_list(squeeze(F.col("text")))), "\n").alias("_c"))
    rows = answers.select(query, F.explode(lines).alias("line")).join(told, query, "left")
    name = F.regexp_extract("line", r"\bdef\s+(\w+)", 1)
    found = F.coalesce(F.col("_c").contains(squeeze(F.col("line"))) | ((name != "") & F.col("_c").contains(name)), F.lit(False))
    counted = rows.groupBy(query).agg(F.count(F.lit(1)).alias("code_lines"), F.count_if(found).alias("grounded"))
    share = F.round(F.col("grounded") / F.col("code_lines"), 6)
    return answers.select(query).join(counted, query, "left").withColumn("share", share).withColumn("passed", F.col("share") >= minimum)


def strip_ungrounded_code(answer: Column, failed: Column) -> Column:
    """Drops the fences that hold a failed line, and a line that announces code which no longer follows."""
    parts = F.split(answer, "```")
    squeeze = lambda x: F.regexp_replace(x, r"\s+", "")
    bad = lambda p: F.exists(failed, lambda f: squeeze(p).contains(squeeze(f)))
    kept = F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 0, strip(p)).when(~bad(p), F.concat(F.lit("```"), p, F.lit("```"))).otherwise("")), lambda p: p != "")
    text = F.array_join(kept, "\n")
    lines = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(r"(?i)(defined as|as follows|the following code|example)\s*:\s*$") & ~text.contains("```")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


# How a partial answer and an abstention begin.
PARTIAL = "based on the available information"
ABSTENTIONS = ("I am unable to answer", "The documents do not contain")
PARTIAL_CHARS = 100


def normalize_answer(answer: Column) -> Column:
    """An abstention before or after a partial answer of at least PARTIAL_CHARS characters, or one with a source, goes; other answers stay."""
    text = strip(answer)
    at = F.locate(PARTIAL, F.lower(text))
    leads = F.lit(False)
    cut = F.lit(None).cast("int")
    for m in ABSTENTIONS:
        leads = leads | text.startswith(m)
    body = F.when(leads & (at > 1), F.substr(text, at)).otherwise(text)
    enough = lambda x: (F.length(x) >= PARTIAL_CHARS) | F.lower(x).contains("[source")
    body = F.when(enough(body), body).otherwise(text)
    for m in ABSTENTIONS:
        place = F.locate(m, body)
        cut = F.coalesce(cut, F.when(place > 1, place))
    before = strip(F.substr(body, F.lit(1), F.coalesce(cut, F.length(body) + 1) - 1))
    return F.when(F.lower(body).startswith(PARTIAL) & cut.isNotNull() & enough(before), before).otherwise(body)
