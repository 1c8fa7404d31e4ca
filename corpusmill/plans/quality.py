"""Verification, cache, evaluation and telemetry queries over documents, labels, benchmark, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.session import scratch_path
from ..functions.text import strip
from ..operators import answers as A
from ..operators import cache as H
from ..operators import evaluation as E
from ..operators import telemetry as T
from ..operators import verification as V
from ..operators import vectors as X
from ..streaming import jobs
from .corpus import quoted
from .registry import query
from .retrieval import BM25, sparse_hits, with_context

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"
# A question, an answer and a context for each document: the answer is the whole text with an ending by the id, the context the text or, for a third, one in which many words are others.
ENDINGS = (" [Source 1].", " costs $5,000 a year [Source 2]", " whereas 45 days differ.", "", " [Source 9] and 120 hours!", " unable to answer")
QUESTIONS = ("What is the deadline for leave?", "compare the two plans", "Which rules are about the and of", "ertion heath whor")
JUDGED_SQL = (
    "judged AS (SELECT doc_id, CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {quoted(q)}" for i, q in enumerate(QUESTIONS)) + " END AS question, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text || CASE doc_id % 6 "
    + " ".join(f"WHEN {i} THEN {quoted(e)}" for i, e in enumerate(ENDINGS)) + " END END AS answer, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 1 THEN replace(text, 'th', 'zz') ELSE text END END AS context, CASE WHEN doc_id % 5 <> 0 THEN 3 ELSE 0 END AS chunks, CAST(doc_id % 2 AS INTEGER) AS citations FROM documents)"
)


def judged(t):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % n + 1).cast("int"))
    answer = F.when(F.col("doc_id") % 17 == 0, " ").otherwise(F.concat("text", pick(ENDINGS, 6)))
    has = F.col("doc_id") % 5 != 0
    return t("documents").select("doc_id", pick(QUESTIONS, 4).alias("question"), answer.alias("answer"), F.when(has & (F.col("doc_id") % 3 == 1), F.replace("text", F.lit("th"), F.lit("zz"))).when(has, F.col("text")).alias("context"), F.when(has, 3).otherwise(0).alias("chunks"), (F.col("doc_id") % 2).cast("int").alias("citations"))


STOP = "[" + ", ".join(map(quoted, R.STOP_WORDS)) + "]"
# Words bounded by any letter or digit, as Java and not RE2 sees them.
ALL_WORDS = "list_filter(regexp_extract_all(lower({}), '[\\pL\\p{{Nd}}_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{{3,}}$'))"
CONTENT = "list_filter(list_distinct(" + ALL_WORDS + "), lambda w: NOT list_contains(" + STOP.replace("{", "{{").replace("}", "}}") + ", w))"
ABSTAINS = "contains(lower(answer), 'unable to answer')"
FAITH_SQL = f"""fa AS (SELECT *, {CONTENT.format("regexp_replace(lower(answer), '[[](?:source\\s*)?[0-9]+(?:,\\s*[0-9]+)*[]]', '', 'g')")} AS ours, {CONTENT.format('context')} AS theirs,
  list_filter(regexp_extract_all(regexp_replace(regexp_replace(answer, '(?i)[[](?:Source\\s*)?[0-9]+(?:,\\s*[0-9]+)*[]]', ' ', 'g'), '(?:^|\\n|\\b)\\(?[0-9]+[.)]\\s*', ' ', 'g'), {quoted(R.NUMBERS)}, 1), lambda x: NOT contains(replace(lower(context), ' ', ''), replace(lower(x), ' ', ''))) AS odd FROM judged),
fs AS (SELECT *, len(list_intersect(ours, theirs)) AS shared FROM fa),
fl AS (SELECT *, CASE WHEN len(ours) = 0 OR len(theirs) = 0 THEN 0.85::DOUBLE ELSE CASE WHEN shared >= least(3, len(theirs)) THEN greatest(0.85::DOUBLE, least(1.0, 0.7::DOUBLE * shared / len(theirs) + 0.3::DOUBLE * shared / len(ours))) ELSE least(1.0, 0.7::DOUBLE * shared / len(theirs) + 0.3::DOUBLE * shared / len(ours)) END END AS lex FROM fs),
fv AS (SELECT *, CASE WHEN context IS NULL THEN CASE WHEN {ABSTAINS} OR contains(lower(answer), 'not contain sufficient information') THEN 1.0 WHEN citations > 0 OR regexp_matches(answer, '[[]Source [0-9]+[]]') THEN 0.2 ELSE 0.5 END
  WHEN contains(answer, '$5,000') OR contains(answer, '$5000') OR contains(lower(answer), 'unauthorized furniture') THEN CASE WHEN contains(lower(context), '$5,000') OR contains(lower(context), '$5000') THEN round(CASE WHEN len(odd) > 0 THEN least(lex, 0.4) ELSE lex END, 3) ELSE 0.35 END
  WHEN contains(lower(answer), 'furniture') AND NOT contains(lower(context), 'furniture') THEN 0.35 ELSE round(CASE WHEN len(odd) > 0 THEN least(lex, 0.4) ELSE lex END, 3) END::DOUBLE AS faithfulness FROM fl)"""
COMP_SQL = f"""ca AS (SELECT *, {CONTENT.format('question')} AS asked, {ALL_WORDS.format('answer')} AS said FROM {{src}}),
cs AS (SELECT *, CASE WHEN len(asked) = 0 THEN 0.9::DOUBLE ELSE len(list_filter(asked, lambda w: len(list_filter(said, lambda x: contains(x, left(w, 4)))) > 0 OR contains(lower(answer), w)))::DOUBLE / len(asked) END AS share FROM ca),
cv AS (SELECT *, CASE WHEN {ABSTAINS} THEN 1.0 WHEN contains(lower(question), 'deadline') AND NOT contains(lower(answer), 'deadline') THEN 0.4
  WHEN (contains(lower(question), 'compare') OR contains(lower(question), 'difference')) AND NOT (contains(lower(answer), 'whereas') OR contains(lower(answer), 'while') OR contains(lower(answer), 'differ') OR contains(lower(answer), 'versus') OR contains(lower(answer), 'contrast')) THEN round(least(share, 0.45), 3) ELSE round(share, 3) END::DOUBLE AS completeness FROM cs)"""
CITE_SQL = f"""CASE WHEN {ABSTAINS} THEN 1.0 WHEN citations = 0 AND len(regexp_extract_all(answer, '(?i)[[]Source\\s+([0-9]+)[]]', 1)) = 0 THEN 0.2 WHEN chunks > 0 AND len(regexp_extract_all(answer, '(?i)[[]Source\\s+([0-9]+)[]]', 1)) > 0 THEN
 CASE WHEN len(list_filter(regexp_extract_all(answer, '(?i)[[]Source\\s+([0-9]+)[]]', 1), lambda t: t::BIGINT BETWEEN 1 AND chunks)) = 0 THEN 0.15 ELSE round(0.8 + 0.2::DOUBLE * len(list_filter(regexp_extract_all(answer, '(?i)[[]Source\\s+([0-9]+)[]]', 1), lambda t: t::BIGINT BETWEEN 1 AND chunks)) / len(regexp_extract_all(answer, '(?i)[[]Source\\s+([0-9]+)[]]', 1)), 3) END ELSE 0.95 END::DOUBLE"""
COH_SQL = f"CASE WHEN {STRIP.format('answer')} = '' THEN 0.0 WHEN {WORDS.format('answer')} < 5 THEN 0.5 WHEN regexp_matches({STRIP.format('answer')}, '[.\\]!?]$') THEN 0.95 ELSE 0.7 END::DOUBLE"
EMPTY = f"{STRIP.format('answer')} = ''"
REPORT_SQL = (
    f"{JUDGED_SQL}, {FAITH_SQL}, {COMP_SQL.replace('{src}', 'fv')}, sc AS (SELECT doc_id, answer, " + ", ".join(f"CASE WHEN {EMPTY} THEN 0.0 ELSE {x} END::DOUBLE AS {n}" for n, x in (("faithfulness", "faithfulness"), ("completeness", "completeness"), ("citation_coverage", CITE_SQL), ("coherence", COH_SQL)))
    + f" FROM cv), cp AS (SELECT *, CASE WHEN {EMPTY} THEN 0.0 ELSE round(0.35::DOUBLE * faithfulness + 0.3::DOUBLE * completeness + 0.2::DOUBLE * citation_coverage + 0.15::DOUBLE * coherence, 3) END AS composite FROM sc), "
    f"rp AS (SELECT doc_id, faithfulness, completeness, citation_coverage, coherence, composite, NOT ({EMPTY}) AND ((composite >= 0.7 AND faithfulness >= 0.65 AND completeness >= 0.5 AND citation_coverage >= 0.5) OR {ABSTAINS}) AS passed FROM cp)"
)


def reports(t):
    return V.verify_answers(judged(t))


@query(f"WITH {JUDGED_SQL}, {FAITH_SQL} SELECT doc_id, faithfulness FROM fv")
def verify_faithfulness(t):
    cited = (F.col("citations") > 0) | F.col("answer").rlike(r"\[Source \d+\]")
    return judged(t).select("doc_id", V.faithfulness(F.col("answer"), F.col("context"), cited).alias("faithfulness"))


@query(f"WITH {JUDGED_SQL}, {COMP_SQL.replace('{src}', 'judged')} SELECT doc_id, completeness FROM cv")
def verify_completeness(t):
    return judged(t).select("doc_id", V.completeness(F.col("question"), F.col("answer")).alias("completeness"))


@query(f"WITH {JUDGED_SQL} SELECT doc_id, {CITE_SQL} AS citation_coverage FROM judged")
def verify_citations(t):
    return judged(t).select("doc_id", V.citation_coverage(F.col("answer"), F.col("chunks"), F.col("citations")).alias("citation_coverage"))


@query(f"WITH {JUDGED_SQL} SELECT doc_id, {COH_SQL} AS coherence FROM judged")
def verify_coherence(t):
    return judged(t).select("doc_id", V.coherence(F.col("answer")).alias("coherence"))


@query(f"WITH {REPORT_SQL} SELECT * FROM rp")
def verify_answer(t):
    return reports(t).select("doc_id", "faithfulness", "completeness", "citation_coverage", "coherence", "composite", "passed")


@query(
    f"WITH {REPORT_SQL} SELECT doc_id, CASE WHEN faithfulness < 0.65 THEN least(0.6, round(0.4 + 0.1, 2)) ELSE 0.4 END::DOUBLE AS min_score_ratio, CASE WHEN faithfulness < 0.65 THEN greatest(0, round(0.1 - 0.05, 2)) ELSE 0.1 END::DOUBLE AS temperature, "
    "CASE WHEN completeness < 0.65 THEN 35 ELSE 25 END AS dense_top_k, CASE WHEN completeness < 0.65 THEN 9 ELSE 6 END AS rerank_top_n, completeness < 0.65 AS multi_query FROM rp WHERE NOT passed"
)
def retry_adjust(t):
    plan = reports(t).filter("not passed").select("doc_id", "faithfulness", "completeness", F.lit(0.4).alias("min_score_ratio"), F.lit(0.1).alias("temperature"), F.lit(25).alias("dense_top_k"), F.lit(25).alias("bm25_top_k"), F.lit(6).alias("rerank_top_n"), F.lit(False).alias("multi_query"), F.lit(False).alias("parent_expansion"))
    return V.retry_adjust(plan).select("doc_id", "min_score_ratio", "temperature", "dense_top_k", "rerank_top_n", "multi_query")


@query()
def retry_rounds(t):
    columns = ["doc_id", "question", "answer", "context", "chunks", "citations"]

    def again(failed, attempt):
        better = F.concat("context", F.repeat(F.lit(" so it is"), F.lit(attempt)), F.lit(" [Source 1]."))
        return failed.withColumn("answer", F.coalesce(better, F.col("answer"))).select(columns)

    return V.retry_rounds(judged(t).select(columns), again, query="doc_id").select("doc_id", "attempt", "composite", "passed")


@query(f"WITH {REPORT_SQL} SELECT doc_id, CASE WHEN lang = 'fr' THEN 'llm_offline_fallback' WHEN NOT passed THEN 'retry_exhausted_fallback' ELSE 'none' END AS fallback_reason FROM documents LEFT JOIN rp USING (doc_id)")
def fallback_reason(t):
    told = t("documents").select("doc_id", "lang").join(reports(t).select("doc_id", "passed"), "doc_id", "left")
    return told.select("doc_id", V.fallback_reason(F.coalesce(F.col("lang") != "fr", F.lit(True)), F.col("passed")).alias("fallback_reason"))


@query(f"WITH {JUDGED_SQL} SELECT doc_id, list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all(answer, '(?i)[[]Source\\s+([^]]+)[]]', 1), lambda x: regexp_extract_all(x, '\\b([0-9]+)\\b', 1))), lambda n: n::INTEGER))) AS tags FROM judged")
def extract_source_tags(t):
    return judged(t).select("doc_id", A.source_tags(F.col("answer")).alias("tags"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'plan ' || lang END AS thinking, regexp_replace({STRIP.format('text')}, '\n{{3,}}', chr(10) || chr(10), 'g') AS answer FROM documents")
def split_thinking(t):
    raw = t("documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<think> plan "), F.col("lang"), F.lit(" </think>"))).otherwise(""), "text").alias("raw"))
    thinking, answer = A.split_thinking(F.col("raw"))
    return raw.select("doc_id", thinking.alias("thinking"), answer.alias("answer"))


# Verdicts around whole texts: a word list decides on the upper-cased answer, wherever in it the words stand.
GUARD_SQL = "guard AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' UNSUPPORTED claims' WHEN 1 THEN text || ' SUPPORTED' WHEN 2 THEN 'this is SUPPORTED, ' || text || ' not UNSUPPORTED' WHEN 3 THEN ' Yes. ' || text ELSE text END AS raw FROM documents)"


def guard(t):
    n, text = F.col("doc_id") % 5, F.col("text")
    raw = F.when(n == 0, F.concat(text, F.lit(" UNSUPPORTED claims"))).when(n == 1, F.concat(text, F.lit(" SUPPORTED"))).when(n == 2, F.concat(F.lit("this is SUPPORTED, "), text, F.lit(" not UNSUPPORTED"))).when(n == 3, F.concat(F.lit(" Yes. "), text)).otherwise(text)
    return t("documents").select("doc_id", raw.alias("raw"))


@query(f"WITH {GUARD_SQL} SELECT doc_id, NOT (contains(upper(raw), 'UNSUPPORTED') AND NOT contains(string_split(upper(raw), 'UNSUPPORTED')[1], 'SUPPORTED')) AS balanced, starts_with({STRIP.format('upper(raw)')}, 'YES') AS strict FROM guard")
def parse_guard_verdict(t):
    return guard(t).select("doc_id", A.parse_guard_verdict(F.col("raw")).alias("balanced"), A.parse_guard_verdict(F.col("raw"), True).alias("strict"))


CODE_SQL = "raws AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'VERDICT: YES' || chr(10) || text || chr(10) || 'EXPLANATION: ' || lang || ' is there' WHEN 1 THEN 'NO ' || text || chr(10) || 'explanation: missing ' || source WHEN 2 THEN text || chr(10) || 'verdict: no' ELSE text END AS raw FROM documents)"


@query(
    f"""WITH {CODE_SQL}, u AS (SELECT *, {STRIP.format('raw')} AS s FROM raws), v AS (SELECT *, upper(s) AS up, list_slice(list_filter(regexp_split_to_array(upper(s), '\\s+'), lambda w: w <> ''), 1, 3) AS head, list_filter(string_split(s, chr(10)), lambda x: starts_with(upper(x), 'EXPLANATION:')) AS told FROM u),
k AS (SELECT *, contains(up, 'VERDICT: YES') OR starts_with(up, 'YES') AS yes, contains(up, 'VERDICT: NO') OR starts_with(up, 'NO') AS no FROM v)
SELECT doc_id, CASE WHEN yes THEN true WHEN no THEN false ELSE list_contains(head, 'YES') END AS passed, CASE WHEN yes OR no OR list_contains(head, 'YES') OR list_contains(head, 'NO') THEN CASE WHEN len(told) > 0 THEN {STRIP.format("regexp_replace(told[-1], '^[^:]*:', '')")} ELSE '' END ELSE left(s, 200) END AS explanation FROM k"""
)
def parse_code_verdict(t):
    n, text, line = F.col("doc_id") % 4, F.col("text"), F.lit("\n")
    raw = F.when(n == 0, F.concat(F.lit("VERDICT: YES\n"), text, F.lit("\nEXPLANATION: "), F.col("lang"), F.lit(" is there"))).when(n == 1, F.concat(F.lit("NO "), text, F.lit("\nexplanation: missing "), F.col("source"))).when(n == 2, F.concat(text, line, F.lit("verdict: no"))).otherwise(text)
    return t("documents").select("doc_id", A.parse_code_verdict(raw).alias("v")).select("doc_id", "v.*")


# The lines of a text as the code of an answer; the context lacks the ones with a word of it.
SQUEEZED = "regexp_replace({}, '\\s+', '', 'g')"


@query(
    f"""WITH f AS (SELECT doc_id, replace(text, '`', ' ') AS code, replace(replace(text, '`', ' '), 'st', 'ts') AS given FROM documents),
l AS (SELECT doc_id, unnest(string_split(code || chr(10) || 'y = x', chr(10))) AS line, {SQUEEZED.format("'code: y=x ' || given")} AS c FROM f),
k AS (SELECT doc_id, contains(c, {SQUEEZED.format('line')}) OR (regexp_extract(line, '\\bdef\\s+(\\w+)', 1) <> '' AND contains(c, regexp_extract(line, '\\bdef\\s+(\\w+)', 1))) AS ok FROM l WHERE length({SQUEEZED.format('line')}) > 2 AND NOT regexp_matches(line, '^\\s*#')),
g AS (SELECT doc_id, count(*) AS code_lines, count(*) FILTER (WHERE ok) AS grounded FROM k GROUP BY 1) SELECT doc_id, code_lines, grounded, round(grounded / code_lines, 6) >= 0.8 AS passed FROM documents LEFT JOIN g USING (doc_id)"""
)
def code_grounding(t):
    code = F.replace("text", F.lit("`"), F.lit(" "))
    answers = t("documents").select("doc_id", F.concat(F.lit("see\n```python\n"), code, F.lit("\ny = x\n```\n")).alias("answer"))
    context = t("documents").select("doc_id", F.concat(F.lit("code: y=x "), F.replace(code, F.lit("st"), F.lit("ts"))).alias("text"))
    return A.code_grounding(answers, context, "doc_id").select("doc_id", "code_lines", "grounded", "passed")


@query("SELECT item_id, sha256(lower(text) || '|' || 'm' || (item_id % 3)) AS entry_id FROM benchmark")
def cache_keys(t):
    return t("benchmark").select("item_id", H.cache_key(F.col("text"), F.concat(F.lit("m"), (F.col("item_id") % 3).cast("string"))).alias("entry_id"))


@query("SELECT doc_id, sha256(lower(lang) || '|' || 'a:' || source || ',z:' || lang) AS cache_key FROM documents")
def exact_cache_key(t):
    return t("documents").select("doc_id", H.exact_cache_key(F.col("lang"), F.create_map(F.lit("z"), F.col("lang"), F.lit("a"), F.col("source"))).alias("cache_key"))


@query(
    "WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) = 1) "
    "SELECT query_id, entry_id, similarity, similarity >= 0.5 AND entry_id % 3 = query_id % 3 AS hit FROM n"
)
def cache_lookup(t):
    """Every row is an entry; a question's own row is among its two nearest or farther than both."""
    two = X.dense_topk(t("embeddings"), t("embeddings").filter("vec_id % 20 = 0"), 2).filter("vec_id <> query_id")
    best = two.groupBy("query_id").agg(F.min_by(F.struct(F.col("vec_id").alias("entry_id"), "similarity"), F.struct(-F.col("similarity"), F.col("vec_id"))).alias("b"))
    nearest = best.select("query_id", "b.*")
    entries = t("embeddings").select(F.col("vec_id").alias("entry_id"), F.lit("v1").alias("kb_version"), (F.col("vec_id") % 3).alias("model"))
    asked = t("embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.lit("v1").alias("kb_version"), (F.col("vec_id") % 3).alias("model"))
    return H.cache_lookup(nearest, entries, asked, 0.5).select("query_id", "entry_id", "similarity", "hit")


@query(
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, TIMESTAMP '2024-01-01' + INTERVAL 1 second * (vec_id * 7919 % 100003) AS ts, vec_id % 3 AS model, 'v' || (vec_id % 2) AS kb FROM embeddings), "
    "n AS (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON b.ts < a.ts AND b.model = a.model AND b.kb = a.kb WHERE a.vec_id % 20 = 0 "
    "QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) = 1) "
    "SELECT vec_id AS query_id, entry_id, similarity, coalesce(similarity >= 0.4, false) AS hit FROM e LEFT JOIN n ON n.query_id = e.vec_id WHERE vec_id % 20 = 0"
)
def cache_lookup_asof(t):
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 7919 % 100003)
    every = t("embeddings").select("vec_id", "embedding", ts.alias("ts"), (F.col("vec_id") % 3).alias("model"), F.concat(F.lit("v"), (F.col("vec_id") % 2).cast("string")).alias("kb_version"))
    return H.cache_lookup_asof(every.withColumnRenamed("vec_id", "entry_id"), every.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 0.4)


@query("WITH a AS (SELECT sha256(lower(text) || '|m') AS entry_id, item_id AS answer_no FROM benchmark WHERE item_id % 3 <> 0 AND trim(text) <> ''), e AS (SELECT sha256(lower(text) || '|m') AS entry_id, -1 AS answer_no FROM benchmark WHERE item_id % 2 = 0) SELECT * FROM e WHERE entry_id NOT IN (SELECT entry_id FROM a) UNION ALL SELECT * FROM a")
def cache_store(t):
    base = t("benchmark").withColumn("model", F.lit("m")).withColumn("entry_id", H.cache_key(F.col("text"), F.col("model")))
    entries = base.filter("item_id % 2 = 0").select("entry_id", F.lit(-1).cast("long").alias("answer_no"))
    fresh = base.select(F.col("text").alias("question"), F.lit("yes").alias("answer"), (F.col("item_id") % 3).alias("citations"), "model", F.col("item_id").alias("answer_no"))
    return H.cache_store(entries, fresh)


# Case results from labels: scores by arithmetic on the ids, some missing.
CASES_SQL = """cases AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'policy' ELSE 'guidebook' END AS corpus, CASE doc_id % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'edge_case' ELSE 'code' END AS category, quality::DOUBLE AS hit_rate,
(doc_id % 11) / 10.0::DOUBLE AS context_precision, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 13) / 12.0::DOUBLE END AS faithfulness, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 17) / 16.0::DOUBLE END AS answer_relevancy, toxic = 1 AS guard_modified,
CASE WHEN doc_id % 19 = 0 THEN 'code_validation' ELSE 'none' END AS fallback_reason, doc_id % 4 = 0 AS code_validation_triggered, doc_id % 8 = 0 AS code_validation_passed FROM labels)"""


def cases(t):
    c = F.col("doc_id")
    return t("labels").select(
        c.alias("case_id"), F.when(c % 2 == 0, "policy").otherwise("guidebook").alias("corpus"), F.when(c % 3 == 0, "factual").when(c % 3 == 1, "edge_case").otherwise("code").alias("category"), F.col("quality").cast("double").alias("hit_rate"),
        ((c % 11) / 10.0).alias("context_precision"), F.when(c % 7 != 0, (c % 13) / 12.0).alias("faithfulness"), F.when(c % 5 != 0, (c % 17) / 16.0).alias("answer_relevancy"), (F.col("toxic") == 1).alias("guard_modified"),
        F.when(c % 19 == 0, "code_validation").otherwise("none").alias("fallback_reason"), (c % 4 == 0).alias("code_validation_triggered"), (c % 8 == 0).alias("code_validation_passed"),
    )


METRICS = ["hit_rate", "context_precision", "faithfulness", "answer_relevancy"]


@query(f"WITH {CASES_SQL} SELECT CASE WHEN grouping(corpus) = 0 THEN 'corpus' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS dimension, coalesce(corpus, category, 'all') AS value, count(*) AS cases, {', '.join(f'round(avg({m}), 6) AS {m}' for m in METRICS)}, round(avg(CASE WHEN code_validation_triggered THEN CASE WHEN code_validation_passed THEN 1.0 ELSE 0.0 END END), 6) AS code_validation_pass_rate, round(avg(CASE WHEN fallback_reason = 'code_validation' THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_fallback_rate FROM cases GROUP BY GROUPING SETS ((), (corpus), (category))")
def aggregate_metrics(t):
    return E.aggregate_metrics(cases(t), METRICS, ["corpus", "category"])


@query(
    f"""WITH {CASES_SQL}, b AS (SELECT case_id, unnest(list_filter([CASE WHEN hit_rate < 1 THEN 'retrieval_miss' END, CASE WHEN context_precision < 0.5 THEN 'low_context_precision' END, CASE WHEN faithfulness < 0.8 THEN 'low_faithfulness' END, CASE WHEN answer_relevancy < 0.75 THEN 'low_relevancy' END,
CASE WHEN guard_modified THEN 'faithfulness_guard_abstention' END, CASE WHEN fallback_reason = 'code_validation' THEN 'code_validation_fallback' END, CASE WHEN code_validation_triggered AND NOT code_validation_passed THEN 'code_validation_failed' END,
CASE WHEN category = 'edge_case' AND answer_relevancy < 0.75 THEN 'abstention_failure' END], lambda x: x IS NOT NULL)) AS bucket FROM cases) SELECT * FROM b"""
)
def failure_buckets(t):
    return E.failure_buckets(cases(t))


@query(f"WITH {CASES_SQL} SELECT case_id, faithfulness, answer_relevancy FROM cases ORDER BY CASE WHEN coalesce(faithfulness, 0) = 0 THEN 1 ELSE faithfulness END, CASE WHEN coalesce(answer_relevancy, 0) = 0 THEN 1 ELSE answer_relevancy END, case_id LIMIT 5")
def worst_cases(t):
    return E.worst_cases(cases(t)).select("case_id", "faithfulness", "answer_relevancy")


@query(f"WITH {CASES_SQL}, l AS ({' UNION ALL '.join(f"SELECT case_id, '{m}' AS metric, {m} AS v FROM cases" for m in METRICS)}) SELECT case_id, metric, v AS before, CASE WHEN metric = 'hit_rate' THEN v ELSE v + case_id % 3 / 4.0::DOUBLE END AS after, round(CASE WHEN metric = 'hit_rate' THEN 0 ELSE case_id % 3 / 4.0::DOUBLE END + v - v, 6) AS delta FROM l")
def compare_runs(t):
    later = cases(t)
    for m in METRICS[1:]:
        later = later.withColumn(m, F.col(m) + F.col("case_id") % 3 / 4.0)
    return E.compare_runs(cases(t), later, METRICS)


@query(f"WITH {CASES_SQL}, m AS (SELECT avg(hit_rate) AS hit_rate, avg(context_precision) AS context_precision, avg(faithfulness) AS faithfulness FROM cases), l AS (SELECT 'hit_rate' AS metric, hit_rate AS v, 0.99::DOUBLE AS floor FROM m UNION ALL SELECT 'context_precision', context_precision, 0.1 FROM m UNION ALL SELECT 'faithfulness', faithfulness, 0.9 FROM m UNION ALL SELECT 'missing', NULL, 0.5) SELECT metric, round(v, 6) AS value, floor FROM l WHERE v IS NULL OR v < floor")
def metric_gate(t):
    means = cases(t).agg(*[F.avg(m).alias(m) for m in METRICS[:3]]).withColumn("missing", F.lit(None).cast("double"))
    return E.metric_gate(means, {"hit_rate": 0.99, "context_precision": 0.1, "faithfulness": 0.9, "missing": 0.5}).withColumn("value", F.round("value", 6))


@query(f"WITH {CASES_SQL}, s AS (SELECT count(*) AS n, corr(context_precision, faithfulness) AS r, avg(abs(context_precision - faithfulness)) AS mae, avg((abs(context_precision - faithfulness) <= 0.1 + 1e-12)::INT) AS w, avg(((context_precision >= 0.5) = (faithfulness >= 0.5))::INT) AS po, avg((context_precision >= 0.5)::INT) AS px, avg((faithfulness >= 0.5)::INT) AS py FROM cases WHERE faithfulness IS NOT NULL) SELECT n, round(r, 6) AS pearson, round(mae, 6) AS mae, round(w, 6) AS within, round((po - (px * py + (1 - px) * (1 - py))) / (1 - (px * py + (1 - px) * (1 - py))), 6) AS kappa FROM s")
def agreement(t):
    return E.agreement(cases(t).filter("faithfulness is not null"), "context_precision", "faithfulness")


@query("SELECT 'c' || item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'general' ELSE 'facts' END AS category, text AS question, CASE WHEN item_id % 2 = 0 THEN text ELSE '' END AS expected_answer, [split_part(text, ' ', 1)] AS expected_key_points, CASE WHEN item_id % 3 = 0 THEN 'factual' ELSE 'facts' END AS query_type FROM benchmark WHERE text IS NOT NULL AND item_id % 5 <> 0")
def load_golden(t):
    n = F.col("item_id")
    case = F.struct(F.concat(F.lit("c"), n.cast("string")).alias("id"), F.when(n % 3 != 0, "facts").alias("category"), F.col("text").alias("question"), F.when(n % 2 == 0, F.col("text")).alias("expected_answer"), F.array(F.split("text", " ")[0]).alias("expected_key_points"), F.when(n % 5 == 0, "guidebook").alias("corpus"))
    files = t("benchmark").select(F.to_json(F.struct(F.array(case).alias("cases"))).alias("content"))
    return E.golden_cases(files, corpus="policy").select("id", "category", "question", "expected_answer", "expected_key_points", "query_type")


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_summary(t):
    return E.latency_summary(t("events").withColumnRenamed("event_type", "stage"), value="value")


JUDGE_TEXT = "regexp_replace(text, '[^\\x20-\\x7E]|[{}\"\\\\]', '.', 'g')"


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN round(n_chars % 97 / 97.0::DOUBLE, 4) WHEN 1 THEN 1.0 END::DOUBLE AS score, CASE WHEN doc_id % 3 < 2 THEN {JUDGE_TEXT} ELSE left({STRIP.format(JUDGE_TEXT)}, 300) END AS reasoning FROM documents")
def parse_judge_scores(t):
    n, text = F.col("doc_id") % 3, F.regexp_replace("text", r'[^\x20-\x7E]|[{}"\\]', ".")
    given = F.concat(F.lit('{"score": '), F.round(F.col("n_chars") % 97 / 97.0, 4).cast("string"), F.lit(', "reasoning": "'), text, F.lit('"}'))
    raw = F.when(n == 0, given).when(n == 1, F.concat(F.lit('I think {"score": 1, "reasoning": "'), text, F.lit('"} holds'))).otherwise(text)
    return t("documents").select("doc_id", E.parse_judge_scores(raw).alias("j")).select("doc_id", "j.*")


@query(
    f"""WITH {BM25}, g AS (SELECT item_id AS query_id, unnest([split_part(lower(text), ' ', 1), 'the of', split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)]) AS keyword FROM benchmark), w AS (SELECT * FROM g WHERE trim(keyword) <> ''),
h AS (SELECT query_id, chunk_id AS id, lower(d.text) AS s FROM sparse JOIN documents d ON d.doc_id = chunk_id),
tok AS (SELECT query_id, keyword, regexp_replace(lower(keyword), '^\\s+|\\s+$', '', 'g') AS needle, list_filter(regexp_split_to_array(regexp_replace(lower(keyword), '^\\s+|\\s+$', '', 'g'), '[^a-z0-9_]+'), lambda x: length(x) > 3) AS tk FROM w),
rel AS (SELECT h.query_id, count(DISTINCT id) AS relevant FROM h JOIN tok USING (query_id) WHERE contains(s, needle) OR (len(tk) > 0 AND len(list_filter(tk, lambda x: contains(s, x))) = len(tk)) GROUP BY 1),
told AS (SELECT query_id, count(*) AS total, string_agg(s, ' ' ORDER BY s) AS s FROM h GROUP BY 1),
rec AS (SELECT tok.query_id, count(*) AS expected, count(*) FILTER (WHERE told.s IS NOT NULL AND (contains(told.s, needle) OR len(list_filter(tk, lambda x: contains(told.s, x))) = len(tk))) AS matched FROM tok LEFT JOIN told USING (query_id) GROUP BY 1)
SELECT query_id, CASE WHEN coalesce(relevant, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, CASE WHEN total > 0 THEN round(coalesce(relevant, 0)::DOUBLE / total, 6) ELSE 0 END AS context_precision, CASE WHEN total IS NULL THEN 0 WHEN expected IS NULL THEN 1 ELSE round(matched::DOUBLE / expected, 6) END AS context_recall, coalesce(relevant, 0) AS relevant, coalesce(expected, 0) AS expected
FROM (SELECT DISTINCT query_id FROM g) LEFT JOIN told USING (query_id) LEFT JOIN rel USING (query_id) LEFT JOIN rec USING (query_id)"""
)
def retrieval_metrics(t):
    part = lambda i: F.coalesce(F.get(F.split("text", " "), F.lit(i)), F.lit(""))
    golden = t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lower(part(0)), F.lit("the of"), F.concat(part(2), F.lit(" "), part(3)))).alias("keyword"))
    return E.retrieval_metrics(with_context(t, sparse_hits(t)).select("query_id", "text"), golden)


TRACES = "traces AS (SELECT event_id AS trace_id, ts, value AS latency FROM events)"
USAGE = "usage AS (SELECT event_id AS trace_id, ts, value AS latency, value / 4 AS ttft, event_id % 50 AS prompt_tokens, event_id % 90 AS completion_tokens, event_id % 100 / 128.0::DOUBLE AS similarity, CASE WHEN event_id % 3 > 0 THEN event_id % 7 / 8.0::DOUBLE END AS rerank FROM events)"


def traces(t):
    return t("events").select(F.col("event_id").alias("trace_id"), "ts", F.col("value").alias("latency"))


@query(
    f"WITH {USAGE}, r AS (SELECT * FROM usage ORDER BY ts DESC, trace_id DESC LIMIT 1000), l AS (SELECT list(latency ORDER BY latency) AS l, avg(latency) AS m, avg(ttft) AS f, avg(similarity) AS s, avg(rerank) AS k FROM r), "
    "a AS (SELECT count(*) AS total_queries, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM usage) "
    "SELECT a.*, prompt_tokens + completion_tokens AS total_tokens, round(m, 2) AS avg_latency_ms, round(f, 2) AS avg_ttft_ms, round(l[CAST(least(floor(len(l) * 0.95), len(l) - 1) AS BIGINT) + 1], 2) AS p95_latency_ms, round(s, 4) AS similarity_avg, round(k, 4) AS rerank_avg FROM l, a"
)
def trace_metrics(t):
    c = F.col("event_id")
    used = t("events").select(c.alias("trace_id"), "ts", F.col("value").alias("latency"), (F.col("value") / 4).alias("ttft"), (c % 50).alias("prompt_tokens"), (c % 90).alias("completion_tokens"), (c % 100 / 128).alias("similarity"), F.when(c % 3 > 0, c % 7 / 8).alias("rerank"))
    return T.trace_metrics(used)


@query(f"WITH {TRACES} SELECT * FROM traces ORDER BY ts DESC, trace_id DESC LIMIT 50 OFFSET 10")
def recent_traces(t):
    return T.recent_traces(traces(t), 50, 10)


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 6 hour, ts) - i * INTERVAL 6 hour AS window_start, value FROM events, range(4) r(i) WHERE ts IS NOT NULL)
SELECT window_start, count(*) AS n, round(sum(value), 3) AS total, true AS p50_held, true AS p95_held FROM w WHERE window_start + INTERVAL 24 hour <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 hour FROM events) GROUP BY 1"""
)
def stream_trace_quantiles(t):
    """A day's windows every six hours, appended by a stream; held: the window's rows at or below the sketch's quantile are the share wanted, within the stated error."""
    rows = traces(t).select(F.col("ts").cast("timestamp").alias("ts"), "latency")
    stream = jobs.trace_quantiles(streamed(rows, "trace-rows"), "24 hours", "6 hours", "1 hour")
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "trace-quantiles")
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "trace-quantiles-log")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(stream.schema).parquet(path)
    met = rows.filter("ts is not null").select(F.window("ts", "24 hours", "6 hours").alias("w"), "latency").join(told, F.col("w.start") == F.col("window_start"))
    share = lambda c, q: ((F.avg((F.col("latency") < F.col(c)).cast("int")) - jobs.RANK_ERROR <= q) & (F.avg((F.col("latency") <= F.col(c)).cast("int")) + jobs.RANK_ERROR >= q)).alias(f"{c}_held")
    return met.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round(F.col("mean") * F.col("n"), 3).alias("total")).agg(share("p50", 0.5), share("p95", 0.95))


@query("SELECT count(*) FILTER (WHERE event_type = 'purchase') AS up, count(*) FILTER (WHERE event_type = 'error') AS down, count(*) AS total, (SELECT list(event_id ORDER BY ts, event_id) FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)) AS recent FROM events")
def feedback_summary(t):
    return T.feedback_summary(t("events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0).alias("rating")))


@query("SELECT doc_id, lang, source, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 20")
def list_documents(t):
    return T.list_documents(t("documents").select("doc_id", "lang", "source"), F.col("lang") == "en", 20, 1)


@query(f"WITH {BM25}, h AS (SELECT query_id, d.source FROM sparse JOIN documents d ON d.doc_id = chunk_id), u AS (SELECT query_id, count(*) AS n_chunks, list_sort(list_distinct(list(source))) AS sources FROM h GROUP BY 1) SELECT item_id AS query_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS prompt_tokens, n_chunks, sources FROM benchmark LEFT JOIN u ON u.query_id = item_id")
def trace_from_answers(t):
    hits = with_context(t, sparse_hits(t))
    answers = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("text").alias("answer"))
    return T.trace_from_answers(answers, hits).select("query_id", "prompt_tokens", "n_chunks", "sources")


def streamed(df, name: str):
    """The table as a stream of its rows, over a copy in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def result_of(stream, name: str):
    """The last state of a stream's result table, once all its rows are in."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    job = stream.writeStream.outputMode("complete").foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(path)).option("checkpointLocation", scratch_path(spark, f"{name}-log")).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_trace_metrics(t):
    return result_of(jobs.trace_windows(streamed(traces(t).withColumn("ts", F.col("ts").cast("timestamp")), "traces")), "trace-windows").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "mean")


@query("SELECT count(*) FILTER (WHERE event_type = 'purchase') AS up, count(*) FILTER (WHERE event_type = 'error') AS down, count(*) AS total FROM events")
def stream_feedback(t):
    rating = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return result_of(jobs.stream_feedback(streamed(t("events").select(F.col("event_id").cast("string").alias("id"), rating.alias("rating")), "feedback")), "feedback-totals")


@query("SELECT doc_id, left(sha256(text), 16) AS content_hash FROM documents WHERE regexp_matches(text, '[^\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]')")
def stream_ingest(t):
    """All documents through the ingesting stream: one that has a chunk is in the table under its hash."""
    from ..operators.chunking import chunk_recursive

    docs = t("documents").select("doc_id", "text")
    table = scratch_path(docs.sparkSession, "ingested")
    jobs.ingest(streamed(docs, "inbox"), table, chunk_recursive, scratch_path(docs.sparkSession, "ingest-log")).awaitTermination()
    return jobs.current_chunks(docs.sparkSession, table).select("doc_id", "content_hash").distinct()


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events), s AS (SELECT user_id, min(ts) AS start, 1 AS session FROM e GROUP BY 1
UNION ALL SELECT s.user_id, (SELECT min(ts) FROM e WHERE e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 24 hour), s.session + 1 FROM s WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 24 hour))
SELECT s.user_id, s.session, s.start AS session_start, count(*) AS n FROM s JOIN events v ON v.user_id = s.user_id AND v.ts >= s.start AND v.ts < s.start + INTERVAL 24 hour GROUP BY ALL"""
)
def stream_sessions(t):
    """All events through the stream: a session's last row holds."""
    spark, path = t("events").sparkSession, scratch_path(t("events").sparkSession, "sessions")
    name, provider = jobs.STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        stream = jobs.stream_sessions(streamed(t("events").select("user_id", "ts"), "events"))
        keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch_path(spark, "sessions-log")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    last = F.max_by(F.struct("session_start", "n"), F.struct("batch", F.col("n"), F.col("closed"))).alias("s")
    return spark.read.parquet(path).groupBy("user_id", "session").agg(last).select("user_id", "session", F.col("s.session_start").cast("timestamp_ntz").alias("session_start"), "s.n")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events), s AS (SELECT user_id, min(ts) AS start, 1 AS session FROM e GROUP BY 1
UNION ALL SELECT s.user_id, (SELECT min(ts) FROM e WHERE e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 24 hour), s.session + 1 FROM s WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 24 hour))
SELECT s.user_id, s.session, s.start AS session_start, count(*) AS n FROM s JOIN events v ON v.user_id = s.user_id AND v.ts >= s.start AND v.ts < s.start + INTERVAL 24 hour GROUP BY ALL"""
)
def sessions(t):
    return jobs.sessions(t("events").select("user_id", "ts")).groupBy("user_id", "session", "session_start").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'code' WHEN contains(text, '|') THEN 'diagram' ELSE 'section' END AS kind FROM documents QUALIFY row_number() OVER (PARTITION BY CASE WHEN contains(lower(text), 'license') THEN 'code' WHEN contains(text, '|') THEN 'diagram' ELSE 'section' END ORDER BY length(text) DESC, doc_id) <= 20")
def golden_candidates(t):
    kind = F.when(F.lower("text").contains("license"), "code").when(F.col("text").contains("|"), "diagram").otherwise("section")
    return E.golden_candidates(t("documents"), kind, 20, "doc_id")


@query(f"WITH c AS (SELECT doc_id, replace(text, '`', ' ') AS s FROM documents) SELECT doc_id, {STRIP.format("regexp_replace(" + STRIP.format('s') + " || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '```' || chr(10) || 'x = 1' || chr(10) || '```' ELSE '' END, '\n{3,}', chr(10) || chr(10), 'g')")} AS answer FROM c")
def strip_ungrounded_code(t):
    text = F.replace("text", F.lit("`"), F.lit(" "))
    raw = F.concat(text, F.when(F.col("doc_id") % 3 == 0, "\n```\nx = 1\n```").otherwise("\nIt is defined as:\n```\ny = 2\n```"))
    return t("documents").select("doc_id", A.strip_ungrounded_code(raw, F.array(F.lit("y = 2"))).alias("answer"))


PARTIAL_TEXT = "Based on the available information, leave is paid for all staff after thirty days of work in the company, as the handbook says."


@query(f"WITH c AS (SELECT doc_id, {STRIP.format('text')} AS s FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {quoted(PARTIAL_TEXT)} || ' ' || s WHEN 1 THEN {STRIP.format(quoted(PARTIAL_TEXT) + " || ' ' || s")} ELSE {STRIP.format("'I am unable to answer this, ' || s")} END AS answer FROM c")
def normalize_answer(t):
    n, text = F.col("doc_id") % 3, strip(F.col("text"))
    raw = F.when(n == 0, F.concat(F.lit(PARTIAL_TEXT + " "), text, F.lit("\n\nI am unable to answer the rest."))).when(n == 1, F.concat(F.lit("I am unable to answer. " + PARTIAL_TEXT + " "), text)).otherwise(F.concat(F.lit("I am unable to answer this, "), text))
    return t("documents").select("doc_id", A.normalize_answer(raw).alias("answer"))


@query(
    f"WITH {REPORT_SQL}, g AS (SELECT doc_id, quality, toxic FROM labels) SELECT g.doc_id AS case_id, faithfulness, completeness, passed, g.quality::DOUBLE AS hit_rate, {ABSTAINS} AND toxic = 1 AS guard_modified FROM g JOIN rp USING (doc_id) JOIN judged USING (doc_id)"
)
def case_results(t):
    cases = t("labels").select(F.col("doc_id").alias("case_id"), F.col("quality").cast("double").alias("hit_rate"), (F.col("toxic") == 1).alias("guarded"))
    return E.case_results(cases, reports(t).withColumnRenamed("doc_id", "case_id")).drop("guarded")


@query("SELECT event_id AS trace_id, ts, value AS latency FROM events WHERE event_id IN (SELECT doc_id FROM labels)")
def trace_by_id(t):
    return T.trace_by_id(traces(t), t("labels").select(F.col("doc_id").alias("trace_id")))
