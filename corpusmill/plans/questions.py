"""Question, history and filter queries over benchmark, conversations and rule-bearing variants of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import questions as Q
from .corpus import quoted, words_rx
from .registry import query

# A lead-in for each question, by its id, so that every rule is met in every table.
LEADS = (
    "How do I ", "List all ", "Compare these: ", "hello", "What are the IT policy steps for ", "tell me more", "Does HR pay for health insurance and vacation, including pto (a, b), sick leave, ",
    "Explain the building blocks of an agent ", "show a custom tool for currency ", "你好世界再见 ", "The employee handbook on expense report and ethics ", "it", "",
)
ASKED_SQL = "asked AS (SELECT item_id AS query_id, CASE item_id % 13 " + " ".join(f"WHEN {i} THEN {quoted(x)}" + ("" if x in ("hello", "tell me more", "it") else " || text") for i, x in enumerate(LEADS)) + " END AS text FROM benchmark)"
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
WORDS = r"len(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''))"


def asked(t):
    lead = F.element_at(F.array(*[F.lit(x) for x in LEADS]), (F.col("item_id") % 13 + 1).cast("int"))
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.when(lead.isin("hello", "tell me more", "it"), lead).otherwise(F.concat(lead, F.col("text"))).alias("text"))


def any_sql(words, column: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


INTENT = f"CASE WHEN {STRIP} = '' THEN 'empty' WHEN regexp_matches({STRIP}, {quoted(R.COMPARISON)}) THEN 'comparison' WHEN regexp_matches({STRIP}, {quoted(R.ENUMERATION)}) THEN 'enumeration' WHEN regexp_matches({STRIP}, {quoted(R.PROCEDURAL)}) THEN 'procedural' WHEN {WORDS.format(STRIP)} <= 7 AND regexp_matches({STRIP}, {quoted(R.GREETING)}) THEN 'conversational' ELSE 'factual' END"
TERMS = "list_filter([" + ", ".join(f"CASE WHEN {any_sql(tr)} THEN {quoted(w)} END" for tr, w in R.POLICY_TERMS + R.GUIDE_TERMS) + "], lambda x: x IS NOT NULL)"
GROWN = f"CASE WHEN len({TERMS}) > 0 THEN text || ' ' || array_to_string({TERMS}, ' ') ELSE text END"
FOLLOWUP = f"({STRIP} <> '' AND (regexp_matches(lower({STRIP}), {quoted(R.PRONOUNS)}) OR regexp_matches(lower({STRIP}), {quoted(R.REFERENCES)}) OR ({WORDS.format(STRIP)} <= 3 AND len({TERMS}) = 0)))"


@query(f"WITH {ASKED_SQL} SELECT query_id, {INTENT} AS intent FROM asked")
def classify_intent(t):
    return asked(t).select("query_id", Q.classify_intent(F.col("text")).alias("intent"))


@query(f"WITH {ASKED_SQL}, i AS (SELECT query_id, {INTENT} AS intent FROM asked), s(intent, confidence, strategy, dense_top_k, rerank_top_n, min_score_ratio) AS (VALUES " + ", ".join(f"({quoted(r[0])}, {r[1]}::DOUBLE, {quoted(r[2])}, {r[3]}, {r[6]}, {r[7]}::DOUBLE)" for r in R.STRATEGIES) + ") SELECT query_id, CASE WHEN intent = 'empty' THEN 'factual' ELSE intent END AS intent, confidence, strategy, dense_top_k, rerank_top_n, min_score_ratio FROM i JOIN s USING (intent)")
def select_strategy(t):
    return Q.select_strategy(asked(t)).select("query_id", "intent", "confidence", "strategy", "dense_top_k", "rerank_top_n", "min_score_ratio")


@query(f"WITH {ASKED_SQL} SELECT query_id, ({WORDS.format(STRIP)} <= 6 AND regexp_matches({STRIP}, {quoted(R.SMALLTALK)})) AS bypass FROM asked")
def conversational_bypass(t):
    return asked(t).select("query_id", Q.is_conversational(F.col("text")).alias("bypass"))


@query(f"WITH {ASKED_SQL} SELECT query_id, {GROWN} AS expanded FROM asked")
def expand_terms(t):
    return asked(t).select("query_id", Q.expand_terms(F.col("text")).alias("expanded"))


@query(f"WITH {ASKED_SQL} SELECT query_id, (length({STRIP}) >= 20 AND regexp_matches({STRIP}, {quoted(R.LIST_PATTERNS)})) AS comprehensive FROM asked")
def is_comprehensive(t):
    return asked(t).select("query_id", Q.is_comprehensive(F.col("text")).alias("comprehensive"))


@query(f"WITH {ASKED_SQL} SELECT query_id, CASE WHEN {any_sql(R.POLICY_WORDS)} THEN 'policy' WHEN {any_sql(R.GUIDE_WORDS)} THEN 'guidebook' WHEN " + " OR ".join(any_sql(tr) for tr, _ in R.GUIDE_TERMS) + " THEN 'guidebook' WHEN " + " OR ".join(any_sql(tr) for tr, _ in R.POLICY_TERMS) + " THEN 'policy' END AS corpus FROM asked")
def detect_corpus(t):
    return asked(t).select("query_id", Q.detect_corpus(F.col("text")).alias("corpus"))


@query(f"WITH {ASKED_SQL} SELECT query_id, {FOLLOWUP} AS followup FROM asked")
def is_followup(t):
    return asked(t).select("query_id", Q.is_followup(F.col("text")).alias("followup"))


# Conversations with an opening that refers back in some of the later user turns.
SAID_SQL = "said AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn > 0 AND (conv_id + turn) % 3 = 0 THEN 'and it?' WHEN role = 'user' AND conv_id % 4 = 0 THEN 'Finance ' || text ELSE text END AS text FROM conversations)"


def said(t):
    text = F.when((F.col("role") == "user") & (F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 3 == 0), "and it?").when((F.col("role") == "user") & (F.col("conv_id") % 4 == 0), F.concat(F.lit("Finance "), F.col("text"))).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", "role", text.alias("text"))


BEFORE = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {SAID_SQL}, u AS (SELECT *, CASE WHEN role = 'user' AND {STRIP} <> '' THEN {STRIP} END AS s FROM said), k AS (SELECT *, first_value(s IGNORE NULLS) {BEFORE} AS f, last_value(s IGNORE NULLS) {BEFORE} AS l FROM u) SELECT conv_id, turn, CASE WHEN f IS NOT NULL AND {FOLLOWUP} THEN ({GROWN}) || ' ' || CASE WHEN f = l THEN f ELSE f || ' ' || l END ELSE {GROWN} END AS rewritten FROM k WHERE role = 'user'")
def rewrite_followup(t):
    return Q.rewrite_followup(said(t)).select("conv_id", "turn", "rewritten")


@query(f"WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || {STRIP} AS line FROM conversations) SELECT conv_id, turn, coalesce(array_to_string(list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), chr(10)), '') AS history FROM l")
def history_window(t):
    return Q.history_window(t("conversations")).select("conv_id", "turn", "history")


@query(f"WITH {ASKED_SQL} SELECT query_id, CASE WHEN c >= 3 AND c >= l THEN 'chinese' ELSE 'english' END AS language FROM (SELECT query_id, length(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]', '', 'g')) AS c, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM asked)")
def detect_language(t):
    return asked(t).select("query_id", Q.detect_language(F.col("text")).alias("language"))


@query(f"WITH {ASKED_SQL} SELECT query_id, regexp_matches({STRIP}, {quoted(R.CODE_PATTERNS)}) AS code, {any_sql(R.EDGE_WORDS)} AS edge FROM asked")
def is_code_query(t):
    return asked(t).select("query_id", Q.is_code_query(F.col("text")).alias("code"), Q.is_edge_case_query(F.col("text")).alias("edge"))


def dept_list(column: str = "text") -> str:
    low = f"lower({column})"
    spaced = [f"CASE WHEN regexp_matches({low}, {quoted(words_rx([a]))}) THEN {quoted(n)} END" for n, al in R.DEPARTMENTS for a in al if " " in a]
    special = [
        f"CASE WHEN regexp_matches({column}, '\\bIT\\b') OR regexp_matches({low}, {quoted(Q.IT_AFTER)}) OR regexp_matches({low}, {quoted(words_rx(Q.IT_WORDS))}) THEN 'IT' END",
        f"CASE WHEN regexp_matches({low}, {quoted(words_rx(Q.HR_WORDS))}) THEN 'HR' END",
    ]
    single = [f"CASE WHEN regexp_matches({low}, {quoted(words_rx(ws))}) THEN {quoted(n)} END" for n, ws in Q.SINGLE_WORDS]
    return "list_filter([" + ", ".join(spaced + special + single) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {ASKED_SQL}, l AS (SELECT query_id, {dept_list()} AS l FROM asked) SELECT query_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS departments FROM l")
def detect_department(t):
    return asked(t).select("query_id", Q.detect_departments(F.col("text")).alias("departments"))


TOPIC_HITS = "list_filter([CASE WHEN " + any_sql(("pto", "vacation", "sick leave", "benefits", "health insurance", "parental leave", "paid time off")) + " THEN 'benefits' END, " + ", ".join(f"CASE WHEN regexp_matches(lower(text), {quoted(words_rx(ws))}) THEN {quoted(n)} END" for n, ws in R.TOPICS) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {ASKED_SQL} SELECT query_id, {TOPIC_HITS} AS topics FROM asked")
def detect_topic(t):
    return asked(t).select("query_id", Q.detect_topics(F.col("text")).alias("topics"))


@query(f"WITH {ASKED_SQL} SELECT query_id, CASE WHEN regexp_matches(lower(text), '\\b(legal\\s+document|legal\\s+contract|agreement|nda)\\b') THEN 'legal' WHEN regexp_matches(lower(text), '\\b(guidebook|employee\\s+guide|manual|handbook)\\b') THEN 'guidebook' WHEN regexp_matches(lower(text), '\\bpolicy\\b') THEN 'policy' END AS category FROM asked")
def detect_category(t):
    return asked(t).select("query_id", Q.detect_category(F.col("text")).alias("category"))


@query(f"WITH {SAID_SQL}, d AS (SELECT *, {dept_list()} AS l FROM said), e AS (SELECT *, CASE WHEN role = 'user' AND len(l) > 0 THEN l END AS own FROM d), k AS (SELECT *, last_value(own IGNORE NULLS) {BEFORE} AS old FROM e) SELECT conv_id, turn, CASE WHEN turn % 5 = 0 AND conv_id % 2 = 0 THEN ['Legal'] ELSE coalesce(own, old) END AS departments FROM k WHERE role = 'user'")
def infer_filters(t):
    """Some turns come with a department of their own, which wins."""
    given = F.when((F.col("turn") % 5 == 0) & (F.col("conv_id") % 2 == 0), F.array(F.lit("Legal")))
    return Q.infer_filters(said(t), {"departments": given}).select("conv_id", "turn", "departments")


@query()
def multi_query(t):
    return Q.multi_query(asked(t))


# Questions that name policies in all forms.
NAMED = ("under POL-HR-001 ", "see policy 42: ", "policy #5.2, ", "in 2024 ", "HR-101. ", "IT-SEC-2024-v2 ", "section 7 ", "")
NAMED_SQL = "named AS (SELECT item_id AS query_id, CASE item_id % 8 " + " ".join(f"WHEN {i} THEN {quoted(x)} || text" for i, x in enumerate(NAMED)) + " END AS text FROM benchmark)"


def policy_sql(pattern: str) -> str:
    p, name = quoted(pattern), f"regexp_replace(regexp_extract(text, {quoted(pattern)}, 1), '^[\\s.,;:|()\\[\\]{{}}]+|[\\s.,;:|()\\[\\]{{}}]+$', '', 'g')".replace("{{}}", "{}")
    return f"CASE WHEN regexp_matches(text, {p}) THEN CASE WHEN regexp_matches({name}, '^\\d+$') THEN CASE WHEN NOT regexp_matches({name}, '^(19|20)\\d\\d$') AND contains(lower(regexp_extract(text, {p}, 0)), 'policy') THEN 'Policy ' || {name} END WHEN length({name}) >= 3 THEN {name} END END"


@query(f"WITH {NAMED_SQL} SELECT query_id, coalesce({', '.join(map(policy_sql, R.POLICY_ID_PATTERNS))}) AS policy_id FROM named")
def detect_policy_id(t):
    lead = F.element_at(F.array(*[F.lit(x) for x in NAMED]), (F.col("item_id") % 8 + 1).cast("int"))
    return t("benchmark").select(F.col("item_id").alias("query_id"), Q.detect_policy_id(F.concat(lead, F.col("text"))).alias("policy_id"))
