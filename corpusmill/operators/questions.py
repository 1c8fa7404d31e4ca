"""Question understanding: projections over a table of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions.text import strip


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify_intent(text: Column) -> Column:
    q = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(q == "", "empty")
        .when(q.rlike(R.COMPARISON), "comparison")
        .when(q.rlike(R.ENUMERATION), "enumeration")
        .when(q.rlike(R.PROCEDURAL), "procedural")
        .when((word_count(q) <= 7) & q.rlike(R.GREETING), "conversational")
        .otherwise("factual")
    )


def strategies(spark: SparkSession) -> DataFrame:
    """The dimension table of retrieval parameters: six rows."""
    schema = "intent string, confidence double, strategy string, dense_top_k int, bm25_top_k int, rrf_k int, rerank_top_n int, min_score_ratio double, multi_query boolean, parent_expansion boolean, temperature double"
    return spark.createDataFrame(R.STRATEGIES, schema)


def select_strategy(questions: DataFrame, text: str = "text") -> DataFrame:
    """Adds the intent, its confidence and its parameters; below 0.70 the balanced ones, which is the row of empty questions."""
    table = F.broadcast(strategies(questions.sparkSession))
    return questions.withColumn("intent", classify_intent(F.col(text))).join(table, "intent").withColumn("intent", F.when(F.col("intent") == "empty", "factual").otherwise(F.col("intent")))


def is_conversational(text: Column) -> Column:
    q = strip(text)
    return (word_count(q) <= 6) & q.rlike(R.SMALLTALK)


def expansions(text: Column, terms=R.POLICY_TERMS + R.GUIDE_TERMS) -> Column:
    """The vocabularies whose trigger phrases occur, in table order."""
    q = F.lower(text)
    return F.filter(F.array(*[F.when(contains_any(q, triggers), words) for triggers, words in terms]), lambda x: x.isNotNull())


def expand_terms(text: Column) -> Column:
    found = expansions(text)
    return F.when(F.size(found) > 0, F.concat(text, F.lit(" "), F.array_join(found, " "))).otherwise(text)


def is_comprehensive(text: Column, minimum: int = 20) -> Column:
    q = strip(text)
    return (F.length(q) >= minimum) & q.rlike(R.LIST_PATTERNS)


def detect_corpus(text: Column) -> Column:
    q = F.lower(text)
    return (
        F.when(contains_any(q, R.POLICY_WORDS), "policy")
        .when(contains_any(q, R.GUIDE_WORDS), "guidebook")
        .when(F.size(expansions(text, R.GUIDE_TERMS)) > 0, "guidebook")
        .when(F.size(expansions(text, R.POLICY_TERMS)) > 0, "policy")
    )


def is_followup(text: Column) -> Column:
    q = F.lower(strip(text))
    short = (word_count(q) <= 3) & (F.size(expansions(text)) == 0)
    return (q != "") & (q.rlike(R.PRONOUNS) | q.rlike(R.REFERENCES) | short)


def rewrite_followup(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text): a user turn that follows up gets the first and the last earlier user turn appended."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & (strip(F.col("text")) != ""), strip(F.col("text")))
    known = messages.withColumn("_first", F.first(said, ignorenulls=True).over(before)).withColumn("_last", F.last(said, ignorenulls=True).over(before))
    context = F.when(F.col("_first") == F.col("_last"), F.col("_first")).otherwise(F.concat_ws(" ", "_first", "_last"))
    grown = expand_terms(F.col("text"))
    rewritten = F.when(is_followup(F.col("text")) & F.col("_first").isNotNull(), F.concat_ws(" ", grown, context)).otherwise(grown)
    return known.filter("role = 'user'").withColumn("rewritten", rewritten).drop("_first", "_last")


def history_window(messages: DataFrame, turns: int = 4) -> DataFrame:
    """Adds history: the 2 * turns messages before each one as lines `Role: text`."""
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), strip(F.coalesce("text", F.lit(""))))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * turns, -1)
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))


def detect_language(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit("[一-鿿぀-ヿ가-힯]"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((cjk >= 3) & (cjk >= latin), "chinese").otherwise("english")


def is_code_query(text: Column) -> Column:
    return strip(text).rlike(R.CODE_PATTERNS)


def is_edge_case_query(text: Column) -> Column:
    return contains_any(F.lower(text), R.EDGE_WORDS)


def _word(word: str) -> str:
    import re

    return r"\b" + re.escape(word).replace("\\ ", " ") + r"\b"


# Words of a question about benefits in general.
BENEFIT_WORDS = ("pto", "vacation", "sick leave", "benefits", "health insurance", "parental leave", "paid time off")


def detect_topics(text: Column) -> Column:
    """The topics of which a keyword occurs; general benefit words come first as benefits."""
    q = F.lower(text)
    general = F.when(contains_any(q, BENEFIT_WORDS), "benefits")
    named = [F.when(q.rlike("|".join(_word(w) for w in words)), topic) for topic, words in R.TOPICS]
    return F.filter(F.array(general, *named), lambda x: x.isNotNull())


# Words of a question that name a department besides its aliases.
IT_WORDS = ("cybersecurity", "infosec", "password", "vpn", "usb", "software", "endpoint", "laptop", "vdi", "chromebook")
IT_AFTER = r"\bit\s+(?:department|policy|team|security|dept|rules|support|guidelines|cybersecurity|equipment)\b"
HR_WORDS = (
    "hr", "human resources", "pto", "vacation", "sick leave", "sick day", "parental leave", "maternity", "paternity", "fmla", "bereavement", "jury duty", "benefits", "health insurance", "employee conduct", "holiday pay",
    "tuition assistance", "paid time off", "remote work allowance",
)
SINGLE_WORDS = (
    ("Finance", ("finance", "accounting", "payroll", "tax", "treasury", "billing", "reimbursement", "per diem", "mileage", "expense report")),
    ("Legal", ("legal", "compliance", "regulatory", "governance", "contracts", "ethics", "nda", "confidentiality", "arbitration")),
    ("Operations", ("operations", "facilities", "logistics", "workplace")),
    ("Engineering", ("engineering",)),
    ("R&D", ("r&d",)),
    ("Marketing", ("marketing",)),
    ("Sales", ("sales",)),
)


def detect_departments(text: Column) -> Column:
    """Departments that a question names, in order of the tests; `it` counts only in capitals or before a telling word."""
    q = F.lower(text)
    any_of = lambda words: q.rlike("|".join(_word(w) for w in words))
    spaced = [F.when(any_of([a]), name) for name, aliases in R.DEPARTMENTS for a in aliases if " " in a]
    special = [F.when(text.rlike(r"\bIT\b") | q.rlike(IT_AFTER) | any_of(IT_WORDS), "IT"), F.when(any_of(HR_WORDS), "HR")]
    single = [F.when(any_of(words), name) for name, words in SINGLE_WORDS]
    return F.array_distinct(F.filter(F.array(*spaced, *special, *single), lambda x: x.isNotNull()))


def detect_category(text: Column) -> Column:
    q = F.lower(text)
    return (
        F.when(q.rlike(r"\b(?:legal\s+document|legal\s+contract|agreement|nda)\b"), "legal")
        .when(q.rlike(r"\b(?:guidebook|employee\s+guide|manual|handbook)\b"), "guidebook")
        .when(q.rlike(r"\b(?:policy|company\s+policy)\b"), "policy")
    )


def detect_policy_id(text: Column) -> Column:
    """The policy id that a question names: the first match of the patterns in order that is good; a pattern of which the first match is a bare number counts
    only if that match says `policy` and it is no year."""
    edges = r"^[\s.,;:|()\[\]{}]+|[\s.,;:|()\[\]{}]+$"

    def found(pattern: str) -> Column:
        name = F.regexp_replace(F.regexp_extract(text, pattern, 1), edges, "")
        number, year = name.rlike(r"^\d+$"), name.rlike(r"^(19|20)\d\d$")
        told = F.lower(F.regexp_extract(text, pattern, 0)).contains("policy")
        return F.when(text.rlike(pattern), F.when(number, F.when(~year & told, F.concat(F.lit("Policy "), name))).when(F.length(name) >= 3, name))

    return F.coalesce(*[found(p) for p in R.POLICY_ID_PATTERNS])


def infer_filters(messages: DataFrame, explicit: dict[str, Column] | None = None) -> DataFrame:
    """messages(conv_id, turn, role, text) -> user turns with departments (inherited from the newest earlier user turn that names any), policy_id, topics and category.

    explicit holds columns for departments (an array), policy_id or category: where they aren't null they win over what is inferred, and blank questions have only them. A category is inferred beside a department or a policy only.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.size(detect_departments(F.col("text"))) > 0, detect_departments(F.col("text")))
    known = messages.withColumn("_own", own).withColumn("_old", F.last(F.when(F.col("role") == "user", F.col("_own")), ignorenulls=True).over(before))
    given = {name: (explicit or {}).get(name, F.lit(None).cast(kind)) for name, kind in (("departments", "array<string>"), ("policy_id", "string"), ("category", "string"))}
    asked = F.length(strip(F.coalesce(F.col("text"), F.lit("")))) > 0
    dept = F.coalesce(given["departments"], F.when(asked, F.coalesce("_own", "_old")))
    policy = F.coalesce(given["policy_id"], F.when(asked, detect_policy_id(F.col("text"))))
    return known.filter("role = 'user'").select(
        *messages.columns,
        dept.alias("departments"),
        policy.alias("policy_id"),
        detect_topics(F.col("text")).alias("topics"),
        F.coalesce(given["category"], F.when(asked & (dept.isNotNull() | policy.isNotNull()), detect_category(F.col("text")))).alias("category"),
    )


def multi_query(questions: DataFrame, key: str = "query_id", text: str = "text", limit: int = 8, rules: tuple = R.SUB_QUESTIONS) -> DataFrame:
    """key, n, sub_query: the question, the sub-questions of rules (pattern, texts) that match, and the topics of an `including a, b` clause.

    Equal texts count once whatever their case; a comma inside parentheses does not split.
    """
    core = strip(F.col(text))
    q = F.lower(core)
    fixed = [F.when(q.rlike(pattern), F.array(*[F.lit(t) for t in texts])).otherwise(F.array().cast("array<string>")) for pattern, texts in rules]
    clause = F.regexp_extract(core, r"(?i)(?:pay\s+special\s+attention\s+to|including|covering|focus\s+on)\s+(.+)", 1)
    topics = F.filter(F.transform(F.split(clause, r",(?![^()]*\))"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ .]+|[ .]+$", "")), lambda x: F.length(x) >= 3)
    every = F.filter(F.concat(F.array(core), *fixed, topics), lambda x: x != "")
    rows = questions.select(key, F.posexplode(every).alias("at", "sub_query"))
    first = rows.groupBy(key, F.lower("sub_query").alias("_l")).agg(F.min_by("sub_query", "at").alias("sub_query"), F.min("at").alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at"))).filter(F.col("n") <= limit).select(key, "n", "sub_query")
