"""Document metadata by rules: department, policy id, dates, entities, topics and a weighted confidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import once, strip

EDGE_MARKS = r"^[.,;:|()\[\]{}]+|[.,;:|()\[\]{}]+$"


def _bare(x: Column) -> Column:
    return F.regexp_replace(strip(x), EDGE_MARKS, "")


def _any_of(phrases: list[str]):
    return lambda x: x.isin(phrases)


def _phrases(phrases: list[str]) -> tuple[str, dict[str, list[str]]]:
    """(a pattern whose group 1 is the longest phrase at each word's beginning, phrase -> the phrases that begin it and so occur there too). One pass finds all."""
    by_letter: dict[str, list[str]] = {}
    for x in sorted(set(phrases), key=lambda x: (-len(x), x)):
        by_letter.setdefault(x[0], []).append(x)
    rest = lambda x: re.escape(x[1:]).replace("\\ ", " ")
    groups = "|".join(re.escape(c) + "(?:" + "|".join(rest(x) for x in xs) + ")" for c, xs in sorted(by_letter.items()))
    return rf"\b(?=({groups})\b)", {x: [y for y in set(phrases) if x == y or x.startswith(y) and not x[len(y)].isalnum()] for x in set(phrases)}


def _present(text: Column, named: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The names of which a phrase occurs in a lower-cased text, in their order, from one pass over it."""
    pattern, within = _phrases([x for _, phrases in named for x in phrases])
    holds = lambda phrases: [m for m, ys in within.items() if not set(phrases).isdisjoint(ys)]
    told = lambda hits: F.filter(F.array(*[F.when(F.arrays_overlap(hits, F.array(*[F.lit(m) for m in holds(phrases)])), name) for name, phrases in named]), lambda x: x.isNotNull())
    return once(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), told)


def extract_department(text: Column) -> Column:
    """struct<department, confidence>: a label in the first 1000 characters, else the alias with most occurrences (three times in the header)."""
    header = F.left(text, F.lit(1000))
    raw = F.lit(None).cast("string")
    for pattern in reversed(R.DEPARTMENT_LABELS):
        raw = F.when(header.rlike(pattern), _bare(F.regexp_extract(header, pattern, 1))).otherwise(raw)
    named = [(a, name) for name, aliases in R.DEPARTMENTS for a in aliases] + [(a, "General") for a in R.COMPANY_WIDE]
    made = lambda name, confidence: F.struct(name.alias("department"), F.lit(confidence).cast("double").alias("confidence"))

    def by_label(raw: Column) -> Column:
        clean = F.lower(raw)
        exact = reduce(lambda rest, x: F.when(clean == x[0], F.lit(x[1]) if x[0] == x[1].lower() else F.initcap(raw)).otherwise(rest), reversed(named), F.lit(None).cast("string"))
        inside = reduce(lambda rest, x: F.when(clean.contains(x[0]), x[1]).otherwise(rest), reversed(named), F.lit(None).cast("string"))
        return (
            F.when(clean == "information technology", made(F.lit("Information Technology"), 0.95))
            .when(exact.isNotNull(), made(exact, 0.95))
            .when(inside.isNotNull(), made(inside, 0.90))
            .when(F.length(raw).between(2, 40), made(F.initcap(raw), 0.85))
        )

    pattern, within = _phrases([a for _, aliases in R.DEPARTMENTS for a in aliases])

    def by_words(texts: Column) -> Column:
        hits = lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return once(F.struct(hits(texts["head"]).alias("head"), hits(texts["all"]).alias("all")), by_hits)

    def by_hits(found: Column) -> Column:
        def count(hits: Column, aliases) -> Column:
            """Occurrences of aliases: a phrase counts for each alias that begins it."""
            weights = {x: sum(y in aliases for y in ys) for x, ys in within.items()}
            return reduce(lambda a, b: a + b, [F.size(F.filter(hits, _any_of([x for x, w in weights.items() if w >= n]))) for n in range(1, max(weights.values()) + 1)])

        scores = F.array(*[F.struct((count(found["head"], aliases) * 3.0 + count(found["all"], aliases)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, aliases) in enumerate(R.DEPARTMENTS)])
        chosen = lambda best: F.when(best["score"] >= 3, F.struct(best["name"].alias("department"), F.least(F.lit(0.85), 0.60 + best["score"] * 0.05).alias("confidence"))).when(best["score"] >= 1, made(best["name"], 0.65)).otherwise(made(F.lit("General"), 0.50))
        return once(F.array_max(scores), chosen)

    return F.coalesce(once(raw, by_label), once(F.struct(F.lower(header).alias("head"), F.lower(text).alias("all")), by_words))


def extract_policy_id(text: Column) -> Column:
    """The first good match of the patterns in order in the first 2000 characters, then in all the text; years and bare numbers without `policy` don't count."""
    scan = F.left(text, F.lit(2000))

    def found(pattern: str, where: Column, numbers: bool) -> Column:
        ids = F.regexp_extract_all(where, F.lit(pattern), F.lit(1))
        whole = F.regexp_extract_all(where, F.lit(pattern), F.lit(0))
        both = F.zip_with(ids, whole, lambda i, w: F.struct(_bare(i).alias("id"), w.alias("whole")))
        digits = lambda x: x["id"].rlike(r"^\d+$")
        year = lambda x: x["id"].rlike(r"^(19|20)\d\d$")
        good = F.transform(both, lambda x: F.when(digits(x), F.when(~year(x) & F.lower(x["whole"]).contains("policy"), F.concat(F.lit("Policy "), x["id"])) if numbers else F.lit(None)).when(F.length(x["id"]) >= 3, x["id"]))
        return F.get(F.filter(good, lambda x: x.isNotNull()) if numbers else F.filter(F.slice(good, 1, 1), lambda x: x.isNotNull()), F.lit(0))

    return F.coalesce(*[found(p, scan, True) for p in R.POLICY_ID_PATTERNS], *[found(p, text, False) for p in R.POLICY_ID_PATTERNS])


def normalize_date(raw: Column) -> Column:
    """ISO, US, `Month D Y`, `D Month Y` and `Month Y` dates of the first line as YYYY-MM-DD; null if there is none."""
    line = strip(F.regexp_extract(F.regexp_replace(strip(raw), EDGE_MARKS, ""), r"^[^\n\r|]*", 0))
    part = lambda p, g: F.regexp_extract(line, p, g)
    two = lambda x: F.lpad(x, 2, "0")
    iso = r"\b(20\d{2}|19\d{2})[-/.](0[1-9]|1[0-2])[-/.](0[1-9]|[12]\d|3[01])\b"
    us = r"\b(0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])[-/.](20\d{2}|19\d{2})\b"
    word = r"(?i)\b([A-Za-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(20\d{2}|19\d{2})\b"
    day = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]+)\.?,?\s+(20\d{2}|19\d{2})\b"
    month = r"(?i)\b([A-Za-z]+)\.?,?\s+(20\d{2}|19\d{2})\b"
    names = {n: i + 1 for i, m in enumerate(R.MONTHS) for n in (m, m[:3])}
    number = F.create_map(*[F.lit(x) for n, i in names.items() for x in (n, f"{i:02d}")])
    of = lambda p, g: number[F.lower(part(p, g))]
    return F.coalesce(
        F.when(line.rlike(iso), F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3))),
        F.when(line.rlike(us), F.concat_ws("-", part(us, 3), two(part(us, 1)), two(part(us, 2)))),
        F.when(line.rlike(word) & of(word, 1).isNotNull(), F.concat_ws("-", part(word, 3), of(word, 1), two(part(word, 2)))),
        F.when(line.rlike(day) & of(day, 2).isNotNull(), F.concat_ws("-", part(day, 3), of(day, 2), two(part(day, 1)))),
        F.when(line.rlike(month) & of(month, 1).isNotNull(), F.concat_ws("-", part(month, 2), of(month, 1), F.lit("01"))),
    )


def extract_effective_date(text: Column) -> Column:
    """The date after the first label in the first 1500 characters that gives one, else a date on their first line."""
    scan = F.left(text, F.lit(1500))
    labelled = [F.when(scan.rlike(p), normalize_date(F.regexp_extract(scan, p, 1))) for p in R.DATE_LABELS]
    return F.coalesce(*labelled, normalize_date(scan))


def extract_entities(text: Column, limit: int = 20) -> Column:
    """Roles, amounts, durations, titles and periods in this order, each once whatever its case."""
    roles = _present(F.lower(text), [(r, (r.lower(),)) for r in R.ROLES])
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    found = F.concat(roles, every(R.DOLLARS), every(R.DURATIONS), F.transform(every(R.TITLES), lambda x: F.initcap(x)), F.transform(every(R.PERIODS), lambda x: F.initcap(x)))
    clean = F.filter(F.transform(found, lambda x: F.replace(_bare(x), F.lit(","), F.lit(""))), lambda x: F.length(x) >= 2)
    lower = F.transform(clean, lambda x: F.lower(x))
    first = F.filter(clean, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return F.slice(first, 1, limit)


def extract_topics(text: Column) -> Column:
    """Keywords that occur, then the taxonomy's topics."""
    return F.array_distinct(_present(F.lower(text), [(w, (w,)) for w in R.TOPIC_WORDS] + list(R.TOPICS)))


def extract_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds department, policy_id, effective_date, entities, topics and a confidence weighted .35, .20, .15, .30."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_d", extract_department(t)).withColumn("policy_id", extract_policy_id(t)).withColumn("effective_date", extract_effective_date(t)).withColumn("entities", extract_entities(t)).withColumn("topics", extract_topics(t))
    score = F.col("_d.confidence") * 0.35 + F.when(F.col("policy_id").isNotNull(), 0.95).otherwise(0.5) * 0.20 + F.when(F.col("effective_date").isNotNull(), 0.90).otherwise(0.5) * 0.15 + F.when(F.size("topics") > 0, 0.85).otherwise(0.5) * 0.30
    return out.withColumn("department", F.col("_d.department")).withColumn("confidence", F.round(score, 2)).drop("_d")


def attach_metadata(chunks: DataFrame, documents: DataFrame, key: str, always: list[str], arrays: list[str]) -> DataFrame:
    """Document fields on its chunks: always the first kind, arrays only where the chunk's own is empty."""
    side = documents.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in always + arrays])
    met = chunks.join(side, chunks[key] == F.col("_k"), "left")
    for c in always:
        met = met.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)) if c in chunks.columns else F.col(f"_{c}"))
    for c in arrays:
        met = met.withColumn(c, F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) == 0, F.col(f"_{c}")).otherwise(F.col(c)) if c in chunks.columns else F.col(f"_{c}"))
    return met.drop("_k", *[f"_{c}" for c in always + arrays])
