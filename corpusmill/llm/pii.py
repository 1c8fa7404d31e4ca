"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers with their places. They are the seeds: the two words before
a seed induce a lexical pattern, and a graph of patterns and the identifier-like values that follow them is scored in rounds. A
pattern's score is the sum of its values' scores over the number of different followers it has in the corpus: values, plain words and other words with digits.
It counts only if it is HALF or more and MIN_SUPPORT values scored HALF or more follow it; a value's score grows with the patterns that hold it, so that what was discovered
induces further patterns. Rounds go on, ROUNDS at a time, until no score and no support changes. Values that no base rule finds but that follow a pattern of high
score become further spans of kind id. The graph holds only identifier-like tokens, counted once for each pattern and value, so copies add nothing.

Only patterns before MIN_SUPPORT different values, of which one is no seed, can ever discover, and only if other followers are no more than those values. A
twentieth of the documents suffices to prove of most frequent patterns that they have more; of the rest all followers are counted, in one scan of all documents. A
filter by hash, of at most FILTER_SLOTS bytes, lets other patterns go before anything is grouped; what it lets through besides falls away in a join of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Kinds in the order in which spans that start together are listed; id is what patterns discover.
KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS, MIN_SUPPORT, MIN_SCORE, HALF = 3, 5, 0.8, 0.5
FILTER_SLOTS, PROOF = 1 << 21, 20
#: The base rules. A look-behind lets a match begin only where a run of its first characters begins or the last match ended, and
#: possessive repeats never step back: the same matches as the plain rules, in time linear in the text.
RULES = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: A run that may be an identifier: at least six characters, three of them digits, of any length. It ends at the last letter or digit with a full stop or
#: none of its characters behind; each part runs up to such an end, so nothing steps back.
_PART = r"[A-Za-z0-9]++(?:[@_%+/#-][@._%+/#-]*+[A-Za-z0-9]++)*+(?![@_%+/#-])"
_RUN = rf"(?=(?:[A-Za-z@._%+/#-]*+[0-9]){{3}})(?=[A-Za-z0-9@._%+/#-]{{6}}){_PART}(?:\.[@._%+/#-]*+{_PART})*+"
TOKEN = rf"(?<![^\s\"'(\[<]){_RUN}"
#: What stands for each code point of a base span where tokens are sought, and words with digits, @ or such a span in them that no span begins.
MASK = "\uE000"
OTHER = rf"(?<!\S)(?!{MASK}|{_RUN})(?=[^\s0-9@{MASK}]*+[0-9@{MASK}])\S++"
LEAST = 6
BLOCK, PIECE = 256, 4096


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        backwards = F.reverse(digits)
        each = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substr(backwards, i + 1, F.lit(1)).cast("int") * (1 + i % 2))
        luhn = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0
        return F.when(F.length(digits).between(12, 19), luhn).otherwise(False)
    return F.lit(True)


def _located(df: DataFrame, rule: str, hint: str, out: str) -> DataFrame:
    """Adds out: array<struct<start, end, value>> of the leftmost matches in code points.

    The text between matches comes from split, so a match starts after the lengths before it; these are summed in blocks.
    """
    none = F.array().cast("array<string>")
    there = F.col("text").rlike(hint)
    found = df.withColumn("_m", F.when(there, F.regexp_extract_all("text", F.lit(rule), F.lit(0))).otherwise(none))
    found = found.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", rule, -1)).otherwise(none))
    found = found.withColumn("_l", F.zip_with(F.slice("_p", F.lit(1), F.size("_m")), "_m", lambda p, m: F.length(p) + F.length(m)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    found = found.withColumn("_b", F.when(F.size("_m") > 0, F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(_m) - 1) div {BLOCK} as int)")), lambda b: total(F.slice("_l", b * BLOCK + 1, BLOCK)))).otherwise(F.array().cast("array<int>")))
    found = found.withColumn("_b", F.transform("_b", lambda x, i: total(F.slice("_b", F.lit(1), i))))
    start = lambda i: F.col("_b")[F.floor(i / BLOCK).cast("int")] + total(F.slice("_l", i - i % BLOCK + 1, i % BLOCK)) + F.length(F.col("_p")[i])
    spans = F.transform("_m", lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("value")))
    return found.withColumn(out, spans).drop("_m", "_p", "_l", "_b")


def _pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, from which a part can be taken without walking the whole."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive)."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    within = F.substr(piece(a), (start % PIECE + 1).cast("int"), (end - start).cast("int"))
    across = F.concat(F.substr(piece(a), (start % PIECE + 1).cast("int"), F.lit(PIECE)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substr(piece(b), F.lit(1), (end % PIECE).cast("int")))
    return F.when(a == b, within).otherwise(across)


def _left(pieces: Column, start: Column) -> Column:
    """The two words before a place, lower-cased; null without two words and white space. Words longer than a window are sought in the next, at last in all before."""
    words = r"(\S++\s++\S++)\s++$"
    before = lambda n: F.lower(_part(pieces, F.greatest(F.lit(0), start - n), start))
    found = lambda text, edge: F.nullif(F.regexp_extract(text, edge + words, 1), F.lit(""))
    inside = lambda n: F.when(start <= n, found(before(n), r"(?:^|\s)")).otherwise(found(before(n), r"\s"))
    context = F.when(before(1).rlike(r"\s$"), F.coalesce(inside(64), F.when(start > 64, inside(1024)), F.when(start > 1024, inside(16384)), F.when(start > 16384, found(before(start), r"(?:^|\s)"))))
    return F.regexp_replace(context, r"\s+", " ")


def _once(value: Column, use) -> Column:
    """use(value), with value computed once for the row however often use names it."""
    return F.transform(F.array(value), use)[0]


def _rebuilt(pieces: Column, spans: Column, length: Column, instead) -> Column:
    """A text with instead(span) in place of each span; of spans that overlap, the first stands for all. spans: sorted by start."""

    def with_ends(s: Column) -> Column:
        tops = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["spans"]) / BLOCK).cast("int")), lambda b: F.coalesce(F.array_max(F.slice(s["ends"], b * BLOCK + 1, BLOCK)), F.lit(0)))
        return _once(F.struct(s["spans"].alias("spans"), s["ends"].alias("ends"), tops.alias("tops")), with_tops)

    def with_tops(s: Column) -> Column:
        # The end of all spans before the i-th: that of the blocks before it and of those before it in its block.
        before = lambda i: F.greatest(F.coalesce(F.array_max(F.slice(s["tops"], F.lit(1), F.floor(i / BLOCK).cast("int"))), F.lit(0)), F.coalesce(F.array_max(F.slice(s["ends"], i - i % BLOCK + 1, i % BLOCK)), F.lit(0)))
        made = F.zip_with(s["spans"], F.transform(s["spans"], lambda x, i: before(i)), lambda x, upto: F.when(x["start"] >= upto, F.concat(_part(pieces, upto, x["start"]), instead(x))).otherwise(""))
        return F.concat(F.array_join(made, ""), _part(pieces, F.coalesce(F.array_max(s["ends"]), F.lit(0)), length))

    return _once(F.struct(spans.alias("spans"), F.transform(spans, lambda x: x["end"]).alias("ends")), with_ends)


def _key() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _facts(docs: DataFrame) -> DataFrame:
    """doc_id, row, base, maybe (array<struct<start, rank, end, kind, value, pattern>>) and other (array<struct<pattern, value>>) for each document, from one scan."""
    df = docs.select("doc_id", _key().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for kind, (rule, hint) in RULES.items():
        df = _located(df, rule, hint, kind)
    cast = lambda kind: F.transform(F.filter(kind, lambda x: _valid(kind, x["value"])), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    df = df.withColumn("bare", F.array_sort(F.concat(*[cast(k) for k in RULES]))).drop(*RULES)
    df = df.withColumn("pieces", F.when(F.col("text").rlike("[0-9@]"), _pieces(F.col("text"))).otherwise(F.array().cast("array<string>")))
    masked = _rebuilt(F.col("pieces"), F.col("bare"), F.length("text"), lambda x: F.repeat(F.lit(MASK), x["end"] - x["start"]))
    df = df.withColumn("text", F.when(F.size("bare") > 0, masked).otherwise(F.col("text")))
    df = _located(df, TOKEN, r"[0-9]", "token")
    df = _located(df, OTHER, rf"[0-9@{MASK}]", "odd")
    shaped = F.filter("token", lambda x: (F.length(x["value"]) >= LEAST) & (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 3))
    left = lambda x: _left(F.col("pieces"), x["start"]).alias("pattern")
    base = F.transform("bare", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "value")], left(x)))
    maybe = F.transform(shaped, lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("rank"), x["end"].alias("end"), F.lit("id").alias("kind"), x["value"].alias("value"), left(x)))
    other = F.transform("odd", lambda x: F.struct(left(x), F.lower(x["value"]).alias("value")))
    known = lambda a: F.filter(a, lambda x: x["pattern"].isNotNull())
    return df.select("doc_id", "row", base.alias("base"), known(maybe).alias("maybe"), known(other).alias("other"))


def _filter_of(patterns: DataFrame, count: int) -> tuple[int, bytes]:
    """(slots, one byte a slot, 1 where one of count patterns hashes to); the driver gets bitmaps of FILTER_SLOTS bits at most in all."""
    slots = 1 << 12
    while slots < min(FILTER_SLOTS, 64 * count):
        slots *= 2
    words = F.split("pattern", " ")
    marked = patterns.select((F.pmod(F.xxhash64(words[0], words[1]), F.lit(slots)) + 1).alias("s"))
    rows = marked.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = bytearray(max(slots, 1 << 15))
    for b, bits in rows:
        first = (b - 1) << 15  # numbers from 1 up lie in buckets from 1 up of 32768 bits
        for i, x in enumerate(bits):
            for k in range(8) if x else ():
                out[first + 8 * i + k] = x >> k & 1
    return slots, bytes(out[:slots])


def _followers(docs: DataFrame, facts: DataFrame, patterns: DataFrame, count: int) -> DataFrame:
    """pattern, more: how many different followers that are no values each of count patterns has; without any, it is absent."""
    slots, table = _filter_of(patterns, count)
    passes = lambda a, b: F.substring(F.lit(table), F.pmod(F.xxhash64(a, b), F.lit(slots)).cast("int") + 1, 1) == F.lit(b"\x01")
    words = docs.select(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "").alias("w")).filter("size(w) > 2")
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 3), lambda i: passes(F.col("w")[i], F.col("w")[i + 1]))
    plain = words.select(F.explode(F.array_distinct(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.col("w")[i], F.col("w")[i + 1]).alias("pattern"), F.col("w")[i + 2].alias("value"))))).alias("x")).select("x.*").filter(~F.col("value").rlike("[0-9@]"))
    parts = F.split("pattern", " ")
    other = facts.select(F.explode("other").alias("x")).select("x.*").filter(passes(parts[0], parts[1]))
    counts = plain.unionByName(other).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("more"))
    return counts.join(patterns.select("pattern"), "pattern", "left_semi")


def _confident_patterns(docs: DataFrame, facts: DataFrame, scratch: Scratch) -> DataFrame:
    """pattern, score of the patterns that discover identifiers."""
    pairs = scratch.save(
        facts.select(F.explode(F.concat("base", "maybe")).alias("x")).filter("x.pattern is not null").groupBy("x.pattern", "x.value").agg(F.max(F.col("x.kind") != "id").alias("seed"))
    )
    many = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("seeds"))
    possible = scratch.save(many.filter((F.col("n") >= MIN_SUPPORT) & (F.col("seeds") < F.col("n"))).select("pattern", "n"))
    some = F.pmod(F.xxhash64("doc_id"), F.lit(PROOF)) == 0
    # Followers in some documents are no more than those in all: what goes here could never count.
    for d, f in ((docs.filter(some), facts.filter(some)), (docs, facts)):
        if not (count := possible.count()):
            return possible.select("pattern", F.lit(0.0).alias("score"))
        possible = possible.select("pattern", "n")
        met = possible.join(_followers(d, f, possible, count), "pattern", "left").select("pattern", "n", F.coalesce("more", F.lit(0)).alias("more"))
        possible = scratch.save(met.filter("more <= n"))
    weight = possible.select("pattern", (F.col("n") + F.col("more")).alias("all"))
    graph = scratch.save(pairs.join(possible.select("pattern"), "pattern", "left_semi"))
    values = scratch.save(graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score")))
    mark = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("pattern", "support", "score"))).first()
    patterns = None
    while True:
        for _ in range(ROUNDS):
            before = patterns
            scored = graph.join(values, "value").groupBy("pattern").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= HALF).alias("support"))
            share = F.round(F.col("sum") / F.col("all"), 9)
            patterns = scratch.save(scored.join(weight, "pattern").select("pattern", "support", F.when((F.col("support") >= MIN_SUPPORT) & (share >= HALF), share).otherwise(0.0).alias("score")))
            joined = graph.join(patterns, "pattern").groupBy("value").agg(F.max("seed").alias("seed"), F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))).alias("log"))
            values = scratch.save(joined.select("value", F.when(F.col("seed"), 1.0).otherwise(F.round(1 - F.exp("log"), 9)).alias("score")))
        # Values follow from patterns alone, so equal patterns of two rounds are the fixed point.
        if mark(before) == mark(patterns):
            return patterns.filter(F.col("score") >= MIN_SCORE).select("pattern", "score")


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, row, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans, found for every row.

    found: array<struct<start, rank, end, kind, value>>, sorted; spans lists it as kind:start:end. The counts and base_sha256 are of the base rules
    (n_id: discovered). row is a hash of doc_id and text. Null and empty texts have no spans. Repeated rows get equal results, a null doc_id is kept;
    an empty table gives an empty result; further columns are ignored. An identifier that overlaps a base span is none; followers that begin like an
    identifier but end too short for one aren't counted.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    facts = scratch.save(_facts(docs))
    patterns = _confident_patterns(docs, facts, scratch)
    hit = facts.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.explode("maybe").alias("x")).join(patterns.select(F.col("pattern").alias("_p")), F.col("x.pattern") == F.col("_p"), "left_semi")
    new = scratch.save(hit.groupBy("_doc", "_row").agg(F.collect_set("x").alias("new")))
    spans = facts.join(new, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left").withColumn("found", F.array_sort(F.concat("base", F.coalesce("new", F.slice("base", 1, 0)))))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", "row", *[count(k) for k in KINDS], F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("found")).alias("spans"), "found")


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with each found span of text replaced by its kind in angle brackets; spans that overlap become one, of the first kind.

    A column n_chars follows the new text; rows without spans, null texts too, stay as they are. Further columns of any name are kept.
    """
    found = find_pii(docs).filter(F.size("found") > 0).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "found").dropDuplicates(["_doc", "_row"])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), F.col("doc_id").alias("_id"), _key().alias("_key"))
    joined = whole.join(found, (F.col("_key") == F.col("_row")) & F.col("_id").eqNullSafe(F.col("_doc")), "left").withColumn("pieces", F.when(F.col("found").isNotNull(), _pieces(F.col("_d.text"))))
    clean = _rebuilt(F.col("pieces"), F.col("found"), F.length("_d.text"), lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    joined = joined.withColumn("clean", F.when(F.col("found").isNotNull(), clean).otherwise(F.col("_d.text")))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("found").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_d.n_chars"))
    return joined.select(*[new.get(c, F.col("_d")[c]).alias(c) for c in docs.columns])
