"""Chunkers: folds over a document's sentences, lines or pieces that stay inside the row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import content_hash, strip, token_estimate
from .structure import lines, section_context

CHUNK_TOKENS, OVERLAP_TOKENS, MIN_CHARS = 512, 64, 40
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'“])|\n\n+"
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def _with_ids(rows: DataFrame, key: str, strategy: str) -> DataFrame:
    return rows.withColumn("strategy", F.lit(strategy)).withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("chunk_index").cast("string"), "text"), 256))


def chunk_semantic(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, drop: int = MIN_CHARS) -> DataFrame:
    """key, chunk_index, text, strategy, chunk_id: sentences packed up to size tokens, whole sentences of at most overlap tokens carried over, chunks under drop characters dropped.

    Sentences are numbered, and the fold keeps only the bounds of chunks, so its state is small whatever the text.
    """
    said = docs.select(key, F.filter(F.transform(F.split(F.col(text), SENTENCE_END), lambda s: strip(s)), lambda s: s != "").alias("s"))
    said = said.withColumn("n", F.transform("s", lambda x: token_estimate(x)))
    state = "struct<i:int,from:int,sum:bigint,cuts:array<struct<a:int,b:int>>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("from"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts")).cast(state)

    def carried(upto: Column, first: Column) -> Column:
        """How many sentences before upto fit the overlap."""
        back = F.reverse(F.slice("n", first + 1, upto - first))
        took = F.aggregate(back, F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("t"), F.lit(True).alias("on")), lambda a, x: F.when(a["on"] & (a["t"] + x <= overlap), F.struct((a["k"] + 1).alias("k"), (a["t"] + x).alias("t"), F.lit(True).alias("on"))).otherwise(F.struct(a["k"].alias("k"), a["t"].alias("t"), F.lit(False).alias("on"))))
        return took

    def step(a: Column, x: Column) -> Column:
        full = (a["sum"] + x > size) & (a["i"] > a["from"])
        keep = carried(a["i"], a["from"])
        cut = F.struct(a["from"].alias("a"), a["i"].alias("b"))
        return F.struct(
            (a["i"] + 1).alias("i"),
            F.when(full, a["i"] - keep["k"]).otherwise(a["from"]).cast("int").alias("from"),
            F.when(full, keep["t"] + x).otherwise(a["sum"] + x).cast("bigint").alias("sum"),
            F.when(full, F.array_append(a["cuts"], cut)).otherwise(a["cuts"]).alias("cuts"),
        ).cast(state)

    folded = said.withColumn("f", F.aggregate("n", start, step))
    bounds = F.when(F.size("s") > F.col("f.from"), F.array_append(F.col("f.cuts"), F.struct(F.col("f.from").alias("a"), F.size("s").alias("b")))).otherwise(F.col("f.cuts"))
    texts = F.filter(F.transform(bounds, lambda c: F.array_join(F.slice("s", c["a"] + 1, c["b"] - c["a"]), " ")), lambda t: F.length(t) >= drop)
    return _with_ids(folded.select(key, F.posexplode(texts).alias("chunk_index", "text")), key, "semantic")


def _packed(pieces: Column, gap: int, size: int, overlap: int) -> Column:
    """array<struct<a, b, big>>: how successive pieces, gap characters apart, are joined.

    A piece of size characters and more stands alone and is big. Others are joined while they fit size; the next join begins with the last pieces of the
    one before that fit overlap. The fold keeps the bounds of joins and the length of the open one.
    """
    bounds = "array<struct<a:int,b:int,big:boolean>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), F.lit(0).alias("held"), F.array().cast(bounds).alias("cuts"))
    lengths = F.transform(pieces, lambda x: F.length(x))
    cut = lambda x, big: F.struct(x["a"].alias("a"), x["i"].alias("b"), F.lit(big).alias("big"))
    closed = lambda x: F.when(x["a"] < x["i"], F.array_append(x["cuts"], cut(x, False))).otherwise(x["cuts"])
    made = lambda i, a, held, cuts: F.struct(i.alias("i"), a.cast("int").alias("a"), held.cast("int").alias("held"), cuts.cast(bounds).alias("cuts"))

    def joined(all_lengths: Column) -> Column:
        def carried(x: Column) -> Column:
            first = F.struct(x["a"].alias("a"), x["held"].alias("held"))
            return F.aggregate(F.slice(all_lengths, x["a"] + 1, x["i"] - x["a"]), first, lambda k, n: F.when(k["held"] > overlap, F.struct((k["a"] + 1).alias("a"), (k["held"] - n - gap).alias("held"))).otherwise(k))

        def step(x: Column, n: Column) -> Column:
            full = (x["a"] < x["i"]) & (x["held"] + n + gap > size)
            longer = lambda a, held: held + n + F.when(a < x["i"], gap).otherwise(0)
            alone = F.array_append(closed(x), F.struct(x["i"].alias("a"), (x["i"] + 1).alias("b"), F.lit(True).alias("big")))
            after = F.transform(F.array(carried(x)), lambda k: made(x["i"] + 1, k["a"], longer(k["a"], k["held"]), closed(x)))[0]
            return F.when(n >= size, made(x["i"] + 1, x["i"] + 1, F.lit(0), alone)).when(full, after).otherwise(made(x["i"] + 1, x["a"], longer(x["a"], x["held"]), x["cuts"]))

        return F.aggregate(all_lengths, start, step, closed)

    return F.transform(F.array(lengths), joined)[0]


def split_text(text: Column, size: int = CHUNK_TOKENS * 4, overlap: int = OVERLAP_TOKENS * 4, marks: tuple[str, ...] = SEPARATORS) -> Column:
    """array<string>: a text cut at the coarsest of marks that it has, what is still size characters and more at the finer ones, at last between
    characters; neighbours joined up to size with overlap. All stays in the row: a level of marks is a level of nested arrays."""
    mark, finer = marks[0], marks[1:]
    if not mark:
        begins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - overlap - 1), F.lit(size - overlap))
        return F.transform(begins, lambda i: F.substr(text, i + 1, F.lit(size)))

    def at_mark(pieces: Column) -> Column:
        whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(True).alias("big")))
        runs = F.when(F.size(pieces) > 1, _packed(pieces, len(mark), size, overlap)).otherwise(whole)
        return F.flatten(F.transform(runs, lambda r: F.when(r["big"], split_text(F.get(pieces, r["a"]), size, overlap, finer)).otherwise(F.array(F.array_join(F.slice(pieces, r["a"] + 1, r["b"] - r["a"]), mark)))))

    return F.when(text.isNotNull(), F.transform(F.array(F.split(text, re.escape(mark), -1)), at_mark)[0])


def chunk_recursive(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """key, chunk_index, text, strategy, chunk_id by recursive separators; null and blank texts have no chunks."""
    pieces = F.filter(split_text(F.col(text), size * 4, overlap * 4), lambda x: x.rlike(r"(?U)\S"))
    return _with_ids(docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(pieces).alias("chunk_index", "text")), key, "recursive")


def chunk_heading(docs: DataFrame, key: str = "doc_id", text: str = "text", minimum: int = 100, drop: int = MIN_CHARS, size: int = CHUNK_TOKENS) -> DataFrame:
    """A chunk begins at a heading once minimum characters have gathered and has the context in force at its last heading; long ones are cut recursively.

    Gathered characters are a running sum of line lengths; which headings begin a chunk is a fold over a document's headings only.
    """
    marked = section_context(lines(docs, key, text), key).withColumn("is_head", F.coalesce(F.col("section_title"), F.lit("")) != F.coalesce(F.lag("section_title").over(Window.partitionBy(key).orderBy("line_no")), F.lit("")))
    sums = marked.withColumn("upto", F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = sums.filter("is_head").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "upto"))).alias("h"))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<int>").alias("cuts"))
    cuts = F.aggregate("h", state, lambda a, x: F.when(x["upto"] - a["at"] >= minimum, F.struct(x["upto"].cast("bigint").alias("at"), F.array_append(a["cuts"], x["line_no"]).alias("cuts"))).otherwise(a))["cuts"]
    begins = heads.select(key, cuts.alias("cuts"))
    placed = sums.join(begins, key, "left").withColumn("part", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("line_no"))), F.lit(0)))
    item = F.struct("line_no", "line", "section_title", "section_path", "section_level")
    parts = placed.groupBy(key, "part").agg(F.array_sort(F.collect_list(item)).alias("l"))
    whole = parts.select(key, "part", strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"), F.element_at("l", -1)["section_title"].alias("section_title"), F.element_at("l", -1)["section_path"].alias("section_path")).filter(F.length("text") >= drop)
    named = whole.withColumn("_k", F.concat_ws(":", F.col(key).cast("string"), F.col("part").cast("string")))
    pieces = chunk_recursive(named, "_k", "text", size).filter(F.length(strip(F.col("text"))) >= drop).select("_k", F.col("chunk_index").alias("sub"), strip(F.col("text")).alias("text"))
    ordered = named.drop("text").join(pieces, "_k").withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("part", "sub")) - 1)
    return _with_ids(ordered.select(key, "chunk_index", "text", "section_title", "section_path"), key, "heading_aware")


def block_types(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n, kind, block: what lies between fences is code; the rest is text."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), "```")).alias("n", "block"))
    return parts.withColumn("kind", F.when(F.col("n") % 2 == 1, "code").otherwise("text")).filter(strip(F.col("block")) != "")


#: Strategy -> what a strategy asked for must hold to mean it, tried in this order.
ASKED = {"table": "table", "markdown": "markdown", "heading_aware": "heading", "semantic": "semantic", "recursive": "recursive"}


def chunk_strategy(text: Column, document_type: Column | None = None, has_section: Column | None = None, has_tables: Column | None = None, has_code: Column | None = None, override: Column | str | None = None) -> Column:
    """The chunker for a document: the one that override names (of which an unknown name or null names none), else by its tables, code, type, section and length."""
    known = lambda c: F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    kind = F.lit("text") if document_type is None else F.lower(F.coalesce(document_type, F.lit("text")))
    asked = F.lower(F.coalesce(override if isinstance(override, Column) else F.lit(override).cast("string"), F.lit("")))
    out = F
    for name, word in ASKED.items():
        out = out.when(asked.contains(word), name)
    return (
        out.when(known(has_tables) | text.contains("|---") | text.contains("\n|") & text.contains("|"), "table")
        .when(kind.isin("markdown", "html") | known(has_code) | text.contains("```"), "markdown")
        .when(known(has_section) | kind.isin("pdf", "docx"), "heading_aware")
        .when(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) > 200, "semantic")
        .otherwise("recursive")
    )


def chunk_markdown(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fences are chunks of their own; prose between them is cut at headings once 60 characters have gathered, pieces under 30 dropped."""
    blocks = block_types(docs, key, text).withColumn("_b", F.concat_ws(":", F.col(key).cast("string"), F.col("n").cast("string")))
    prose = chunk_heading(blocks.filter("kind = 'text'").select("_b", F.col("block").alias("text")), "_b", "text", 60, 30).select("_b", F.col("chunk_index").alias("sub"), "text", "section_title", "section_path")
    code = blocks.filter("kind = 'code'").select("_b", F.lit(0).alias("sub"), strip(F.col("block")).alias("text"), F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("string").alias("section_path"))
    both = blocks.select(key, "n", "_b", "kind").join(prose.unionByName(code), "_b")
    ordered = both.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("n", "sub")) - 1)
    return _with_ids(ordered.select(key, "chunk_index", "text", "section_title", "section_path", F.col("kind").alias("content_type")), key, "markdown")


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS) -> DataFrame:
    """Runs of pipe lines are tables, cut into slices of rows under size tokens that each repeat the header; what lies between goes to chunk_recursive."""
    rows = lines(docs, key, text).withColumn("is_row", F.col("line").rlike(r"^\s*\|.*\|\s*$|\|.+\|"))
    change = (F.col("is_row") != F.coalesce(F.lag("is_row").over(Window.partitionBy(key).orderBy("line_no")), ~F.col("is_row"))).cast("int")
    runs = rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(Window.partitionBy(key).orderBy("line_no"))).drop("_c")
    inside = Window.partitionBy(key, "run").orderBy("line_no")
    head = F.when(F.row_number().over(inside) == 1, F.col("line"))
    rule = F.when((F.row_number().over(inside) == 2) & F.col("line").rlike(r"^[\s|:\-]+$"), F.col("line"))
    table = runs.filter("is_row").withColumn("_h", head).withColumn("_r", rule)
    table = table.withColumn("header", F.max("_h").over(Window.partitionBy(key, "run"))).withColumn("rule", F.max("_r").over(Window.partitionBy(key, "run")))
    body = table.filter(F.col("_h").isNull() & F.col("_r").isNull()).withColumn("_sum", F.sum(F.length("line") + 1).over(inside)).withColumn("part", F.floor(F.col("_sum") / (size * 4 - F.length("header") - 8)).cast("int"))
    cut = body.groupBy(key, "run", "part", "header", "rule").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    sliced = cut.select(key, "run", "part", F.concat_ws("\n", "header", "rule", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"), F.lit("table").alias("content_type"))
    prose = runs.filter("not is_row").groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select(key, "run", strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text")).filter("text <> ''").withColumn("_k", F.concat_ws(":", F.col(key).cast("string"), F.col("run").cast("string")))
    pieces = prose.select(key, "run", "_k").join(chunk_recursive(prose, "_k", "text", size).select("_k", F.col("chunk_index").alias("part"), "text"), "_k").select(key, "run", "part", "text", F.lit("prose").alias("content_type"))
    ordered = sliced.unionByName(pieces).withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("run", "part")) - 1)
    return _with_ids(ordered.select(key, "chunk_index", "text", "content_type"), key, "table_aware")


def chunk_adaptive(docs: DataFrame, key: str = "doc_id", text: str = "text", document_type: Column | None = None, has_section: Column | None = None, has_tables: Column | None = None, has_code: Column | None = None, override: Column | str | None = None) -> DataFrame:
    """Each document by the chunker that chunk_strategy chooses from its text and columns."""
    chosen = docs.select(key, text, chunk_strategy(F.col(text), document_type, has_section, has_tables, has_code, override).alias("_s"))
    makers = {"table": chunk_table, "markdown": chunk_markdown, "heading_aware": chunk_heading, "semantic": chunk_semantic, "recursive": chunk_recursive}
    out = None
    for name, maker in makers.items():
        part = maker(chosen.filter(F.col("_s") == name), key, text).select(key, "chunk_index", "text", "strategy", "chunk_id")
        out = part if out is None else out.unionByName(part)
    return out


def chunk_parent_child(docs: DataFrame, key: str = "doc_id", text: str = "text", parent_tokens: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(parents, children): recursive pieces of up to parent_tokens, and their semantic chunks under parent_id."""
    parents = chunk_recursive(docs, key, text, parent_tokens, 0).withColumnRenamed("chunk_id", "parent_id")
    children = chunk_semantic(parents, "parent_id", "text")
    return parents, children


def chunk_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_hash", content_hash(F.col("text")))
