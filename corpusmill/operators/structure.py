"""Lines, headings and section context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import parse_heading

LEVELS, PAGES = 6, 256
SECTION = ("section_title", "section_number", "section_level", "section_path")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line: key, line_no from 0, line."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def section_context(rows: DataFrame, key: str = "doc_id", order: str | Column = "line_no", block: Column | None = None) -> DataFrame:
    """Adds the section in force at each line: title, number, level and path; a line's own heading is in force from it on.

    A heading closes those of its own and deeper levels, so level L's last heading is in force if it is later
    than the last heading of every shallower level: running values over a file's lines, no state. block: a number that never falls along order; a file
    is then taken block by block, and a block hands on one row, so that no task sees the whole of a large file.
    """
    at = F.col(order) if isinstance(order, str) else order
    h = rows.withColumn("_at", at).withColumn("_h", parse_heading(F.col("line")))
    return _in_force(h, key, block).select(*rows.columns, *SECTION)


def _in_force(h: DataFrame, key: str, block: Column | None = None) -> DataFrame:
    """Adds the SECTION columns to rows with _at (their order in key) and _h (a heading or null)."""
    h = h.withColumn("_block", F.lit(0) if block is None else block)
    upto = Window.partitionBy(key, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("_h.number").isNotNull() & (F.col("_h.number") != ""), F.concat_ws(" ", "_h.number", "_h.title")).otherwise(F.col("_h.title"))
    here = F.when(F.col("_h").isNotNull(), F.struct(F.col("_at").alias("at"), label.alias("label"), F.col("_h.title").alias("title"), F.col("_h.number").alias("number"), F.col("_h.level").alias("level")))
    h = h.withColumn("_x", here)
    for level in range(1, LEVELS + 1):
        h = h.withColumn(f"_{level}", F.last(F.when(F.col("_x.level") == level, F.col("_x")), ignorenulls=True).over(upto))
    if block is not None:
        across = Window.partitionBy("_f").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
        lasts = h.groupBy(F.col(key).alias("_f"), F.col("_block").alias("_k")).agg(*[F.max(F.when(F.col("_x.level") == n, F.col("_x"))).alias(f"_e{n}") for n in range(1, LEVELS + 1)])
        lasts = lasts.select("_f", "_k", *[F.last(f"_e{n}", ignorenulls=True).over(across).alias(f"_e{n}") for n in range(1, LEVELS + 1)])
        h = h.join(lasts, F.col(key).eqNullSafe(F.col("_f")) & F.col("_block").eqNullSafe(F.col("_k")))
        h = h.withColumns({f"_{n}": F.coalesce(F.col(f"_{n}"), F.col(f"_e{n}")) for n in range(1, LEVELS + 1)}).drop("_f", "_k", *[f"_e{n}" for n in range(1, LEVELS + 1)])
    alive = []
    for level in range(1, LEVELS + 1):
        mine = F.col(f"_{level}.at")
        later = F.lit(True)
        for k in range(1, level):
            later = later & (F.col(f"_{k}.at").isNull() | (mine > F.col(f"_{k}.at")))
        alive.append(F.when(mine.isNotNull() & later, F.col(f"_{level}")))
    h = h.withColumn("_s", F.filter(F.array(*alive), lambda x: x.isNotNull()))
    top = F.when(F.size("_s") > 0, F.element_at("_s", -1))
    path = F.when(F.size("_s") > 0, F.array_join(F.transform("_s", lambda x: x["label"]), " > "))
    found = {"section_title": top["title"], "section_number": F.when(top["number"] != "", top["number"]), "section_level": top["level"], "section_path": path}
    return h.withColumns(found)


def chunk_context(chunks: DataFrame, file: str = "source_file", page: str = "page_number", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """Adds to a file's chunks, in the order of page and index, the section in force at each one's end: that of its own last heading or of chunks before it.

    A chunk's headings are its lines'; a chunk is a row of its own among its lines, so that chunks without any inherit. Only lines that are headings are kept
    for the running maxima. Columns of the results' names are kept as they are where no section is in force.
    """
    kept = [c for c in chunks.columns if c not in SECTION]
    said = chunks.select(file, page, index, F.posexplode(F.split(text, "\n")).alias("_n", "line")).withColumn("_h", parse_heading(F.col("line"))).filter("_h is not null").drop("line")
    ends = chunks.select(file, page, index, F.lit(2_147_483_647).alias("_n"), F.lit(None).cast(said.schema["_h"].dataType).alias("_h"))
    rows = said.unionByName(ends).withColumn("_at", F.struct(page, index, "_n"))
    told = _in_force(rows, file, F.floor(F.col(page) / PAGES)).filter("_n = 2147483647").select(F.col(file).alias("_f"), F.col(page).alias("_p"), F.col(index).alias("_i"), *[F.col(c).alias(f"_{c}") for c in SECTION])
    met = chunks.join(told, F.col(file).eqNullSafe(F.col("_f")) & F.col(page).eqNullSafe(F.col("_p")) & F.col(index).eqNullSafe(F.col("_i")), "left")
    old = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast(told.schema[f"_{c}"].dataType)
    return met.select(*kept, *[F.when(F.col("_section_title").isNotNull(), F.col(f"_{c}")).otherwise(old(c)).alias(c) for c in SECTION])


def nearest_section(pages: DataFrame, file: str = "source_file", block: int = 1024) -> DataFrame:
    """pages(file, page_number, section_path) -> file, page_number, section_path: the page's own section or that of the nearest page that has one, the earlier of two as near.

    The last section before and the first after a page are running values over blocks of page numbers; what a block hands on to the others is one row a block,
    so no task sees a whole file's pages and no pairs of pages arise. A file without any section has null.
    """
    own = F.when(F.col("section_path").isNotNull(), F.struct(F.col("page_number").alias("n"), F.col("section_path").alias("s")))
    rows = pages.groupBy(file, "page_number").agg(F.min("section_path").alias("section_path")).select(file, "page_number", F.floor(F.col("page_number") / block).alias("_b"), own.alias("_o"))
    inside = Window.partitionBy(file, "_b").orderBy("page_number")
    rows = rows.withColumn("_l", F.last("_o", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.first("_o", True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    ends = rows.groupBy(F.col(file).alias("_f"), F.col("_b").alias("_k")).agg(F.max("_o").alias("_last"), F.min("_o").alias("_first"))
    across = Window.partitionBy("_f").orderBy("_k")
    ends = ends.select("_f", "_k", F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    met = rows.join(ends, (F.col(file).eqNullSafe(F.col("_f"))) & (F.col("_b") == F.col("_k"))).withColumn("_l", F.coalesce("_l", "_before")).withColumn("_r", F.coalesce("_r", "_after"))
    near = F.when(F.col("_r").isNull() | (F.col("page_number") - F.col("_l.n") <= F.col("_r.n") - F.col("page_number")), F.col("_l")).otherwise(F.col("_r"))
    return met.select(file, "page_number", near["s"].alias("section_path"))


def caption_rows(pages: DataFrame, images: DataFrame, file: str = "source_file") -> DataFrame:
    """images(file, page_number), pages(file, page_number, text, section_path) -> file, page_number, caption, section_path.

    The caption is the page's first line that names a figure or diagram, else its first line; the section is the page's own or that of the nearest page that has one.
    Images that repeat a page count once; an image without a page is captioned by its file.
    """
    lines_of = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    figure = F.get(F.filter(lines_of, lambda x: x.rlike(r"(?i)\b(figure|fig\.|diagram|chart|illustration)\b")), F.lit(0))
    own = pages.select(file, "page_number", F.coalesce(figure, F.left(F.get(lines_of, F.lit(0)), F.lit(200))).alias("_c"))
    at = images.select(file, "page_number").distinct()
    placed = nearest_section(pages.select(file, "page_number", "section_path").unionByName(at.withColumn("section_path", F.lit(None).cast("string"))), file)
    named = at.join(placed, [file, "page_number"], "left").join(own, [file, "page_number"], "left")
    words = F.coalesce("_c", F.concat(F.lit("Visual content from "), F.col(file)))
    return named.select(file, "page_number", F.concat(F.lit("[DIAGRAM CAPTION — "), F.col(file), F.lit(" (page "), F.col("page_number").cast("string"), F.lit(")] "), words).alias("caption"), "section_path")
