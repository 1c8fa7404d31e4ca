"""Files to document tables: every loader is a Spark reader plus column functions."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, document_type
from ..operators.structure import section_context

SUFFIXES = {"pdf": "pdf", "docx": "docx", "txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "csv": "csv", "json": "json", "jsonl": "json"}
MAX_BYTES = 100 * 1024 * 1024


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def discover_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, source_file, loader, length, modified, without reading any content; unknown suffixes are text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[suffix]
    return files.select("path", _file(F.col("path")).alias("source_file"), F.coalesce(kind, F.lit("text")).alias("loader"), "length", F.col("modificationTime").alias("modified"))


def list_source_files(spark: SparkSession, root: str) -> DataFrame:
    return discover_files(spark, root).select("source_file", F.round(F.col("length") / 1024, 1).alias("size_kb"), "modified")


def validate_upload(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files(path, length, content) with reason: null if the file is fit, else why it is not."""
    name = _file(F.col("path"))
    reason = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("length") > max_bytes, "file too large")
        .when(~name.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._()-]*$"), "unsafe name")
        .when(F.lower(name).endswith(".pdf") & (F.substring(F.hex(F.substring("content", 1, 4)), 1, 8) != "25504446"), "not a PDF")
    )
    return files.withColumn("reason", reason)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """source_file, content, content_hash, has_code, has_tables, section of the last heading."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))
    lines = whole.select("source_file", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    last = section_context(lines, "source_file").groupBy("source_file").agg(F.max_by("section_title", "line_no").alias("section_title"), F.max_by("section_path", "line_no").alias("section_path"))
    code = F.col("content").rlike(r"(?m)^\s*(def |class |import |from \w+ import |function |```)")
    return whole.join(last, "source_file").withColumn("content_hash", content_hash(F.col("content"))).withColumn("has_code", code).withColumn("has_tables", F.col("content").rlike(r"(?m)^\s*\|.*\|"))


def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    docs = load_text(spark, path)
    tables = F.col("content").rlike(r"\|\s*:?-+") | (F.col("content").contains("|") & F.col("content").contains("---"))
    return docs.withColumn("has_code", F.col("content").contains("```")).withColumn("has_tables", tables)


def load_csv_rendered(spark: SparkSession, path: str) -> DataFrame:
    """source_file, content (a pipe table, rows cut or padded to the header), columns, row_count: any number of columns, quoted commas, quotes and line breaks.

    A file is one document and so one row; validate_upload keeps it to MAX_BYTES. Blank lines are no rows, line breaks in a cell become spaces; a file without a row has 0 columns and an empty content.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), "value")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                content, width, count = [], 0, 0
                csv.field_size_limit(MAX_BYTES)
                for cells in csv.reader(io.StringIO(text.as_py().removeprefix("\ufeff"), newline="")):
                    if not any(c.strip() for c in cells):
                        continue
                    first, width = not content, width or len(cells)
                    cells = [" ".join(c.splitlines()) for c in cells[:width]] + [""] * (width - len(cells))
                    content.append(f"| {' | '.join(cells)} |")
                    count += not first
                    if first:
                        content.append(f"| {' | '.join(['---'] * width)} |")
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array(["\n".join(content)]), pa.array([width], pa.int32()), pa.array([count], pa.int32())], names=["source_file", "content", "columns", "row_count"])

    return whole.mapInArrow(render, "source_file string, content string, columns int, row_count int")


def _key_lines(pairs: Column) -> Column:
    """`- **Key**: value` lines of a map; nested values as JSON."""
    title = lambda k: F.initcap(F.regexp_replace(k, "_", " "))
    return F.array_join(F.transform(F.map_entries(pairs), lambda e: F.concat(F.lit("- **"), title(e["key"]), F.lit("**: "), F.coalesce(e["value"], F.lit("None")))), "\n")


def load_json_lines_rendered(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: `- **Key**: value` lines; lines that are no object are skipped."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("source_file"), "value")
    return raw.withColumn("m", F.from_json("value", "map<string,string>")).filter(F.col("m").isNotNull()).select("source_file", _key_lines(F.col("m")).alias("content"))


def render_json(value: Column) -> Column:
    """The text of a JSON file: key lines of an object; an array's objects under `### title` by rules, other elements as they are; anything else as it is."""
    pairs = lambda x: F.from_json(x, "map<string,string>")

    def item(x: Column, i: Column) -> Column:
        m = pairs(x)
        name = F.coalesce(*[F.nullif(m[k], F.lit("")) for k in ("title", "name", "policy", "topic")], F.concat(F.lit("Record "), (i + 1).cast("string")))
        return F.when(F.trim(x).startswith("{"), F.concat(F.lit("### "), name, F.lit("\n\n"), _key_lines(m))).otherwise(x)

    body = F.array_join(F.transform(F.from_json(value, "array<string>"), item), "\n\n---\n\n")
    first = F.substring(F.regexp_replace(value, r"^\s+", ""), 1, 1)
    return F.coalesce(F.when(first == "[", body).when(first == "{", _key_lines(pairs(value))), value)


def load_json_rendered(spark: SparkSession, path: str) -> DataFrame:
    """One document a file, rendered by render_json; record_count of an array."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), "value")
    return whole.select("source_file", render_json(F.col("value")).alias("content"), F.when(F.regexp_replace("value", r"^\s+", "").startswith("["), F.json_array_length("value")).alias("record_count"))


def pages_to_text(pages: DataFrame) -> DataFrame:
    """page_id, title, content of well-formed pages: scripts, styles, navigation and footers go, headings become # lines, cells pipe rows."""
    h = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav|footer)\b.*?</\1\s*>", " ")
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")
    for n in range(1, 7):
        h = F.regexp_replace(h, rf"(?is)<h{n}\b[^>]*>", "\n" + "#" * n + " ")
    h = F.regexp_replace(F.regexp_replace(h, r"(?is)<title\b.*?</title>", " "), r"(?is)</t[dh]\s*>", " | ")
    h = F.regexp_replace(h, r"(?is)<tr\b[^>]*>", "\n| ")
    h = F.regexp_replace(h, r"(?is)</?(p|div|article|section|ul|ol|li|table|tr|h[1-6]|br|body|html|head|main)\b[^>]*>", "\n")
    h = F.regexp_replace(h, r"<[^>]*>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        h = F.regexp_replace(h, f"&{name};", char)
    lines = F.filter(F.transform(F.split(h, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.select("page_id", title.alias("title"), F.array_join(lines, "\n").alias("content"))


def describe_files(files: DataFrame) -> DataFrame:
    return files.withColumn("document_type", document_type(F.col("path")))


class LoaderRegistry:
    """Suffix -> function(spark, path) -> DataFrame; later registrations come first."""

    def __init__(self) -> None:
        self.loaders: dict[str, Callable[[SparkSession, str], DataFrame]] = {"txt": load_text, "md": load_markdown, "markdown": load_markdown, "csv": load_csv_rendered, "json": load_json_rendered, "jsonl": load_json_lines_rendered}

    def register(self, suffix: str, loader: Callable[[SparkSession, str], DataFrame]) -> None:
        self.loaders[suffix.lower().lstrip(".")] = loader

    def load(self, spark: SparkSession, path: str) -> DataFrame:
        return self.loaders.get(path.rsplit(".", 1)[-1].lower(), load_text)(spark, path)
