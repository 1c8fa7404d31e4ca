"""Text columns: tokens, hashes, paths, page furniture and headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page furniture by whole line and by beginning.
NOISE_PHRASES = ("contents", "table of contents", "index", "preface", "foreword", "acknowledgments", "acknowledgements", "all rights reserved", "strictly confidential")
NOISE_PREFIXES = ("page ", "confidential and proprietary", "strictly confidential", "table of contents", "revised ", "effective date", "last updated", "copyright ", "all rights reserved", "isbn:", "isbn ")
# The heading patterns by priority as (name, level, pattern, number group, title group).
HEADING_PATTERNS = (
    ("markdown_heading", 0, r"^(#{1,6})\s+(.+)$", 0, 2),
    ("article_section_clause", 4, r"(?i)^(?:Article|Section|Clause|Part|Chapter|Appendix)\s+([\dIVXLC]+(?:\.\d+)*)\s*(?::|\.|\-|–|—)\s*(.+)$", 1, 2),
    ("roman_numeral", 1, r"(?i)^([IVXLC]+)\.\s+(.+)$", 1, 2),
    ("letter_subsection", 2, r"^([A-Z])\.\s+([A-Z][A-Za-z0-9\s\-,&'()/]{2,})$", 1, 2),
    ("numbered_section", 3, r"^(\d+(?:\.\d+){0,3})\s+([A-Z][A-Za-z0-9\s\-,&'()/]{3,})$", 1, 2),
    ("numbered_trailing_dot", 3, r"^(\d+(?:\.\d+){0,3})\.\s+([A-Z][A-Za-z0-9\s\-,&'()/]{3,})$", 1, 2),
    ("all_caps_heading", 5, r"^([A-Z][A-Z0-9\s\-/&]{5,})$", 0, 1),
)
#: What a heading of any pattern begins with.
BEGINNINGS = r"^(?:#|(?i:Article|Section|Clause|Part|Chapter|Appendix|[IVXLC]+\.)\s|[A-Z]\.\s|\d+[.\s]|[A-Z][A-Z0-9\s\-/&]{5,}$)"
ROMANS = "^(?i:I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII|XIII|XIV|XV|XVI|XVII|XVIII|XIX|XX)$"


def once(value: Column, use) -> Column:
    """use(value), with value computed once for the row however often use names it."""
    return F.transform(F.array(value), use)[0]


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Blanks and tabs to one blank, three or more line breaks to two, no white space at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(16))


def page_number(label: Column) -> Column:
    """The digits of a page label as a number, null without any."""
    return F.regexp_replace(label.cast("string"), r"\D", "").try_cast("int")


def document_type(path: Column) -> Column:
    """policy or legal by the top folder."""
    return F.when(F.split(path, "/")[0] == "legal", "legal").otherwise("policy")


def category_label(path: Column) -> Column:
    """The file's stem as a title."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.initcap(F.regexp_replace(stem, "[_-]+", " "))


def is_noise_line(line: Column) -> Column:
    """Empty lines, page furniture, leader dots, page numbers, and lines with less than 30 % letters."""
    lower = F.lower(strip(line))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    starts = reduce(lambda a, b: a | b, [lower.startswith(p) for p in NOISE_PREFIXES])
    return (
        (lower == "")
        | lower.isin(*NOISE_PHRASES)
        | starts
        | lower.rlike(r"(?:\.{3,}|_{3,}|-{3,}|\s{4,})\s*\d+$")
        | lower.rlike(r"^(?:page\s+)?[-–—\[(]?\s*\d+\s*[-–—\])]?$")
        | (letters < F.greatest(F.lit(3.0), F.length(line) * 0.3))
    )


def clean_title(title: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(strip(title), r"\s+", " "), r"[.:;\-–—]+$", ""), F.lit(200))


def parse_heading(line: Column) -> Column:
    """struct<level, number, title, pattern> of a heading line, else null. Patterns are tried by priority; a
    markdown heading with an empty or noisy title ends the search, any other pattern that fails its test lets the next one try."""
    # Few lines begin like a heading: the others end at one test.
    return F.when(strip(line).rlike(BEGINNINGS), F.transform(F.array(strip(line)), _heading)[0])


def _heading(text: Column) -> Column:
    """parse_heading of a stripped line, as the body of a lambda: computed once a row, and too large for generated code."""
    found = F.lit(None)
    for name, level, pattern, number, title in reversed(HEADING_PATTERNS):
        # One expression for each group: Java's ^ and $ are the line's ends here, as a line has no breaks.
        label = clean_title(F.regexp_extract(text, pattern, title))
        code = F.regexp_extract(text, pattern, number) if number else F.lit(None).cast("string")
        good = text.rlike(pattern) & (label != "") & ~is_noise_line(label)
        if name == "roman_numeral":
            good = good & code.rlike(ROMANS)
        if name == "all_caps_heading":
            letters = F.length(F.regexp_replace(label, r"[^\p{L}]", ""))
            good = good & (letters > 0) & (F.length(F.regexp_replace(label, r"[^\p{Lu}]", "")) >= 0.7 * letters)
        depth = F.length(F.regexp_extract(text, pattern, 1)) if name == "markdown_heading" else F.lit(level)
        made = F.struct(depth.cast("int").alias("level"), code.alias("number"), label.alias("title"), F.lit(name).alias("pattern"))
        found = F.when(good, made).otherwise(found)
        if name == "markdown_heading":
            found = F.when(text.rlike(pattern) & ~good, F.lit(None)).otherwise(found)
    return F.when((F.length(text) >= 3) & ~is_noise_line(text), found)
