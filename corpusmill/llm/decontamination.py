"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text.

The benchmark is a small fixed set: its normalised size is checked, and beyond BLOCK_CHARS of patterns it is
taken in blocks, each with its own automaton and scan, so no broadcast grows without a bound. The documents are
never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, add_columns

WINDOW = 13
#: Contaminated: hit words times this reach all words.
SHARE = 20
BLOCK_CHARS = 8_000_000
#: Bytes of words after A-Z are lowered: digits, letters and all that is not ASCII; the others part words.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {x: x + 32 for x in range(65, 91)}
_BUILT: dict = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    """The runs of window words, or the whole of a shorter, non-empty item."""
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


def _automaton(key: str, items: list[tuple[str, bytes]], window: int):
    """Built once in a Python worker; each pattern carries its items and its number of words."""
    import ahocorasick

    if key not in _BUILT:
        owners: dict[bytes, list[str]] = {}
        for item, text in items:
            for w in windows_of(text.split(), window):
                owners.setdefault(w, []).append(item)
        found = ahocorasick.Automaton()
        for w, own in owners.items():
            found.add_word(f" {w.decode('latin-1')} ", (own, w.count(b" ") + 1))
        found.make_automaton()
        _BUILT.clear()
        _BUILT[key] = found
    return _BUILT[key]


def _scan(text: str | None, automaton, spans: list, items: list) -> tuple[int, list, list]:
    """(words, merged [start, end) word intervals that are hit, items): what a text adds to earlier blocks' finds."""
    words = words_of(text)
    hits, own = [tuple(x) for x in spans or []], set(items or [])
    if words and len(automaton):
        line = f" {b' '.join(words).decode('latin-1')} "
        starts: list[int] = []
        for end, (who, n) in automaton.iter(line):
            if not starts:
                at = 1
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
            last = bisect_right(starts, end - 1)
            hits.append((last - n, last))
            own.update(who)
    merged: list[list[int]] = []
    for a, b in sorted(hits):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return len(words), merged, sorted(own)


def _original(text: str | None, spans: list) -> list[dict]:
    """Word intervals as code points of the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in spans]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(text, ...), benchmark(item_id, text) -> docs with n_words, n_hit, n_items, items, items_sha256, contaminated, hit_spans.

    hit_spans are code points of the original text. Null and empty texts have no words and are clean; items
    without words have no windows; items with equal ids count once, a null item_id counts as the item "null"; an empty benchmark hits nothing.
    Repeated documents are judged row by row. Columns of the results' names are replaced, others kept.
    """
    spark = docs.sparkSession
    space = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.trim(space).alias("norm")).filter("norm <> ''").distinct()
    # A window of an item of c characters and w words costs about its share of the text, so the patterns of an item cost at most window * c.
    cost = tests.agg(F.coalesce(F.sum(F.octet_length("norm")), F.lit(0)) * window).first()[0]
    blocks = max(1, -(-int(cost) // block_chars))
    parts = tests.withColumn("block", F.pmod(F.xxhash64("item", "norm"), F.lit(blocks)).cast("int"))
    scratch = Scratch(spark, "decontamination")
    # What blocks hand on has names that docs can't hold, as they are longer than any of its names.
    long = "_" * max(map(len, [*docs.columns, ""]))
    spans_name, items_name = f"_spans{long}", f"_items{long}"
    found = docs
    empty = [T.StructField("new" + spans_name, T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("new" + items_name, T.ArrayType(T.StringType()))]
    for block in range(blocks):
        items = sorted((r["item"], r["norm"].encode("utf-8", "surrogatepass")) for r in parts.filter(F.col("block") == block).collect())
        shared, key = spark.sparkContext.broadcast(items), hashlib.sha256(repr((items, window)).encode()).hexdigest()
        last, first = block == blocks - 1, block == 0

        def compute(batch: pa.RecordBatch, shared=shared, key=key, last=last, first=first) -> list:
            automaton = _automaton(key, shared.value, window)
            texts = batch.column("text").to_pylist()
            none = [None] * len(texts)
            spans, own = (none, none) if first else (batch.column(spans_name).to_pylist(), batch.column(items_name).to_pylist())
            rows = [_scan(t, automaton, s, i) for t, s, i in zip(texts, spans, own, strict=True)]
            if not last:
                return [[r[1] for r in rows], [r[2] for r in rows]]
            hit = [sum(b - a for a, b in r[1]) for r in rows]
            return [[r[0] for r in rows], hit, [len(r[2]) for r in rows], [r[2] for r in rows], [hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows], [h > 0 and share * h >= r[0] for r, h in zip(rows, hit, strict=True)], [_original(t, r[1]) for t, r in zip(texts, rows, strict=True)]]

        spot = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        results = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("hit_spans", T.ArrayType(spot))]
        found = add_columns(found, results if last else empty, compute)
        found = found.drop(spans_name, items_name)
        if not last:
            found = scratch.save(found.withColumnsRenamed({"new" + spans_name: spans_name, "new" + items_name: items_name}))
    return found
