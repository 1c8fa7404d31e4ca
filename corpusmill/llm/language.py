"""Language identification by compression: zstandard with one raw-content dictionary for each language.

A text goes to the language whose dictionary makes it smallest. The dictionaries come from a bounded
sample of labelled rows (PER_LANGUAGE documents, at most SLICE characters of each); every text is
judged whole, in pieces of PIECE bytes so that a dictionary helps all along a long text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

PER_LANGUAGE, SLICE, PIECE, LEVEL = 250, 500, 4096, 6
#: A relative gain under this over the second best language is a narrow margin. Where the gain is under SURE, as in very short
#: texts, the text is compressed again at FINE_LEVEL, which finds matches of three bytes.
MIN_MARGIN, SURE, FINE_LEVEL = 0.005, 0.03, 19
#: zstandard stores a short text plainly if compression saves next to nothing; behind a run that always shrinks, each byte saved counts.
PAD = b"\n" * 256
FOLDS = 5
#: Bytes of lower-cased text: ASCII letters and all that is not ASCII stay, the others part words.
_TABLE = bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_BUILT: dict = {}


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, slice_chars: int = SLICE) -> list[tuple[str, bytes]]:
    """(language, dictionary content) from labelled rows outside the held-out fold.

    The sample is chosen by a hash of the text, at a rate that the counts of languages set, so no language's
    rows meet in one task and equal texts count once. The driver gets at most about three times per_language slices a language.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return []
    top = 1 << 62
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(top, int(top * 3.0 * per_language / max(1, r["n"]))))])
    picked = usable.filter(F.pmod("h", F.lit(top)) <= rate[F.col("lang")]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, slice_chars)).alias("part"))
    by: dict[str, list] = {}
    for lang, h, part in picked.collect():
        by.setdefault(lang, []).append((h % top, part))
    return sorted((lang, b"\n".join(_plain(p) for _, p in sorted(rows)[:per_language])) for lang, rows in by.items())


def _plain(text: str) -> bytes:
    """Lower-cased words by single spaces, so that a language's words look alike in any layout."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def _compressors(learned: list[tuple[str, bytes]]) -> tuple[list, list]:
    """(language, compressor) at both levels, built once in a Python worker."""
    import zstandard as zstd

    key = hash(tuple(learned))
    if key not in _BUILT:
        made = ([], [])
        for out, level in zip(made, (LEVEL, FINE_LEVEL), strict=True):
            for lang, content in learned:
                words = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=level)
                out.append((lang, zstd.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)))
        _BUILT.clear()
        _BUILT[key] = made
    return _BUILT[key]


def _smallest(data: bytes, compressors: list) -> tuple[str, float]:
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors)
    second = sizes[1][0] if len(sizes) > 1 else len(data) + 1
    return sizes[0][1], min(1.0, max(0.0, 1 - sizes[0][0] / second))


def classify(text: str | None, compressors: tuple[list, list]) -> tuple[str, float]:
    """(language, relative gain over the second best); und and 0 without a letter or a learned language."""
    if not text or not compressors[0] or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = _plain(text) or b" "
    found = _smallest(data, compressors[0])
    return found if found[1] >= SURE else _smallest(PAD + data, compressors[1])


def identify_language(docs: DataFrame, learned: list[tuple[str, bytes]] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> docs with held_out, lang_pred, score and rejected.

    lang_pred is und for a null or empty text, one without letters, or if nothing could be learned; then score is 0.
    Ties go to the language that sorts first. rejected: und, or a score under min_margin. A null doc_id counts
    as an empty one for the fold. Repeated rows are judged alike, columns of the results' names are replaced, others kept.
    """
    learned = learn(docs) if learned is None else learned
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def compute(batch: pa.RecordBatch) -> list:
        compressors = _compressors(shared.value)
        rows = [classify(t, compressors) for t in batch.column("text").to_pylist()]
        return [[r[0] for r in rows], [r[1] for r in rows], [r[0] == "und" or r[1] < min_margin for r in rows]]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return add_columns(docs.withColumn("held_out", held_out()), fields, compute)
