"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece goes on past a white-space marker, a text's pieces are those of its chunks, each a run of markers and what follows it.
Every distinct chunk that occurs again is counted and segmented once; the most frequent go to all tasks as a dictionary of bounded size.
A task takes a block of texts to its distinct chunks, looks them up, segments what the dictionary lacks (chunks that occur once, and the rarest of a
large corpus, once a block) and puts the ids back by position. Texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, ship

MARK = "▁"
#: What the dictionary may hold: a digest of 16 bytes, a place and the ids of each chunk.
DICTIONARY_BYTES, ENTRY = 32 << 20, 20
#: A task counts so many distinct chunks before it hands them on, and looks up the chunks of so many bytes of text together.
HELD, BLOCK_BYTES = 200_000, 2 << 20
SLICE = 256
_CHUNK = re.compile(" +[^ ]*")
_PROBE = "  a \t　ﬁ é\n  B  "
_LOADED: dict = {}


def _held(key, make):
    """The worker's own copy of what belongs to key; one of each kind is kept."""
    if _LOADED.get(key[0], (None,))[0] != key:
        _LOADED[key[0]] = (key, make())
    return _LOADED[key[0]][1]


def processor(model: bytes):
    import sentencepiece

    return _held(("model", hashlib.sha256(model).digest()), lambda: sentencepiece.SentencePieceProcessor(model_proto=model))


def check_model(model: bytes) -> None:
    """Raises ValueError unless the model leaves characters as they are, marks each space and the start, and has no piece with a marker behind another character."""
    sp = processor(model)
    if sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
        raise ValueError("the model changes texts before it cuts them")
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("the model has pieces that cross a white-space marker")


def chunks_of(text: str | None) -> list[str]:
    """Runs of markers, written as spaces, each with what follows it; the first has the marker that the model puts before a text."""
    return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def _segment(sp, chunks: list[str]) -> list[bytes]:
    """The model puts a chunk's first marker there itself; a lone marker, as a text's end may have, is what it adds behind another chunk."""
    alone = sp.encode("a ")[len(sp.encode("a")) :]
    return [np.array(x or alone, np.int32).tobytes() for x in sp.encode([c[1:] for c in chunks], num_threads=1)] if chunks else []


def _digest(chunk: str) -> bytes:
    return xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass"))


def _place_all(found: pa.Table) -> bytes:
    """Digests in order and the ids behind each other, as one stream of bytes for _look_up."""
    digests = np.frombuffer(b"".join(found["digest"].to_pylist()), np.uint64).reshape(-1, 2)
    order = np.argsort(digests[:, 0], kind="stable")
    ids = found["piece_ids"].take(pa.array(order)).to_pylist()
    ends = np.cumsum([0, *map(len, ids)], dtype=np.uint32)
    return b"".join([np.int64(len(order)).tobytes(), np.ascontiguousarray(digests[order].T).tobytes(), ends.tobytes(), *ids])


def _look_up(stream: bytes, chunks: list[str]) -> list[bytes | None]:
    """Each chunk's ids, or None if it isn't there."""
    n = int(np.frombuffer(stream, np.int64, 1)[0])
    if not n or not chunks:
        return [None] * len(chunks)
    first, second = np.frombuffer(stream, np.uint64, 2 * n, 8).reshape(2, n)
    ends, base = np.frombuffer(stream, np.uint32, n + 1, 8 + 16 * n), 8 + 16 * n + 4 * (n + 1)
    asked = np.frombuffer(b"".join(map(_digest, chunks)), np.uint64).reshape(-1, 2)
    at = np.minimum(np.searchsorted(first, asked[:, 0]), n - 1)
    hit = (first[at] == asked[:, 0]) & (second[at] == asked[:, 1])
    return [stream[base + a : base + b] if h else None for h, a, b in zip(hit.tolist(), ends[at].tolist(), ends[at + 1].tolist(), strict=True)]


def repeated_chunks(texts: DataFrame, model: bytes) -> DataFrame:
    """texts(text) -> chunk, n (its occurrences, two or more), piece_ids (32-bit numbers), digest: every distinct chunk that occurs again, segmented once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        give = lambda: pa.Table.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["chunk", "n"]).to_batches(max_chunksize=50_000)
        for batch in batches:
            for text in batch.column(0):
                seen.update(chunks_of(text.as_py()))
                if len(seen) >= HELD:
                    yield from give()
                    seen.clear()
        yield from give()

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_segment(sp, chunks), pa.binary()), pa.array([_digest(c) for c in chunks], pa.binary())], names=["chunk", "n", "piece_ids", "digest"])

    counted = texts.select("text").mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1")
    return counted.mapInArrow(segment, "chunk string, n long, piece_ids binary, digest binary")


def _level(table: DataFrame, limit: int) -> int:
    """The least power of two from which on the chunks that occur as often fit into limit bytes."""
    cost = F.octet_length("piece_ids") + ENTRY
    total, level = 0, 62
    by = table.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.sum(cost).alias("bytes")).collect()
    for row in sorted(by, key=lambda r: -r["level"]):
        total += row["bytes"]
        if total > limit:
            return level
        level = row["level"]
    return 0


def encode(docs: DataFrame, model: bytes, dictionary_bytes: int = DICTIONARY_BYTES, decoded: bool = False) -> DataFrame:
    """docs with a column text -> the other columns and ids, array<int>, exactly the library's ids of the whole text without begin and end.

    Null and empty texts have no ids; a marker that a text itself holds counts as a space, as in the library. Repeated rows are rows like
    others, a column named ids is replaced. The text isn't carried along: decode gives it back, or decoded adds what decode would, in the same task. The model is checked first (check_model). An empty table gives an empty result.
    """
    check_model(model)
    spark = docs.sparkSession
    scratch = Scratch(spark, "sentencepiece")
    table = scratch.save(repeated_chunks(docs, model))
    least = 1 << _level(table, dictionary_bytes)
    frequent = table.filter(F.col("n") >= least).select("digest", "piece_ids").toArrow()
    shipped = spark.sparkContext.broadcast(_place_all(frequent))
    kept = [f for f in docs.schema.fields if f.name.lower() not in (("text", "ids", "decoded") if decoded else ("text", "ids"))]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    kind = to_arrow_type(schema["ids"].dataType)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in _blocks(batches):
            chunked = [chunks_of(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            distinct = list(set().union(*chunked))
            pieces = dict(zip(distinct, _look_up(shipped.value, distinct), strict=True))
            other = [c for c, x in pieces.items() if x is None]
            pieces.update(zip(other, _segment(sp, other), strict=True))
            found = [b"".join(map(pieces.__getitem__, x)) for x in chunked]
            texts = [pa.array(_decode(sp, (np.frombuffer(x, np.int32).tolist() for x in found)), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(found, kind), *texts], names=schema.names)

    return docs.select(*[f.name for f in kept], "text").mapInArrow(look_up, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_BYTES in the last column, a text; a longer text is one by itself."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes, dtype=np.int64) // BLOCK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _lists(data: list[bytes], kind: pa.DataType) -> pa.Array:
    """Each text's 32-bit numbers as a list."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), np.int32), pa.int32())).cast(kind)


def _decode(sp, ids) -> list[str]:
    return [sp.decode(x, num_threads=1) if x else "" for x in ids]


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Adds decoded, the library's text of the column ids (null ids: empty); a column of that name is replaced."""
    ship(encoded.sparkSession)
    kept = encoded.select(*[c for c in encoded.columns if c.lower() not in ("decoded", "ids")], "ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = _decode(sp, (x.as_py() for x in batch.column(batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    both = encode(docs.select("doc_id", "text"), model, decoded=True)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
