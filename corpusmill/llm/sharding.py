"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

DataFrame functions only. Each document is a point with four whole-number coordinates (language,
source, size on a log scale, id); a coordinate holds 22 bits of value above 40 bits of a hash of the row,
so rows that tie in value can still be split, and a third of all rows from one source is no obstacle.
Every level writes the points' nodes and costs one pass for the extents and a few passes that narrow the split point of all nodes
at once by histograms of at most BINS bins a node. The driver sees one row a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, number_rows

SHARDS = 24
BINS = 4096
VALUE_BITS, TIE_BITS = 22, 40
DIMENSIONS = ("lang", "source", "size", "id")


def leaves_for(total_bytes: int, target_bytes: int) -> int:
    """How many leaves reach the target size."""
    return max(1, -(-total_bytes // max(1, target_bytes)))


def _points(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    top = (1 << VALUE_BITS) - 1
    named = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(top + 1))
    on_log = F.least(F.lit(top), (F.log2(size.cast("double")) * 65536).cast("long"))
    on_line = F.pmod(F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), F.lit(1 << 40))
    has = set(docs.columns)
    values = [named("lang") if "lang" in has else F.lit(0), named("source") if "source" in has else F.lit(0), on_log]
    values = [v.cast("long") for v in values]
    same = F.xxhash64(*[x for c in ("doc_id", "lang", "source") if c in has for x in (F.col(c).isNull(), F.col(c))], F.col("text").isNull(), text)
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.array(*values).alias("values"), on_line.alias("line"), same.alias("same"))


def _told_apart(points: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """points with tie, a hash of the row; rows that are equal in all are numbered and hashed with their numbers, so ties don't depend on how the table is dealt."""
    again = scratch.save(points.groupBy("same").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("same"))
    told = points.withColumn("place", F.lit(0).cast("long"))
    if not again.isEmpty():
        repeated = scratch.save(points.join(again, "same", "left_semi").withColumn("_at", F.monotonically_increasing_id()))
        repeated = number_rows(repeated, "same", [F.col("_at")], rows, "place").drop("_at")
        told = scratch.save(points.join(again, "same", "left_anti").withColumn("place", F.lit(0).cast("long")).unionByName(repeated))
    tie = F.pmod(F.xxhash64("same", "place"), F.lit(1 << TIE_BITS))
    keys = F.concat(F.transform("values", lambda v: v * (1 << TIE_BITS) + F.col("tie")), F.array(F.col("line") * (1 << VALUE_BITS) + F.shiftright("tie", TIE_BITS - VALUE_BITS)))
    return told.withColumn("tie", tie).select("doc_id", "size", "text_crc32", keys.alias("at"), "tie")


def _by_node(values: dict, kind: str) -> Column:
    """A value looked up by a row's node in a literal map of at most one entry a node; null elsewhere."""
    return F.create_map(*[F.lit(x).cast(t) for n, v in values.items() for x, t in ((n, "int"), (v, kind))])[F.col("node")]


def _split(splits: dict) -> Column:
    """The next level's node of a row: 2n for the low side, 2n + 1 for the high side; leaves stay."""
    low = F.col("at")[_by_node({n: d for n, (d, _) in splits.items()}, "int")] < _by_node({n: v for n, (_, v) in splits.items()}, "long")
    return F.when(F.col("node").isin(list(splits)), F.when(low, F.col("node") * 2).otherwise(F.col("node") * 2 + 1)).otherwise(F.col("node")).cast("int")


def kd_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0005, target_bytes: int | None = None) -> DataFrame:
    """docs(doc_id, text[, lang, source]) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Splitting ends when leaves reach target_bytes; the default target is a shards-th of all bytes. Shards have near equal bytes: every split leaves each side its share of the node's bytes, to one row or to
    tolerance of a shard. Null texts count as empty (8 bytes, crc32 0), null languages or sources as one more
    value, null ids as the lowest. Repeated rows are rows like others, numbered to be told apart, so any number of them is split. How the table is dealt or ordered changes nothing but which of equal rows is which. An empty table gives an empty result;
    further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "kd")
    points = scratch.save(_points(docs))
    rows, total = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards if target_bytes is None else leaves_for(total, target_bytes)
    leaves = {1: shards}  # node -> shards below it
    splits: dict = {}
    current = _told_apart(points, scratch, rows).withColumn("node", F.lit(1))
    ranges: list | None = None
    current_saved = False
    while rows and any(n > 1 for n in leaves.values()):
        open_nodes = [n for n in leaves if leaves[n] > 1]
        dims = range(len(DIMENSIONS))
        extent = current.filter(F.col("node").isin(open_nodes)).groupBy("node").agg(F.sum("size").alias("bytes"), *[f(F.col("at")[d]).alias(f"{k}{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()
        if ranges is None:
            ranges = [max(1, extent[0][f"hi{d}"] - extent[0][f"lo{d}"]) for d in dims]
        state = {}
        for x in extent:
            d = max(dims, key=lambda d: ((x[f"hi{d}"] - x[f"lo{d}"]) / ranges[d], -d))
            n = x["node"]
            low = leaves[n] // 2
            state[n] = {"d": d, "lo": x[f"lo{d}"], "hi": x[f"hi{d}"] + 1, "below": 0, "want": x["bytes"] * low / leaves[n], "low": low}
        _narrow(current, state, tolerance * total / shards)
        splits = {n: (s["d"], s["at"]) for n, s in state.items()}
        for n in open_nodes:
            low = leaves[n] // 2
            count = leaves.pop(n)
            leaves |= {2 * n: low, 2 * n + 1: count - low}
            if n not in splits:  # no rows
                splits[n] = (0, 0)
        level = scratch.count
        current = scratch.save(current.withColumn("node", _split(splits)))
        if current_saved:
            scratch.drop(level)
        current_saved = True
    order = sorted(leaves, key=lambda n: n / 2 ** n.bit_length())
    first, at = {}, 0
    for n in order:
        first[n] = at
        at += leaves[n]
    shard = _by_node(first, "int")
    placed = current.select("doc_id", "size", "text_crc32", "tie", F.lit("bytes").alias("law"), shard.alias("shard"))
    return number_rows(placed, "shard", [F.col("doc_id"), F.col("tie"), F.col("size")], rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _narrow(current: DataFrame, state: dict, slack: float) -> None:
    """Sets state[n]['at'], the split point of each node, by histograms of the range that still holds it."""
    todo = set(state)
    while todo:
        pick = lambda k: _by_node({n: state[n][k] for n in todo}, "long")
        value = F.col("at")[_by_node({n: state[n]["d"] for n in todo}, "int")]
        width = {n: max(1, -(-(state[n]["hi"] - state[n]["lo"]) // BINS)) for n in todo}
        inside = current.filter(F.col("node").isin(list(todo))).select("node", "size", value.alias("v"), pick("lo").alias("lo"), pick("hi").alias("hi"), _by_node(width, "long").alias("step")).filter("v >= lo and v < hi")
        bins = inside.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
        want = _by_node({n: float(state[n]["want"] - state[n]["below"]) for n in todo}, "double")
        last = Window.partitionBy("node")
        found = bins.withColumn("upto", upto).withColumn("top", F.max("bin").over(last)).filter((F.col("upto") >= want) | (F.col("bin") == F.col("top"))).groupBy("node").agg(F.min_by(F.struct("bin", "bytes", "rows", "upto"), "bin").alias("x")).collect()
        for n, x in found:
            s = state[n]
            start = s["lo"] + x["bin"] * width[n]
            before = s["below"] + x["upto"] - x["bytes"]
            if x["rows"] == 1 or width[n] == 1 or x["bytes"] <= slack:
                s["at"] = start + width[n] if before + x["bytes"] - s["want"] < s["want"] - before else start
                todo.discard(n)
            else:
                s |= {"lo": start, "hi": min(s["hi"], start + width[n]), "below": before}
