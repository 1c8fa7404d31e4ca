"""A trie of conversations' prefixes, screened by a count-min sketch.

Turns are numbered by runs of a global order, so that a conversation of very many turns is dealt over many tasks. A prefix is known by the
exclusive or of 128-bit hashes of its turns with their depths, which runs along the turns and is put together over the borders of runs.
A sketch of all prefixes' digests goes to all tasks: a prefix estimated at one is nobody else's, and what lies below the first of them is told
where it stands. Only prefixes that may be shared, and the first below them, are shuffled and grouped exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, add_columns, ship

#: Conversations in a family start from the first HEADS - 1 turns at most of the one whose id they share up to FAMILY.
FAMILY, HEADS = 20, 4
#: Hashes of the sketch, the most cells of each, and cells in one piece of it.
ROWS, MOST_CELLS, PIECE = 4, 1 << 23, 1 << 16
#: Ids of a node's ending conversations that are put together before the rest.
IDS = 4096
NODE = ["depth", "x", "y"]
_WORD = "[^\\x20\\x09-\\x0D]+"


def _lane(k: int, depth: Column, content: Column) -> Column:
    return F.xxhash64(F.lit(k), depth.cast("long"), content)


def _numbered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, block, turn, content, words, rn) and (conv_id, block, ahead, own, first, several): turns numbered inside blocks of the order, and the turns ahead of each block."""
    text, role = (F.coalesce(c, F.lit("")) for c in ("text", "role"))
    content = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    clean = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), content.alias("content"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("content").asc(), F.col("_tie").asc()]
    ranged = clean.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("block", F.spark_partition_id())
    base = scratch.save(ranged)
    rn = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order[1:]))
    counts = base.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("conv_id")
    ahead = F.coalesce(F.sum("size").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own, several = F.sum("size").over(whole), F.count(F.lit(1)).over(whole) > 1
    blocks = counts.select("conv_id", "block", ahead.alias("ahead"), own.alias("own"), (ahead == 0).alias("first"), several.alias("several"))
    return base.withColumn("rn", rn).drop("_tie"), blocks


def rebuilt_prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, block, several, depth, n (its turns), words, x, y (digest within block), u, v (this turn's part): a row for each rebuilt turn and one of depth 0."""
    numbered, blocks = _numbered(turns, scratch)
    top = numbered.filter(F.col("conv_id") % FAMILY == 0).withColumn("p", F.row_number().over(Window.partitionBy("conv_id").orderBy("block", "rn"))).filter(F.col("p") < HEADS)
    heads = top.groupBy(F.col("conv_id").alias("_base")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "content", "words"))), lambda t: F.struct(t["content"].alias("content"), t["words"].alias("words"))).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS)).cast("int")
    info = blocks.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("_base"), "left").drop("_base")
    info = info.withColumn("h", h).withColumn("head", F.slice(F.coalesce("head", F.expr("array()").cast("array<struct<content:binary,words:bigint>>")), F.lit(1), F.col("h")))
    info = info.withColumn("m", F.size("head")).withColumn("n", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    hashed = F.transform("head", lambda t, i: F.struct((i + 1).cast("long").alias("depth"), t["words"].alias("words"), _lane(1, i + 1, t["content"]).alias("u"), _lane(2, i + 1, t["content"]).alias("v")))
    info = scratch.save(info.withColumn("head", hashed))
    xor = lambda items, name: F.aggregate(items, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t[name]))
    came = info.filter("first").select("conv_id", "block", "several", "n", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"))), "head")).alias("t"), "head")
    upto = F.filter("head", lambda t: t["depth"] <= F.col("t.depth"))
    came = came.select("conv_id", "block", "several", "t.depth", "n", "t.words", xor(upto, "u").alias("x"), xor(upto, "v").alias("y"), "t.u", "t.v")
    mine = numbered.join(info.drop("own"), ["conv_id", "block"]).withColumn("p", F.col("rn") + F.col("ahead")).filter(F.col("p") > F.col("h")).withColumn("depth", (F.col("m") + F.col("p") - F.col("h")).cast("long"))
    mine = mine.withColumn("u", _lane(1, F.col("depth"), F.col("content"))).withColumn("v", _lane(2, F.col("depth"), F.col("content")))
    run = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ahead = lambda name: F.when(F.col("first"), xor("head", name)).otherwise(F.lit(0).cast("long"))
    mine = mine.withColumn("x", F.bit_xor("u").over(run).bitwiseXOR(ahead("u"))).withColumn("y", F.bit_xor("v").over(run).bitwiseXOR(ahead("v")))
    local = scratch.save(came.unionByName(mine.select(came.columns)))
    # At most two rows for each block: the conversations that begin before it or go on behind it.
    totals = local.filter("several").groupBy("conv_id", "block").agg(F.max(F.struct("depth", "x", "y")).alias("t"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.bit_xor("t.x").over(before), F.lit(0).cast("long")).alias("cx"), F.coalesce(F.bit_xor("t.y").over(before), F.lit(0).cast("long")).alias("cy"))
    met = local.join(F.broadcast(scratch.save(carry)), (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    full = lambda c, carried: F.col(c).bitwiseXOR(F.coalesce(carried, F.lit(0).cast("long")))
    return met.withColumn("x", full("x", "cx")).withColumn("y", full("y", "cy")).drop("_c", "_b", "cx", "cy")


def _cells(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The cell of each digest in each row of a sketch."""
    x, y = x.view(np.uint64), y.view(np.uint64) | np.uint64(1)
    return np.stack([((x + np.uint64(r) * y) % np.uint64(size)).astype(np.int64) + r * size for r in range(ROWS)])


def sketch(prefixes: DataFrame, size: int) -> bytes:
    """A bit for each of ROWS * size cells, set if two prefixes or more fall into it: all that is asked of the counts is whether they are one."""
    ship(prefixes.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ROWS * size, np.uint8)
        for batch in batches:
            found, n = np.unique(_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), size), return_counts=True)
            held[found] = np.minimum(2, held[found] + np.minimum(n, 2))
        pieces = held.reshape(-1, PIECE)
        some = np.flatnonzero(pieces.any(axis=1))
        bits = [[np.packbits(pieces[i] >= k).tobytes() for i in some] for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bits[0], pa.binary()), pa.array(bits[1], pa.binary())], names=["piece", "ones", "twos"])

    def merge(group: pa.Table) -> pa.Table:
        one, two = (np.zeros(PIECE // 8, np.uint8) for _ in range(2))
        for a, b in zip(group["ones"], group["twos"], strict=True):
            a, b = (np.frombuffer(z.as_py(), np.uint8) for z in (a, b))
            one, two = one | a, two | b | (one & a)
        return pa.table([pa.array([group["piece"][0].as_py()]), pa.array([one.tobytes()], pa.binary()), pa.array([two.tobytes()], pa.binary())], names=["piece", "ones", "twos"])

    schema = "piece long, ones binary, twos binary"
    parts = prefixes.select("x", "y").mapInArrow(part, schema)
    near = parts.withColumn("some", F.spark_partition_id() % 64).groupBy("piece", "some").applyInArrow(lambda _, t: merge(t), schema)
    out = np.zeros((ROWS * size // PIECE, PIECE // 8), np.uint8)
    for row in near.groupBy("piece").applyInArrow(lambda _, t: merge(t), schema).select("piece", "twos").toArrow().to_pylist():
        out[row["piece"]] = np.frombuffer(row["twos"], np.uint8)
    return out.tobytes()


def _screen(prefixes: DataFrame, seen: bytes, size: int) -> DataFrame:
    """Adds shared and above: whether the prefix, and its parent, may be another conversation's as well."""
    shipped = prefixes.sparkSession.sparkContext.broadcast(seen)

    def compute(batch: pa.RecordBatch) -> list:
        bits = np.frombuffer(shipped.value, np.uint8)
        x, y, u, v, depth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("x", "y", "u", "v", "depth"))
        many = lambda a, b: ((bits[(cells := _cells(a, b, size)) >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)
        return [many(x, y), many(x ^ u, y ^ v) | (depth == 1)]

    return add_columns(prefixes, [T.StructField("shared", T.BooleanType()), T.StructField("above", T.BooleanType())], compute, rows=10_000)


def _ends(ends: DataFrame) -> DataFrame:
    """depth, x, y, conv_id -> depth, x, y, ends_sha256: ids in order, put together in many tasks and hashed as a stream."""
    ship(ends.sparkSession)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        give = lambda: pa.RecordBatch.from_arrays([pa.array([z]) for z in (*key, ids[0], ",".join(map(str, ids)))], names=[*NODE, "start", "ids"])
        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (node != key or len(ids) == IDS):
                    yield give()
                    ids = []
                key = node
                ids.append(conv)
        if ids:
            yield give()

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([z]) for z in (*key, state.hexdigest())], names=[*NODE, "ends_sha256"])
        for batch in batches:
            for *node, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node == key:
                    state.update(b",")
                else:
                    if key:
                        yield give()
                    key, state = node, hashlib.sha256()
                state.update(ids.encode())
        if key:
            yield give()

    ordered = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = ordered.mapInArrow(put_together, "depth long, x long, y long, start long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "start").mapInArrow(hash_all, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations' trie.

    Turns go by number, null first, equal numbers by a hash of role and text; equal turns count each. A null role or text is empty. Turns without a conv_id belong to
    no conversation and make no node. An empty table gives an empty result, further columns are ignored. Up to half as many prefixes as
    most_cells, nearly every unshared prefix is told without a shuffle; beyond, more of them are grouped, with the same result.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    prefixes = rebuilt_prefixes(turns, scratch)
    below = prefixes.filter("depth > 0")
    total = prefixes.count()
    size = max(PIECE, min(most_cells, 1 << (2 * total).bit_length()))
    screened = _screen(below, sketch(below, size), size)
    told = screened.filter("not shared and not above")
    moved = scratch.save(screened.filter("shared or above"))
    alone = moved.filter("not shared").groupBy(F.col("conv_id").alias("_c")).agg(F.min("depth").alias("cut"))
    cut = scratch.save(moved.join(alone, F.col("conv_id") == F.col("_c"), "left").drop("_c"))
    told = told.unionByName(cut.filter("depth > cut").drop("cut"))
    exact = cut.filter("cut is null or depth <= cut")
    nodes = scratch.save(
        exact.groupBy(*NODE).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("head"), F.max("n").alias("deepest"), F.min("u").alias("u"), F.min("v").alias("v"), F.max("shared").alias("shared"))
    )
    mine = nodes.select(*[F.col(c).alias(f"_{c}") for c in NODE], "head", "deepest")
    same = (F.col("depth") == F.col("_depth")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    met = exact.join(mine, same)
    first = F.col("conv_id") == F.col("head")
    # A conversation stands for a leaf at its end, if no smaller one ends there, or at the first prefix that is its own.
    stands = first & (~F.col("shared") | ((F.col("deepest") == F.col("depth")) & (F.col("n") == F.col("depth"))))
    met = met.select("conv_id", "block", "several", *NODE, F.when(first, 0).otherwise(F.col("words")).cast("decimal(38, 0)").alias("words"), stands.cast("long").alias("stands"))
    upwards = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = scratch.save(met.select("conv_id", "block", "several", *NODE, F.sum("words").over(upwards).cast("decimal(38, 0)").alias("saved"), F.sum("stands").over(upwards).alias("leaves")))
    totals = summed.filter("several").groupBy("conv_id", "block").agg(F.max(F.struct(-F.col("depth"), "saved", "leaves")).alias("t"))
    behind = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.sum("t.saved").over(behind).alias("more_saved"), F.sum("t.leaves").over(behind).alias("more_leaves"))
    carried = summed.join(F.broadcast(scratch.save(carry)), (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    sums = carried.groupBy(*NODE).agg(F.sum(plus("saved", "more_saved")).cast("long").alias("saved_tokens"), F.sum(plus("leaves", "more_leaves")).alias("n_leaves"))
    parent = [(F.col("depth") - 1).alias("_depth"), F.col("x").bitwiseXOR(F.col("u")).alias("_x"), F.col("y").bitwiseXOR(F.col("v")).alias("_y")]
    children = nodes.groupBy(*parent).agg(F.count(F.lit(1)).alias("below"))
    turnless = prefixes.filter("depth = 0 and n = 0")
    ends = _ends(exact.filter("shared and depth = n"))
    ended = ends.select(*[F.col(c).alias(f"_{c}") for c in NODE], "ends_sha256")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    own_end = F.when(F.col("depth") == F.col("deepest"), F.sha2(F.col("head").cast("string"), 256)).otherwise(nothing)
    whole = nodes.join(sums, NODE).join(children, same, "left").drop("_depth", "_x", "_y").join(ended, same, "left").drop("_depth", "_x", "_y")
    whole = scratch.save(
        whole.select(
            *NODE, "head", "u", "v", "n_convs",
            F.when(F.col("shared"), F.coalesce("below", F.lit(0))).otherwise((F.col("deepest") > F.col("depth")).cast("long")).alias("n_children"),
            "n_leaves", "saved_tokens",
            F.when(F.col("shared"), F.coalesce("ends_sha256", nothing)).otherwise(own_end).alias("ends_sha256"),
        )
    )
    over = nodes.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("head").alias("parent_conv_id"))
    above = (F.col("depth") - 1 == F.col("_depth")) & (F.col("x").bitwiseXOR(F.col("u")) == F.col("_x")) & (F.col("y").bitwiseXOR(F.col("v")) == F.col("_y"))
    root = prefixes.filter("depth = 0").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    smallest = F.broadcast(root.select(F.col("conv_id").alias("smallest")))  # one row
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rest = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = whole.filter("depth > 1").join(over, above).select(F.col("head").alias("conv_id"), "depth", "parent_conv_id", *rest)
    top = whole.filter("depth = 1").crossJoin(smallest).select(F.col("head").alias("conv_id"), "depth", F.col("smallest").alias("parent_conv_id"), *rest)
    under = whole.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root_ends = _ends(turnless).agg(F.coalesce(F.max("ends_sha256"), nothing).alias("ends_sha256"))
    root = root.crossJoin(F.broadcast(under)).crossJoin(F.broadcast(root_ends)).withColumn("depth", F.lit(0).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = told.select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("n") > F.col("depth")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("n") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return root.select(out).union(top.select(out)).union(inner.select(out)).union(tails.select(out))
