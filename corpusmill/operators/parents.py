"""Parents made of whole pages, and their children: prose in chunks, code in one piece."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import saved, ship
from ..functions.text import strip
from .chunking import OVERLAP_TOKENS, chunk_semantic

PARENT_TOKENS, CHILD_TOKENS, CODE_TOKENS = 2000, 512, 40
#: Pages of a block are 2 to this.
BLOCK_BITS = 18
FENCE = r"(?sU)```[\w-]*\n.*?```"


def page_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def _steps(n: np.ndarray, run: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums before each page, where each page's run ends, where the parent after one that begins at a page begins)."""
    sums = np.concatenate([[0], np.cumsum(n)])
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    ends = np.repeat(np.append(first[1:], len(n)), np.diff(np.append(first, len(n))))
    after = np.maximum(np.searchsorted(sums, sums[:-1] + budget, side="right") - 1, np.arange(1, len(n) + 1))
    return sums, ends, np.minimum(after, ends)


def _block_ends(budget: int):
    """A block -> its row: the runs at its ends and the parent that is open at its end.

    Where one run fills the block, the open parent hangs on what the block before hands over: then held[i] are the tokens of the first i pages, and last[i], open[i] are
    the open parent and its tokens if the first new parent begins at page i. A parent holds at most budget pages, so these lists do too.
    """

    def told(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id")
        n, run, ids = rows["_n"].to_numpy(), rows["_run"].to_numpy(), rows["_id"].to_numpy()
        sums, ends, after = _steps(n, run, budget)
        size = len(n)
        whole = bool(ends[0] == size)
        if whole:
            last = list(range(size))
            for i in range(size - 1, -1, -1):
                if after[i] < size:
                    last[i] = last[after[i]]
            upto = min(size, int(np.searchsorted(sums, budget, side="right")))
            last = np.array(last[:upto])
        else:
            i = int(np.flatnonzero(run != run[-1])[-1]) + 1
            while after[i] < size:
                i = int(after[i])
            last = np.array([i])
        return pd.DataFrame({"_block": [rows["_block"].iloc[0]], "first_run": [run[0]], "last_run": [run[-1]], "whole": [whole], "total": [int(sums[-1])], "held": [sums[: len(last)].tolist()], "last": [ids[last].tolist()], "open": [(sums[-1] - sums[last]).tolist()]})

    return told


def _handed(blocks: list, budget: int) -> list[tuple[int, int, int]]:
    """(block, parent, tokens): the parent that is open where a block begins with its run."""
    found, run, parent, held = [], None, None, 0
    for b in blocks:
        goes_on = run == b["first_run"]
        if goes_on:
            found.append((b["_block"], parent, held))
        if not b["whole"]:
            parent, held = b["last"][0], b["open"][0]
        elif goes_on and held + b["total"] <= budget:
            held += b["total"]
        else:
            i = max(0, int(np.searchsorted(b["held"], budget - held, side="right")) - 1) if goes_on else 0
            parent, held = b["last"][i], b["open"][i]
        run = b["last_run"]
    return found


def _block_parents(budget: int):
    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id")
        n, run, ids = rows["_n"].to_numpy(), rows["_run"].to_numpy(), rows["_id"].to_numpy()
        sums, ends, after = _steps(n, run, budget)
        parent, i = np.zeros(len(n), np.int64), 0
        if pd.notna(rows["_parent"].iloc[0]):
            room = budget - int(rows["_held"].iloc[0])
            i = min(max(0, int(np.searchsorted(sums, room, side="right")) - 1), int(ends[0]))
            parent[:i] = int(rows["_parent"].iloc[0])
        while i < len(n):
            parent[i : after[i]] = ids[i]
            i = int(after[i])
        return pd.DataFrame({"_id": ids, "_group": parent})

    return placed


def page_groups(pages: DataFrame, file: str = "source_file", page: str = "page_number", section: str = "section_path", text: str = "text", budget: int = PARENT_TOKENS) -> DataFrame:
    """pages with _id (their order) and _group (the _id of their parent's first page).

    A parent is a stretch of a file's pages, in the order of their numbers (null: 0; equal ones by a hash of the text), of one section (null is one too) and of budget tokens at most; a
    page beyond budget is a parent of its own. A file ends a parent. Pages are dealt by ranges of file and page, and a range is taken in blocks of 2^18 pages, so a
    file may be as large as it likes: a block's open parent is one row, and the driver walks over these rows to hand each block what the one before left open. Only
    three numbers a page are grouped; texts move when pages are dealt and when they meet their parents.
    """
    ship(pages.sparkSession)
    at = F.coalesce(F.col(page), F.lit(0))
    dealt = pages.withColumn("_tie", F.xxhash64(text)).withColumn("_at", at)
    dealt = dealt.repartitionByRange(file, "_at", "_tie").sortWithinPartitions(file, "_at", "_tie").drop("_tie", "_at")
    kept = saved(dealt.withColumn("_id", F.monotonically_increasing_id()), "page-order")
    told = lambda c: (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))
    light = kept.select("_id", F.shiftright("_id", BLOCK_BITS).alias("_block"), F.xxhash64(*told(file), *told(section)).alias("_run"), page_tokens(F.col(text)).alias("_n"))
    row = "_block long, first_run long, last_run long, whole boolean, total long, held array<long>, last array<long>, open array<long>"
    blocks = light.groupBy("_block").applyInPandas(_block_ends(budget), row).collect()
    handed = pages.sparkSession.createDataFrame(_handed(sorted(blocks, key=lambda b: b["_block"]), budget), "_block long, _parent long, _held long")
    placed = light.join(handed, "_block", "left").groupBy("_block").applyInPandas(_block_parents(budget), "_id long, _group long")
    return kept.join(placed, "_id")


def code_segments(text: Column, types: Column | None = None) -> Column:
    """array<struct<kind, text>>: fenced code with its fences, and the prose between, in order; a text without a fence that types calls code is code if it has more than 40 tokens."""
    between, fenced = F.split(text, FENCE, -1), F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    part = lambda kind, x: F.struct(F.lit(kind).alias("kind"), strip(x).alias("text"))
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.size(between) - 1), lambda i: F.array(part("prose", F.get(between, i)), part("code", F.get(fenced, i)))))
    cut = F.filter(both, lambda x: x["text"] != "")
    if types is None:
        return cut
    bare = F.lower(F.coalesce(types, F.lit(""))).contains("code") & ~text.rlike(FENCE) & (page_tokens(text) > CODE_TOKENS)
    return F.when(bare, F.array(F.struct(F.lit("code").alias("kind"), text.alias("text")))).otherwise(cut)


def page_parent_child(pages: DataFrame, file: str = "source_file", page: str = "page_number", section: str = "section_path", text: str = "text", types: str | None = None, budget: int = PARENT_TOKENS, size: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of the parents of page_groups.

    parents: parent_id, file, page (its first), section, text (its pages with a blank line between), n_pages; one without text is left out. children: parent_id, chunk_index, file, page,
    text, content_type, is_atomic, chunk_id: a page's code blocks in one piece each under a line that names file and page, whatever their length, and its prose in chunks of whole sentences.
    parent_id is a digest of file, first page and text, so parents that are equal in all have one id. types: a column of a page's block types. Null texts are empty.
    """
    grouped = page_groups(pages.withColumn(text, F.coalesce(F.col(text), F.lit(""))), file, page, section, text, budget)
    item = F.struct("_id", strip(F.col(text)).alias("t"))
    whole = grouped.groupBy("_group").agg(F.array_sort(F.collect_list(item)).alias("p"), *[F.min_by(c, "_id").alias(c) for c in (file, page, section)])
    joined = F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda x: x != ""), "\n\n")
    named = F.sha2(F.to_json(F.struct(F.col(file).alias("f"), F.col(page).alias("p"), F.col(text).alias("t"))), 256)
    parents = whole.select("_group", file, page, section, joined.alias(text), F.size("p").alias("n_pages")).filter(F.col(text) != "").withColumn("parent_id", named)

    cut = code_segments(F.col(text), None if types is None else F.col(types))
    parts = grouped.filter(strip(F.col(text)) != "").select("_group", "_id", F.col(file).alias("f"), F.col(page).alias("p"), F.posexplode(cut).alias("part", "x"))
    place = F.struct("_group", "_id", "part", "f", "p").alias("k")
    prose = chunk_semantic(parts.filter("x.kind = 'prose'").select(place, F.col("x.text").alias("text")), "k", "text", size, overlap, 1).select("k", F.col("chunk_index").alias("sub"), "text", F.lit("prose").alias("content_type"))
    head = F.concat(F.lit("[CODE BLOCK — "), F.coalesce(F.col("f").cast("string"), F.lit("document")), F.when(F.col("p") != 0, F.concat(F.lit(" p."), F.col("p").cast("string"))).otherwise(""), F.lit("]\n"))
    code = parts.filter("x.kind = 'code'").select(place, F.lit(0).alias("sub"), F.concat(head, F.col("x.text")).alias("text"), F.lit("code").alias("content_type"))
    every = prose.unionByName(code).select("k.*", "sub", "text", "content_type").repartition(F.xxhash64("_group"))
    index = F.row_number().over(Window.partitionBy("_group").orderBy("_id", "part", "sub")) - 1
    children = every.withColumn("chunk_index", index).join(parents.select("_group", "parent_id"), "_group")
    chunk = F.sha2(F.concat_ws("|", "parent_id", F.col("chunk_index").cast("string"), "text"), 256)
    children = children.select("parent_id", "chunk_index", F.col("f").alias(file), F.col("p").alias(page), "text", "content_type", (F.col("content_type") == "code").alias("is_atomic"), chunk.alias("chunk_id"))
    return parents.drop("_group"), children
