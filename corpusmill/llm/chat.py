"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the assistant and the others as named users; the
spans of the assistant's turns are the loss mask. A conversation is rendered in parts of PART turn numbers, and a part of which more than PART rows share these numbers in sections of PART
rows, so that one with a large share of all turns is many rows, none of which needs the whole of it. Texts move once by part and once to meet the participants; sections are found by keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

PART = 64
END = "<|end|>\n"
SYSTEM = "system"


def _sections(clean: DataFrame, part: int, scratch: Scratch) -> DataFrame | None:
    """_c, _t, _h, section of the rows of crowded parts, numbered in the order of turn and hash by counts over turns and the hash's first digits; None if no part is crowded."""
    keys = clean.select("conv_id", "part", "turn", "h").distinct()
    counts = scratch.save(keys.groupBy("conv_id", "part", "turn", F.substring("h", 1, 2).alias("salt")).agg(F.count(F.lit(1)).alias("c")))
    crowded = counts.groupBy(F.col("conv_id").alias("_c"), F.col("part").alias("_p")).agg(F.sum("c").alias("n")).filter(F.col("n") > part).drop("n")
    crowded = scratch.save(crowded)
    if crowded.isEmpty():
        return None
    mine = lambda df: df.join(crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")), "left_semi")
    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id", "part").orderBy("turn", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = mine(counts).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("salt").alias("_s"), before.alias("ahead"))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn", "salt").orderBy("h")) - 1
    placed = mine(keys).withColumn("salt", F.substring("h", 1, 2)).withColumn("k", place)
    met = placed.join(ahead, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")) & (F.col("salt") == F.col("_s")))
    return met.select("_c", "_t", F.col("h").alias("_h"), F.floor((F.col("ahead") + F.col("k")) / part).alias("section"))


def rotate_perspectives(turns: DataFrame, part: int = PART) -> DataFrame:
    """turns(conv_id, turn, role, text) -> conv_id, perspective, part, section, n_turns, rendered, mask, n_masked.

    One row for each conversation, participant, part and section. mask lists start:end of the participant's texts with their end marks
    in code points of rendered (empty in a part where it doesn't speak). System turns are rendered, in the part where they fall, but are no participant's. A null
    role is the speaker "unknown", a null text is empty, a null turn comes before the first (-1), null conversations are one.
    Equal rows count once, turns that tie are ordered by a hash of role and text. An empty table gives an empty result; further columns are ignored.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    clean = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("part", F.floor(F.col("turn") / part)).withColumn("h", F.md5(F.concat("speaker", F.lit("\n"), "text")))
    sections = _sections(clean, part, scratch)
    if sections is None:
        clean = clean.withColumn("section", F.lit(0).cast("long"))
    else:
        clean = clean.join(sections, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")) & (F.col("h") == F.col("_h")), "left").withColumn("section", F.coalesce("section", F.lit(0)).cast("long"))
    parts = clean.groupBy("conv_id", "part", "section").agg(F.array_sort(F.collect_set(F.struct("turn", "h", "speaker", "text"))).alias("said"))
    people = clean.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    mine = lambda x: x["speaker"] == F.col("perspective")
    head = lambda x: F.when(mine(x), F.lit("<|assistant|>\n")).when(x["speaker"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), x["speaker"], F.lit("|>\n")))
    rendered = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("pieces", F.transform("said", lambda x: F.struct(head(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), mine(x).alias("mine"))))
    ended = rendered.withColumn("upto", F.transform("pieces", lambda x, i: F.aggregate(F.slice("pieces", F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y["head"]) + F.length(y["body"]))))
    spans = F.filter(F.transform("pieces", lambda x, i: F.struct((F.col("upto")[i] - F.length(x["body"])).alias("start"), F.col("upto")[i].alias("end"), x["mine"].alias("mine"))), lambda x: x["mine"])
    return ended.withColumn("spans", spans).select(
        "conv_id",
        "perspective",
        F.col("part").cast("long").alias("part"),
        "section",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_masked"),
    )


SQL = f"""
WITH u AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, CAST(floor(turn / {PART}.0) AS BIGINT) ORDER BY turn, md5(speaker || chr(10) || text)) - 1 AS n, CAST(floor(turn / {PART}.0) AS BIGINT) AS part FROM u),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.conv_id, perspective, part, CAST(n // {PART} AS BIGINT) AS section, n, speaker, text, speaker = perspective AS mine,
        CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = '{SYSTEM}' THEN '<|system|>' || chr(10) ELSE '<|user:' || speaker || '|>' || chr(10) END AS head,
        text || '<|end|>' || chr(10) AS body
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
w AS (SELECT *, CAST(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part, section ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM r)
SELECT conv_id, perspective, part, section, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS rendered,
  coalesce(string_agg((upto - length(body)) || ':' || upto, ',' ORDER BY n) FILTER (WHERE mine), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS BIGINT) AS n_masked
FROM w GROUP BY conv_id, perspective, part, section
"""
