"""Details in which queries differed from their SQL: signs of zeros, judges' texts that begin like JSON."""

import hashlib
import math

import duckdb
from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E
from corpusmill.operators import vectors as V
from corpusmill.plans import QUERIES, SQL


def over(spark, tmp_path, name, table, rows, schema):
    """The rows of a query, and of its SQL, over a table of these rows; signs of zeros are told apart."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    return sorted(map(repr, map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))), sorted(map(repr, con.execute(SQL[name]).fetchall()))


def test_judge_text_that_begins_like_json(spark, tmp_path):
    got, want = over(spark, tmp_path, "parse_judge_scores", "documents", [(2, "4763047826333361 Of a", 21), (5, "true or not", 11), (3, "x", 1)], "doc_id long, text string, n_chars long")
    assert got == want and "'4763047826333361 Of a'" in got[0]
    texts = ['{"score": 0.5, "reasoning": "a"} b', '{"x": 1} b', '{"x": 1}, {"x": 2}', '{"x": {"score": 1}} b', '{"score": 2, "reasoning": "c"}', "[1] b"]
    told = [tuple(r["j"]) for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").coalesce(1).select(E.parse_judge_scores(F.col("x")).alias("j")).collect()]
    assert told == [(0.5, "a"), (None, texts[1]), (None, texts[2]), (1.0, None), (2.0, "c"), (None, texts[5])]


def test_normalised_components_keep_the_sign_of_zero(spark, tmp_path):
    got, want = over(spark, tmp_path, "l2_normalize", "embeddings", [(1, [1.0, -1e-9, 1e-9, -0.5])], "vec_id long, embedding array<float>")
    assert got == want and "-0.0," in got[0]


def test_hashed_components_keep_the_sign_of_zero(spark, tmp_path):
    """Two words of one component whose values cancel but for a negative rest, one of them several times."""
    slot = lambda w: (lambda h: (h % V.DIMENSION, (h >> 8) % 1000 / 1000 - 0.5))(int.from_bytes(hashlib.md5(w.encode()).digest(), "big"))
    by: dict = {}
    for i in range(40_000):
        by.setdefault(slot(f"w{i}")[0], []).append(f"w{i}")
    told = next((a, b, n) for words in by.values() for a in words for b in words for n in (1, 2, 3) if -1e-9 < n * slot(a)[1] + slot(b)[1] < 0)
    text = " ".join([told[0]] * told[2] + [told[1], "else", "more"])
    got, want = over(spark, tmp_path, "hashed_embedding", "documents", [(1, text)], "doc_id long, text string")
    assert got == want and any(math.copysign(1, float(r.rsplit(", ", 1)[1][:-1])) < 0 and "-0.0)" in r for r in got)
