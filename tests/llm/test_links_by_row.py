"""Links run through rows, not ids: null ids, repeated ids, repeated rows."""

import numpy as np

from corpusmill.llm import embedding, simhash


def test_vectors_without_an_id_link_like_others(spark):
    rng = np.random.default_rng(3)
    x, y, z = (v / np.linalg.norm(v) for v in rng.standard_normal((3, 16)))
    near = x + 0.3 * (y - y.dot(x) * x) / np.linalg.norm(y - y.dot(x) * x)  # cosine about 0.96
    far = x + 0.7 * (y - y.dot(x) * x) / np.linalg.norm(y - y.dot(x) * x)  # about 0.82 to x, above 0.9 to near
    rows = [(5, x), (None, 1.01 * x), (None, near), (3, far), (7, z), (None, z), (9, None), (None, None), (11, -y), (11, z), (None, -z)]
    table = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    key = lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"] or 0)
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in sorted(embedding.embedding_components(table).collect(), key=key)]
    assert got == [
        (3, 1, 3, True), (5, 2, 3, False), (7, 2, 7, True), (9, 0, 9, True), (11, 0, 11, True), (11, 2, 7, False),
        (None, 0, None, True), (None, 0, None, True), (None, 2, 3, False), (None, 2, 7, False), (None, 3, 3, False),
    ]


def test_texts_under_one_doc_id(spark):
    rows = [(1, "alpha beta gamma delta one two"), (1, "quite another text of other words"), (2, "alpha beta gamma delta one two"), (3, "quite another text of other words"), (4, "x y z"), (4, "x y z"), (None, "lone text here"), (None, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.simhash_components(docs).collect())
    assert got == [(-1, -1), (-1, 8), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (8, 8)]
    joined = [(1, rows[0][1]), (2, rows[0][1]), (1, "one more for itself alone"), (3, "one more for itself alone and then some other words behind it")]
    parts = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(spark.createDataFrame(joined, docs.schema)).collect()}
    assert (3, 3) in parts and (2, 1) in parts
    kept = sorted(((r["doc_id"] or -1, r["text"]) for r in simhash.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, rows[0][1]), (1, rows[1][1]), (4, "x y z"), (-1, "lone text here"), (8, " ")], key=str)
