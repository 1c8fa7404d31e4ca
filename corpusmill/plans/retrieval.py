"""Vector, lexical, fusion and context queries. Documents are the chunks, benchmark items the questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import tokenize
from ..operators import ann as N
from ..operators import answers as A
from ..operators import fusion as U
from ..operators import lexical as L
from ..operators import maintenance as M
from ..operators import vectors as V
from .registry import query

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
K = 25


def corpus(t):
    return t("documents").select("doc_id", "text", "lang", "source")


def questions(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


#: (application, table's files with their times) -> the saved index of the documents, which all searches of a session share.
_INDEXES: dict = {}


def index_of(docs):
    spark = docs.sparkSession
    paths = sorted(docs.inputFiles())
    files = spark._jvm.org.apache.hadoop.fs
    status = lambda p: (lambda f: (p, f.getLen(), f.getModificationTime()))(files.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(files.Path(p)))
    key = (spark.sparkContext.applicationId, *map(status, paths))
    if key not in _INDEXES:
        _INDEXES[key] = L.build_index(docs)
    return _INDEXES[key]


def sparse_hits(t, k: int = K):
    """query_id, chunk_id, score, rank by BM25."""
    return L.bm25_search(None, questions(t), k, index=index_of(corpus(t))).withColumnRenamed("doc_id", "chunk_id")


def dense_hits(t, k: int = K):
    """query_id, chunk_id, score, rank by cosine of hashed embeddings."""
    docs = V.hashed_vectors(corpus(t)).select("doc_id", "embedding")
    asked = V.hashed_vectors(questions(t), "query_id").select(F.col("query_id").alias("doc_id"), "embedding")
    return V.dense_topk(docs, asked, k, "doc_id").select("query_id", F.col("doc_id").alias("chunk_id"), F.col("similarity").alias("score"), "rank")


def with_context(t, hits):
    docs = corpus(t).select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_file"), F.col("lang").alias("section"), (F.col("doc_id") % 7).cast("int").alias("page_number"))
    return hits.join(docs, "chunk_id")


BM25 = f"""
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL),
lens AS (SELECT doc_id, len({TOKENS.format("coalesce(text, '')")}) AS dl FROM documents),
raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM lens) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
score AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens)))), 6) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN lens USING (doc_id) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM score) WHERE rank <= {K})"""
def embedded_sql(name: str, table: str, key: str) -> str:
    """CTEs that end in name(key, idx, value): hashed embeddings of unit length."""
    return f"""{name}_w AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {table}) WHERE w <> '' GROUP BY ALL),
{name}_p AS (SELECT {key}, n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(md5(w), i, 8))::BIGINT) AS p FROM {name}_w),
{name}_r AS (SELECT {key}, n, ((((p[1] % 384) * (4294967296 % 384) + p[2]) % 384 * (4294967296 % 384) + p[3]) % 384 * (4294967296 % 384) + p[4]) % 384 AS idx,
  ((((p[1] % 256000) * (4294967296 % 256000) + p[2]) % 256000 * (4294967296 % 256000) + p[3]) % 256000 * (4294967296 % 256000) + p[4]) % 256000 AS big FROM {name}_p),
{name}_s AS (SELECT {key}, idx, sum(n * ((big // 256) / 1000.0::DOUBLE - 0.5)) AS value FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {key}, idx, value / sqrt(sum(value * value) OVER (PARTITION BY {key})) AS value FROM {name}_s)"""


DENSE = f"""{embedded_sql("de", "documents", "doc_id")}, {embedded_sql("qe", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id")},
dot AS (SELECT query_id, doc_id, sum(de.value * qe.value) AS s FROM de JOIN qe USING (idx) GROUP BY ALL),
near AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, round(coalesce(s, 0), 6) AS score FROM documents d CROSS JOIN benchmark b LEFT JOIN dot ON dot.doc_id = d.doc_id AND dot.query_id = b.item_id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near) WHERE rank <= {K})"""
DOCS = "docs AS (SELECT doc_id AS chunk_id, text, source AS source_file, lang AS section, CAST(doc_id % 7 AS INTEGER) AS page_number FROM documents)"
FUSED = """
lists AS (SELECT query_id, chunk_id, 0 AS list, rank, score AS ds, NULL AS ss FROM dense UNION ALL SELECT query_id, chunk_id, 1, rank, NULL, score FROM sparse),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(ds) AS dense_score, max(ss) AS sparse_score, min(list * 1000 + rank) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, dense_score, sparse_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM f)"""


@query("SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM documents")
def tokenized(t):
    return t("documents").select("doc_id", tokenize(F.col("text")).alias("tokens"))


@query("SELECT doc_id, concat_ws(' ', text, lang, source) AS searchable FROM documents")
def searchable_text(t):
    return t("documents").select("doc_id", L.searchable_text("text", "lang", "source").alias("searchable"))


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_index(t):
    docs = corpus(t)
    return L.term_stats(L.postings(docs), L.doc_lengths(docs)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM sparse")
def bm25_search(t):
    return sparse_hits(t)


@query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT * FROM fused")
def rrf_fuse(t):
    lists = dense_hits(t).select("query_id", "chunk_id", F.lit(0).alias("list"), "rank", F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score")).unionByName(
        sparse_hits(t).select("query_id", "chunk_id", F.lit(1).alias("list"), "rank", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("sparse_score"))
    )
    return U.rrf_fuse(lists)


@query(
    f"""WITH {BM25}, {DENSE}, d AS (SELECT * FROM dense WHERE query_id % 4 <> 1), s AS (SELECT * FROM sparse WHERE query_id % 4 <> 2),
lists AS (SELECT query_id, chunk_id, 0 AS list, rank, score AS ds, NULL AS ss FROM d UNION ALL SELECT query_id, chunk_id, 1, rank, NULL, score FROM s),
n AS (SELECT query_id, count(DISTINCT list) AS sides FROM lists GROUP BY 1),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, max(ds) AS dense_score, max(ss) AS sparse_score, min(list * 1000 + rank) AS seen FROM lists JOIN n USING (query_id) WHERE sides = 2 GROUP BY ALL)
SELECT query_id, chunk_id, score, dense_score, sparse_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM f
UNION ALL SELECT query_id, chunk_id, coalesce(ds, ss), ds, ss, rank FROM lists JOIN n USING (query_id) WHERE sides = 1"""
)
def hybrid_search(t):
    return U.hybrid_search(dense_hits(t).filter("query_id % 4 <> 1"), sparse_hits(t).filter("query_id % 4 <> 2"))


@query(f"WITH {BM25}, {DENSE}, u AS (SELECT query_id // 2 AS query_id, chunk_id, score FROM sparse UNION ALL SELECT query_id // 2, chunk_id, score FROM dense), m AS (SELECT query_id, chunk_id, max(score) AS score FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m")
def subquery_merge(t):
    both = sparse_hits(t).drop("rank").unionByName(dense_hits(t).drop("rank"))
    return U.subquery_merge(both.withColumn("query_id", F.floor(F.col("query_id") / 2)))


@query(f"WITH {BM25}, {DOCS}, f AS (SELECT s.* FROM sparse s JOIN docs USING (chunk_id) WHERE section = 'de') SELECT *, false AS relaxed FROM f UNION ALL SELECT *, true FROM sparse WHERE query_id NOT IN (SELECT query_id FROM f)")
def filter_relaxation(t):
    hits = sparse_hits(t)
    kept = with_context(t, hits).filter(M.metadata_filter({"section": "de"})).select(hits.columns)
    return U.filter_relaxation(kept, hits, questions(t))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source = 'src3'")
def metadata_filter(t):
    return t("documents").filter(M.metadata_filter({"lang": ["en", "fr"], "source": "src3"})).select("doc_id", "lang", "source")


@query(f"WITH {BM25}, {DOCS} SELECT s.* FROM sparse s JOIN docs USING (chunk_id) WHERE section = CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'fr' END")
def scope_filter(t):
    scope = F.when(F.col("query_id") % 2 == 0, "en").otherwise("fr")
    hits = sparse_hits(t)
    return U.scope_filter(with_context(t, hits), F.col("section"), scope).select(hits.columns)


@query(f"WITH {BM25}, {DOCS}, r AS (SELECT query_id, chunk_id, s.score, round(score / ln(length(text) + 2), 6) AS rerank_score FROM sparse s JOIN docs USING (chunk_id)), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM r) SELECT * FROM n WHERE rank <= 6")
def rerank(t):
    hits = with_context(t, sparse_hits(t).drop("rank"))
    return U.rerank(hits, F.round(F.col("score") / F.log(F.length("text") + 2), 6)).select("query_id", "chunk_id", "score", "rerank_score", "rank")


@query(f"WITH {BM25}, n AS (SELECT query_id, chunk_id, score AS rerank_score, rank FROM sparse) SELECT * FROM n WHERE rank <= CASE WHEN query_id % 3 = 0 THEN 4 ELSE 10 END")
def rerank_topn(t):
    hits = sparse_hits(t).drop("rank")
    return U.rerank(hits, top_n=F.when(F.col("query_id") % 3 == 0, 4).otherwise(10)).select("query_id", "chunk_id", "rerank_score", "rank")


@query(f"WITH {BM25}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM sparse) SELECT query_id, chunk_id, score, rank FROM m WHERE (top > 0 AND score >= 0.6 * top) OR (top <= 0 AND rank <= 1)")
def relative_threshold(t):
    return U.relative_threshold(sparse_hits(t), 0.6)


@query(f"WITH {BM25}, {DOCS}, p AS (SELECT query_id, chunk_id, score, rank, section, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, chunk_id) AS n FROM sparse JOIN docs USING (chunk_id)) SELECT query_id, chunk_id, score, rank, section FROM p WHERE n <= 2")
def diversify_sections(t):
    return U.diversify_sections(with_context(t, sparse_hits(t))).select("query_id", "chunk_id", "score", "rank", "section")


@query(f"WITH {BM25}, {DOCS} SELECT query_id, chunk_id, round(CASE WHEN contains(lower(text), 'license') THEN greatest(1.2 * max(score) OVER (PARTITION BY query_id), 10) ELSE score END, 6) AS score FROM sparse JOIN docs USING (chunk_id)")
def topic_boost(t):
    return U.topic_boost(with_context(t, sparse_hits(t)), F.lower("text").contains("license")).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25}, {DOCS}, c AS (SELECT query_id, chunk_id, rank AS r, CASE WHEN section = 'en' THEN 0 WHEN section = 'fr' THEN 1 WHEN section = 'de' THEN 2 ELSE 3 END AS topic_class FROM sparse JOIN docs USING (chunk_id)) SELECT query_id, chunk_id, topic_class, row_number() OVER (PARTITION BY query_id ORDER BY topic_class, r) AS rank FROM c")
def topic_reorder(t):
    order = F.when(F.col("section") == "en", 0).when(F.col("section") == "fr", 1).when(F.col("section") == "de", 2).otherwise(3)
    return U.topic_reorder(with_context(t, sparse_hits(t)), order).select("query_id", "chunk_id", "topic_class", "rank")


@query(f"""WITH {BM25}, {DOCS}, h AS (SELECT query_id, chunk_id, score, rank, section FROM sparse JOIN docs USING (chunk_id)), kept AS (SELECT * FROM h WHERE rank <= 6),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM h WHERE rank > 6 AND section = 'de'),
u AS (SELECT query_id, chunk_id, score, rank AS p FROM kept UNION ALL SELECT query_id, chunk_id, score, n - 1000000 FROM m WHERE n <= 2) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM u""")
def topic_ensure(t):
    hits = with_context(t, sparse_hits(t))
    return U.topic_ensure(hits.filter("rank <= 6"), hits, F.col("section") == "de")


@query(f"""WITH {BM25}, p AS (SELECT query_id, chunk_id, rank AS r, CASE WHEN chunk_id % 5 = 0 THEN NULL ELSE chunk_id // 10 * 10 END AS parent_id FROM sparse),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY r) AS n FROM p)
SELECT query_id, chunk_id, parent_id, coalesce(d.doc_id, chunk_id) AS result_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM k LEFT JOIN documents d ON d.doc_id = k.parent_id WHERE parent_id IS NULL OR n = 1""")
def parent_expand(t):
    parent = F.when(F.col("chunk_id") % 5 != 0, F.floor(F.col("chunk_id") / 10) * 10)
    parents = t("documents").select(F.col("doc_id").alias("parent_id"), "text")
    return U.parent_expand(sparse_hits(t).withColumn("parent_id", parent), parents).select("query_id", "chunk_id", "parent_id", "result_id", "rank")


CONTEXT = f"""{BM25}, {DOCS},
b AS (SELECT query_id, rank, s.score, chunk_id, source_file, section, page_number, text, '[Source ' || rank || '] File: ' || source_file || ' | Section: ' || section || ' | Page ' || page_number || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) AS block FROM sparse s JOIN docs USING (chunk_id) WHERE rank <= 12),
tk AS (SELECT *, CAST(floor(len(list_filter(regexp_split_to_array(block, '\\s+'), lambda x: x <> '')) * 1.3) AS BIGINT) AS tokens FROM b),
su AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM tk),
ok AS (SELECT *, max(CASE WHEN total > 4096 AND rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS stop FROM su),
ctx AS (SELECT * FROM ok WHERE stop = 0)"""


def ranked_context(t):
    return with_context(t, sparse_hits(t, K).filter("rank <= 12"))


@query(f"WITH {CONTEXT} SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS sources, CAST(sum(tokens) AS BIGINT) AS tokens FROM ctx GROUP BY 1")
def build_context(t):
    return A.build_context(ranked_context(t))


@query(f"WITH {BM25}, {DOCS}, b AS (SELECT query_id, rank, '<source id=\"' || rank || '\" file=\"' || source_file || '\" section=\"' || section || '\">' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || '</source>' AS block FROM sparse JOIN docs USING (chunk_id) WHERE rank <= 2) SELECT query_id, rank, block FROM b")
def build_context_tagged(t):
    return A.context_blocks(with_context(t, sparse_hits(t).filter("rank <= 2")), 10**9, tagged=True).select("query_id", "rank", "block")


@query("SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20")
def dense_topk(t):
    return V.dense_topk(t("embeddings"), t("embeddings").filter("vec_id % 20 = 0"))


@query()
def dense_topk_ann(t):
    return N.ann_search(N.build_vector_index(t("embeddings")), t("embeddings").filter("vec_id % 20 = 0"))


@query()
def dense_topk_lsh(t):
    return V.dense_topk_lsh(t("embeddings"), t("embeddings").filter("vec_id % 20 = 0"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT list(m ORDER BY i) FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))), 6) AS similarity FROM embeddings")
def cosine_similarity(t):
    centre = t("embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    return t("embeddings").crossJoin(F.broadcast(centre)).select("vec_id", F.round(V.cosine_similarity(F.col("embedding").cast("array<double>"), F.col("c")), 6).alias("similarity"))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(3 * x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: 9 * y::DOUBLE * y::DOUBLE))), 6)) AS v FROM embeddings")
def l2_normalize(t):
    scaled = F.transform("embedding", lambda x: 3 * x.cast("double"))
    return t("embeddings").select("vec_id", F.transform(V.l2_normalize(scaled), lambda x: V.round_signed(x, 6)).alias("v"))


@query(f"WITH {embedded_sql('de', 'documents', 'doc_id')} SELECT doc_id, idx, round(value, 6) AS value FROM de")
def hashed_embedding(t):
    return V.hashed_embedding(t("documents")).withColumn("value", V.round_signed(F.col("value"), 6))


@query("SELECT doc_id, md5(text) AS embedding_key FROM documents")
def embed_distinct(t):
    return V.embed_distinct(t("documents").select("doc_id", "text"), lambda d: d.select("_h", F.md5("text").alias("embedding"))).select("doc_id", F.col("embedding").alias("embedding_key"))


@query(f"WITH {CONTEXT}, sn AS (SELECT query_id, rank, list_filter(list_transform(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS whole FROM ctx WHERE rank <= 3), a AS (SELECT query_id, string_agg(CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], '. ') || '.' ELSE whole END || ' [Source ' || rank || ']', chr(10) || chr(10) ORDER BY rank) AS body FROM sn GROUP BY 1) SELECT item_id AS query_id, CASE WHEN body IS NULL THEN 'I am unable to answer based on the provided documents.' ELSE 'Based on the official documentation regarding ''' || text || ''':' || chr(10) || chr(10) || body END AS answer FROM benchmark LEFT JOIN a ON a.query_id = item_id")
def extractive_answer(t):
    asked = questions(t).withColumnRenamed("text", "question")
    return A.extractive_answer(asked, A.context_blocks(ranked_context(t)).filter("rank <= 3")).select("query_id", "answer")


@query(f"""WITH {BM25}, {DOCS}, c AS (SELECT query_id, chunk_id, source_file, page_number, section, score FROM sparse JOIN docs USING (chunk_id)),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, page_number, section ORDER BY score DESC, chunk_id) AS n FROM c),
k AS (SELECT query_id, chunk_id, source_file, page_number, section, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM u WHERE n = 1) SELECT * FROM k WHERE place <= 6""")
def dedupe_citations(t):
    return A.dedupe_citations(with_context(t, sparse_hits(t)).select("query_id", "chunk_id", "source_file", "page_number", "section", "score"))


@query(f"""WITH {BM25}, c AS (SELECT query_id, chunk_id, rank, score FROM sparse WHERE rank <= 6), t AS (SELECT c.* FROM c WHERE query_id % 2 = 0 AND rank IN (1, 3)),
r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM c WHERE query_id % 2 = 1), n AS (SELECT query_id, chunk_id, rank, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM r WHERE score >= CASE WHEN top > 0 THEN 0.45 * top ELSE 0 END)
SELECT query_id, chunk_id, rank, score, 'cited_in_answer' AS reason FROM t UNION ALL SELECT query_id, chunk_id, rank, score, 'score_threshold_fallback' FROM n WHERE n <= 3""")
def select_citations(t):
    answers = questions(t).select("query_id", F.when(F.col("query_id") % 2 == 0, "so it is [Source 1] and [source 3, excerpt 9]").otherwise("so it is").alias("answer"))
    return A.select_citations(answers, sparse_hits(t).filter("rank <= 6").select("query_id", "chunk_id", "rank", "score"))


@query(f"WITH {BM25} SELECT query_id, chunk_id, CASE WHEN chunk_id % 3 = 0 THEN greatest(0.2, least(0.99, CASE WHEN score > 15 THEN 0.99 ELSE round(1 / (1 + exp(-score)), 4) END)) ELSE CASE WHEN score BETWEEN 0 AND 1 THEN greatest(0.5, least(0.99, score)) WHEN score > 15 THEN 0.99 ELSE greatest(0.2, least(0.99, round(1 / (1 + exp(-score)), 4))) END END AS confidence FROM sparse")
def citation_confidence(t):
    return sparse_hits(t).select("query_id", "chunk_id", A.citation_confidence(F.col("score"), F.when(F.col("chunk_id") % 3 == 0, F.col("score"))).alias("confidence"))


@query("SELECT doc_id, concat_ws(' · ', upper(lang[1]) || lang[2:], upper(source[1]) || source[2:], 'p. ' || (doc_id % 7)) AS label FROM documents")
def citation_label(t):
    return t("documents").select("doc_id", A.citation_label(F.concat("source", F.lit(".pdf")), F.initcap("lang"), (F.col("doc_id") % 7).cast("int")).alias("label"))


PRIMARY_SQL = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS title, CASE WHEN doc_id % 4 = 0 THEN '4.' || doc_id END AS number, CASE WHEN doc_id % 5 = 0 THEN 'I > ' || lang END AS path, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 7 END AS page, upper(source[1]) || source[2:] AS name FROM documents"
OWN_LABEL = "coalesce(path, CASE WHEN title IS NOT NULL AND number IS NOT NULL THEN 'Section ' || number || ' ' || title ELSE coalesce(title, 'Section ' || number) END)"


@query(f"WITH c AS ({PRIMARY_SQL}) SELECT doc_id, concat_ws(' ', coalesce({OWN_LABEL}, name), '(p.' || page || ')') AS section_first, concat_ws(' ', name, '— ' || {OWN_LABEL}, '(Page ' || page || ')') AS document_first FROM c")
def citation_primary(t):
    c = F.col("doc_id")
    parts = (F.concat("source", F.lit(".pdf")), F.when(c % 7 != 0, c % 7), F.when(c % 5 == 0, F.concat(F.lit("I > "), F.col("lang"))), F.when(c % 3 == 0, F.col("lang")), F.when(c % 4 == 0, F.concat(F.lit("4."), c.cast("string"))))
    return t("documents").select("doc_id", A.citation_primary(*parts).alias("section_first"), A.citation_primary(*parts, document_first=True).alias("document_first"))


@query(f"WITH {BM25}, {DOCS} SELECT query_id, CAST(count(*) AS BIGINT) AS n_chunks, string_agg(rank || ':' || round(score, 2) || ':' || left(text, 40), '|' ORDER BY rank) FILTER (WHERE rank <= 12) AS chunks FROM sparse s JOIN docs USING (chunk_id) GROUP BY 1")
def retrieval_trace(t):
    from ..operators.telemetry import retrieval_trace as trace

    found = trace(with_context(t, sparse_hits(t).withColumn("score", F.round("score", 2))), preview=40)
    return found.select("query_id", "n_chunks", F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["rank"].cast("string"), c["score"].cast("string"), c["preview"])), "|").alias("chunks"))



TOPIC_RULES = (("license", ("license", "copyright")), ("there", ("the the", "there")), ("other", ("ertion",)))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'license' WHEN contains(lower(text), 'the the') OR contains(lower(text), 'there') THEN 'there' WHEN contains(lower(text), 'ertion') THEN 'other' ELSE 'none' END AS topic FROM documents")
def topic_classify(t):
    return t("documents").select("doc_id", U.topic_classify(F.col("text"), TOPIC_RULES).alias("topic"))


@query(
    f"""WITH {BM25}, {DENSE}, {DOCS}, h AS (SELECT query_id, chunk_id, score, rank, section = 'de' AS marked FROM sparse JOIN docs USING (chunk_id)),
s AS (SELECT query_id, count(*) FILTER (WHERE marked) AS have, greatest(max(score) * 1.2, 10) AS boost FROM h GROUP BY 1 HAVING count(*) FILTER (WHERE marked) < 2),
c AS (SELECT d.query_id, d.chunk_id, have, boost, row_number() OVER (PARTITION BY d.query_id ORDER BY d.score DESC, d.chunk_id) AS n FROM dense d JOIN docs USING (chunk_id) JOIN s USING (query_id) WHERE section = 'de' AND NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = d.query_id AND h.chunk_id = d.chunk_id)),
u AS (SELECT query_id, chunk_id, score, rank AS p FROM h UNION ALL SELECT query_id, chunk_id, boost, n - 1000000 FROM c WHERE n <= 2 - have)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM u"""
)
def topic_inject(t):
    hits, canned = with_context(t, sparse_hits(t)), with_context(t, dense_hits(t)).filter("section = 'de'")
    return U.topic_inject(hits, canned, F.col("section") == "de").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {BM25}, {DENSE}, {DOCS}, u AS (SELECT query_id, chunk_id, score FROM sparse UNION ALL SELECT query_id, chunk_id, score FROM dense), m AS (SELECT query_id, chunk_id, section, max(score) AS score FROM u JOIN docs USING (chunk_id) GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, chunk_id) AS n FROM m), k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM d WHERE n <= 2),
r AS (SELECT query_id, chunk_id, section, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k WHERE score >= 0.25 * top) SELECT * FROM r WHERE rank <= 12"""
)
def comprehensive_retrieve(t):
    both = sparse_hits(t).drop("rank").unionByName(dense_hits(t).drop("rank"))
    return U.comprehensive_retrieve(with_context(t, both).select("query_id", "chunk_id", "section", "score"), "section").select("query_id", "chunk_id", "section", "score", "rank")


def sub_questions(t):
    """Each question and its first three sentences."""
    parts = F.concat(F.array("text"), F.slice(F.split("text", r"\. ", -1), 1, 3))
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.explode(parts).alias("sub_query"))


def fused_hits(t, asked):
    """query_id, chunk_id, score of any questions: both searches of all of them in one pass each, fused."""
    sparse = L.bm25_search(None, asked, K, index=index_of(corpus(t))).select("query_id", F.col("doc_id").alias("chunk_id"), F.lit(1).alias("list"), "rank", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("sparse_score"))
    docs = V.hashed_vectors(corpus(t)).select("doc_id", "embedding")
    near = V.dense_topk(docs, V.hashed_vectors(asked, "query_id").select(F.col("query_id").alias("doc_id"), "embedding"), K, "doc_id")
    dense = near.select("query_id", F.col("doc_id").alias("chunk_id"), F.lit(0).alias("list"), "rank", F.col("similarity").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score"))
    return U.rrf_fuse(dense.unionByName(sparse)).select("query_id", "chunk_id", "score")


# A common table named benchmark stands before the table of that name, so the searches' SQL is over the sub-questions.
FAN_OUT = f"""subs AS (SELECT item_id AS question, sha256(text) AS whole, unnest([text] || list_slice(string_split(text, '. '), 1, 3)) AS text FROM benchmark), asked AS (SELECT DISTINCT question, sha256(text) AS item_id FROM subs WHERE trim(text) <> ''),
benchmark AS (SELECT DISTINCT sha256(text) AS item_id, text FROM subs WHERE trim(text) <> ''), {BM25}, {DENSE}, {DOCS}, {FUSED},
found AS (SELECT question AS query_id, chunk_id, max(score) AS score FROM fused JOIN asked ON asked.item_id = fused.query_id GROUP BY ALL),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM found)"""


@query(f"WITH {FAN_OUT} SELECT query_id, chunk_id, score, rank FROM merged")
def fan_out(t):
    return U.fan_out(sub_questions(t), lambda asked: fused_hits(t, asked))


@query(
    f"""WITH {FAN_OUT}, h AS (SELECT query_id, chunk_id, score, rank, coalesce(section = 'de', false) AS marked FROM merged JOIN docs USING (chunk_id)),
canned AS (SELECT question AS query_id, chunk_id, round(1.0::DOUBLE / (60 + d.rank), 9) AS score FROM dense d JOIN docs USING (chunk_id) JOIN (SELECT DISTINCT question, whole FROM subs) ON whole = d.query_id WHERE section = 'de'),
s AS (SELECT query_id, count(*) FILTER (WHERE marked) AS have, greatest(max(score) * 1.2, 10) AS boost FROM h GROUP BY 1 HAVING count(*) FILTER (WHERE marked) < 2),
c AS (SELECT d.query_id, d.chunk_id, have, boost, row_number() OVER (PARTITION BY d.query_id ORDER BY d.score DESC, d.chunk_id) AS n FROM canned d JOIN s USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = d.query_id AND h.chunk_id = d.chunk_id)),
u AS (SELECT query_id, chunk_id, score FROM h UNION ALL SELECT query_id, chunk_id, boost FROM c WHERE n <= 2 - have),
own AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, score FROM merged UNION ALL SELECT query_id, chunk_id, score FROM canned) GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id, section ORDER BY score DESC, chunk_id) AS n FROM u JOIN docs USING (chunk_id)),
w AS (SELECT v.query_id, v.chunk_id, section, own.score, max(own.score) OVER (PARTITION BY v.query_id) AS top FROM v JOIN own ON own.query_id = v.query_id AND own.chunk_id = v.chunk_id WHERE n <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS p FROM w WHERE score >= 0.25 * top),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1000000 AS p FROM w WHERE score < 0.25 * top AND section = 'de'),
y AS (SELECT query_id, chunk_id, score, p FROM k UNION ALL SELECT query_id, chunk_id, score, p FROM x WHERE p <= -999998),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p) AS r, CASE WHEN chunk_id % 5 = 0 THEN NULL ELSE chunk_id // 10 * 10 END AS parent_id FROM y),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY r) AS n FROM z WHERE r <= 12)
SELECT query_id, chunk_id, e.score, parent_id, coalesce(d.doc_id, chunk_id) AS result_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM e LEFT JOIN documents d ON d.doc_id = e.parent_id WHERE parent_id IS NULL OR n = 1"""
)
def comprehensive_context(t):
    """Sub-questions through one search, then injection, sections, threshold, ensured topics and parents."""
    merged = U.fan_out(sub_questions(t), lambda asked: fused_hits(t, asked))
    near = dense_hits(t).join(corpus(t).filter("lang = 'de'").select(F.col("doc_id").alias("chunk_id")), "chunk_id")
    canned = near.select("query_id", "chunk_id", F.round(1.0 / (60 + F.col("rank")), 9).alias("score"))
    parent = F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("doc_id") / 10) * 10)
    chunks = corpus(t).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section"), parent.alias("parent_id"))
    marked = F.coalesce(F.col("section") == "de", F.lit(False))
    return U.comprehensive_context(merged, canned, chunks, marked, t("documents").select(F.col("doc_id").alias("parent_id"), "text"))


@query(
    f"""WITH {BM25}, c AS (SELECT query_id, chunk_id, rank, score FROM sparse WHERE rank <= 6), t AS (SELECT c.* FROM c WHERE query_id % 2 = 0 AND rank = 2),
r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM c WHERE query_id % 2 = 1), n AS (SELECT query_id, chunk_id, rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS n FROM r WHERE score >= CASE WHEN top > 0 THEN 0.7 * top ELSE 0 END)
SELECT query_id, chunk_id, rank, score, 'cited_in_answer' AS reason FROM t UNION ALL SELECT query_id, chunk_id, rank, score, 'score_threshold_fallback' FROM n WHERE n <= 4"""
)
def select_citations_ratio(t):
    answers = questions(t).select("query_id", F.when(F.col("query_id") % 2 == 0, "see [Source 2]").otherwise("none").alias("answer"))
    return A.select_citations(answers, sparse_hits(t).filter("rank <= 6").select("query_id", "chunk_id", "rank", "score"), 0.7, 4, by_score=True)


@query(f"WITH {BM25}, q AS (SELECT item_id AS query_id, split_part(lower(text), ' ', 1) AS keyword FROM benchmark) SELECT query_id, chunk_id, contains(lower(d.text), regexp_replace(keyword, '^\\s+|\\s+$', '', 'g')) OR (len(list_filter(regexp_split_to_array(regexp_replace(keyword, '^\\s+|\\s+$', '', 'g'), '[^a-z0-9_]+'), lambda x: length(x) > 3)) > 0 AND len(list_filter(list_filter(regexp_split_to_array(regexp_replace(keyword, '^\\s+|\\s+$', '', 'g'), '[^a-z0-9_]+'), lambda x: length(x) > 3), lambda x: NOT contains(lower(d.text), x))) = 0) AS relevant FROM sparse JOIN q USING (query_id) JOIN documents d ON d.doc_id = chunk_id")
def chunk_relevance(t):
    from ..operators.evaluation import keyword_match

    wanted = questions(t).select("query_id", F.split(F.lower("text"), " ")[0].alias("keyword"))
    return with_context(t, sparse_hits(t)).join(wanted, "query_id").select("query_id", "chunk_id", keyword_match(F.col("keyword"), F.lower("text")).alias("relevant"))


# Questions on each topic before the items' texts, and chunks with a marker of each topic before the documents' texts.
TOPICS_ASKED = ("What does the manager agent do? ", "planning as a building block ", "which guardrails ", "dress code for ", "show the currency conversion tool code ", "RAG in an agent ", "")
TOPICS_TOLD = ("The manager agent coordinates. ", "subdividing tasks first. ", "Design Patterns of old. ", "validation checkpoints. ", "professional appearance. ", "live exchange. ", "kickoff and results. ", "a planning pattern. ", "")
TOPICS_SQL = "asked AS (SELECT item_id AS query_id, CASE item_id % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TOPICS_ASKED)) + " END || text AS text FROM benchmark), told AS (SELECT doc_id AS chunk_id, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TOPICS_TOLD)) + " END || text AS text, lang AS section FROM documents)"


def lead(values, key):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values) + 1).cast("int"))


def topics_asked(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.concat(lead(TOPICS_ASKED, "item_id"), F.col("text")).alias("text"))


def held(column: str, words) -> str:
    return "(" + (" OR ".join(f"contains(lower({column}), '{w}')" for w in words) or "false") + ")"


def kind_sql(family: str) -> str:
    rules = " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(f"contains(lower(text), '{w}')" for w in ws) + ')' for ws in alternatives)} THEN '{name}'" for name, alternatives, *_ in R.TOPIC_FAMILIES[family])
    asks = f"regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{R.CODE_PATTERNS}')" if family == "tool" else "trim(text) <> ''"
    return f"CASE WHEN {asks} THEN CASE {rules} ELSE 'none' END ELSE 'none' END"


@query(f"WITH {TOPICS_SQL} SELECT query_id, {', '.join(f'{kind_sql(f)} AS {f}' for f in R.TOPIC_FAMILIES)} FROM asked")
def topic_kinds(t):
    return topics_asked(t).select("query_id", *[U.topic_kind(F.col("text"), f).alias(f) for f in R.TOPIC_FAMILIES])


CLASS_SQL = "CASE kind " + " ".join(f"WHEN '{n}' THEN CASE WHEN {held('told', p)} THEN 0 WHEN {held('told', s)} THEN 1 WHEN {held('told', x)} THEN 3 ELSE 2 END" for n, _, p, s, x, _ in R.TOPIC_FAMILIES["guidebook"] + R.TOPIC_FAMILIES["agent"]) + " ELSE 2 END"


@query(
    f"""WITH {BM25}, {TOPICS_SQL}, k AS (SELECT query_id, CASE WHEN ({kind_sql('guidebook')}) <> 'none' THEN {kind_sql('guidebook')} ELSE {kind_sql('agent')} END AS kind FROM asked),
h AS (SELECT query_id, chunk_id, rank AS r, kind, section || ' ' || text AS told FROM sparse JOIN told USING (chunk_id) JOIN k USING (query_id)), c AS (SELECT *, {CLASS_SQL} AS c FROM h),
b AS (SELECT *, CASE WHEN min(c) OVER (PARTITION BY query_id) < 2 THEN c ELSE 2 END AS topic_class FROM c)
SELECT query_id, chunk_id, kind, topic_class, row_number() OVER (PARTITION BY query_id ORDER BY topic_class, r) AS rank FROM b"""
)
def topic_reorder_rules(t):
    asked = topics_asked(t)
    families = ("guidebook", "agent")
    book, agent = (U.topic_kind(F.col("text"), f) for f in families)
    kinds = asked.select("query_id", F.when(book != "none", book).otherwise(agent).alias("kind"), F.when(book != "none", families[0]).otherwise(families[1]).alias("family"))
    told = t("documents").select(F.col("doc_id").alias("chunk_id"), F.concat(lead(TOPICS_TOLD, "doc_id"), F.col("text")).alias("text"), F.col("lang").alias("section"))
    hits = sparse_hits(t).join(kinds, "query_id").join(told, "chunk_id")
    parts = [U.topic_reorder_by_rules(hits.filter(F.col("family") == f), f) for f in families]
    return parts[0].unionByName(parts[1]).select("query_id", "chunk_id", "kind", "topic_class", "rank")
