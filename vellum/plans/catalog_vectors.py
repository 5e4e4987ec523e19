"""Registered queries for vectors, embedding and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import vectors as V
from vellum.operators.ann import DEFAULT_BITS, DEFAULT_TABLES
from vellum.plans import sqlparts as S
from vellum.plans.catalog import LIB, _K2_SQL, _k2, _long, query
from vellum.plans.derived import library, millis, table

R6 = 6


def _r(c):
    return F.round(c, R6)


# ---------------------------------------------------------------- V: vectors and embedding
_DOC_HB = S.hash_buckets_cte("hb", "documents", "doc_id", "text")


def vector_rows(df, vec: str, *keep):
    """One row per non-zero component: `keep`, pos, value."""
    x = df.select(*keep, F.posexplode(vec).alias("pos", "v")).where(F.col("v") != 0)
    return x.withColumn("pos", _long(F.col("pos"))).withColumn("value", _r(F.col("v").cast("double"))).drop("v")


@query("embed", S.with_(_DOC_HB, S.hash_vec_cte("hv", "hb")) + """
SELECT k AS doc_id, true AS success, CAST(64 AS BIGINT) AS dimensions, 'vellum/hash-embed' AS model,
       CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM hv""")
def q_embed(spark, sf):
    from vellum.operators.embed import embed
    e = embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return vector_rows(e, "emb.embedding", "doc_id", F.col("emb.success").alias("success"),
                       _long(F.col("emb.dimensions")).alias("dimensions"), F.col("emb.model").alias("model"))


@query("hash_embed", S.with_(_DOC_HB, S.hash_vec_cte("hv", "hb"))
       + "SELECT k AS doc_id, CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM hv")
def q_hash_embed(spark, sf):
    from vellum.operators.embed import hash_embed
    e = hash_embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return vector_rows(e, "embedding", "doc_id")


_COMPS = "(SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@query("mean_pool", f"""
WITH m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS v FROM {_COMPS} GROUP BY label, pos)
SELECT label, CAST(pos AS BIGINT) AS pos,
       round(CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY label)) = 0 THEN v
                  ELSE v / sqrt(sum(v * v) OVER (PARTITION BY label)) END, 6) AS value
FROM m""")
def q_mean_pool(spark, sf):
    from vellum.operators.embed import mean_pool
    p = mean_pool(table(spark, sf, "embeddings"), "label")
    return p.select("label", F.posexplode("embedding").alias("pos", "v")).select(
        "label", _long(F.col("pos")).alias("pos"), _r(F.col("v")).alias("value"))


@query("l2_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) "
                  "AS norm FROM embeddings")
def q_l2_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", _r(V.l2_norm("embedding")).alias("norm"))


_PAIRS = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(b, "vec_id")


@query("dot", "SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
              " AS dot " + _PAIRS)
def q_dot(spark, sf):
    return _pairs(spark, sf).select("vec_id", _r(V.dot("embedding", "next")).alias("dot"))


@query("cosine_similarity", f"SELECT a.vec_id, round({S.cos('a.embedding', 'b.embedding')}, 6) AS cos " + _PAIRS)
def q_cosine_similarity(spark, sf):
    return _pairs(spark, sf).select("vec_id", _r(V.cosine_similarity("embedding", "next")).alias("cos"))


@query("cosine_distance", f"SELECT a.vec_id, round(1 - {S.cos('a.embedding', 'b.embedding')}, 6) AS dist " + _PAIRS)
def q_cosine_distance(spark, sf):
    return _pairs(spark, sf).select("vec_id", _r(V.cosine_distance("embedding", "next")).alias("dist"))


@query("to_float32", f"SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS value "
                     f"FROM {_COMPS} WHERE x <> 0")
def q_to_float32(spark, sf):
    return vector_rows(table(spark, sf, "embeddings").select("vec_id", V.to_float32("embedding").alias("v32")), "v32", "vec_id")


@query("dimension_check", LIB + "SELECT id, coalesce(embedding IS NOT NULL AND len(embedding) > 0 "
                                "AND len(embedding) = 64, false) AS dim_ok FROM library")
def q_dimension_check(spark, sf):
    return library(spark, sf).select("id", V.dimension_ok("embedding", 64).alias("dim_ok"))


# ---------------------------------------------------------------- K: search
_MEAN_Q = f"""
WITH m AS (SELECT pos, avg(CAST(x AS DOUBLE)) AS v FROM {_COMPS} GROUP BY pos),
q AS (SELECT list(v ORDER BY pos) AS qv FROM m)"""


@query("exact_topk", _MEAN_Q + f"""
SELECT vec_id, round(sim, 6) AS similarity, CAST(rank AS BIGINT) AS rank FROM (
  SELECT e.vec_id, {S.cos('e.embedding', 'q.qv')} AS sim,
         row_number() OVER (ORDER BY {S.cos('e.embedding', 'q.qv')} DESC, e.vec_id) AS rank
  FROM embeddings e, q) WHERE rank <= 10""")
def q_exact_topk(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from vellum.operators.search import exact_topk
    e = table(spark, sf, "embeddings")
    qv = e.agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("m")).first()["m"]
    top = exact_topk(e, qv, 10, id_col="vec_id")
    from pyspark.sql import Window
    w = Window.orderBy(F.col("similarity").desc(), F.col("vec_id"))
    return top.select("vec_id", _r(F.col("similarity")).alias("similarity"),
                      _long(F.row_number().over(w)).alias("rank"))


@query("batch_topk", _K2_SQL.format(cos=S.cos("q.embedding", "e.embedding"), k=5))
def q_batch_topk(spark, sf):
    return _k2(spark, sf).select("qid", "vec_id", _r(F.col("sim")).alias("sim"), _long(F.col("rank")).alias("rank"))


def _unit_sparse(name: str, src: str) -> str:
    return f"""
{name} AS (SELECT k, pos, CASE WHEN sqrt(sum(value * value) OVER (PARTITION BY k)) = 0 THEN 0
                         ELSE value / sqrt(sum(value * value) OVER (PARTITION BY k)) END AS u FROM {src})"""


_QTEXT = f"(SELECT item_id, {S.js_trim('text')} AS q FROM benchmark WHERE {S.js_trim('text')} <> '')"

K3_CTES = [S.hash_buckets_cte("dhb", "documents", "doc_id", "text"), S.hash_vec_cte("dhv", "dhb"),
           _unit_sparse("du", "dhv"), S.hash_buckets_cte("qhb", _QTEXT, "item_id", "q"), S.hash_vec_cte("qhv", "qhb"),
           _unit_sparse("qu", "qhv"), """
dots AS (SELECT q.k AS qid, d.k AS doc_id, sum(q.u * d.u) AS s FROM qu q JOIN du d ON q.pos = d.pos GROUP BY 1, 2)""",
           f"""
ranked AS (
  SELECT b.item_id AS qid, d.doc_id, coalesce(x.s, 0.0) AS sim,
         row_number() OVER (PARTITION BY b.item_id ORDER BY round(coalesce(x.s, 0.0), 12) DESC, d.doc_id) AS rank
  FROM {_QTEXT} b JOIN documents d ON true LEFT JOIN dots x ON x.qid = b.item_id AND x.doc_id = d.doc_id)"""]


@query("search_text", S.with_(*K3_CTES)
       + "SELECT qid, doc_id, round(sim, 6) AS sim, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5")
def q_search_text(spark, sf):
    return _search(spark, sf).select("qid", "doc_id", _r(F.col("sim")).alias("sim"), _long(F.col("rank")).alias("rank"))


def _search(spark, sf, k=5):
    from vellum.operators.embed import hash_embed
    from vellum.operators.search import search_text
    docs = hash_embed(table(spark, sf, "documents").select("doc_id", "text"), "text")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search_text(docs, q, k, id_col="doc_id")


@query("result_card", S.with_(S.LIBRARY, *K3_CTES) + f"""
SELECT r.qid, l.id, CAST(r.rank AS BIGINT) AS rank, {S.match_percent('r.sim')} AS match,
  CASE WHEN l.url <> '' THEN 'Bookmark' END AS badge,
  {S.trunc(f"CASE WHEN {S.truthy('l.title')} THEN l.title ELSE l.text END", 120)} AS title_line,
  CASE WHEN l.notes <> '' THEN {S.trunc('l.notes', 180)} END AS note_line,
  CASE WHEN l.url <> '' THEN {S.short_url('l.url', 40, 60)} END AS url_line
FROM ranked r JOIN library l ON l.doc_id = r.doc_id WHERE r.rank <= 5""")
def q_result_card(spark, sf):
    from vellum.operators.library import result_card
    from vellum.operators.search import hydrate
    found = hydrate(_search(spark, sf), library(spark, sf).drop("embedding"), 5, id_col="doc_id")
    return result_card(found).withColumn("rank", F.col("rank").cast("long"))


def lsh_sql(tables: int = DEFAULT_TABLES, bits: int = DEFAULT_BITS, dim: int = 64, k: int = 5) -> str:
    return f"""
WITH planes AS (
  SELECT t, j, i, CASE WHEN CAST(('0x' || substr(md5(CAST(t AS VARCHAR) || ':' || CAST(j AS VARCHAR) || ':'
                                      || CAST(i AS VARCHAR)), 1, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END AS h
  FROM range({tables}) AS a(t), range({bits}) AS b(j), range({dim}) AS c(i)),
comps AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
proj AS (SELECT c.vec_id, p.t, p.j, sum(CAST(c.x AS DOUBLE) * p.h) AS s FROM comps c JOIN planes p ON p.i = c.i
         GROUP BY 1, 2, 3),
keys AS (SELECT vec_id, t * {1 << bits} + sum(CASE WHEN s >= 0 THEN (1 << j) ELSE 0 END) AS key FROM proj
         GROUP BY vec_id, t),
cand AS (SELECT DISTINCT a.vec_id AS qid, b.vec_id FROM keys a JOIN keys b ON a.key = b.key),
scored AS (
  SELECT c.qid, c.vec_id, {S.cos('q.embedding', 'e.embedding')} AS sim
  FROM cand c JOIN embeddings q ON q.vec_id = c.qid JOIN embeddings e ON e.vec_id = c.vec_id),
ranked AS (SELECT qid, vec_id, sim, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 12) DESC, vec_id) AS rank
          FROM scored)
"""


def _ann(spark, sf, k=5, adaptive=False):
    from vellum.operators.ann import ann_topk
    from vellum.operators.search import adaptive_topk
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    if adaptive:
        return adaptive_topk(e, q.withColumnRenamed("qv", "embedding"), k, id_col="vec_id", qid_col="qid")
    return ann_topk(e, q, k, id_col="vec_id", qid_col="qid", qvec_col="qv")


_ANN_OUT = "SELECT qid, vec_id, round(sim, 6) AS sim, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5"


@query("ann_topk", lsh_sql() + _ANN_OUT)
def q_ann_topk(spark, sf):
    return _ann(spark, sf).select("qid", "vec_id", _r(F.col("sim")).alias("sim"), _long(F.col("rank")).alias("rank"))


@query("ann_index_topk", None)
def q_ann_index_topk(spark, sf):
    from vellum.operators.pq_index import build_index
    from vellum.session import scratch_path
    e = table(spark, sf, "embeddings")
    index = build_index(e, scratch_path(spark, "pq-index"), id_col="vec_id", k=5)
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    return index.search(q, 5, id_col="vec_id", exclude_self=True).select("qid", "vec_id", _r(F.col("sim")).alias("sim"), _long(F.col("rank")).alias("rank"))


@query("adaptive_topk", lsh_sql() + _ANN_OUT)
def q_adaptive_topk(spark, sf):
    return _ann(spark, sf, adaptive=True).select("qid", "vec_id", _r(F.col("sim")).alias("sim"),
                                                 _long(F.col("rank")).alias("rank"))


@query("hydrate", lsh_sql() + ", " + S.LIBRARY.strip() + """
SELECT r.qid, l.id, round(r.sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY r.qid ORDER BY r.sim DESC, l.id) AS BIGINT)
       AS rank, substr(l.text, 1, 50) AS preview
FROM ranked r JOIN library l ON l.doc_id = r.vec_id WHERE r.rank <= 5""")
def q_hydrate(spark, sf):
    from vellum.operators.search import hydrate
    hits = _ann(spark, sf).select("qid", F.col("vec_id").alias("doc_id"), "sim")
    lib = library(spark, sf).select("doc_id", "id", "text")
    out = hydrate(hits, lib, 5, id_col="doc_id")
    from pyspark.sql import Window
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), F.col("id"))
    return out.select("qid", "id", _r(F.col("sim")).alias("sim"), _long(F.row_number().over(w)).alias("rank"),
                      F.substring("text", 1, 50).alias("preview"))


_KNN = f"""
knn AS (
  SELECT src, dst, sim, rank FROM (
    SELECT a.vec_id AS src, b.vec_id AS dst, {S.cos('a.embedding', 'b.embedding')} AS sim,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY round({S.cos('a.embedding', 'b.embedding')}, 12) DESC, b.vec_id)
             AS rank
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 16)"""


@query("knn_graph", S.with_(_KNN) + "SELECT src, dst, round(1 - sim, 6) AS dist, CAST(rank AS BIGINT) AS rank FROM knn")
def q_knn_graph(spark, sf):
    from vellum.operators.ann import knn_graph
    g = knn_graph(table(spark, sf, "embeddings"), 16, id_col="vec_id")
    return g.select("src", "dst", _r(F.col("dist")).alias("dist"), _long(F.col("rank")).alias("rank"))


@query("knn_graph_descent", None)
def q_knn_graph_descent(spark, sf):
    from vellum.operators.nn_descent import descend
    g = descend(table(spark, sf, "embeddings"), 16, id_col="vec_id").graph
    return g.select("src", "dst", _r(F.col("dist")).alias("dist"), _long(F.col("rank")).alias("rank"))


@query("symmetrize_prune", S.with_(_KNN) + """
, both_dirs AS (SELECT src, dst, 1 - sim AS dist FROM knn UNION ALL SELECT dst, src, 1 - sim FROM knn),
dedup AS (SELECT src, dst, min(dist) AS dist FROM both_dirs GROUP BY 1, 2)
SELECT src, dst, round(dist, 6) AS dist, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM dedup) WHERE rank <= 16""")
def q_symmetrize_prune(spark, sf):
    from vellum.operators.ann import knn_graph, symmetrize_prune
    g = knn_graph(table(spark, sf, "embeddings"), 16, id_col="vec_id")
    p = symmetrize_prune(g, 16)
    return p.select("src", "dst", _r(F.col("dist")).alias("dist"), _long(F.col("rank")).alias("rank"))


@query("geometric_levels", """
WITH lv AS (SELECT CAST(floor(-ln((CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) + 0.5)
                                / 4294967296.0)) AS INTEGER) AS level FROM embeddings),
c AS (SELECT level, count(*) AS n FROM lv GROUP BY level)
SELECT CAST(level AS BIGINT) AS level, CAST(n AS BIGINT) AS n_nodes,
       CAST(sum(n) OVER (ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS layer_size
FROM c""")
def q_geometric_levels(spark, sf):
    from vellum.operators.ann import geometric_levels
    g = geometric_levels(table(spark, sf, "embeddings"), id_col="vec_id")
    return g.select(_long(F.col("level")).alias("level"), _long(F.col("n_nodes")).alias("n_nodes"),
                    _long(F.col("layer_size")).alias("layer_size"))


@query("sort_truncate", LIB + "SELECT id, ts_ms FROM library ORDER BY ts_ms DESC, id LIMIT 10")
def q_sort_truncate(spark, sf):
    from vellum.operators.search import sort_truncate
    lib = library(spark, sf).select("id", millis(F.col("ts")).alias("ts_ms"))
    return sort_truncate(lib, "ts_ms", 10)


# ---------------------------------------------------------------- U1: a custom embedder through the hook
@query("embedder", S.with_(S.hash_buckets_cte("hb", "documents", "doc_id", "text", 32), S.hash_vec_cte("hv", "hb", 32))
       + "SELECT k AS doc_id, CAST(32 AS BIGINT) AS dimensions, CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM hv")
def q_embedder(spark, sf):
    from vellum.operators.embed import embed_udf, hash_embedder
    udf = embed_udf(hash_embedder(32), key="hash-32")
    d = table(spark, sf, "documents").select("doc_id", udf(F.col("text")).alias("e"))
    return vector_rows(d, "e.embedding", "doc_id", _long(F.size("e.embedding")).alias("dimensions"))
