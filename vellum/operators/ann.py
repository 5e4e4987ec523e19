"""Approximate top-K and the neighbour graph (K4, K7, K8, K9).

A mutable layered graph does not distribute, so the approximate index is
re-aimed as bucketing with an exact re-rank:

* sign-LSH: `tables` x `bits` random +-1 hyperplanes (seeded by md5, so the
  buckets are reproducible in SQL); a record is a candidate for a query when
  they share a bucket in any table;
* IVF: `ml.clustering.KMeans` cells on unit vectors; a query probes its
  `nprobe` nearest cells.

Probe plan (query side under a checked byte budget): the query vectors and
their keys are broadcast; every library partition computes its own keys,
looks up the queries that share one (sorted-key search in numpy), scores those
pairs exactly and keeps its top-K per query.  The library is not shuffled.

Grid plan (query side over the budget, e.g. a graph over the whole library):
`(key, id, vector)` rows of both sides meet by key in blocks
(`search.grid_topk`); a hot key gets more blocks, so it is spread without
losing a pair, and a task holds two blocks.

Dense plan (keys of which a pair shares one in DENSE of all cases or more, such
as the default planes): rows repeated for each key would outnumber the pairs'
rows many times over, so blocks of rows meet as in the exact search, and the
most similar pairs are checked for a key in common.  All plans score the same
pairs: those that share a key.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.vectors import dimension_ok
from vellum.operators.search import (MAX_QUERY_BYTES, SIM_DIGITS, _pandas_batch, _query_size, _score_partitions, _stack, _unit_rows,
                                     flat_topk, grid_topk, rank_window, whole_topk)

DEFAULT_TABLES = 64
DEFAULT_BITS = 6
# Share of all pairs that have a key in common from which blocks are scored whole.
DENSE = 0.02
# Candidate pairs scored at once inside one task (bounds memory under a hot bucket).
PAIR_BUDGET = 1 << 21


def hyperplanes(tables: int, bits: int, dim: int) -> np.ndarray:
    """+-1 planes: entry (t, j, i) is +1 when the first hex digit of md5('t:j:i') is below 8."""
    h = np.empty((tables * bits, dim), dtype=np.float64)
    for t in range(tables):
        for j in range(bits):
            for i in range(dim):
                first = int(hashlib.md5(f"{t}:{j}:{i}".encode()).hexdigest()[0], 16)
                h[t * bits + j, i] = 1.0 if first < 8 else -1.0
    return h


class LSHKeys:
    """Keys per row: table * 2^bits + bucket, one per table (same for records and queries)."""

    def __init__(self, tables: int, bits: int, dim: int):
        self.tables, self.bits = tables, bits
        self.H = hyperplanes(tables, bits, dim)
        self.weights = (1 << np.arange(bits)).astype(np.int64)
        self.share = min(1.0, tables / 2 ** bits)  # of all pairs, about

    def record_keys(self, X: np.ndarray) -> np.ndarray:
        P = X @ self.H.T
        b = (P >= 0).reshape(len(X), self.tables, self.bits).astype(np.int64)
        buckets = b @ self.weights
        return buckets + (np.arange(self.tables, dtype=np.int64) << self.bits)[None, :]

    query_keys = record_keys


class IVFKeys:
    """Keys per row: the nearest cell for records, the `nprobe` nearest cells for queries."""

    def __init__(self, centers: np.ndarray, nprobe: int):
        self.C = _unit_rows(centers)
        self.nprobe = max(1, min(nprobe, len(centers)))
        self.share = self.nprobe / len(centers)

    def record_keys(self, X: np.ndarray) -> np.ndarray:
        return np.argmax(X @ self.C.T, axis=1).astype(np.int64)[:, None]

    def query_keys(self, Q: np.ndarray) -> np.ndarray:
        S = Q @ self.C.T
        order = np.argsort(-S, axis=1, kind="stable")
        return order[:, : self.nprobe].astype(np.int64)


def _pairs(lib_keys: np.ndarray, q_keys: np.ndarray):
    """All (record row, query row) sharing at least one key, each pair once."""
    qk = q_keys.ravel()
    qi = np.repeat(np.arange(q_keys.shape[0]), q_keys.shape[1])
    o = np.argsort(qk, kind="stable")
    qk, qi = qk[o], qi[o]
    lk = lib_keys.ravel()
    li = np.repeat(np.arange(lib_keys.shape[0]), lib_keys.shape[1])
    lo = np.searchsorted(qk, lk, "left")
    hi = np.searchsorted(qk, lk, "right")
    cnt = hi - lo
    total = int(cnt.sum())
    if total == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.repeat(lo, cnt) + (np.arange(total) - np.repeat(np.cumsum(cnt) - cnt, cnt))
    rows = np.repeat(li, cnt)
    cols = qi[starts]
    code = np.unique(rows.astype(np.int64) * q_keys.shape[0] + cols)
    return code // q_keys.shape[0], code % q_keys.shape[0]


def _probe(library: DataFrame, id_col: str, vec_col: str, qid_col: str, qids, Q, keys, k: int,
           exclude_self: bool, schema: T.StructType) -> DataFrame:
    bc = library.sparkSession.sparkContext.broadcast((qids, Q, keys, keys.query_keys(Q)))
    dim = Q.shape[1]

    def run(it):
        qids_, Q_, keys_, qk = bc.value
        acc_c = np.zeros(0, np.int64)
        acc_s = np.zeros(0)
        acc_i = None
        # a block of library rows pairs with at most every query: bound the block
        # so the candidate pairs held at once stay under PAIR_BUDGET
        step = max(1, PAIR_BUDGET // max(len(qids_), 1))
        for pdf in it:
            if len(pdf) == 0 or len(qids_) == 0:
                continue
            X_all = _unit_rows(_stack(pdf[vec_col], dim))
            ids_all = pdf[id_col].to_numpy()
            if ids_all.dtype == object:
                ids_all = ids_all.astype(str)
            keys_all = keys_.record_keys(X_all)
            for s in range(0, len(pdf), step):
                X, ids = X_all[s:s + step], ids_all[s:s + step]
                rows, cols = _pairs(keys_all[s:s + step], qk)
                if exclude_self and len(rows):
                    keep = ids[rows] != qids_[cols]
                    rows, cols = rows[keep], cols[keep]
                if not len(rows):
                    continue
                sims = np.round(np.einsum("ij,ij->i", X[rows], Q_[cols]), SIM_DIGITS)
                acc_c = np.concatenate([acc_c, cols])
                acc_s = np.concatenate([acc_s, sims])
                acc_i = ids[rows] if acc_i is None else np.concatenate([acc_i, ids[rows]])
                acc_c, acc_s, acc_i = flat_topk(acc_c, acc_s, acc_i, k)
        if acc_i is not None and len(acc_c):
            yield pd.DataFrame({qid_col: qids_[acc_c], id_col: acc_i, "sim": acc_s})

    from vellum.session import spread

    lib = library.select(id_col, vec_col).where(dimension_ok(F.col(vec_col), dim))
    return spread(lib).mapInPandas(run, schema)


def _key_rows(df: DataFrame, id_col: str, vec_col: str, keys, dim: int, query: bool) -> DataFrame:
    """(key, id, _v): one row per vector and key."""
    bc = df.sparkSession.sparkContext.broadcast(keys)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField("_v", df.schema[vec_col].dataType)])

    def run(it):
        ks = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            X = _unit_rows(_stack(pdf[vec_col], dim))
            kk = ks.query_keys(X) if query else ks.record_keys(X)
            at = np.repeat(np.arange(len(pdf)), kk.shape[1])
            yield pd.DataFrame({"key": kk.ravel(), id_col: pdf[id_col].to_numpy()[at], "_v": pdf[vec_col].to_numpy()[at]})

    return df.select(id_col, vec_col).where(dimension_ok(F.col(vec_col), dim)).mapInPandas(run, schema)


def _grid_plan(library, queries, id_col, vec_col, qid_col, qvec_col, keys, k, dim, exclude_self, schema,
               block_rows: int | None = None):
    """Candidates by key in blocks; a pair that shares several keys is scored in each and kept once."""
    lk = _key_rows(library, id_col, vec_col, keys, dim, query=False)
    qk = _key_rows(queries, qid_col, qvec_col, keys, dim, query=True)
    scored = grid_topk(lk, qk, k, id_col, "_v", qid_col, dim, exclude_self, schema, block_rows)
    return scored.groupBy(qid_col, id_col).agg(F.max("sim").alias("sim"))


# IVF centers are trained on at most this many vectors (a seeded sample); every
# vector is still assigned to a cell and searched, so no result is dropped.
MAX_TRAIN = 1_000_000


def build_keys(library: DataFrame, vec_col: str, dim: int, method: str = "lsh", tables: int = DEFAULT_TABLES,
               bits: int = DEFAULT_BITS, cells: int | None = None, nprobe: int = 4, seed: int = 7,
               max_train: int = MAX_TRAIN):
    """The index: LSH planes (no pass over data) or IVF centers (a distributed KMeans on a sample)."""
    if method == "lsh":
        return LSHKeys(tables, bits, dim)
    if method == "ivf":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        from vellum.functions.vectors import normalize

        usable = library.where(dimension_ok(F.col(vec_col), dim))
        n = usable.count()
        cells = cells or max(2, int(math.sqrt(max(n, 1))))
        if n > max_train:
            usable = usable.sample(fraction=max_train / n, seed=seed)
        train = usable.select(array_to_vector(normalize(vec_col)).alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=20).fit(train)
        centers = np.stack([np.asarray(c) for c in model.clusterCenters()])
        return IVFKeys(centers, nprobe)
    raise ValueError(f"unknown index method {method!r}")


def ann_topk(library: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
             qid_col: str = "qid", qvec_col: str | None = None, method: str = "lsh", tables: int = DEFAULT_TABLES,
             bits: int = DEFAULT_BITS, cells: int | None = None, nprobe: int = 4, exclude_self: bool = False,
             keys=None, max_query_bytes: int = MAX_QUERY_BYTES, block_rows: int | None = None) -> DataFrame:
    """K4: approximate top-k -> (qid, id, sim, rank); every candidate is scored exactly."""
    qvec_col = qvec_col or vec_col
    n, d = _query_size(queries, qvec_col)
    out_id = id_col if id_col != qid_col else f"{id_col}_hit"
    lib = library.withColumnRenamed(id_col, out_id) if out_id != id_col else library
    schema = T.StructType([T.StructField(qid_col, queries.schema[qid_col].dataType),
                           T.StructField(out_id, library.schema[id_col].dataType),
                           T.StructField("sim", T.DoubleType())])
    if n == 0:
        return library.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    keys = keys or build_keys(library, vec_col, d, method, tables, bits, cells, nprobe)
    small, dense = n * d * 8 <= max_query_bytes, getattr(keys, "share", 0) >= DENSE
    if small and dense:
        qids, Q = _pandas_batch(queries, qid_col, qvec_col, d)
        scored = _score_partitions(lib, out_id, vec_col, qid_col, qids, Q, k, exclude_self, schema, keys)
    elif dense:
        rows = lib.where(dimension_ok(F.col(vec_col), d)).select(out_id, F.col(vec_col).alias("_v"))
        asked = queries.where(dimension_ok(F.col(qvec_col), d)).select(qid_col, F.col(qvec_col).alias("_v"))
        scored = whole_topk(rows, asked, k, out_id, "_v", qid_col, n, d, exclude_self, schema, keys, block_rows)
    elif small:
        qids, Q = _pandas_batch(queries, qid_col, qvec_col, d)
        scored = _probe(lib, out_id, vec_col, qid_col, qids, Q, keys, k, exclude_self, schema)
    else:
        scored = _grid_plan(lib, queries, out_id, vec_col, qid_col, qvec_col, keys, k, d, exclude_self, schema, block_rows)
    return rank_window(scored, qid_col, out_id, k)


def recall_at_k(approx: DataFrame, exact: DataFrame, qid_col: str = "qid", id_col: str = "id") -> DataFrame:
    """Share of exact neighbours the approximate result found, over all queries."""
    hit = exact.select(qid_col, id_col).join(approx.select(qid_col, id_col).withColumn("_h", F.lit(1)),
                                             [qid_col, id_col], "left")
    return hit.agg((F.sum(F.coalesce("_h", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def knn_graph(vectors: DataFrame, m: int = 16, id_col: str = "id", vec_col: str = "embedding",
              method: str = "exact", **ann_args) -> DataFrame:
    """K7: each vector's m nearest others -> (src, dst, dist, rank), ascending distance.

    Exact by default at every size (pairs of blocks beyond the broadcast
    budget); `method="lsh"` or `"ivf"` asks for the approximate graph.
    """
    from vellum.operators.search import batch_topk

    q = vectors.select(F.col(id_col).alias("src"), F.col(vec_col).alias("_qv"))
    lib = vectors.select(F.col(id_col).alias("dst"), F.col(vec_col))
    if method == "exact":
        hits = batch_topk(lib, q, m, id_col="dst", vec_col=vec_col, qid_col="src", qvec_col="_qv",
                          exclude_self=True)
    else:
        hits = ann_topk(lib, q, m, id_col="dst", vec_col=vec_col, qid_col="src", qvec_col="_qv",
                        exclude_self=True, method=method, **ann_args)
    return hits.select("src", "dst", (F.lit(1.0) - F.col("sim")).alias("dist"), "rank")


def symmetrize_prune(edges: DataFrame, m: int = 16) -> DataFrame:
    """K8: add reverse edges, then every node keeps its m nearest (ties by neighbour id).

    Duplicates collapse through an aggregate (map-side partial), and the
    per-node cut is a window group limit, so a hub node costs at most m rows
    per partition before the shuffle.
    """
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "dist")
    both = edges.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))  # the edges are worked out once
    dedup = both.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("src").orderBy(F.col("dist").asc(), F.col("dst").asc())
    return dedup.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def level_column(id_col: str = "id"):
    """K9: level = floor(-ln u), u uniform from md5(id); P(level >= k) = e^-k."""
    u = (F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-F.log(u)).cast("int")


def geometric_levels(df: DataFrame, id_col: str = "id") -> DataFrame:
    """K9 layer sizes: nodes exactly at each level and the layer size (level >= l)."""
    lv = df.select(level_column(id_col).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))
    w = Window.orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lv.withColumn("layer_size", F.sum("n_nodes").over(w))
