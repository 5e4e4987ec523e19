"""Exact cosine top-K.

Plan for many queries (K2).  A query side under a byte budget, checked before
it is collected, is broadcast: each library partition does an Arrow block
product `X @ Q.T` in numpy and keeps its own top-K per query (ties: smaller id
first), and the library is not shuffled.  Beyond the budget both sides are cut
into blocks by a hash of their ids and meet in a grid: every library block
goes to each query block once, a task scores one pair of blocks and keeps the
top-K per query, and nothing passes through the driver.  One window over `qid`
then picks the global top-K, which Spark plans as a `WindowGroupLimit` on each
side of the shuffle.  Both plans score the same pairs, so the rows of a query
do not depend on the plan or on the queries that come with it.

A pair of blocks is scored in tiles: products in single precision name the pairs
that may still be among a query's best, within the bound of their rounding
error, and only these are scored in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.vectors import dimension_ok, dot, l2_norm

# Budget for one broadcast query matrix (float64 bytes).
MAX_QUERY_BYTES = 4 << 20
# Queries and library rows of one tile of products, and candidate pairs scored exactly at a time.
TILE_QUERIES, TILE_ROWS = 512, 4096
PAIRS_AT_ONCE = 1 << 16
# Float64 bytes of one block of vectors in the grid plan, and the rows below which a block is not cut further.
GRID_BYTES = 32 << 20
LEAST_GRID_ROWS = 2048
# Similarities are kept to 12 decimals so equal vectors tie exactly (ties then go by id).
SIM_DIGITS = 12


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    mat = mat.astype(np.float64, copy=True)
    n = np.sqrt((mat * mat).sum(axis=1))
    nz = n > 0
    mat[nz] /= n[nz, None]
    mat[~nz] = 0.0
    return mat


def _stack(series: pd.Series, dim: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def flat_topk(cols: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int):
    """Keep, per query column, the k best by (sim desc, id asc)."""
    if len(cols) == 0:
        return cols, sims, ids
    order = np.lexsort((ids, -sims, cols))
    cols, sims, ids = cols[order], sims[order], ids[order]
    first = np.r_[0, np.flatnonzero(np.diff(cols)) + 1]
    counts = np.diff(np.r_[first, len(cols)])
    rank = np.arange(len(cols)) - np.repeat(first, counts)
    keep = rank < k
    return cols[keep], sims[keep], ids[keep]


def _schema(id_type: T.DataType, qid_type: T.DataType, qid_col: str, id_col: str) -> T.StructType:
    return T.StructType([T.StructField(qid_col, qid_type), T.StructField(id_col, id_type),
                         T.StructField("sim", T.DoubleType())])


def _query_size(queries: DataFrame, qvec_col: str) -> tuple[int, int]:
    """(number, dimension) of the query vectors; null and empty vectors do not count."""
    v = F.col(qvec_col)
    st = queries.where(v.isNotNull() & (F.size(v) > 0)).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(v)).alias("d")).first()
    return int(st["n"] or 0), int(st["d"] or 0)


def _pandas_batch(part: DataFrame, qid_col: str, qvec_col: str, d: int):
    pdf = part.select(qid_col, qvec_col).where(dimension_ok(F.col(qvec_col), d)).toPandas()
    qids = pdf[qid_col].to_numpy()
    if qids.dtype == object:
        qids = qids.astype(str)
    Q = _unit_rows(_stack(pdf[qvec_col], d)) if len(pdf) else np.zeros((0, d))
    return qids, Q


def _score_partitions(library: DataFrame, id_col: str, vec_col: str, qid_col: str, qids, Q, k: int,
                      exclude_self: bool, schema: T.StructType, keys=None) -> DataFrame:
    spark = library.sparkSession
    bc = spark.sparkContext.broadcast((qids, Q, keys))
    dim = Q.shape[1]

    def run(it):
        qids_, Q_, keys_ = bc.value
        q = len(qids_)
        acc_c = np.zeros(0, dtype=np.int64)
        acc_s = np.zeros(0)
        acc_i = None
        for pdf in it:
            if len(pdf) == 0 or q == 0:
                continue
            X = _unit_rows(_stack(pdf[vec_col], dim))
            c, sv, iv = score_block(_names(pdf[id_col]), X, qids_, Q_, k, exclude_self, shared_keys(keys_, X, Q_))
            acc_c = np.concatenate([acc_c, c])
            acc_s = np.concatenate([acc_s, sv])
            acc_i = iv if acc_i is None else np.concatenate([acc_i, iv])
            acc_c, acc_s, acc_i = flat_topk(acc_c, acc_s, acc_i, k)
        if acc_i is not None and len(acc_c):
            yield pd.DataFrame({qid_col: qids_[acc_c], id_col: acc_i, "sim": acc_s})

    from vellum.session import spread

    lib = library.select(id_col, vec_col).where(dimension_ok(F.col(vec_col), dim))
    return spread(lib).mapInPandas(run, schema)


def score_block(ids, X: np.ndarray, qids, Q: np.ndarray, k: int, exclude_self: bool, shared=None):
    """(query row, sim, id) of the k best library rows per query in one pair of blocks of unit vectors.

    `shared(rows, cols)`, where given, says which pairs of library rows and queries take part.
    Of equal vectors only the least ids that can be wanted are scored.
    """
    rows_ok, cols_ok = np.flatnonzero(np.isfinite(X).all(axis=1)), np.flatnonzero(np.isfinite(Q).all(axis=1))
    rows_ok = rows_ok[_least_copies(X[rows_ok], ids[rows_ok], k + exclude_self)]
    X32, Q32 = X[rows_ok].astype(np.float32), Q[cols_ok].astype(np.float32)
    slack = 4 * (X.shape[1] + 4) * np.finfo(np.float32).eps  # twice what two roundings and a sum of unit products can lose
    found = [(np.zeros(0, np.int64), np.zeros(0), ids[:0])]

    def exact(rows, cols, own):
        """Pairs that take part, scored in double precision: (query's place in the tile, sim, id)."""
        for s in range(0, len(rows), PAIRS_AT_ONCE):
            r, c, o = rows[s:s + PAIRS_AT_ONCE], cols[s:s + PAIRS_AT_ONCE], own[s:s + PAIRS_AT_ONCE]
            keep = ids[r] != qids[c] if exclude_self else np.ones(len(r), bool)
            if shared is not None:
                keep = keep & shared(r, c)
            r, c, o = r[keep], c[keep], o[keep]
            yield o, np.round(np.einsum("ij,ij->i", X[r], Q[c]), SIM_DIGITS), ids[r]

    for a in range(0, len(cols_ok), TILE_QUERIES):
        who = cols_ok[a:a + TILE_QUERIES]
        best, least = found[0], np.full(len(who), -np.inf)
        for s in range(0, len(rows_ok), TILE_ROWS):
            at = rows_ok[s:s + TILE_ROWS]
            S = Q32[a:a + TILE_QUERIES] @ X32[s:s + TILE_ROWS].T
            m = 4 * k + 16
            if s == 0 and m < len(at):  # a first bound from the most promising pairs
                top = np.argpartition(S, len(at) - m, axis=1)[:, len(at) - m:]
                own = np.repeat(np.arange(len(who)), m)
                for got in exact(at[top.ravel()], who[own], own):
                    best = flat_topk(*map(np.concatenate, zip(best, got)), k)
                least, best = _kth(best, len(who), k), found[0]
            cell = np.flatnonzero(S >= (least - slack).astype(np.float32)[:, None])
            own = cell // len(at)
            for got in exact(at[cell % len(at)], who[own], own):
                if len(got[0]):
                    best = flat_topk(*map(np.concatenate, zip(best, got)), k)
            least = np.maximum(least, _kth(best, len(who), k))
        found.append((who[best[0]], best[1], best[2]))
    return tuple(map(np.concatenate, zip(*found)))


def _kth(best, n: int, k: int) -> np.ndarray:
    """Per query the k-th best score so far; -inf while there are fewer."""
    out = np.full(n, -np.inf)
    full = np.bincount(best[0], minlength=n) >= k
    np.minimum.at(least := np.full(n, np.inf), best[0], best[1])
    out[full] = least[full]
    return out


def _least_copies(X: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows of X less those that have `most` equal rows of smaller ids."""
    if len(X) <= most or not X.shape[1]:
        return np.arange(len(X))
    same = np.unique(np.ascontiguousarray(X).view(f"V{8 * X.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    first = np.r_[0, np.flatnonzero(np.diff(same[order])) + 1]
    nth = np.arange(len(X)) - np.repeat(first, np.diff(np.r_[first, len(X)]))
    return np.sort(order[nth < most])


def shared_keys(keys, X: np.ndarray, Q: np.ndarray):
    """Whether a library row and a query have a key in common."""
    if keys is None:
        return None
    lk, qk = keys.record_keys(X), keys.query_keys(Q)
    return lambda rows, cols: (lk[rows] == qk[cols]).any(axis=1)


def _names(c: pd.Series) -> np.ndarray:
    return c.to_numpy().astype(str) if c.dtype == object else c.to_numpy()


def _score_cells(left: DataFrame, right: DataFrame, k: int, id_col: str, vec_col: str, qid_col: str, dim: int,
                 exclude_self: bool, schema: T.StructType, keys=None) -> DataFrame:
    """Top-K per query in every pair of blocks (`key`, `_lb`, `_qb`)."""
    bc = left.sparkSession.sparkContext.broadcast(keys)

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(asked) == 0:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        ids, qids = _names(rows[id_col]), _names(asked[qid_col])
        X, Q = _unit_rows(_stack(rows[vec_col], dim)), _unit_rows(_stack(asked[vec_col], dim))
        c, s, i = score_block(ids, X, qids, Q, k, exclude_self, shared_keys(bc.value, X, Q))
        return pd.DataFrame({qid_col: qids[c], id_col: i, "sim": s})

    at = ["key", "_lb", "_qb"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(score, schema)


def grid_topk(lib: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, qid_col: str, dim: int,
              exclude_self: bool, schema: T.StructType, block_rows: int | None = None) -> DataFrame:
    """Top-K per query among the library rows of equal `key`, by a grid of blocks per key.

    `lib` is (key, id, vector), `queries` is (key, qid, vector); a key is what
    an index calls a bucket or cell.  A key with many rows on either side gets
    as many blocks as it needs: library rows repeat once per query block of
    their key and queries once per library block, so that a hot key is spread
    and no pair is lost.
    """
    block_rows = block_rows or max(1, GRID_BYTES // (8 * max(dim, 1)))
    blocks = lambda df, c: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias(c))
    shape = blocks(lib, "_nl").join(blocks(queries, "_nq"), "key")
    spread_out = lambda df, own, n_own, other, n_other, by: (
        df.join(shape, "key").withColumn(own, F.pmod(F.xxhash64(by), F.col(n_own)))
        .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))).drop("_nl", "_nq"))
    left = spread_out(lib, "_lb", "_nl", "_qb", "_nq", id_col)
    right = spread_out(queries, "_qb", "_nq", "_lb", "_nl", qid_col)
    return _score_cells(left, right, k, id_col, vec_col, qid_col, dim, exclude_self, schema)


def whole_topk(lib: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, qid_col: str, n_queries: int, dim: int,
               exclude_self: bool, schema: T.StructType, keys=None, block_rows: int | None = None) -> DataFrame:
    """Top-K per query among all library rows (with `keys`: those that share one), by one grid of blocks.

    `lib` is (id, vector), `queries` is (qid, vector).  Blocks are so many that
    every core has several pairs of them, and so few that a row is repeated
    seldom: as often as the other side has blocks.
    """
    n_lib = lib.count()
    cores = lib.sparkSession.sparkContext.defaultParallelism
    most = block_rows or max(1, GRID_BYTES // (8 * max(dim, 1)))
    side = math.ceil(math.sqrt(4 * cores))  # 4 pairs of blocks a core at least
    cut = lambda n: max(1, -(-n // most), min(side, -(-n // (block_rows or LEAST_GRID_ROWS))))
    n_l, n_q = cut(n_lib), cut(n_queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = F.lit(0).alias("key")
    left = lib.select(key, F.pmod(F.xxhash64(id_col, vec_col), F.lit(n_l)).cast("int").alias("_lb"), every(n_q).alias("_qb"), id_col, vec_col)
    right = queries.select(key, every(n_l).alias("_lb"), F.pmod(F.xxhash64(qid_col, vec_col), F.lit(n_q)).cast("int").alias("_qb"), qid_col, vec_col)
    tasks = max(1, min(2 * n_l * n_q, 4096))
    at = ["key", "_lb", "_qb"]
    return _score_cells(left.repartition(tasks, *at), right.repartition(tasks, *at), k, id_col, vec_col, qid_col, dim, exclude_self, schema, keys)


def rank_window(df: DataFrame, part_col: str, id_col: str, k: int | None, score: str = "sim",
                ascending: bool = False, rank_col: str = "rank") -> DataFrame:
    """Order within `part_col` by score (desc by default) then id, keep the first k."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    w = Window.partitionBy(part_col).orderBy(order, F.col(id_col).asc())
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= k) if k is not None else out


def batch_topk(library: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding",
               qid_col: str = "qid", qvec_col: str | None = None, exclude_self: bool = False,
               max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """K2: for every query, the k most similar library rows -> (qid, id, sim, rank).

    Library rows and queries whose vector is null, empty or of another length
    than the longest query vector are skipped (P8).
    """
    qvec_col = qvec_col or vec_col
    id_type = library.schema[id_col].dataType
    qid_type = queries.schema[qid_col].dataType
    out_id = id_col if id_col != qid_col else f"{id_col}_hit"
    lib = library.withColumnRenamed(id_col, out_id) if out_id != id_col else library
    schema = _schema(id_type, qid_type, qid_col, out_id)
    n, d = _query_size(queries, qvec_col)
    if n == 0:
        return library.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    if n * d * 8 <= max_query_bytes:
        qids, Q = _pandas_batch(queries, qid_col, qvec_col, d)
        scored = _score_partitions(lib, out_id, vec_col, qid_col, qids, Q, k, exclude_self, schema)
    else:
        rows = lib.where(dimension_ok(F.col(vec_col), d)).select(out_id, F.col(vec_col).alias("_v"))
        asked = queries.where(dimension_ok(F.col(qvec_col), d)).select(qid_col, F.col(qvec_col).alias("_v"))
        scored = whole_topk(rows, asked, k, out_id, "_v", qid_col, n, d, exclude_self, schema)
    return rank_window(scored, qid_col, out_id, k)


def exact_topk(library: DataFrame, query, k: int | None = 5, id_col: str = "id", vec_col: str = "embedding",
               skip_mismatched: bool = True) -> DataFrame:
    """K1: one query vector against every record, best first (ties by id), first k.

    The query is a literal, so this plans to a scan + `TakeOrderedAndProject`.
    """
    qv = [float(x) for x in query]
    qn = math.sqrt(sum(x * x for x in qv))
    qlit = F.array(*[F.lit(x) for x in qv])
    v = F.col(vec_col)
    n = l2_norm(v)
    sim = F.when((n == 0) | F.lit(qn == 0), F.lit(0.0)).otherwise(dot(v, qlit) / (n * F.lit(qn or 1.0)))
    df = library
    if skip_mismatched:
        df = df.where(dimension_ok(v, len(qv)))
    else:
        sim = F.when(F.size(v) != len(qv), F.raise_error(F.lit("Vectors must have the same length"))).otherwise(sim)
    scored = df.withColumn("similarity", sim)
    out = scored.orderBy(F.col("similarity").desc(), F.col(id_col).asc())
    return out.limit(k) if k is not None else out


def search_text(library: DataFrame, queries: DataFrame, k: int | None = 5, id_col: str = "id",
                vec_col: str = "embedding", qid_col: str = "qid", qtext_col: str = "query",
                embedder=None) -> DataFrame:
    """K3: trim the query, reject empty ones, embed it, top-k (k None -> every record)."""
    from vellum.functions.text import js_trim
    from vellum.operators.embed import embed_udf

    q = queries.select(qid_col, js_trim(F.col(qtext_col)).alias("_q")).where(F.col("_q") != "")
    q = q.withColumn("_qv", embed_udf(embedder)(F.col("_q"))["embedding"]).select(qid_col, "_qv")
    if k is None:  # every record for every query: as many rows as pairs, which the caller asks for
        k = max(1, library.count())
    return batch_topk(library, q, k, id_col=id_col, vec_col=vec_col, qid_col=qid_col, qvec_col="_qv")


def adaptive_topk(library: DataFrame, queries: DataFrame, k: int | None, id_col: str = "id",
                  vec_col: str = "embedding", qid_col: str = "qid", **ann_args) -> DataFrame:
    """K5: exact when the library is empty, k is unset or k >= N, or no index can be built; else approximate.

    Only a failure to build the index falls back, with a warning; a failure of
    the search itself (a full disk, a wrong column) is raised.
    """
    import logging

    from vellum.operators.ann import ann_topk, build_keys

    n = library.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).count()
    if k is None or k >= n:
        return batch_topk(library, queries, max(1, n), id_col, vec_col, qid_col)
    asked, dim = _query_size(queries, vec_col)
    built = {a: ann_args.pop(a) for a in ("method", "tables", "bits", "cells", "nprobe") if a in ann_args}
    if asked and "keys" not in ann_args:
        try:
            ann_args["keys"] = build_keys(library, vec_col, dim, **built)
        except Exception as exc:  # noqa: BLE001 - whatever an index method raises
            logging.getLogger(__name__).warning("no index (%s), exact search instead", exc)
            return batch_topk(library, queries, k, id_col, vec_col, qid_col)
    return ann_topk(library, queries, k, id_col=id_col, vec_col=vec_col, qid_col=qid_col, **ann_args)


def hydrate(hits: DataFrame, records: DataFrame, k: int, id_col: str = "id", qid_col: str = "qid",
            score: str = "sim") -> DataFrame:
    """K6: neighbour ids -> full records, ids not found dropped, re-sorted, cut to k.

    The hit list is at most k rows per query; it is stored, so that the search
    runs once, and broadcast only when its size is under the bound, else both
    sides shuffle on id.
    """
    from vellum.operators.library import sized_broadcast
    from vellum.session import scratch_path

    path = scratch_path(hits.sparkSession, "hits")
    h = hits.select(qid_col, id_col, score)
    h.write.parquet(path)
    h = sized_broadcast(hits.sparkSession.read.schema(h.schema).parquet(path))
    joined = records.join(h, id_col, "inner")
    return rank_window(joined, qid_col, id_col, k, score=score)


def sort_truncate(df: DataFrame, key: str, k: int | None, ascending: bool = False, id_col: str = "id") -> DataFrame:
    """One global sort with the id tie-break, then the first k (a TakeOrderedAndProject)."""
    order = F.col(key).asc() if ascending else F.col(key).desc()
    out = df.orderBy(order, F.col(id_col).asc())
    return out.limit(k) if k is not None else out
