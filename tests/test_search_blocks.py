"""Top-K by blocks: tiles with a running bound, copies of one vector, keys in common, work a row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import ann, search


def _brute(ids, X, qids, Q, k, exclude_self, share=None):
    s = np.round(Q @ X.T, 12)
    out = set()
    for i in range(len(Q)):
        may = [j for j in range(len(X)) if not (exclude_self and ids[j] == qids[i]) and (share is None or share[i, j])]
        out |= {(i, int(ids[j])) for j in sorted(may, key=lambda j: (-s[i, j], ids[j]))[:k]}
    return out


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("planes", [None, (8, 6), (1, 8)])
def test_tiles_by_brute_force(monkeypatch, exclude_self, planes):
    """Small tiles, many copies of a vector, zero vectors and one with a missing component."""
    monkeypatch.setattr(search, "TILE_QUERIES", 50)
    monkeypatch.setattr(search, "TILE_ROWS", 64)
    monkeypatch.setattr(search, "PAIRS_AT_ONCE", 1000)
    rng = np.random.default_rng(4)
    raw = rng.normal(size=(400, 12))
    raw[50:150] = raw[3]
    raw[160:163] = 0
    X, ids = search._unit_rows(raw), rng.permutation(400)
    keys = ann.LSHKeys(*planes, 12) if planes else None
    bad = np.vstack([X, np.full((1, 12), np.nan)])
    shared = search.shared_keys(keys, bad, X)
    share = None if keys is None else (keys.record_keys(X)[:, None, :] == keys.record_keys(X)[None, :, :]).any(axis=2)
    c, s, i = search.score_block(np.append(ids, 1000), bad, ids, X, 5, exclude_self, shared)
    assert {(int(a), int(b)) for a, b in zip(c, i)} == _brute(ids, X, ids, X, 5, exclude_self, share)


def test_candidates_stay_few(monkeypatch):
    """Beyond the first tile only pairs near a query's best are scored in doubles, whatever the number of rows."""
    scored = []
    einsum = np.einsum
    monkeypatch.setattr(search.np, "einsum", lambda how, a, b: scored.append(len(a)) or einsum(how, a, b))
    X = search._unit_rows(np.random.default_rng(5).normal(size=(20_000, 32)))
    search.score_block(np.arange(20_000), X, np.arange(500), X[:500], 5, False)
    assert sum(scored) < 500 * 150  # of 20,000 rows a query


def test_many_queries_do_not_pass_the_driver(spark):
    """Queries beyond a few thousand are dealt over tasks, by keys in common as well as exactly."""
    vec = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(F.col("id") * (i + 1)).cast("float"))
    lib = spark.range(9000).select("id", vec.alias("embedding"))
    q = lib.select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))
    before = search._pandas_batch
    called = []
    for module in (search, ann):
        module._pandas_batch = lambda *a: called.append(1) or before(*a)
    try:
        exact = search.batch_topk(lib, q, 1, qvec_col="qv")
        near = ann.ann_topk(lib, q, 1, qvec_col="qv")
    finally:
        search._pandas_batch = ann._pandas_batch = before
    assert not called
    assert exact.where("qid = id AND rank = 1").count() == near.where("qid = id AND rank = 1").count() == 9000


def test_hydrate_searches_once(spark):
    n = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            n.add(len(pdf))
            yield pdf

    hits = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.75)], "qid long, id string, sim double").mapInPandas(count, "qid long, id string, sim double")
    out = search.hydrate(hits, spark.createDataFrame([("a", "x")], "id string, text string"), 5).collect()
    assert [(r["id"], r["rank"]) for r in out] == [("a", 1)] and n.value == 2


def test_index_search_deals_no_whole_blocks(spark, tmp_path, monkeypatch):
    """Probes carry places, not vectors, and parts of cells give the same rows as all of them at once."""
    from vellum.operators import pq_index

    vec = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.sin(F.col("id") * (i + 1)).cast("float"))
    lib = spark.range(1500).select("id", vec.alias("embedding"))
    index = pq_index.build_index(lib, str(tmp_path / "index"), k=3)
    q = lib.where("id % 5 = 0").select(F.col("id").alias("qid"), "embedding")
    stored = {}
    before = pq_index._stored
    monkeypatch.setattr(pq_index, "_stored", lambda df, name: stored.setdefault(name, df) is None or before(df, name))
    key = lambda df: sorted((r["qid"], r["id"], r["rank"], r["sim"]) for r in df.collect())
    whole = key(index.search(q, 3))
    assert set(stored["pq-probes"].columns) == {"cell", "qb", "at"}
    monkeypatch.setattr(pq_index, "PART_BYTES", 4000)
    assert key(index.search(q, 3)) == whole and len(whole) == 900
