"""The stored index and the neighbour graph against exact search."""

import numpy as np
from pyspark.sql import functions as F

SF01 = "/root/testdata/sf0.1"


def test_index_recall_and_work(spark, tmp_path):
    from vellum.operators.ann import recall_at_k
    from vellum.operators.pq_index import build_index, open_index
    from vellum.operators.search import batch_topk
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("qid"), "embedding").where("qid % 4 = 0")
    build_index(e, str(tmp_path / "ix"), id_col="vec_id")
    index = open_index(spark, str(tmp_path / "ix"))
    assert index.blocks().selectExpr("explode(ids) AS id").distinct().count() == e.count()
    assert index.tuned["rerank"] <= 0.05 * e.count() and index.tuned["recall"] >= 0.9
    got = index.search(q, 10, id_col="vec_id", exclude_self=True).withColumnRenamed("vec_id", "id").cache()
    exact = batch_topk(e, q, 10, id_col="vec_id", exclude_self=True).withColumnRenamed("vec_id", "id")
    assert recall_at_k(got, exact).first()["recall"] >= 0.9
    # what is found is scored as exact search scores it, and ranked by it
    both = got.alias("a").join(exact.alias("b"), ["qid", "id"]).agg(F.max(F.abs(F.col("a.sim") - F.col("b.sim"))).alias("d")).first()["d"]
    assert both <= 2e-12  # the last digit kept
    assert got.groupBy("qid").agg(F.max("rank").alias("r"), F.count("*").alias("n")).where("r <> n OR n <> 10").count() == 0


def test_index_is_exact_when_all_is_scored_and_reads_few_cells(spark, tmp_path):
    from vellum.operators.pq_index import build_index
    from vellum.operators.search import batch_topk
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 6)) * 4
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 6)) * 0.2
    rows = [(f"v{i:04d}", [float(c) for c in v]) for i, v in enumerate(x)] + [("z0", None), ("z1", []), ("z2", [1.0]), ("z3", [0.0] * 6), ("v9", rows0 := [1.0] * 6), ("v8", rows0)]
    lib = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)
    q = lib.where("id LIKE '%7'").select(F.col("id").alias("qid"), "embedding")
    index = build_index(lib, str(tmp_path / "ix"))
    whole = index.search(q, 5, probe=len(index.cells.cells), rerank=index.n)
    exact = batch_topk(lib, q, 5)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.select(whole.columns).collect()))
    assert index.tuned["probe"] < len(index.cells.cells) and index.tuned["recall"] >= 0.9  # clustered vectors need few cells
    assert index.search(q.limit(0), 5).count() == 0
    plan = index.blocks([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters", 1)[1][:60]


def test_cells_follow_the_size():
    from vellum.operators.pq_index import Cells, kmeans
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8))
    coarse = kmeans(x, 4)
    cells, parent = [], []
    for i in range(4):
        some = x[((x[:, None] - coarse[None]) ** 2).sum(axis=2).argmin(axis=1) == i]
        c = kmeans(some, 5)
        cells.append(c)
        parent += [i] * len(c)
    found = Cells(coarse, np.concatenate(cells), np.array(parent), [])
    at = found.assign(x)
    rest = x - found.cells[at]
    found = Cells(coarse, found.cells, found.parent, [kmeans(rest[:, :4], 64), kmeans(rest[:, 4:], 64)])
    codes = found.encode(x, at)
    for c in np.unique(at)[:3]:  # a code's score is that of the vector it stands for
        who = np.flatnonzero(at == c)
        made = found.cells[c] + np.concatenate([found.books[0][codes[who, 0]], found.books[1][codes[who, 1]]], axis=1)
        assert np.allclose(found.scores(x[:7], c, codes[who]), x[:7] @ made.T)


def graph_recall(found, exact):
    hit = exact.select("src", "dst").join(found.select("src", "dst"), ["src", "dst"]).count()
    return hit / exact.count()


def test_neighbour_descent_recall(spark):
    from vellum.operators.ann import knn_graph
    from vellum.operators.nn_descent import descend
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    found = descend(e, 16, id_col="vec_id")
    exact = knn_graph(e, 16, id_col="vec_id")
    assert graph_recall(found.graph, exact) >= 0.9
    same = found.graph.alias("a").join(exact.alias("b"), ["src", "dst"]).agg(F.max(F.abs(F.col("a.dist") - F.col("b.dist")))).first()[0]
    assert same <= 2e-12 and found.changed == sorted(found.changed, reverse=True)


def test_neighbour_descent_work_grows_with_the_vectors(spark):
    from vellum.operators.ann import knn_graph
    from vellum.operators.nn_descent import descend
    rng = np.random.default_rng(5)
    per_node = []
    for n in (1000, 4000):
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 24)) + rng.normal(size=(n, 24)) * 0.05
        rows = [(f"v{i}", [float(c) for c in v]) for i, v in enumerate(x)] + [("z", None), ("y", [1.0])]
        df = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4)
        found = descend(df, 8, pool=12)
        assert graph_recall(found.graph, knn_graph(df, 8)) >= 0.95
        per_node.append(sum(found.scored[1:]) / n)
    assert per_node[1] < 1.5 * per_node[0]  # four times the vectors, about the same work each
    assert descend(df.where("id = 'z'")).graph.count() == 0
