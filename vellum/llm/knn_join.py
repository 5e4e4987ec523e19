"""Exact top-k search by inner product as a Voronoi join.

Pivots drawn from the vectors cut the space into cells. Queries are grouped by
cell, data is stored in blocks of one cell and a narrow ring around its pivot.
Summaries (the vectors nearest to each pivot, the cells' radii) give every
query a score that its k-th best can't fall below, and every group of queries a
bound on what a block can score. A block goes to those groups only whose bound
it can reach; each (group, slice of blocks) is solved on its own, and a query's
best of all slices are its result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, shuffle_partitions

SCALE = 256
MAX_PIVOTS = 1024
PIVOT_NUMBERS = 1 << 22  # numbers in the broadcast pivots and summaries at most (32 MB)
BLOCK = 4096  # vectors in a data block at most
GROUP = 8192  # queries in a group at most, or nearly so
SLICE_ROWS = 1 << 18  # vectors that a group meets in one task, on average
AT_ONCE = 1024  # queries scored against a block at a time
EXACT = float(1 << 53)
LEAST = -(1 << 63)

_BLOCKS = ("block long, cell int, near double, far double, norm double, ids array<long>, rows array<long>, vecs binary")
_FOUND = "qrow long, query_id long, vec_id long, row long, score long"


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, and all components finite, also after scaling."""
    top = F.lit(1.7e308 / SCALE)
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce((x <= top) & (x >= -top) & ~F.isnan(x), F.lit(False)))


def _pack(x: np.ndarray) -> bytes:
    small = x.size == 0 or (x.min() >= -32768 and x.max() <= 32767)
    return x.astype("<i2" if small else "<f8").tobytes()


def _unpack(raw: bytes, n: int, dim: int) -> np.ndarray:
    kind = "<i2" if len(raw) == 2 * n * dim else "<f8"
    return np.frombuffer(raw, kind).astype(np.float64).reshape(n, dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows as int64, exact; beyond its range they are its ends."""
    if not a.shape[1] or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * max(1.0, np.abs(a).max()) * max(1.0, np.abs(b).max()) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in m] for m in (a, b)]
    out = np.array(whole[0], object) @ np.array(whole[1], object).T
    return np.clip(out, LEAST + 1, -LEAST - 1).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values.reshape(len(column), dim) * SCALE)


def _assigned(df: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Stored table (row, vec_id, query, cell, resid, v): each vector with its nearest pivot and a number of its own."""
    sent = df.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, row = sent.value, TaskContext.get().partitionId() << 40
        square = (p * p).sum(axis=1)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column("vec"), dim)
            gap = square[None, :] - 2 * (x @ p.T)
            cell = gap.argmin(axis=1)
            resid = np.sqrt(np.maximum(0, ((x - p[cell]) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.arange(row, row + len(x))), "vec_id": batch.column("vec_id"), "query": batch.column("query"),
                "cell": pa.array(cell.astype(np.int32)), "resid": pa.array(resid), "v": pa.array([_pack(r) for r in x], pa.binary())})
            row += len(x)

    return cut(df.mapInArrow(assign, "row long, vec_id long, query boolean, cell int, resid double, v binary"), "knn-rows")


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Stored table of data blocks: vectors of one cell, in order of their distance from its pivot."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, have = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, have
            t = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([_unpack(v, 1, dim) for v in t.column("v").to_pylist()])
            resid = t.column("resid").to_numpy()
            number, held, have = number + 1, [], 0
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "cell": pa.array([t.column("cell")[0].as_py()], pa.int32()),
                "near": [float(resid.min())], "far": [float(resid.max())], "norm": [float(np.sqrt((x * x).sum(axis=1)).max())],
                "ids": pa.array([t.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                "rows": pa.array([t.column("row").to_pylist()], pa.list_(pa.int64())), "vecs": pa.array([_pack(x)], pa.binary())})

        last = None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if have and cells[a] != last:
                    yield block()
                last = cells[a]
                while a < b:
                    n = min(b - a, BLOCK - have)
                    held.append(batch.slice(a, n))
                    have += n
                    a += n
                    if have == BLOCK:
                        yield block()
        if have:
            yield block()

    ordered = rows.select("cell", "resid", "row", "vec_id", "v").repartitionByRange(shuffle_partitions(rows.sparkSession), "cell", "resid", "row")
    return cut(ordered.sortWithinPartitions("cell", "resid", "row").mapInArrow(pack, _BLOCKS), "knn-blocks")


def _groups(rows: DataFrame, counts: dict[int, int], sizes: int, pivots: np.ndarray, summary: tuple, dim: int, k: int) -> tuple[DataFrame, int]:
    """Stored table of query groups, neighbouring cells together, with each query's least k-th score; and their number."""
    spark = rows.sparkSession
    plan, group, have = [], -1, sizes
    for cell in sorted(counts):
        n = counts[cell]
        if n > sizes:  # a cell with very many queries is some groups of its own
            parts = -(-n // sizes)
            plan.append((cell, group + 1, parts))
            group, have = group + parts, sizes
            continue
        if have + n > sizes:
            group, have = group + 1, 0
        plan.append((cell, group, 1))
        have += n
    placed = rows.filter("query").join(F.broadcast(spark.createDataFrame(plan, "cell int, first int, parts int")), "cell")
    placed = placed.withColumn("grp", F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    sent = spark.sparkContext.broadcast(summary)

    def pack(table: pa.Table) -> pa.Table:
        x = np.concatenate([_unpack(v, 1, dim) for v in table.column("v").to_pylist()])
        row = table.column("row").to_numpy()
        near_rows, near = sent.value
        floor = np.full(len(x), -np.inf)
        if len(near) >= k:
            for at in range(0, len(x), AT_ONCE):
                s = inner(x[at:at + AT_ONCE], near)
                s[row[at:at + AT_ONCE, None] == near_rows[None, :]] = LEAST  # a query is no result of its own
                best = np.partition(s, len(near) - k, axis=1)[:, len(near) - k]
                floor[at:at + AT_ONCE] = np.where(best == LEAST, -np.inf, np.nextafter(best.astype(np.float64), -np.inf))
        return pa.table({"grp": table.column("grp").slice(0, 1), "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                         "rows": pa.array([row.tolist()], pa.list_(pa.int64())), "cells": pa.array([table.column("cell").to_pylist()], pa.list_(pa.int32())),
                         "resid": pa.array([table.column("resid").to_pylist()], pa.list_(pa.float64())),
                         "floor": pa.array([floor.tolist()], pa.list_(pa.float64())), "vecs": pa.array([_pack(x)], pa.binary())})

    packed = placed.select("grp", "cell", "resid", "row", "vec_id", "v").groupBy("grp").applyInArrow(
        pack, "grp int, ids array<long>, rows array<long>, cells array<int>, resid array<double>, floor array<double>, vecs binary")
    return cut(packed, "knn-groups"), group + 1


def _reach(near: tuple, pivots: np.ndarray, cell: int, far: float, norm: float) -> np.ndarray:
    """Upper bounds on the score of any vector of a block against any query of each summary.

    With q = p + r and o = c + s, the product is p·c + r·c + p·s + r·s, the last
    three within the radii; nor can it pass the product of the norms.
    """
    p, radius = pivots[near["cell"]], near["radius"]
    c = pivots[cell]
    size_p, size_c = np.sqrt((p * p).sum(axis=1)), math.sqrt(float(c @ c))
    balls = p @ c + radius * size_c + size_p * far + radius * far
    return _loose(np.minimum(balls, (size_p + radius) * norm))


def _loose(bound: np.ndarray) -> np.ndarray:
    return bound + 1e-9 * np.abs(bound) + 1e-6  # no rounding may cut a result off


def _solve(queries: pa.Table, blocks: pa.Table, pivots: np.ndarray, dim: int, k: int) -> pa.Table:
    """The k best of a slice's blocks for every query of a group, without scores under its floor."""
    names = ["qrow", "query_id", "vec_id", "row", "score"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    if not len(queries) or not len(blocks):
        return schema.empty_table()
    q = queries.slice(0, 1).to_pylist()[0]
    x = _unpack(q["vecs"], len(q["rows"]), dim)
    qrow, floor = np.array(q["rows"]), np.array(q["floor"])
    size = np.sqrt((x * x).sum(axis=1))
    blocks = blocks.to_pylist()
    toward = [_loose(np.minimum(x @ pivots[b["cell"]] + size * b["far"], size * b["norm"])) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: (-float(toward[i].max()), blocks[i]["block"]))
    score = np.full((len(x), k), LEAST)
    ids = np.zeros((len(x), k), np.int64)
    rows = np.zeros((len(x), k), np.int64)
    none = -LEAST - 1  # an id that is null comes last
    for i in order:
        b = blocks[i]
        live = np.flatnonzero(toward[i] >= floor)
        if not len(live):
            continue
        y = _unpack(b["vecs"], len(b["rows"]), dim)
        brow = np.array(b["rows"])
        bid = np.array([none if v is None else v for v in b["ids"]])
        for at in range(0, len(live), AT_ONCE):
            who = live[at:at + AT_ONCE]
            s = inner(x[who], y)
            s[qrow[who, None] == brow[None, :]] = LEAST
            least = np.maximum(score[who, -1], LEAST + 1)
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            a, j = np.nonzero((s >= least[:, None]) & (s > floor[who, None]))
            if not len(a):
                continue
            touched = np.unique(a)
            old = np.repeat(touched, k)
            some = who[touched]
            all_q = np.concatenate((a, old))
            all_s = np.concatenate((s[a, j], score[some].ravel()))
            all_i = np.concatenate((bid[j], ids[some].ravel()))
            all_r = np.concatenate((brow[j], rows[some].ravel()))
            by = np.lexsort((all_r, all_i, -np.maximum(all_s, LEAST + 1), all_q))
            all_q = all_q[by]
            first = np.searchsorted(all_q, touched)
            pick = by[(first[:, None] + np.arange(k)[None, :])]  # a touched query has its k old places at least
            score[some], ids[some], rows[some] = all_s[pick], all_i[pick], all_r[pick]
            floor[some] = np.maximum(floor[some], np.where(score[some, -1] == LEAST, -np.inf,
                                                           np.nextafter(score[some, -1].astype(np.float64), -np.inf)))
    a, j = np.nonzero(score > LEAST)
    found = ids[a, j]
    qid = [q["ids"][n] for n in a.tolist()]
    return pa.table([pa.array(qrow[a]), pa.array(qid, pa.int64()), pa.array(found, mask=found == none),
                     pa.array(rows[a, j]), pa.array(score[a, j])], schema=schema)


def knn_join(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sizes: int = GROUP,
             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `df` that `is_query` holds for, the k other rows of highest score.

    A component x counts as floor(256 x), the score is the inner product, equal
    scores go by ascending id (null last). Vectors that are null or hold a null
    or non-finite component take no part. Vectors meet those of their own length
    only; each length is a join of its own. Rows with equal or null ids are rows
    of their own: a query's own row alone is left out, and each query row is
    ranked by itself. Empty vectors score zero. A null `is_query` is false. An
    empty table gives no rows. Scores past 64 bits count as the range's ends.

    Bounds: at most MAX_PIVOTS pivots, and k vectors near each, are broadcast;
    a task holds a group of queries (`sizes` nearly) and one slice of blocks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"),
                     F.col(vec_col).cast("array<double>").alias("vec")).filter(usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.count_if("query").alias("q")).collect()
    found = [_join(rows.filter(F.size("vec") == r["dim"]), r["dim"], r["n"], k, sizes, slice_rows) for r in lengths if r["q"] and r["n"] > 1]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    order = Window.partitionBy("qrow", "dim").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _join(rows: DataFrame, dim: int, n: int, k: int, sizes: int, slice_rows: int) -> DataFrame:
    spark = rows.sparkSession
    most = max(1, min(MAX_PIVOTS, math.ceil(math.sqrt(n)), PIVOT_NUMBERS // max(1, dim * k)))
    drawn = rows.orderBy(F.xxhash64("vec_id", "vec")).limit(most).select("vec").collect()
    pivots = np.unique(np.floor(np.array([r["vec"] for r in drawn], np.float64).reshape(len(drawn), dim) * SCALE), axis=0)
    if dim and len(pivots) > 2:  # neighbours in one direction lie side by side
        middle = pivots - pivots.mean(axis=0)
        top = float(np.abs(middle).max()) or 1.0
        pivots = pivots[np.argsort(middle @ np.linalg.svd(middle / top, full_matrices=False)[2][0], kind="stable")]

    stored = _assigned(rows, pivots, dim)
    blocks = _blocks(stored, dim)
    nearest = Window.partitionBy("cell").orderBy("resid", "row")
    near = stored.withColumn("rn", F.row_number().over(nearest)).filter(F.col("rn") <= k).select("row", "v").collect()  # k a pivot
    summary = (np.array([r["row"] for r in near]), np.concatenate([_unpack(bytes(r["v"]), 1, dim) for r in near]))
    counts = {r["cell"]: r["count"] for r in stored.filter("query").groupBy("cell").count().collect()}  # a row a pivot
    groups, n_groups = _groups(stored, counts, sizes, pivots, summary, dim, k)

    # per group and cell: the radius of its queries and the least score that one of them still needs
    parts = (groups.select("grp", F.explode(F.arrays_zip("cells", "resid", "floor")).alias("z"))
             .groupBy("grp", F.col("z.cells").alias("cell")).agg(F.max("z.resid").alias("radius"), F.min("z.floor").alias("floor")))
    parts = parts.orderBy("grp", "cell").collect()  # a row a pivot, more only for the groups of a split cell
    near = {c: np.array([r[c] for r in parts]) for c in ("grp", "cell", "radius", "floor")}
    # as many slices as keep a task's rows in bounds, or all cores at work
    slices = max(-(-n // slice_rows), min(-(-n // BLOCK), -(-spark.sparkContext.defaultParallelism // n_groups)))
    sent = spark.sparkContext.broadcast((pivots, near))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, near = sent.value
        for batch in batches:
            cells, far, norm = (batch.column(c).to_pylist() for c in ("cell", "far", "norm"))
            for i in range(len(batch)):
                need = np.unique(near["grp"][_reach(near, pivots, cells[i], far[i], norm[i]) >= near["floor"]])
                if len(need):
                    times = pa.array(np.full(len(need), i))
                    yield pa.RecordBatch.from_arrays([pa.array(need.astype(np.int32)), *(c.take(times) for c in batch.columns)],
                                                     names=["grp", *batch.schema.names])

    slice_of = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice")
    data = blocks.mapInArrow(replicate, "grp int, " + _BLOCKS).select("*", slice_of)
    asked = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def solve(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        return _solve(queries, blocks, sent.value[0], dim, k)

    found = asked.groupBy("grp", "slice").cogroup(data.groupBy("grp", "slice")).applyInArrow(solve, _FOUND)
    return found.withColumn("dim", F.lit(dim))
