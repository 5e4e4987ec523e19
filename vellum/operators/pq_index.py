"""K4 as a stored index: two-level cells that follow the library's size, with product-quantised residuals.

The number of cells grows with the square root of the vectors.  A vector goes
to its nearest coarse centre and, under it, to its nearest cell; what is left
over is coded in a byte for every few dimensions.  The index is a table of
blocks partitioned by cell.  A search names the cells that its queries probe,
reads the codes of those partitions alone, keeps each query's most promising
vectors by their codes, and scores just these exactly, from the blocks that
hold them.  A task takes a block of queries and a bounded part of the cells; what
is dealt to it are codes and the vectors asked for, not whole blocks.  How many cells to probe and how many vectors to score is measured
against exact search on a sample of the library when the index is built.

The driver holds centres, codebooks and bounded training samples, no vectors
of the library or the queries.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from vellum.functions.vectors import dimension_ok
from vellum.operators.search import SIM_DIGITS, _unit_rows, batch_topk, flat_topk, rank_window

#: Vectors that centres and codebooks are trained on at most, and per sub-cell.
MAX_TRAIN = 50_000
TRAIN_PER_CELL = 64
BLOCK = 4096
QUERY_BLOCK = 1024
#: Dimensions that share a code byte.
CODE_DIMS = 4
MAX_CELLS = 1 << 17
#: Bytes of codes or vectors dealt to a task with a block of queries, about.
PART_BYTES = 64 << 20
#: Cells named in a scan's filter at most.
MAX_NAMED = 10_000
SAMPLE_QUERIES = 200
TARGET_RECALL = 0.93
#: Share of the library that a query scores exactly at most, while that is above LEAST_RERANK vectors.
MAX_SHARE, LEAST_RERANK = 0.05, 50


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """At most k centres of the rows of x by Lloyd's rounds from a seeded draw; deterministic."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, step: int = 8192) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[i:i + step] @ c.T - half).argmax(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class Cells:
    """Centres of both levels and the codebooks of the residuals."""

    def __init__(self, coarse: np.ndarray, cells: np.ndarray, parent: np.ndarray, books: list[np.ndarray]):
        self.coarse, self.cells, self.parent, self.books = coarse, cells, parent, books
        self.under = [np.flatnonzero(parent == i) for i in range(len(coarse))]
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    def assign(self, x: np.ndarray) -> np.ndarray:
        top, out = nearest(x, self.coarse), np.zeros(len(x), np.int64)
        for i in np.unique(top):
            who = np.flatnonzero(top == i)
            out[who] = self.under[i][nearest(x[who], self.cells[self.under[i]])]
        return out

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.cells[cell]
        return np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def probe(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n cells of highest product with each query."""
        s = q @ self.cells.T
        return np.argsort(-s, axis=1, kind="stable")[:, :n]

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """What the codes of a cell's vectors stand for."""
        return self.cells[cell] + np.concatenate([book[codes[:, j]] for j, book in enumerate(self.books)], axis=1)

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries with coded vectors of a cell, up to the coding error."""
        return q @ self.decode(cell, codes).astype(q.dtype).T


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _sample(df: DataFrame, most: int, n: int, dim: int, salt: int) -> np.ndarray:
    """At most `most` unit vectors, drawn by a hash of the vector."""
    some = df if n <= most else df.orderBy(F.xxhash64("vec", F.lit(salt))).limit(most)
    got = some.select("vec").toArrow().column("vec").combine_chunks()
    return _unit_rows(_matrix(got, dim)) if len(got) else np.zeros((0, dim))


def train(vectors: DataFrame, dim: int, n: int, cells: int | None = None) -> Cells:
    """Centres and codebooks for `vectors` (vec): about sqrt(n) cells, in sqrt(cells) families."""
    spark = vectors.sparkSession
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    x = _sample(vectors, MAX_TRAIN, n, dim, 1)
    coarse = kmeans(x, max(1, round(math.sqrt(cells))))
    each = math.ceil(cells / len(coarse))
    sent = spark.sparkContext.broadcast(coarse)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                u = _unit_rows(_matrix(batch.column("vec"), dim))
                yield pa.RecordBatch.from_pydict({"family": nearest(u, sent.value).astype(np.int32), "vec": batch.column("vec")})

    def split(table: pa.Table) -> pa.Table:
        c = kmeans(_unit_rows(_matrix(table.column("vec").combine_chunks(), dim)), each)
        return pa.table({"family": pa.array([table.column("family")[0].as_py()] * len(c), pa.int32()), "centre": pa.array(c.tolist())})

    draw = Window.partitionBy("family").orderBy(F.xxhash64("vec", F.lit(2)))
    families = vectors.select("vec").mapInArrow(place, "family int, vec array<double>") \
        .withColumn("rn", F.row_number().over(draw)).where(F.col("rn") <= TRAIN_PER_CELL * each).drop("rn")
    rows = families.groupBy("family").applyInArrow(split, "family int, centre array<double>").collect()  # a row a cell
    rows.sort(key=lambda r: (r["family"], r["centre"]))
    found = Cells(coarse, np.array([r["centre"] for r in rows]), np.array([r["family"] for r in rows]), [])
    kept = np.unique(found.parent)  # families that no vector is nearest to have no cells
    found = Cells(coarse[kept], found.cells, np.searchsorted(kept, found.parent), [])
    rest = x - found.cells[found.assign(x)]
    cuts = [*range(0, dim, CODE_DIMS), dim]
    return Cells(found.coarse, found.cells, found.parent, [kmeans(rest[:, a:b], 256) for a, b in zip(cuts, cuts[1:])])


class PQIndex:
    """An index stored at `path`; `tuned` says how many cells a query probes and how many vectors it scores."""

    def __init__(self, spark: SparkSession, path: str, cells: Cells, dim: int, n: int, id_type: T.DataType, tuned: dict | None = None):
        self.spark, self.path, self.cells, self.dim, self.n, self.id_type = spark, path, cells, dim, n, id_type
        self.tuned = tuned or {"probe": len(cells.cells), "rerank": n}
        self.schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                                    T.StructField("codes", T.BinaryType()), T.StructField("vecs", T.BinaryType()), T.StructField("cell", T.IntegerType())])
        self.counts: dict = {}

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(os.path.join(self.path, "blocks"))
        return rows if cells is None or len(cells) > MAX_NAMED else rows.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int, qid_col: str = "qid", qvec_col: str = "embedding", id_col: str = "id",
               exclude_self: bool = False, probe: int | None = None, rerank: int | None = None) -> DataFrame:
        """(qid, id, sim, rank): the k best of the vectors that the codes bring up, scored exactly (ties by id).

        Query vectors that are null or of another length have no rows.  Work is
        spread by cell and block of queries; neither side passes the driver.
        """
        probe, rerank = probe or self.tuned["probe"], max(k + exclude_self, rerank or self.tuned["rerank"])
        sent, dim = self.spark.sparkContext.broadcast(self.cells), self.dim
        asked = self._asked(queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("vec")))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    q = np.frombuffer(batch.column("vecs")[i].as_py(), np.float64).reshape(-1, dim)
                    where = sent.value.probe(q, probe)
                    by = np.argsort(where.ravel(), kind="stable")
                    cell, row = where.ravel()[by], np.repeat(np.arange(len(q)), where.shape[1])[by]
                    edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
                    yield pa.RecordBatch.from_pydict({
                        "cell": pa.array(cell[edges[:-1]].astype(np.int32)), "qb": pa.array([batch.column("qb")[i].as_py()] * (len(edges) - 1), pa.int64()),
                        "at": pa.array([row[a:b].tolist() for a, b in zip(edges, edges[1:])], pa.list_(pa.int32()))})

        probes = _stored(asked.mapInArrow(ask, "cell int, qb long, at array<int>"), "pq-probes")
        named = [r["cell"] for r in probes.select("cell").distinct().limit(MAX_NAMED + 1).collect()]

        def scan(seen: pa.Table, asked: pa.Table) -> pa.Table:
            """The `rerank` most promising vectors of every query of a block, by the codes of some of the cells."""
            cells = sent.value
            best = (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64))
            blocks = np.zeros(0, np.int64)
            if len(seen) and len(asked):
                q = np.frombuffer(asked.column("vecs")[0].as_py(), np.float64).reshape(-1, dim).astype(np.float32)
                least, held = np.full(len(q), -np.inf, np.float32), 0
                seen = seen.sort_by("block")
                blocks = seen.column("block").to_numpy()
                for i in range(len(seen)):
                    codes = np.frombuffer(seen.column("codes")[i].as_py(), np.uint8).reshape(-1, len(cells.books))
                    at = seen.column("at")[i].values.to_numpy()
                    s = cells.scores(q[at], seen.column("cell")[i].as_py(), codes)
                    if rerank < len(codes):  # only a block's own best can be among the best of all
                        s[s < np.partition(s, -rerank, axis=1)[:, -rerank, None]] = -np.inf
                    row, place = np.nonzero((s >= least[at, None]) & (s > -np.inf))
                    best = tuple(map(np.concatenate, zip(best, (at[row], s[row, place], i * BLOCK + place))))
                    if len(best[0]) > max(2 * held, 1 << 20) or i == len(seen) - 1:  # cut what is kept only when it has doubled
                        best = flat_topk(*best, rerank)
                        held = len(best[0])
                        full = np.bincount(best[0], minlength=len(q)) >= rerank
                        np.minimum.at(low := np.full(len(q), np.inf, np.float32), best[0], best[1])
                        least = np.where(full, low, least)
            return pa.table({"qb": pa.array(np.full(len(best[0]), asked.column("qb")[0].as_py() if len(asked) else 0), pa.int64()),
                             "at": pa.array(best[0].astype(np.int32)), "block": pa.array(blocks[best[2] // BLOCK], pa.int64()),
                             "place": pa.array((best[2] % BLOCK).astype(np.int32)), "guess": pa.array(best[1].astype(np.float64))})

        from vellum.operators.library import sized_broadcast

        def dealt(rows: DataFrame, by: str, row_bytes: int):
            """`rows` and the blocks of queries, by block of queries and part."""
            parts = max(1, -(-self.n * row_bytes // PART_BYTES))
            every = asked.select("qb", "qids", "vecs", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
            return rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).groupBy("qb", "part").cogroup(every.groupBy("qb", "part"))

        seen = self.blocks(named).select("cell", "block", "codes").join(sized_broadcast(probes), "cell")
        seen = dealt(seen, "block", len(self.cells.books)).applyInArrow(scan, "qb long, at int, block long, place int, guess double")
        first = Window.partitionBy("qb", "at").orderBy(F.desc("guess"), "block", "place")
        short = _stored(seen.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= rerank).drop("rn", "guess"), "pq-short")
        pairs = short.groupBy("block", "qb").agg(F.collect_list(F.struct("at", "place")).alias("pairs"))  # of one block of queries
        kind = T.StructType([T.StructField("qid", queries.schema[qid_col].dataType), T.StructField(id_col, self.id_type), T.StructField("sim", T.DoubleType())])

        def take(block: pa.Table, wanted: pa.Table) -> pa.Table:
            """For every block of queries the vectors of one block that it asks for."""
            out = {n: [] for n in ("qb", "block", "at", "place", "ids", "vecs")}
            for i in range(len(wanted) if len(block) else 0):
                ids, raw = block.column("ids")[0].values, block.column("vecs")[0].as_py()
                x = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(ids) else "<f8").reshape(-1, dim)
                both = wanted.column("pairs")[i].values
                used, place = np.unique(both.field("place").to_numpy(), return_inverse=True)
                for n, v in (("qb", wanted.column("qb")[i].as_py()), ("block", wanted.column("block")[i].as_py()), ("at", both.field("at").to_pylist()),
                             ("place", place.tolist()), ("ids", ids.take(pa.array(used)).to_pylist()), ("vecs", x[used].tobytes())):
                    out[n].append(v)
            return pa.table(out, schema=sent_kind)

        id_arrow = to_arrow_schema(T.StructType([T.StructField("ids", T.ArrayType(self.id_type))])).field("ids").type
        sent_kind = pa.schema([("qb", pa.int64()), ("block", pa.int64()), ("at", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())), ("ids", id_arrow), ("vecs", pa.binary())])
        taken = T.StructType([T.StructField("qb", T.LongType()), T.StructField("block", T.LongType()), T.StructField("at", T.ArrayType(T.IntegerType())),
                              T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(self.id_type)), T.StructField("vecs", T.BinaryType())])
        out_kind = to_arrow_schema(kind)

        def score(near: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            if len(near) and len(asked):
                q = np.frombuffer(asked.column("vecs")[0].as_py(), np.float64).reshape(-1, dim)
                qids = asked.column("qids")[0].values
                for i in range(len(near)):
                    ids, raw = near.column("ids")[i].values, near.column("vecs")[i].as_py()
                    x = np.frombuffer(raw, "<f4" if len(raw) == 4 * dim * len(ids) else "<f8").reshape(-1, dim)
                    at, place = near.column("at")[i].values.to_numpy(), near.column("place")[i].values.to_numpy()
                    sims = np.round(np.einsum("ij,ij->i", _unit_rows(x)[place], q[at]), SIM_DIGITS)
                    out.append(pa.table([qids.take(pa.array(at)), ids.take(pa.array(place)), pa.array(sims)], schema=out_kind))
            return pa.concat_tables(out) if out else out_kind.empty_table()

        wanted = [r["cell"] for r in self.blocks(named).select("cell", "block").join(short.select("block").distinct(), "block", "left_semi")
                  .select("cell").distinct().limit(MAX_NAMED + 1).collect()]
        near = self.blocks(wanted).select("block", "ids", "vecs").groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(take, taken)
        scored = dealt(near, "block", 8 * dim).applyInArrow(score, kind)
        if exclude_self:
            scored = scored.where(F.col("qid") != F.col(id_col))
        return rank_window(scored, "qid", id_col, k).withColumnRenamed("qid", qid_col)

    def work(self, n_queries: int, probe: int | None = None, rerank: int | None = None) -> dict[str, float]:
        """Shares of all pairs of queries and vectors: those whose codes are read (about), and those scored exactly (at most)."""
        return {"codes": (probe or self.tuned["probe"]) / max(1, len(self.cells.cells)), "exact": min(1.0, (rerank or self.tuned["rerank"]) / max(1, self.n))}

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Stored blocks of unit query vectors (qb, qids, vecs)."""
        usable = queries.where(dimension_ok(F.col("vec"), self.dim)).select("qid", F.col("vec").cast("array<double>").alias("vec"))
        parts = max(1, -(-usable.count() // QUERY_BLOCK))
        dim = self.dim

        def pack(table: pa.Table) -> pa.Table:
            u = _unit_rows(_matrix(table.column("vec").combine_chunks(), dim))
            qids = table.column("qid").combine_chunks()
            return pa.table({"qb": table.column("qb").slice(0, 1), "qids": pa.ListArray.from_arrays(pa.array([0, len(qids)], pa.int32()), qids),
                             "vecs": pa.array([u.tobytes()], pa.binary())})

        kind = T.StructType([T.StructField("qb", T.LongType()), T.StructField("qids", T.ArrayType(queries.schema["qid"].dataType)), T.StructField("vecs", T.BinaryType())])
        return _stored(usable.withColumn("qb", F.pmod(F.xxhash64("qid", "vec"), F.lit(parts))).groupBy("qb").applyInArrow(pack, kind), "pq-queries")


def _stored(df: DataFrame, name: str) -> DataFrame:
    from vellum.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(library: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", cells: int | None = None, k: int = 10,
                target: float = TARGET_RECALL) -> PQIndex:
    """Store an index of every usable vector of `library` at `path`, tuned to recall@k of `target` on sampled vectors.

    Vectors that are null, empty or of another length than the first usable one
    (by id) are left out, as in the other searches.
    """
    spark = library.sparkSession
    v = F.col(vec_col)
    first = library.where(v.isNotNull() & (F.size(v) > 0)).agg(F.min_by(F.size(v), F.col(id_col)).alias("d")).first()["d"]
    if first is None:
        raise ValueError("no vector to index")
    usable = library.where(dimension_ok(v, first)).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("vec"))
    n, id_type = usable.count(), library.schema[id_col].dataType
    found = train(usable, first, n, cells)
    index = PQIndex(spark, path, found, first, n, id_type)
    sent, single = spark.sparkContext.broadcast(found), isinstance(library.schema[vec_col].dataType.elementType, T.FloatType)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("vec"), first)
                u = _unit_rows(x)
                cell = sent.value.assign(u)
                codes = sent.value.encode(u, cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()),
                                                  pa.array([r.astype("<f4" if single else "<f8").tobytes() for r in x], pa.binary())],
                                                 names=["cell", "id", "code", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True]))) if len(cell) else [0]
            for a, b in zip(edges, edges[1:]):
                for s in range(int(a), int(b), BLOCK):
                    some = batch.slice(s, min(BLOCK, int(b) - s))
                    ids = some.column("id")
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                        pa.array([b"".join(some.column("code").to_pylist())], pa.binary()), pa.array([b"".join(some.column("vec").to_pylist())], pa.binary()),
                        pa.array([int(cell[s])], pa.int32())], names=["block", "ids", "codes", "vecs", "cell"])
                    number += 1

    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", id_type), T.StructField("code", T.BinaryType()), T.StructField("vec", T.BinaryType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a range of cells a task, large cells over several tasks
    placed = usable.mapInArrow(assign, kind).repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")
    placed.mapInArrow(pack, index.schema).write.mode("overwrite").partitionBy("cell").parquet(os.path.join(path, "blocks"))
    index.tuned = tune(index, usable, k, target)
    _save(index)
    return index


def tune(index: PQIndex, usable: DataFrame, k: int, target: float) -> dict:
    """The least work that finds `target` of the exact k nearest of sampled vectors: cells first, then vectors scored.

    Where no setting within MAX_SHARE reaches it, all cells are probed and more vectors scored.
    """
    asked = usable.orderBy(F.xxhash64("vec", "id", F.lit(3))).limit(SAMPLE_QUERIES).select(F.col("id").alias("qid"), "vec")
    asked = _stored(asked, "pq-sample")
    exact = batch_topk(usable, asked, k, vec_col="vec", qvec_col="vec", exclude_self=True).select("qid", "id")
    exact = {(r["qid"], r["id"]) for r in exact.collect()}  # k rows a sampled query
    cells = len(index.cells.cells)
    share = max(LEAST_RERANK, math.floor(MAX_SHARE * index.n))
    tried = [(p, min(share, max(LEAST_RERANK, 10 * k))) for p in sorted({max(1, math.ceil(cells * f)) for f in (0.05, 0.1, 0.2, 0.4, 0.7, 1)})]
    more = [r for r in (max(LEAST_RERANK, 10 * k) << i for i in range(1, 32)) if r < share]  # no more than is needed
    tried += [(cells, r) for r in [*more, share, 4 * share, index.n]]
    for probe, rerank in tried:
        got = index.search(asked, k, qvec_col="vec", exclude_self=True, probe=probe, rerank=min(rerank, index.n)).select("qid", "id").collect()
        recall = len(exact & {(r["qid"], r["id"]) for r in got}) / max(1, len(exact))
        if recall >= target:
            break
    return {"probe": probe, "rerank": min(rerank, index.n), "recall": recall, "k": k}


def _save(index: PQIndex) -> None:
    """Centres and codebooks next to the blocks, as a one-row table."""
    c = index.cells
    meta = {"dim": index.dim, "n": index.n, "id_type": index.id_type.json(), "tuned": index.tuned}
    row = (json.dumps(meta), c.coarse.tobytes(), c.cells.tobytes(), c.parent.astype(np.int64).tobytes(), [b.tobytes() for b in c.books])
    index.spark.createDataFrame([row], "meta string, coarse binary, cells binary, parent binary, books array<binary>").coalesce(1) \
        .write.mode("overwrite").parquet(os.path.join(index.path, "cells"))


def open_index(spark: SparkSession, path: str) -> PQIndex:
    """An index that `build_index` stored."""
    r = spark.read.parquet(os.path.join(path, "cells")).first()
    meta = json.loads(r["meta"])
    dim = meta["dim"]
    cuts = [*range(0, dim, CODE_DIMS), dim]
    floats = lambda raw, w: np.frombuffer(bytes(raw), np.float64).reshape(-1, w)
    cells = Cells(floats(r["coarse"], dim), floats(r["cells"], dim), np.frombuffer(bytes(r["parent"]), np.int64),
                  [floats(b, hi - lo) for b, lo, hi in zip(r["books"], cuts, cuts[1:])])
    return PQIndex(spark, path, cells, dim, meta["n"], T._parse_datatype_json_string(meta["id_type"]), meta["tuned"])
