"""K7 by neighbour descent: a neighbour graph refined by the neighbours of neighbours.

The graph starts with the nearest vectors of each one's own cell and of a block
of vectors from all cells.  In a round,
the neighbours of a node, both ways, are scored against each other where one of
the two is new to it, and every node keeps the best it has seen.  The rounds
end when few edges change.  A round scores a bounded number of pairs a node, so
that the work grows with the vectors, not with their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.vectors import dimension_ok
from vellum.operators.pq_index import _matrix, _stored, train
from vellum.operators.search import SIM_DIGITS, _unit_rows

#: Vectors of a cell that are compared all with all at the start; larger cells are split.
START_BLOCK = 512
MAX_ROUNDS = 12
#: The rounds end when fewer edges than this share change.
STILL = 0.002


@dataclass
class Descent:
    """The graph (src, dst, dist, rank), the pairs scored at the start and in each round, and the edges changed."""

    graph: DataFrame
    scored: list[int] = field(default_factory=list)
    changed: list[int] = field(default_factory=list)


def _best(edges: DataFrame, keep: int) -> DataFrame:
    """Per node its `keep` best edges (ties by id)."""
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep).drop("rn")


def _start(rows: DataFrame, dim: int, n: int, keep: int) -> DataFrame:
    """(src, dst, sim): for every vector its nearest in its own cell, and those in a block of vectors from all cells.

    Half of its edges come from each, so that the graph does not fall apart into cells.
    """
    spark = rows.sparkSession
    cells = train(rows.select(F.col("vec").cast("array<double>").alias("vec")), dim, n, cells=max(1, math.ceil(n / (START_BLOCK // 2))))
    sent = spark.sparkContext.broadcast(cells)
    kind = rows.schema["id"].dataType
    place = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", kind), T.StructField("vec", rows.schema["vec"].dataType)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = sent.value.assign(_unit_rows(_matrix(batch.column("vec"), dim)))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("id"), batch.column("vec")], names=["cell", "id", "vec"])

    placed = _stored(rows.mapInArrow(assign, place), "descent-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / START_BLOCK).alias("parts"))  # a row a cell
    own = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    mixed = placed.select(F.lit(-1).alias("cell"), "id", "vec", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, -(-n // START_BLOCK)))).alias("part"))
    split = own.select("cell", "part", "id", "vec").unionByName(mixed)

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        u = _unit_rows(_matrix(table.column("vec").combine_chunks(), dim))
        s = np.round(u @ u.T, SIM_DIGITS)
        np.fill_diagonal(s, -np.inf)
        m = min(-(-keep // 2), len(u) - 1)
        if m < 1:
            return _edges(ids, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), ["src", "dst", "sim"])
        to = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return _edges(ids, np.repeat(np.arange(len(u)), m), to.ravel(), np.take_along_axis(s, to, 1).ravel(), ["src", "dst", "sim"])

    return split.groupBy("cell", "part").applyInArrow(compare, _schema(kind)).distinct()


def _schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("sim", T.DoubleType())])


def _edges(ids: pa.Array, a: np.ndarray, b: np.ndarray, sims: np.ndarray, names: list[str]) -> pa.Table:
    return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(sims)], names=names)


def _candidates(edges: DataFrame, rows: DataFrame, dim: int, keep: int) -> DataFrame:
    """(src, dst, sim, pairs): scored pairs of neighbours of one node that may be edges; `pairs` counts a node's on one row.

    A node's neighbourhood is its `keep` edges and the `keep` nodes nearest to
    it of those that name it, so that a hub has no more than others.
    """
    kind = rows.schema["id"].dataType
    least = edges.groupBy("src").agg(F.min("sim").alias("least"), F.count("*").alias("n")) \
        .select(F.col("src").alias("node"), F.when(F.col("n") < keep, -2.0).otherwise(F.col("least")).alias("least"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim", "new")
    both = edges.select("src", "dst", "sim", "new").unionByName(_best(back, keep))
    around = both.groupBy("src", "dst").agg(F.max("new").alias("new"))
    # vectors go only to nodes that have a new neighbour: the pairs of the others are known
    around = around.withColumn("due", F.max("new").over(Window.partitionBy("src"))).where("due").drop("due")
    known = rows.join(least, rows["id"] == least["node"]).select("id", "vec", "least")
    near = around.join(known, around["dst"] == known["id"]).groupBy("src").agg(
        F.collect_list(F.struct("id", "new", "least", "vec")).alias("near"))  # at most twice `keep`

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                near = batch.column("near")[i].values
                ids, new = near.field("id"), near.field("new").to_numpy(zero_copy_only=False).astype(bool)
                least = near.field("least").to_numpy()
                u = _unit_rows(_matrix(near.field("vec"), dim))
                s = np.round(u @ u.T, SIM_DIGITS)
                due = new[:, None] | new[None, :]
                np.fill_diagonal(due, False)
                a, b = np.nonzero(due & (s >= least[:, None]))
                pairs = np.zeros(len(a) + 1, np.int64)
                pairs[-1] = int(due.sum()) // 2
                src = pa.concat_arrays([ids.take(pa.array(a)), pa.nulls(1, ids.type)])
                dst = pa.concat_arrays([ids.take(pa.array(b)), pa.nulls(1, ids.type)])
                yield pa.RecordBatch.from_arrays([src, dst, pa.array(np.append(s[a, b], 0.0)), pa.array(pairs)], names=["src", "dst", "sim", "pairs"])

    return near.mapInArrow(score, _schema(kind).add("pairs", T.LongType()))


def descend(vectors: DataFrame, m: int = 16, id_col: str = "id", vec_col: str = "embedding", pool: int | None = None,
            max_rounds: int = MAX_ROUNDS) -> Descent:
    """Each vector's m nearest others by cosine (src, dst, dist, rank), nearly: edges are exact, a few are missed.

    `pool` (twice m, at least 32) is how many neighbours a node holds while
    rounds go on.  Ids must be unique; null vectors and those of another length
    than the first usable one (by id) take no part.
    """
    v = F.col(vec_col)
    first = vectors.where(v.isNotNull() & (F.size(v) > 0)).agg(F.min_by(F.size(v), F.col(id_col)).alias("d")).first()["d"]
    schema = _schema(vectors.schema[id_col].dataType)
    spark = vectors.sparkSession
    if first is None:
        return Descent(spark.createDataFrame([], T.StructType([*schema.fields[:2], T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())])))
    keep = pool or max(2 * m, 32)
    # vectors travel at the precision they have; products are taken in doubles
    vec = v if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else v.cast("array<double>")
    rows = _stored(vectors.where(dimension_ok(v, first)).select(F.col(id_col).alias("id"), vec.alias("vec")), "descent-vectors")
    n = rows.count()
    edges = _stored(_best(_start(rows, first, n, keep), keep).withColumn("new", F.lit(True)), "descent-start")
    found = Descent(edges, scored=[n * min(n, START_BLOCK)])
    for _ in range(max_rounds):
        cand = _stored(_candidates(edges, rows, first, keep), "descent-pairs")
        scored = cand.agg(F.sum("pairs")).first()[0] or 0
        if not scored:
            break
        old = edges.select("src", "dst", "sim", F.lit(False).alias("new"))
        some = cand.where("src IS NOT NULL").select("src", "dst", "sim").withColumn("new", F.lit(True))
        # an edge that was there stays known; `new` marks those that this round brought in
        merged = old.unionByName(some).groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        edges = _stored(_best(merged, keep), "descent-round")
        changed = edges.where("new").count()
        found.scored.append(int(scored))
        found.changed.append(changed)
        if changed <= STILL * n * keep:
            break
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    ranked = edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)
    found.graph = ranked.select("src", "dst", (F.lit(1.0) - F.col("sim")).alias("dist"), "rank")
    return found
