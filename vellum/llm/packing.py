"""Packing documents into windows of W tokens by non-negative least squares over length combinations.

Whole windows are cut off long documents; the rests (1 to W-1 tokens) form a
histogram. Every combination of up to three lengths that fills a window is a
column of a matrix, whose non-negative least-squares solution against the
histogram says how often to use it. The rounded counts are filled with
documents by their rank among those of equal length; documents beyond them are
packed greedily: each goes on where the one before it stopped, cut at the
windows' ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, in_order, running_start
from vellum.llm.tokens import END_ID, encoder, in_chunks

WINDOW = 2048
STEPS = 300


def combinations_of(window: int = WINDOW) -> np.ndarray:
    """(n, 3) lengths a >= b >= c that add up to the window; b and c may be 0 for pairs, never for one (no rest is whole)."""
    b, c = np.meshgrid(np.arange(1, window // 2 + 1), np.arange(0, window // 3 + 1), indexing="ij")
    a = window - b - c
    fits = (a >= b) & (b >= c)
    return np.stack([a[fits], b[fits], c[fits]], axis=1).astype(np.int64)


def solve(hist: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Minimise |A x - hist|^2 over x >= 0 by accelerated projected gradient; A has a column for each combination.

    hist[0] stands for an absent part and has no weight. Deterministic.
    """
    n = len(hist)
    live = (hist[combos] > 0) | (combos == 0)
    use = np.flatnonzero(live.all(axis=1))  # a combination with an absent length cannot help
    cols = combos[use]
    weight = (np.arange(n) > 0).astype(float)

    def apply(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(cols[:, j], x, n) for j in range(3)) * weight

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[cols].sum(axis=1)

    x = np.zeros(len(cols))
    if len(cols):
        v = np.ones(len(cols))
        for _ in range(30):  # the largest eigenvalue of A'A, for the step
            v = back(apply(v))
            top = np.linalg.norm(v)
            v /= top
        y, t = x.copy(), 1.0
        for _ in range(steps):
            new = np.maximum(0.0, y - back(apply(y) - hist) / (1.02 * top))
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    out = np.zeros(len(combos))
    out[use] = x
    return out


def whole_counts(x: np.ndarray, hist: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Repeat counts: rounded down, then one more of each in order of lost fraction while the lengths last."""
    k = np.floor(x + 1e-9).astype(np.int64)
    left = hist.astype(np.int64).copy()
    for j in range(3):
        left -= np.bincount(combos[:, j], k, len(hist)).astype(np.int64)
    left[0] = 1 << 60
    over = left < 0
    if over.any():  # the fit may ask for more of a length than there is
        scale = np.ones(len(hist))
        asked = hist - left
        scale[over] = hist[over] / np.maximum(1, asked[over])
        k = np.floor(k * scale[combos].min(axis=1)).astype(np.int64)
        left = hist.astype(np.int64).copy()
        for j in range(3):
            left -= np.bincount(combos[:, j], k, len(hist)).astype(np.int64)
        left[0] = 1 << 60
    for i in np.argsort(-(x - k), kind="stable"):
        if x[i] - k[i] < 0.2:
            break
        a, b, c = combos[i]
        left[a] -= 1
        left[b] -= 1
        left[c] -= 1
        if min(left[a], left[b], left[c]) < 0:
            left[a] += 1
            left[b] += 1
            left[c] += 1
        else:
            k[i] += 1
    return k


def slots(combos: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """By length and rank: from which rank on, in which window and at which offset a document of that length goes.

    Arrays sorted by (length, first rank); window = base + rank - first.
    At most three entries per combination, so the window bounds the size.
    """
    used = np.flatnonzero(counts)
    base = np.concatenate(([0], np.cumsum(counts[used])))[:-1]
    parts = combos[used]
    before = np.concatenate((np.zeros((len(used), 1), np.int64), np.cumsum(parts, axis=1)[:, :2]), axis=1)
    length, n = parts.ravel(), np.repeat(counts[used], 3)
    entry = {"length": length, "n": n, "base": np.repeat(base, 3), "offset": before.ravel()}
    entry = {k: v[length > 0] for k, v in entry.items()}
    by = np.argsort(entry["length"], kind="stable")
    entry = {k: v[by] for k, v in entry.items()}
    total = np.cumsum(entry["n"])
    first = np.flatnonzero(np.concatenate(([True], entry["length"][1:] != entry["length"][:-1]))) if len(by) else by
    start = total - entry["n"]
    entry["first"] = start - np.repeat(start[first], np.diff(np.append(first, len(by))))
    return entry


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table (doc_id, ids binary, n, part, seq): ids with the end id, little-endian, 2 or 4 bytes each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], enc.dtype).tobytes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_chunks(texts):
                raw = [r + end for r in enc.encode(texts[a:b])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a), "ids": pa.array(raw, pa.binary()),
                    "n": pa.array([len(r) // enc.width for r in raw], pa.int64()),
                    "part": pa.array([part] * (b - a), pa.int32()), "seq": pa.array(range(seq, seq + b - a), pa.int64())})
                seq += b - a

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(encode, "doc_id long, ids binary, n long, part int, seq long"), "packing-ids")


def plan_pieces(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces (part, seq, start, length, sequence_id, offset) for a stored table (part, seq, n).

    Sequence ids: whole windows of long documents first, then the combinations',
    then the greedy rest. The rest's last, unfilled window is cut at powers of two.
    """
    spark = lengths.sparkSession
    rest = lengths.select("part", "seq", "n", (F.col("n") % window).alias("rest"), F.floor(F.col("n") / window).cast("long").alias("whole"))
    ranked = rest.withColumn("local", F.row_number().over(Window.partitionBy("part", "rest").orderBy("seq")) - 1)
    counts = rest.groupBy("part", "rest").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.join(counts.withColumn("before", F.coalesce(before, F.lit(0))).select("part", "rest", "before"), ["part", "rest"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local"))

    hist = np.zeros(window, np.int64)  # a row for each length at most
    for r in rest.groupBy("rest").agg(F.count("*").alias("c")).collect():
        hist[r["rest"]] = r["c"]
    hist[0] = 0
    combos = combinations_of(window)
    entry = slots(combos, whole_counts(solve(hist.astype(float), combos), hist, combos))
    width = np.bincount(entry["length"], entry["n"], window).astype(np.int64)  # documents that combinations take, by length
    edges = np.searchsorted(entry["length"], np.arange(window + 1))
    sent = spark.sparkContext.broadcast((entry, edges, width))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry, edges, width = sent.value
        # one key for (length, rank): ranks stay below 2^48
        keys = (entry["length"] << 48) + entry["first"]
        for t in batches:
            length, rank = t["rest"].to_numpy(), t["rank"].to_numpy()
            taken = (length > 0) & (rank < width[length])
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            at = np.where(taken, at, 0)
            if len(keys):
                seq = entry["base"][at] + rank - entry["first"][at]
                off = entry["offset"][at]
            else:
                seq = off = np.zeros(len(t), np.int64)
            yield pd.DataFrame({"part": t["part"], "seq": t["seq"], "n": t["n"], "rest": length, "whole": t["whole"],
                                "window": np.where(taken, seq, -1), "offset": np.where(taken, off, -1)})

    placed = cut(ranked.select("part", "seq", "n", "rest", "whole", "rank").mapInPandas(
        assign, "part int, seq long, n long, rest long, whole long, window long, offset long"), "packing-placed")
    n_combos = int(entry["n"].sum() and (entry["base"] + entry["n"]).max()) if len(entry["n"]) else 0

    # whole windows of long documents, numbered by a running count
    order = placed.select(F.col("part").alias("p"), "seq", "whole",
                          F.when((F.col("rest") > 0) & (F.col("window") < 0), F.col("rest")).otherwise(0).alias("loose"))
    order = in_order(order, ["p", "seq"], "packing-order")
    order = running_start(running_start(order, ["p", "seq"], "whole", "w0"), ["p", "seq"], "loose", "l0").drop("part")
    sums = order.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("w"), F.coalesce(F.sum("loose"), F.lit(0)).alias("l")).first()
    n_whole, loose = int(sums["w"]), int(sums["l"])

    body = (order.filter("whole > 0")
            .select(F.col("p").alias("part"), "seq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("i"), "w0")
            .select("part", "seq", (F.col("i") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                    (F.col("w0") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    fitted = placed.filter("window >= 0").select("part", "seq", (F.col("whole") * window).alias("start"), F.col("rest").alias("length"),
                                                 (F.col("window") + n_whole).alias("sequence_id"), "offset")
    # the greedy rest: positions cut at the windows' ends, in the last window at powers of two
    full = loose // window * window
    ends, at = [], full
    for bit in reversed(range(window.bit_length())):
        if (loose - full) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    tail = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<long>")
    cuts = F.concat(F.transform(F.sequence(F.floor(F.col("l0") / window), F.floor((F.col("l0") + F.col("loose")) / window)),
                                lambda w: (w * window).cast("long")), tail)
    inner = F.filter(cuts, lambda e: (e > F.col("l0")) & (e < F.col("l0") + F.col("loose")) & (e <= full) | (
        (e > full) & (e > F.col("l0")) & (e < F.col("l0") + F.col("loose"))))
    points = F.array_sort(F.array_distinct(F.concat(F.array(F.col("l0"), F.col("l0") + F.col("loose")), inner)))
    spans = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(
        F.element_at("points", i).alias("a"), F.element_at("points", i + 1).alias("b")))
    first_tail = n_whole + n_combos + full // window
    last = F.array(*[F.lit(e).cast("long") for e in [full, *ends]])
    which = F.size(F.filter(last, lambda e: e <= F.col("s.a"))) - 1  # of the tail's sequences
    pieces = (order.filter("loose > 0").withColumn("points", points).select("p", "seq", "whole", "l0", F.explode(spans).alias("s"))
              .select(F.col("p").alias("part"), "seq", (F.col("whole") * window + F.col("s.a") - F.col("l0")).alias("start"),
                      (F.col("s.b") - F.col("s.a")).alias("length"),
                      F.when(F.col("s.a") < full, F.floor(F.col("s.a") / window) + n_whole + n_combos)
                      .otherwise(first_tail + which).cast("long").alias("sequence_id"),
                      F.when(F.col("s.a") < full, F.col("s.a") % window)
                      .otherwise(F.col("s.a") - F.element_at(last, which + 1)).cast("long").alias("offset")))
    return body.unionByName(fitted).unionByName(pieces)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`, binary).

    Every id of every document, END_ID included, lies in one piece. Sequences
    hold `window` ids, but for the last few, which hold powers of two. Null
    texts are empty and have the end id alone; rows with null or repeated ids
    are packed like any other; an empty table gives no rows. Histograms (a row
    per length) and the slot table (bounded by the window's combinations) are
    all that reaches the driver. Other columns are not read.
    """
    tokens = encode_documents(docs, tokenizer, id_col, text_col)
    pieces = cut(plan_pieces(tokens.select("part", "seq", "n"), window), "packing-pieces")
    grouped = pieces.groupBy("part", "seq").agg(F.sort_array(F.collect_list(
        F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = tokens.join(grouped, ["part", "seq"]).select("doc_id", "ids", "n", "pieces")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, raws = [], []
            for doc, raw, n, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "n", "pieces"))):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                for p in parts:
                    some = ids[p["start"]:p["start"] + p["length"]].tobytes()
                    out.append((doc, p["start"], p["length"], zlib.crc32(some), n, p["sequence_id"], p["offset"]))
                    if with_ids:
                        raws.append(some)
            if out:
                arrays = [pa.array(c, pa.int64()) for c in zip(*out)] + ([pa.array(raws, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    return joined.mapInArrow(digest, schema + ", ids binary" * with_ids)
