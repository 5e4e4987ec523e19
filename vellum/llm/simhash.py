"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits have a common variant within h
bits of each of them. Every distinct fingerprint emits all its variants within
h bits; the variants are shuffled by their address, of which a block of bits is
the shuffle key, and equal variants link their sources.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, hot_join, without
from vellum.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BLOCK_VARIANTS = 1 << 17  # variants that one block holds on average; sets the number of blocks
SLICE_VARIANTS = 1 << 22  # variants that a task holds at a time, however full its block is


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the shingles' XXH64 values; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    starts, ends = starts[:n].tolist(), ends[shingle - 1:].tolist()
    for at in range(0, n, 1 << 16):
        part = zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)])
        h = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """`df` with the fingerprint of the whole text as a signed long; a null text counts as empty."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash64(t, shingle) for t in texts], np.uint64).view(np.int64))

    return without(df, out).withColumn(out, fp(F.col(text_col)))


def _masks(bits: list[int], weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(bits, weight)], np.uint64)


def block_bits(n: int, half: int, block_variants: int = BLOCK_VARIANTS) -> list[int]:
    """Bit positions whose value is a variant's block, so many that a block holds `block_variants` on average."""
    ball = sum(math.comb(64, w) for w in range(half + 1))
    b = min(24, max(0, math.ceil(math.log2(max(1, n * ball / block_variants)))))
    return [i * 64 // b for i in range(b)]


def _pattern(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def block_links(fps: np.ndarray, block: int, bits: list[int], half: int,
                slice_variants: int = SLICE_VARIANTS) -> np.ndarray:
    """Links (m, 2) among the fingerprints sent to a block: a spanning forest of those that share a variant in it."""
    fps = np.unique(fps)
    if len(fps) < 2:
        return np.empty((0, 2), np.uint64)
    own = _pattern(fps, bits) ^ block
    used = np.bitwise_count(own.astype(np.uint64)).astype(np.int64)
    flips = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(bits):
        flips |= ((own >> j) & 1).astype(np.uint64) << np.uint64(b)
    base = fps ^ flips  # the fingerprint moved into the block
    rest = [b for b in range(64) if b not in set(bits)]
    masks = [_masks(rest, w) for w in range(half + 1)]
    plan = [(np.flatnonzero(used == e), np.concatenate(masks[:half - e + 1])) for e in range(half + 1)]
    total = sum(len(i) * len(m) for i, m in plan)
    slices = max(1, -(-total // slice_variants))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    links = []
    for s in range(slices):
        values, sources = [], []
        for who, mask in plan:
            step = max(1, slice_variants // len(mask))
            for at in range(0, len(who), step):
                some = who[at:at + step]
                v = (base[some][:, None] ^ mask[None, :]).ravel()
                src = np.repeat(some.astype(np.int32), len(mask))
                if slices > 1:
                    keep = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(slices) == s
                    v, src = v[keep], src[keep]
                values.append(v)
                sources.append(src)
        v, src = np.concatenate(values), np.concatenate(sources)
        order = np.sort(v)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            continue
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = twice[at] == v
        v, src = v[hit], src[hit]
        by = np.lexsort((src, v))
        v, src = v[by], src[by]
        first = np.concatenate(([True], v[1:] != v[:-1]))
        lead = src[np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))]
        pairs = np.unique(lead.astype(np.int64) * len(fps) + src)
        for a, b in zip((pairs // len(fps)).tolist(), (pairs % len(fps)).tolist()):
            x, y = root(a), root(b)
            if x != y and int(fps[a] ^ fps[b]).bit_count() <= 2 * half:  # verified on the fingerprints
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
    return fps[np.array(links, np.int64)] if links else np.empty((0, 2), np.uint64)


def ball_links(fps: DataFrame, max_bits: int = MAX_BITS, block_variants: int = BLOCK_VARIANTS,
               slice_variants: int = SLICE_VARIANTS) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct `fp` that differ in `max_bits` or fewer bits.

    `fps` is a written table of distinct fingerprints. A variant lies in the
    block that its bits at `block_bits` name. A fingerprint goes once to each
    block that one of its variants lies in, and the block's task enumerates
    the variants there, so that the shuffle moves fingerprints, not variants.
    Sources of one variant are linked to the first of them (any two lie within
    `max_bits` of each other), and a block returns a spanning forest, so links
    stay linear in the fingerprints even where thousands lie close together.
    """
    half = (max_bits + 1) // 2
    bits = block_bits(fps.count(), half, block_variants)
    pattern = F.lit(0).cast("long")
    for j, b in enumerate(bits):
        pattern = pattern.bitwiseOR(F.shiftleft(F.shiftright("fp", b).bitwiseAND(1), j))
    near = [int(m) for w in range(half + 1) for m in _masks(list(range(len(bits))), w)]
    sent = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in near])).alias("m"), pattern.alias("p")) \
        .select("fp", F.col("p").bitwiseXOR(F.col("m")).alias("block"))

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = block_links(rows["fp"].to_numpy().view(np.uint64), int(key[0]), bits, half, slice_variants)
        if max_bits % 2 and len(got):
            got = got[np.bitwise_count(got[:, 0] ^ got[:, 1]) <= max_bits]
        return pd.DataFrame({"u": got[:, 0].view(np.int64).copy(), "v": got[:, 1].view(np.int64).copy()})

    return sent.groupBy("block").applyInPandas(link, "u long, v long")


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """Stored table (id, th, fp): id, hash of the text and fingerprint of every row."""
    if max_bits % 2:
        raise ValueError("max_bits must be even: both sides emit variants within half of it")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return cut(add_fingerprints(rows, "text", "fp", shingle).select("id", "th", "fp"), "simhash-rows")


def _rooted(nodes: DataFrame, max_bits: int) -> DataFrame:
    """A stored table with one row for each `fp`, and `root`, the least fingerprint of its component."""
    comp = components(ball_links(nodes.select("fp"), max_bits))
    return nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id, fp) for every row of `docs`.

    Fingerprints link at `max_bits` (an even number) or fewer differing bits;
    component_id is the least id reachable over links, the row's own included.
    Null and empty texts have fingerprint zero and link like any other. A null
    id takes part; its component_id is the least id that is not null, or null.
    Repeated rows stay repeated. An empty table gives no rows. Other columns of
    `docs` are not read. Fingerprints of many rows and components of many
    fingerprints reach their rows by broadcast (`hot_join`).
    """
    rows = _fingerprints(docs, id_col, text_col, shingle, max_bits)
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "simhash-nodes")
    grouped = cut(_rooted(nodes, max_bits), "simhash-roots")
    total = grouped.agg(F.count("*").alias("n"), F.sum("copies").alias("c")).first()
    named = hot_join(grouped, grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("__n")), "root", total["n"])
    named = cut(named.select("fp", "component_id", F.col("copies").alias("__n")), "simhash-named")
    return hot_join(rows, named, "fp", total["c"] or 0).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with exactly one row of each group of near-duplicates, its columns unchanged.

    Rows are judged by id and text, not by id alone: of a group's rows the one
    with the least id stays (null ids last; of equal ids the least hash of the
    text), so that a repeated or missing id loses no group. Rows equal in both
    are one. Null and empty texts have fingerprint zero and form a group like
    any other. An empty table gives no rows.
    """
    rows = _fingerprints(docs, id_col, text_col, shingle, max_bits)
    row = F.struct(F.isnull("id").alias("no_id"), "id", "th")
    nodes = cut(rows.groupBy("fp").agg(F.min(row).alias("best")), "simhash-nodes")
    best = _rooted(nodes, max_bits).groupBy("root").agg(F.min("best").alias("best"))
    zero = F.lit(0).cast(docs.schema[id_col].dataType)  # stands for a missing id beside the flag
    key = ["__no_id", "__id", "__th"]
    winners = best.select(F.col("best.no_id").alias("__no_id"), F.coalesce("best.id", zero).alias("__id"), F.col("best.th").alias("__th"))
    told = docs.withColumns({"__no_id": F.isnull(id_col), "__id": F.coalesce(F.col(id_col), zero), "__th": F.xxhash64(text_col)})
    # equal rows shrink to one before they are shuffled; the join keeps that partitioning
    first = F.row_number().over(Window.partitionBy(*key).orderBy("__th"))
    return told.withColumn("__rn", first).filter("__rn = 1").join(winners, key, "left_semi").select(*docs.columns)
