"""Ranked lexical search over a length-stratified index.

All documents of one length normaliser m form a stratum, stored in segments of
bounded size. A segment keeps its postings by term, and a term's documents by
the number of times that they hold it, so that an impact, which depends on that
number and on m alone, is computed once for each. What the strata can score at
best orders the visits of a query; strata that can't reach its k-th best score
so far are not visited.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut

SEGMENT = 1024  # documents in a segment on average, at most
VOCABULARY = 64 << 20  # bytes of query terms, with what a worker needs to hold them, up to which they are broadcast
QUERY_BYTES = 4 << 20  # bytes of query text in a block
VISIT_BYTES = 64 << 20  # bytes of visits up to which they are broadcast
FIRST_DOCS = 4000  # documents in the strata that a query visits first, about
CELLS = 1 << 20  # scores, and postings, that a worker holds at a time
EXACT = 1 << 53

# bytes of terms: ASCII letters (A-Z lower-cased) and digits, and all bytes of characters beyond ASCII; others part terms
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_SEGMENT = ("m long, docs long, ids array<long>, terms array<string>, spans array<int>, tfs array<int>, ends array<int>, "
            "postings array<int>, df array<long>, top array<int>")


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass
class Index:
    """`segments`: a stored table of _SEGMENT rows; `n_docs` documents with a term, `n_terms` terms in all."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(term) of all queries, each once."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"term": pa.array(sorted({t.decode() for t in terms_of(text)}), pa.string())})

    return queries.select(text_col).mapInArrow(cut_up, "term string").distinct()


def build_index(docs: DataFrame, only: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> Index:
    """Index of all rows of `docs`, of all terms or of those in `only` (term) while these fit in VOCABULARY bytes.

    Counts cover every row and all terms either way. Null texts have no term;
    rows without a term are in no stratum. Rows with null or equal ids are
    documents of their own. Other columns are not read. An empty table gives an
    index without segments. Strata of many documents are dealt to segments by a
    row's number; no task holds more than a segment.
    """
    spark = docs.sparkSession
    wanted = None
    if only is not None:
        size = only.agg(F.sum(F.octet_length("term") + 120)).first()[0] or 0
        if size <= VOCABULARY:
            wanted = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in only.toLocalIterator()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        keep = wanted.value if wanted else None
        for batch in batches:
            texts = batch.column("text")
            at = 0
            while at < len(batch):
                terms, tfs, ends, lengths, start = [], [], [0], [], at
                while at < len(batch) and len(terms) < 1 << 18:
                    words = terms_of(texts[at].as_py())
                    found = Counter(words if keep is None else filter(keep.__contains__, words))
                    terms.extend(found)
                    tfs.extend(found.values())
                    ends.append(len(terms))
                    lengths.append(len(words))
                    at += 1
                ends = pa.array(ends, pa.int32())
                strings = pa.array(terms, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(np.arange(row, row + at - start)), "id": batch.column("id").slice(start, at - start),
                    "n": pa.array(lengths, pa.int64()), "terms": pa.ListArray.from_arrays(ends, strings),
                    "tfs": pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))})
                row += at - start

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = cut(rows.mapInArrow(count, "row long, id long, n long, terms array<string>, tfs array<int>").filter("n > 0"), "lexical-rows")
    total = counted.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], int(total["l"] or 0)
    if not n_docs:
        return Index(spark.createDataFrame([], _SEGMENT), 0, 0)
    m = F.expr(f"cast(75 + (25 * cast(n AS decimal(19,0)) * cast({n_docs} AS decimal(19,0))) div {n_terms} AS long)")
    strata = counted.select("row", "id", m.alias("m"), "terms", "tfs")
    # strata of over `segment` documents are at most n_docs / segment
    large = strata.groupBy("m").count().filter(F.col("count") > segment).select("m", F.ceil(F.col("count") / segment).alias("parts"))
    dealt = strata.join(F.broadcast(large), "m", "left").withColumn("seg", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending")])
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(table), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        by = np.lexsort((doc, tf, term))
        term, tf, doc = term[by], tf[by], doc[by]
        run = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))) if len(term) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate(([True], term[run][1:] != term[run][:-1]))) if len(run) else run
        spans = np.append(first, len(run))
        ends = np.append(run, len(term))
        held = ends[spans[1:]] - ends[spans[:-1]]
        one = {"m": pa.array([table.column("m")[0].as_py()], pa.int64()), "docs": pa.array([len(table)], pa.int64()),
               "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
               "terms": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
               "spans": _one(spans), "tfs": _one(tf[run]), "ends": _one(ends), "postings": _one(doc), "df": _one(held, pa.int64()),
               "top": _one(tf[run][spans[1:] - 1])}
        return pa.table(one)

    segments = cut(dealt.select("m", "seg", "row", "id", "terms", "tfs").groupBy("m", "seg").applyInArrow(pack, _SEGMENT), "lexical-index")
    return Index(segments, n_docs, n_terms)


def _one(values: np.ndarray, kind: pa.DataType = pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _portions(queries: list[tuple[int, list]], held: np.ndarray, docs: int) -> Iterator[list]:
    """Queries with a term in the segment, in portions of about CELLS scores and postings (a query at least)."""
    some, cells, postings = [], 0, 0
    for q, terms in queries:
        if not terms:
            continue
        n = int(held[[t for t, _ in terms]].sum())
        if some and (cells + docs > CELLS or postings + n > CELLS):
            yield some
            some, cells, postings = [], 0, 0
        some.append((q, terms))
        cells, postings = cells + docs, postings + n
    if some:
        yield some


def score_segment(seg: dict, queries: list[tuple[int, dict[str, int]]], floor: dict[int, int], k: int) -> list[tuple]:
    """(query, score, id) of the segment's best documents for each query: those of the k best scores, ties included by id."""
    place = {t: i for i, t in enumerate(seg["terms"])}
    spans, tfs, ends, postings = (np.asarray(seg[c]) for c in ("spans", "tfs", "ends", "postings"))
    by_tf = impact(tfs.astype(np.int64), seg["m"])  # once for each term and tf
    of_posting = np.repeat(by_tf, np.diff(ends))
    docs, out = len(seg["ids"]), []
    last = (1 << 63) - 1
    ids = np.array([last if i is None else i for i in seg["ids"]])
    held = ends[spans[1:]] - ends[spans[:-1]]
    for some in _portions([(q, [(place[t], w) for t, w in terms.items() if t in place]) for q, terms in queries], held, docs):
        j, t, w = (np.array(c, np.int64) for c in zip(*[(j, t, w) for j, (_, terms) in enumerate(some) for t, w in terms]))
        a, n = ends[spans[t]].astype(np.int64), held[t].astype(np.int64)
        which = np.repeat(np.arange(len(t)), n)
        posting = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[which]
        cell = j[which] * docs + postings[posting]
        gain = of_posting[posting] * w[which]
        if gain.sum(dtype=np.float64) < EXACT:  # sums of whole numbers below 2^53 are exact in doubles
            score = np.bincount(cell, gain, len(some) * docs).astype(np.int64)
        else:
            score = np.zeros(len(some) * docs, np.int64)
            np.add.at(score, cell, gain)
        score = score.reshape(len(some), docs)
        least = np.array([max(1, floor.get(q, 1)) for q, _ in some])
        if docs > k:
            least = np.maximum(least, np.partition(score, docs - k, axis=1)[:, docs - k])
        qs, ds = np.nonzero(score >= least[:, None])
        by = np.lexsort((ids[ds], -score[qs, ds], qs))
        qs, ds = qs[by], ds[by]
        rank = np.arange(len(qs)) - np.searchsorted(qs, qs)
        out += [(some[q][0], int(score[q, d]), seg["ids"][d]) for q, d in zip(qs[rank < k].tolist(), ds[rank < k].tolist())]
    return out


def _visited(index: Index, visits: DataFrame, asked, k: int) -> DataFrame:
    """(q, score, id): scores of the strata in `visits` (m, q, floor), of each segment the k best at most."""
    by_m = visits.groupBy("m").agg(F.collect_list(F.struct("q", "floor")).alias("qs"))  # bounded by a block of queries
    size = visits.count() * 16
    by_m = F.broadcast(by_m) if size <= VISIT_BYTES else by_m

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value
        for batch in batches:
            for i in range(len(batch)):
                seg = batch.slice(i, 1).to_pylist()[0]
                qs = sorted((r["q"], r["floor"]) for r in seg["qs"])
                found = score_segment(seg, [(q, terms[q]) for q, _ in qs], dict(qs), k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["q", "score", "id"])

    return index.segments.join(by_m, "m").mapInArrow(score, "q long, score long, id long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for every query, equal scores by id (null last).

    The index must hold the queries' terms. Queries go in blocks of QUERY_BYTES
    of text. Equal rows (id and text) are one query; rows of one id with
    different texts are queries of their own. Null texts, texts without terms
    and terms that no document holds add nothing; a query without a hit has no
    row. An empty table of queries or documents gives no rows.
    """
    spark = queries.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    if not index.n_docs or not size:
        return empty
    blocks = -(-int(size) // QUERY_BYTES)
    out = empty
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            out = out.unionByName(_search_block(index, rows, k))
    return out


def _search_block(index: Index, rows: list[tuple[int | None, str]], k: int) -> DataFrame:
    spark = index.segments.sparkSession
    bags = [{t.decode(): c for t, c in Counter(terms_of(text)).items()} for _, text in rows]
    used = spark.createDataFrame([(t,) for t in sorted({t for bag in bags for t in bag})], "term string")
    held = index.segments.select("m", "docs", F.explode(F.arrays_zip("terms", "df", "top")).alias("z")) \
        .select("m", F.col("z.terms").alias("term"), F.col("z.df").alias("df"), F.col("z.top").alias("top"))
    strata = cut(held.join(F.broadcast(used), "term").groupBy("m", "term").agg(F.sum("df").alias("df"), F.max("top").alias("top")), "lexical-strata")
    df = {r["term"]: r["df"] for r in strata.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # terms of this block
    weighed = [{t: c * weight(index.n_docs, df[t]) for t, c in bag.items() if t in df} for bag in bags]
    asked = spark.sparkContext.broadcast(weighed)
    pairs = [(t, q, w) for q, bag in enumerate(weighed) for t, w in bag.items() if w > 0]
    items = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(rows)], "q long, item_id long")
    if not pairs:
        return items.limit(0).selectExpr("item_id", "0 AS rank", "item_id AS doc_id", "item_id AS score")
    terms = spark.createDataFrame(pairs, "term string, q long, w long")
    best = F.expr("w * ((1000000000L * top) div (1000L * top + 12 * m))")  # what a document of the stratum can gain by the term
    bounds = strata.join(F.broadcast(terms), "term").groupBy("q", "m").agg(F.sum(best).alias("bound"))
    sizes = index.segments.groupBy("m").agg(F.sum("docs").alias("docs"))  # a row a stratum
    order = Window.partitionBy("q").orderBy(F.desc("bound"), "m").rowsBetween(Window.unboundedPreceding, -1)
    bounds = cut(bounds.join(sizes, "m").withColumn("before", F.coalesce(F.sum("docs").over(order), F.lit(0))), "lexical-bounds")

    early = bounds.filter(F.col("before") < FIRST_DOCS).select("m", "q", F.lit(1).cast("long").alias("floor"))
    first = cut(_best(_visited(index, early, asked, k), k).select("q", "score", "id", "rank"), "lexical-first")
    floors = first.filter(F.col("rank") == k).select("q", F.col("score").alias("floor"))  # a row a query
    rest = bounds.filter(F.col("before") >= FIRST_DOCS).join(F.broadcast(floors), "q", "left") \
        .select("m", "q", F.coalesce("floor", F.lit(1).cast("long")).alias("floor"), "bound").filter("bound >= floor")
    later = _visited(index, cut(rest.drop("bound"), "lexical-visits"), asked, k)
    found = _best(first.select("q", "score", "id").unionByName(later), k)
    return found.join(F.broadcast(items), "q").select("item_id", F.col("rank").cast("int"), F.col("id").alias("doc_id"), "score")
