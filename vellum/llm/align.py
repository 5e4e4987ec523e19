"""Alignment of two tokenizers' tokens by their byte ranges, over distinct texts.

Texts are shuffled by their whole content, so that each distinct one is
tokenised and aligned once; what it adds to the counts of id pairs is weighted
by its copies, and its measures go back to all documents that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, hot_join
from vellum.llm.tokens import byte_letters, encoder, in_chunks

HOT_PAIRS = 1 << 20  # id pairs that are broadcast at most (17 bytes each); rarer ones are joined by a shuffle
CHARS = 1 << 20  # characters that a worker aligns at a time, about
TOKENS = 1 << 20

_PAIRS: dict = {}


class Pair:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = encoder(path_a, plain_specials=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        entries = {i: t for t, i in self.a.lib.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters.get(c, 0) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.len_a = np.array([len(t) for t in self.bytes_a])
        self.len_b = np.array([len(t) for t in self.bytes_b])
        self.digits = _digits(max(len(self.bytes_a), len(self.bytes_b)))

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; none where a side's bytes are not those of space and text."""
        if not text:
            return [], []
        a, b = self.a.ids(" " + text).tolist(), self.b.encode(text, num_threads=1)
        want = b" " + text.encode()
        if b"".join([self.bytes_a[i] for i in a]) != want or b"".join([self.bytes_b[i] for i in b]) != want:
            return [], []
        return a, b


def pair(path_a: str, path_b: str) -> Pair:
    """This worker's tokenizers."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n-1 as bytes, padded by zeros to a common width with room for one more."""
    out = np.zeros((n, len(str(n)) + 1), np.uint8)
    for i in range(n):
        s = str(i).encode()
        out[i, :len(s)] = list(s)
    return out


class Aligned:
    """Ends, groups and links of texts that lie one after the other; each text's two sides are as long in bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a.astype(np.int64), b.astype(np.int64), n_a, n_b
        self.end_a, self.end_b = np.cumsum(len_a[self.a]), np.cumsum(len_b[self.b])
        size = int(self.end_a[-1]) if len(a) else 0
        is_a, is_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        is_a[self.end_a] = is_b[self.end_b] = True
        self.common = is_a & is_b
        ends = np.flatnonzero(is_a | is_b)  # between two ends of either side lies what one token of each side shares
        self.link_a, self.link_b = np.cumsum(is_a)[ends - 1], np.cumsum(is_b)[ends - 1]
        self.text = np.repeat(np.arange(len(n_a)), n_a)[self.link_a]  # of each link

    def groups(self) -> np.ndarray:
        """The number of groups of each text."""
        return np.bincount(np.repeat(np.arange(len(self.n_a)), self.n_a)[self.common[self.end_a]], minlength=len(self.n_a))

    def written(self, digits: np.ndarray) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        before = np.cumsum(self.common)
        group_a, group_b = before[self.end_a - 1], before[self.end_b - 1]
        n = int(before[-1]) if len(self.a) else 0
        a_in, b_in = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        at_a = np.arange(len(self.a)) + (np.cumsum(b_in) - b_in)[group_a]
        at_b = np.arange(len(self.b)) + np.cumsum(a_in)[group_b]
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a] = np.where(self.common[self.end_a], ord("|"), ord(","))
        mark[at_b] = np.where(self.common[self.end_b], ord(";"), ord(","))
        cells = digits[ids]
        width = (cells != 0).sum(axis=1)
        cells[np.arange(len(ids)), width] = mark
        raw = cells.ravel()
        raw = raw[raw != 0].tobytes()
        stops = np.concatenate(([0], np.cumsum(width + 1)))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        return [raw[s:max(s, e - 1)] for s, e in zip(stops[:-1].tolist(), stops[1:].tolist())]

    def pairs(self, vocab_b: int) -> np.ndarray:
        """The id pair of every link as one number."""
        return self.a[self.link_a] * vocab_b + self.b[self.link_b]


def _aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Stored table of the distinct texts (digest, copies, text): ids of both sides and what needs no counts."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        kind_b = "<u2" if len(both.bytes_b) <= 1 << 16 else "<u4"
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in in_chunks(texts, CHARS):
                ids = [both.encode(t) for t in texts[i:j]]
                a, b = [np.array(x, both.a.dtype) for x, _ in ids], [np.array(y, kind_b) for _, y in ids]
                n_a, n_b = np.array([len(x) for x in a]), np.array([len(y) for y in b])
                al = Aligned(np.concatenate(a), np.concatenate(b), n_a, n_b, both.len_a, both.len_b)
                sums = [hashlib.sha256(w).hexdigest() if n else "" for w, n in zip(al.written(both.digits), n_a.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "digest": batch.column("digest").slice(i, j - i), "copies": batch.column("copies").slice(i, j - i),
                    "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(al.groups()),
                    "n_links": pa.array(np.bincount(al.text, minlength=j - i)), "groups_sha256": pa.array(sums, pa.string()),
                    "a": pa.array([x.tobytes() for x in a], pa.binary()), "b": pa.array([y.tobytes() for y in b], pa.binary())})

    return cut(texts.mapInArrow(align, "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                       "a binary, b binary"), "align-texts")


def _links(batch: pa.RecordBatch, both: Pair) -> Iterator[tuple[int, int, Aligned]]:
    """(first row, row after the last, alignment) of about TOKENS tokens at a time, from stored ids."""
    n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
    total, at = np.cumsum(n_a + n_b), 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOKENS, "right")))
        a, b = (b"".join(batch.column(c).slice(at, stop - at).to_pylist()) for c in ("a", "b"))
        ids_a, ids_b = (np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, np.int64)
                        for raw, n in ((a, int(n_a[at:stop].sum())), (b, int(n_b[at:stop].sum()))))
        yield at, stop, Aligned(ids_a, ids_b, n_a[at:stop], n_b[at:stop], both.len_a, both.len_b)
        at = stop


def _pair_counts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Stored table (pair, a, n, top): the documents that hold a pair linked, and whether that is the most of its A id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        space = len(both.bytes_a) * len(both.bytes_b)
        held, have = [], 0

        def summed() -> pa.RecordBatch:
            pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, where, np.concatenate([c for _, c in held]))
            return pa.RecordBatch.from_pydict({"pair": pairs, "n": n})

        for batch in batches:
            for i, j, al in _links(batch, both):
                once = np.unique(al.text * space + al.pairs(len(both.bytes_b)))  # a document counts once
                held.append((once % space, batch.column("copies").slice(i, j - i).to_numpy()[once // space]))
                have += len(once)
            if have > 4 * TOKENS:
                yield summed()
                held, have = [], 0
        if held:
            yield summed()

    vocab_b = len(pair(path_a, path_b).bytes_b)
    counted = texts.filter("n_a > 0").select("copies", "n_a", "n_b", "a", "b").mapInArrow(count, "pair long, n long") \
        .groupBy("pair").agg(F.sum("n").alias("n"))
    counted = cut(counted.withColumn("a", F.expr(f"pair div {vocab_b}")), "align-counts")
    best = counted.groupBy("a").agg(F.max("n").alias("most"))  # a row for each entry of A's vocabulary at most
    return cut(counted.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top")), "align-pairs")


def _least_hot(pairs: DataFrame, hot_pairs: int) -> int:
    """The least power of two such that `hot_pairs` pairs at most have that count."""
    sizes = {int(r["p"]): r["count"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()}  # 64 rows at most
    have, least = 0, 63
    while least > 0 and have + sizes.get(least - 1, 0) <= hot_pairs:
        least -= 1
        have += sizes.get(least, 0)
    return 1 << least


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`.

    A is a byte-level file of the tokenizers library and reads space and text, B
    a sentencepiece model that adds the space itself; special tokens' strings
    are plain text. Bytes where tokens of both sides end cut them into groups;
    every overlapping pair of tokens is a link. An id pair's count is the number
    of documents that hold it linked, repeated rows included. Null and empty
    texts, and texts whose bytes a side does not keep, have no tokens: zeros and
    ''. Repeated rows and rows without an id are documents of their own. An
    empty table gives no rows. Other columns are not read.

    Pairs with the highest counts, HOT_PAIRS at most, are broadcast; the others
    are joined by a shuffle in which none is frequent.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.length(text_col) > 0, F.col(text_col)).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    distinct = rows.filter("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("copies"))
    texts = _aligned_texts(distinct.select(digest.alias("digest"), "copies", "text"), path_a, path_b)
    pairs = _pair_counts(texts, path_a, path_b)
    least = _least_hot(pairs, hot_pairs)
    hot = pairs.filter(F.col("n") >= least).orderBy("pair").toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64), hot["top"].to_numpy(bool)))
    n_all = pairs.count()
    rare = n_all > len(hot)

    def known(al: Aligned, vocab_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = sent.value[0]
        found = al.pairs(vocab_b)
        at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
        return found, at, keys[at] == found if len(keys) else np.zeros(len(found), bool)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        _, n, top = sent.value
        for batch in batches:
            for i, j, al in _links(batch, both):
                _, at, hit = known(al, len(both.bytes_b))
                total, best = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                np.add.at(total, al.text[hit], n[at[hit]])
                np.add.at(best, al.text[hit], top[at[hit]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), pa.array(best), pa.array(total)],
                                                 names=[*kept, "n_best", "count_sum"])

    def leftover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        space = len(both.bytes_a) * len(both.bytes_b)
        for batch in batches:
            for i, j, al in _links(batch, both):
                found, _, hit = known(al, len(both.bytes_b))
                keys, times = np.unique(al.text[~hit] * space + found[~hit], return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(i, j - i).take(pa.array(keys // space)),
                                                  pa.array(keys % space), pa.array(times)], names=["digest", "pair", "times"])

    kept = ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    types = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    measured = texts.mapInArrow(measure, types)
    if rare:
        seldom = texts.select("digest", "n_a", "n_b", "a", "b").mapInArrow(leftover, "digest binary, pair long, times long") \
            .join(pairs.filter(F.col("n") < least), "pair") \
            .groupBy("digest").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("tops"))
        measured = measured.join(seldom, "digest", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("tops", F.lit(0))}).drop("more", "tops")
    measured = cut(measured.withColumnRenamed("copies", "__n"), "align-measures")

    out = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    held = rows.filter("text IS NOT NULL").select("doc_id", digest.alias("digest"))
    total = measured.agg(F.sum("__n")).first()[0] or 0
    zeros = rows.filter("text IS NULL").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in out], F.lit("").alias("groups_sha256"))
    return hot_join(held, measured, "digest", total).select("doc_id", *out, "groups_sha256").unionByName(zeros)
