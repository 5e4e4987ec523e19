"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification.

The alphabet is words. The CGK random walk reads a window word by word: at step
j it writes the word it stands on and goes on one word if bit j of that word's
random bits is set, so that few edits leave most of the written sequence as it
was: edit distance becomes Hamming distance. A repetition samples a few
positions of the sequence; windows of documents and items whose samples agree
are candidates, and the edit distance between item and text decides.

Items are indexed by length class, so that a window is no longer than the
class's items. Where the walks do not reach the target recall on copies of a
class's items with all edits allowed (short items), and for items too short for
an edit, candidates come from whole parts of the items instead: of k + 1 parts
one is left alone by k edits, so that none is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import mix, runs, text_words

CLASSES = (1, 5, 10, 15, 24, 40)  # least words of each length class
SIMILARITY = 0.8  # edit distance of at most a fifth of the item's words
STRIDE = 4  # document windows start at every fourth word, item windows at every word
STEPS = 24  # steps of a walk
SAMPLES = 5  # positions in a repetition
TARGET_RECALL = 0.95
DRAWN = 200  # items of a class, drawn at random, that the walks are chosen on
MAX_WALKS = 12
BLOCK_BYTES = 1 << 20  # benchmark text indexed, and broadcast, at a time; an index takes 128 to 768 bytes a word

def walk_keys(words: np.ndarray, starts: np.ndarray, seed: int, samples: list[list[int]]) -> list[np.ndarray]:
    """For each repetition, the hash of the sampled positions of the walks that begin at `starts`."""
    steps = 1 + max(map(max, samples))
    padded = np.concatenate((words, np.zeros(steps, np.uint64)))
    bits = mix(padded + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & (1 << 64) - 1))
    keys = [np.zeros(len(starts), np.uint64) for _ in samples]
    at = starts.astype(np.int64)
    for j in range(steps):
        here = bits[at]
        for key, positions in zip(keys, samples):
            if j in positions:
                key *= np.uint64(0x100000001B3)
                key ^= here
        at += ((here >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return [mix(k + np.uint64(r)) for r, k in enumerate(keys)]


def distance(item: list[int], text: list[int]) -> int:
    """Least edit distance of the item's words to any run of the text's words (bit-parallel)."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    up, down, score = mask, 0, m
    best = m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) & mask | eq
        ph = down | ~(xh | up) & mask
        mh = up & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        up = mh | ~(xv | ph) & mask
        down = ph & xv
        best = min(best, score)
    return best


@dataclass
class Index:
    """Item windows of one block of the benchmark, by key; what tasks get."""

    ids: list
    words: list[np.ndarray]
    seeds: list[int]
    samples: list[list[int]]  # of each walk the same
    stride: int
    similarity: float
    keys: np.ndarray = None  # sorted
    items: np.ndarray = None
    offsets: np.ndarray = None
    near: np.ndarray = None  # bitmap on the keys' upper bits

    def build(self) -> Index:
        keys, items, offsets = [], [], []
        for seed in self.seeds:
            for i, w in enumerate(self.words):
                starts = np.arange(max(1, len(w) - self._reach() + 1))
                for k in walk_keys(w, starts, seed, self.samples):
                    keys.append(k)
                    items.append(np.full(len(starts), i, np.int32))
                    offsets.append(starts.astype(np.int32))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        by = np.argsort(keys, kind="stable")
        self.keys = keys[by]
        self.items = np.concatenate(items)[by] if items else np.zeros(0, np.int32)
        self.offsets = np.concatenate(offsets)[by] if offsets else np.zeros(0, np.int32)
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        return self

    def _reach(self) -> int:
        """Words that the shortest repetition may read."""
        return 1 + min(max(s) for s in self.samples)

    def _keys(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, keys) of a text's windows, for each repetition."""
        starts = np.arange(0, len(words), self.stride)
        for seed in self.seeds:
            for k in walk_keys(words, starts, seed, self.samples):
                yield starts, k

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, word at which the item would begin), distinct, for one run of words."""
        found_i, found_at = [], []
        for starts, k in self._keys(words):
            some = np.flatnonzero(self.near[(k >> np.uint64(44)).astype(np.int64)])
            if not len(some):
                continue
            low = np.searchsorted(self.keys, k[some], "left")
            n = np.searchsorted(self.keys, k[some], "right") - low
            hit = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            found_i.append(self.items[hit].astype(np.int64))
            found_at.append(np.repeat(starts[some], n) - self.offsets[hit])
        if not found_i:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(found_i), np.concatenate(found_at)]), axis=1)
        return pairs[0], pairs[1]

    def verified(self, words: np.ndarray, firsts: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (least edit distance, word of the text at which the match is) for texts that begin at `firsts`."""
        item, at = self.candidates(words)
        # a window may begin before its item does, in the text before: the text is the one where the item's middle lies
        best: dict[tuple[int, int], tuple[int, int]] = {}
        stops = np.append(firsts[1:], len(words))
        last: dict[tuple[int, int], int] = {}
        half = np.array([len(w) // 2 for w in self.words], np.int64)
        docs = np.searchsorted(firsts, np.clip(at + half[item], 0, max(0, len(words) - 1)), "right") - 1 if len(item) else item
        for i, a, d in zip(item.tolist(), at.tolist(), docs.tolist()):
            key, w = (d, i), self.words[i]
            allowed = allowed_edits(len(w), self.similarity)
            slack = allowed + self.stride
            got = best.get(key)
            if got and (got[0] == 0 or a - last[key] <= slack):
                continue  # the text around it is verified already
            lo, hi = max(int(firsts[d]), a - 2 * slack), min(int(stops[d]), a + len(w) + 2 * slack)
            k = distance(w.tolist(), words[lo:hi].tolist())
            if k <= allowed:
                last[key] = a
                if not got or k < got[0]:
                    best[key] = k, max(0, a - int(firsts[d]))
        return best


def sample_positions(shortest: int, seed: int = 7) -> tuple[int, list[list[int]]]:
    """Stride and sampled positions for items of `shortest` words or more.

    The first repetition reads only as far as a window of the shortest item
    reaches past the stride, so that unedited copies are always found.
    """
    stride = max(1, min(STRIDE, shortest // 4))
    early = min(STEPS, max(1, shortest - stride + 1))
    rng = np.random.default_rng(seed)

    def pick(n: int) -> list[int]:
        """One position from each of equal parts of the first n steps: neighbours often read the same word."""
        edges = np.linspace(0, n, min(n, SAMPLES) + 1).astype(int)
        return sorted({int(rng.integers(a, b)) for a, b in zip(edges, edges[1:])})

    return stride, [pick(early), pick(early), pick(max(early, STEPS * 2 // 3)), pick(max(early, STEPS))]


class Parts(Index):
    """Items cut into one part more than the edits allowed, by the hash of each part: no copy within them is missed."""

    def build(self) -> Parts:
        keys, items, offsets, sizes = [], [], [], []
        for i, w in enumerate(self.words):
            edges = np.linspace(0, len(w), allowed_edits(len(w), self.similarity) + 2).astype(int)
            for a, b in zip(edges, edges[1:]):
                keys.append(_run_keys(w[a:b], int(b - a))[0])
                items.append(i)
                offsets.append(a)
                sizes.append(b - a)
        by = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[by]
        self.items, self.offsets = np.array(items, np.int32)[by], np.array(offsets, np.int32)[by]
        self.samples = sorted(set(map(int, sizes)))  # lengths of parts
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        return self

    def _keys(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in self.samples:
            if len(words) >= n:
                yield np.arange(len(words) - n + 1), _run_keys(words, n)


def _run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words, and of n."""
    key = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        key = mix(key * np.uint64(0x100000001B3) ^ words[j:len(words) - n + 1 + j])
    return key


def allowed_edits(n: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy in which so many words, drawn at random, are each replaced, left out or followed by another word."""
    where = set(rng.choice(len(words), min(edits, len(words)), replace=False).tolist())
    out = []
    for i, w in enumerate(words.tolist()):
        other, kind = int(rng.integers(1, 1 << 62)), int(rng.integers(3))
        out += [w] if i not in where else ([other], [], [w, other])[kind]
    return np.array(out, np.uint64)


def recall(index: Index, items: list[int], seed: int = 11) -> float:
    """The share of copies of some items, with all edits allowed, that the index finds in random text."""
    rng = np.random.default_rng(seed)
    found = due = 0
    for i in items:
        w = index.words[i]
        copy = edited(w, allowed_edits(len(w), index.similarity), rng)
        noise = rng.integers(1, 1 << 62, 40 + int(rng.integers(0, 8)), np.int64).astype(np.uint64)
        text = np.concatenate((noise, copy, noise))
        due += 1
        found += (0, i) in index.verified(text, np.zeros(1, np.int64))
    return found / max(1, due)


def class_index(words: list[np.ndarray], similarity: float = SIMILARITY, target: float = TARGET_RECALL) -> Index:
    """Index of one length class: the fewest walks that reach the target on items drawn at random, else parts."""
    stride, samples = sample_positions(min(map(len, words)))
    drawn = np.random.default_rng(5).permutation(len(words))[:DRAWN].tolist()
    if allowed_edits(min(map(len, words)), similarity):
        some = [words[i] for i in drawn]
        for n in range(2, MAX_WALKS + 1, 2):
            trial = Index(list(range(len(some))), some, list(range(n)), samples, stride, similarity).build()
            if recall(trial, list(range(len(some)))) >= target:
                return Index(list(range(len(words))), words, list(range(n)), samples, stride, similarity).build()
    return Parts(list(range(len(words))), words, [], [], 1, similarity).build()


@dataclass
class Classes:
    """The indexes of all length classes of one block of the benchmark."""

    ids: list
    words: list[np.ndarray]
    parts: list[tuple[np.ndarray, Index]]  # the items of each class, and their index

    def verified(self, words: np.ndarray, firsts: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(text, item) -> (least edit distance, word of the text at which the match is) for texts that begin at `firsts`."""
        return {(d, int(items[i])): v for items, index in self.parts for (d, i), v in index.verified(words, firsts).items()}


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = -(-size // block_bytes)
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i) for i in range(n)]


def benchmark_index(rows: list, similarity: float = SIMILARITY) -> Classes | None:
    words = [text_words(r["text"]) for r in rows]
    keep = [i for i, w in enumerate(words) if len(w)]
    if not keep:
        return None
    words = [words[i] for i in keep]
    sizes = np.searchsorted(CLASSES, [len(w) for w in words], "right")
    parts = []
    for c in np.unique(sizes):
        items = np.flatnonzero(sizes == c)
        parts.append((items, class_index([words[i] for i in items], similarity)))
    return Classes([rows[i]["item_id"] for i in keep], words, parts)


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, item_words, similarity, word_at): one row per document row and item that it holds.

    A document holds an item if some run of its words is within
    floor((1 - similarity) x item words) word edits of the item; the least
    distance found is returned. Words are runs of letters and digits, case
    apart (ASCII and Latin-1). Items below five words allow no edit and are
    found exactly; items without a word are not searched; null texts hold
    nothing; null ids are returned as they are; repeated rows give repeated
    results; an empty table of documents or items gives no rows. The benchmark
    is indexed and broadcast in blocks of at most about `block_bytes` of text,
    all documents against each block. Unedited copies are always found, edited
    ones at TARGET_RECALL in every length class (`class_index`).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, item_words int, similarity double, word_at long"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        index = benchmark_index(sorted(block.collect(), key=lambda r: (r["text"], str(r["item_id"]))), similarity)
        if index is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                found = []
                for row, words, firsts in runs(batch.column("text")):
                    for (d, i), (k, at) in index.verified(words, firsts).items():
                        n = len(index.words[i])
                        found.append((row + d, index.ids[i], k, n, 1 - k / n, at))
                if found:
                    r, items, *rest = zip(*found)
                    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(r)), pa.array(items), *[pa.array(c, t) for c, t in zip(rest, kinds)]],
                        ["doc_id", "item_id", "distance", "item_words", "similarity", "word_at"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text holds a benchmark item; rows are judged by their own id and text, null ids included."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    bad = find_items(docs.withColumn("__key", key), benchmark, "__key", text_col).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.withColumn("__key", key).join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")
