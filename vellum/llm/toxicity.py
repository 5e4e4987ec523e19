"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton on folded text.

Folding lower-cases, strips marks, maps look-alike letters to Latin ones and
reads digits and signs inside words as letters. Lexicon entries are words and
word beginnings with log-odds weights learned from labelled rows; a word counts
with its heaviest entry, unless an exception phrase covers it. Sums are
normalised by the text's length and calibrated by a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from vellum.llm.common import cut, without

# Look-alike letters (Greek, Cyrillic and others) and the Latin letters they stand for.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l", "ø": "o", "đ": "d", "ł": "l",
}
# Digits and signs written for letters.
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

PREFIX = range(4, 11)  # lengths of word beginnings that may enter the lexicon
MAX_WORD = 40
MIN_DOCS = 8  # toxic documents that an entry occurs in, at least
MIN_Z = 4.0  # log-odds over its standard error
MIN_ODDS = 0.5  # log-odds, at least, however many documents make a smaller value firm
MAX_MODEL_BYTES = 8 << 20  # entries, weights and exceptions, which are broadcast; a larger model is an error
BROADCAST_LABELS = 1_000_000  # (id, label) rows of 64 bytes or less each
FIT_ROWS = 20_000  # labelled rows that the logistic curve is fitted on

_LOOK = str.maketrans(LOOK_ALIKES)
_WRITTEN = str.maketrans(WRITTEN_FOR)
_SUBSTITUTED = re.compile(r"[013457@$]+(?=[a-z])|(?<=[a-z])[013457]+(?![0-9a-z])")
_MARKS = re.compile("[\\u0300-\\u036f\\u200b-\\u200f\\u2060\\ufeff]+")
_BREAK = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words of a text, each with a space on both sides; a null text counts as empty."""
    s = (text or "").lower()
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFKD", s))
        if not s.isascii():
            s = s.translate(_LOOK)
    s = _SUBSTITUTED.sub(lambda m: m.group().translate(_WRITTEN), s)
    return f" {_BREAK.sub(' ', s).strip()} "


@dataclass
class Model:
    """Entries start with a space; those that end with one are whole words, the others word beginnings."""

    entries: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    curve: list[float] = field(default_factory=lambda: [-4.0, 2.0, 1.0, 1.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton:
        auto = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            auto.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            auto.add_word(phrase, (len(phrase), None))
        if len(auto):
            auto.make_automaton()
        return auto


def matched(auto: ahocorasick.Automaton, folded: str) -> dict[int, float]:
    """Start of each matched word (the space before it) and its heaviest weight, without those that exceptions cover."""
    found: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    if len(auto):
        for end, (n, weight) in auto.iter(folded):
            at = end - n + 1
            if weight is None:
                covered.append((at, end))
            elif weight > found.get(at, 0.0):
                found[at] = weight
    for a, b in covered:
        at = a
        while 0 <= at < b:  # the words of the phrase
            found.pop(at, None)
            at = folded.find(" ", at + 1, b)
    return found


def features(auto: ahocorasick.Automaton, text: str | None) -> tuple[float, float, float, float]:
    """Log of the matched weight, of that weight in 100 words, the heaviest word, log of the matches."""
    folded = fold(text)
    found = matched(auto, folded)
    if not found:
        return 0.0, 0.0, 0.0, 0.0
    total, words = sum(found.values()), folded.count(" ") - 1
    return math.log1p(total), math.log1p(100 * total / words), max(found.values()), math.log1p(len(found))


def _curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a slight ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _bounded(rows: DataFrame, key: str, used: int, name: str) -> list[Row]:
    """All rows, in order of `key`; an error if they and `used` bytes are over MAX_MODEL_BYTES."""
    rows = cut(rows, name)
    size = used + (rows.agg(F.sum(F.octet_length(key) + 8)).first()[0] or 0)
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"the toxicity model would be {size} bytes and is broadcast with at most {MAX_MODEL_BYTES}; raise MIN_Z, MIN_ODDS or MIN_DOCS")
    return sorted(rows.collect(), key=lambda r: r[key])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn entries, exceptions and the curve from labelled rows (label 0 or 1; rows with other labels do not count).

    Words are counted by document over all labelled rows, beginnings are summed
    from the words' counts, and all entries of firm and large log-odds stay but
    those no heavier than a shorter one that they begin with, which never count.
    An exception is a matched word with the word before or after it that clean
    documents use at least as readily as toxic ones; all of them stay. A model
    over MAX_MODEL_BYTES raises ValueError. The curve is fitted on FIT_ROWS rows
    of the least text hash. Without labels of both kinds the model knows no
    entries.
    """
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            seen = [Counter(), Counter()]
            for text, y in zip(t["text"], t["y"]):
                seen[y].update(w for w in set(fold(text).split()) if len(w) <= MAX_WORD)
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": keys, "c1": [seen[1][k] for k in keys], "c0": [seen[0][k] for k in keys]})

    counted = cut(rows.mapInPandas(words, "word string, c1 long, c0 long").groupBy("word")
                  .agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")), "toxic-words")
    n = counted.agg(F.coalesce(F.sum("c1"), F.lit(0)).alias("n1"), F.coalesce(F.sum("c0"), F.lit(0)).alias("n0")).first()
    if not n["n1"] or not n["n0"]:
        return Model({})
    begins = F.transform(F.filter(F.array(*[F.lit(k) for k in PREFIX]), lambda k: k <= F.length("word")),
                         lambda k: F.concat(F.lit(" "), F.col("word").substr(F.lit(1), k)))
    entries = counted.select(F.explode(F.concat(begins, F.array(F.concat(F.lit(" "), "word", F.lit(" "))))).alias("entry"), "c1", "c0") \
        .groupBy("entry").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    odds: Column = F.log((F.col("c1") + 0.5) / n["n1"]) - F.log((F.col("c0") + 0.5) / n["n0"])
    firm = odds / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    passing = cut(entries.filter(F.col("c1") >= MIN_DOCS).select("entry", odds.alias("w"), firm.alias("z"))
                  .filter((F.col("z") >= MIN_Z) & (F.col("w") >= MIN_ODDS)).select("entry", "w"), "toxic-entries")
    shorter = F.transform(F.filter(F.array(*[F.lit(k + 1) for k in PREFIX]), lambda k: k < F.length("entry")), lambda k: F.col("entry").substr(F.lit(1), k))
    # a word counts with its heaviest entry, and an entry's beginnings match wherever it does
    idle = (passing.select(F.explode(shorter).alias("begin"), F.col("entry").alias("long"), F.col("w").alias("v"))
            .join(passing, F.col("begin") == F.col("entry")).filter("v <= w").select(F.col("long").alias("entry")).distinct())
    best = _bounded(passing.join(idle, "entry", "left_anti"), "entry", 0, "toxic-lexicon")
    model = Model({r["entry"]: float(r["w"]) for r in best})
    if not model.entries:
        return model

    spark = labelled.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = sent.value.automaton()
        for t in batches:
            seen = [Counter(), Counter()]
            for text, y in zip(t["text"], t["y"]):
                folded, got = fold(text), set()
                for at in matched(auto, folded):
                    stop = folded.index(" ", at + 1)
                    before = folded.rfind(" ", 0, at) if at else -1
                    after = folded.find(" ", stop + 1)
                    got.update(folded[a:b + 1] for a, b in ((before, stop), (at, after)) if a >= 0 and b > 0 and b - a <= 2 * MAX_WORD)
                seen[y].update(got)
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"phrase": keys, "c1": [seen[1][k] for k in keys], "c0": [seen[0][k] for k in keys]})

    found = (rows.mapInPandas(phrases, "phrase string, c1 long, c0 long").groupBy("phrase").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
             .filter(F.col("c0") >= MIN_DOCS).withColumn("w", odds).filter("w <= 0").select("phrase", "w"))
    found = _bounded(found, "phrase", sum(len(e.encode()) + 8 for e in model.entries), "toxic-exceptions")
    model.exceptions = {r["phrase"] for r in found}

    # by hash, with a margin, before the texts are read; the narrow measures decide who is in
    share = min(1.0, 1.3 * FIT_ROWS / max(1, rows.count()))
    at = F.pmod(F.xxhash64("text", "y"), F.lit(1 << 30))
    sample = rows.withColumn("h", at).filter(F.col("h") <= int(share * (1 << 30)))
    sent2 = spark.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = sent2.value.automaton()
        for t in batches:
            yield pd.DataFrame([(*features(auto, text), y, h) for text, y, h in zip(t["text"], t["y"], t["h"])],
                               columns=["a", "b", "c", "d", "y", "h"])

    taken = sample.mapInPandas(measured, "a double, b double, c double, d double, y double, h long") \
        .orderBy("h", "y", "a", "b", "c", "d").limit(FIT_ROWS).drop("h").collect()
    got = np.array([tuple(r) for r in taken])
    if len(got) and 0 < got[:, 4].sum() < len(got):
        got = got[np.lexsort(got.T)]  # the same sums whatever order the rows came in
        model.curve = _curve(got[:, :4], got[:, 4])
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`df` with a score from 0 to 1 of the whole text; null and empty texts score as texts without matches.

    Other columns are not read; an input column of the name `out` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        auto, w = model.automaton(), model.curve
        for texts in batches:
            z = [w[0] + sum(a * b for a, b in zip(w[1:], features(auto, t))) for t in texts]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z])

    return without(df, out).withColumn(out, scored(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 5 is 0; a null id is held out as well."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Model of the documents' labelled rows that are not held out; of several labels of an id the highest counts.

    Labels go to the texts by broadcast while they are few, else the labelled
    rows are stored once for the passes over them.
    """
    known = labels.filter(~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    texts = docs.select(id_col, "text")
    if known.count() <= BROADCAST_LABELS:
        return fit(texts.join(F.broadcast(known), id_col), "text", label_col)
    return fit(cut(texts.join(known, id_col), "toxic-labelled"), "text", label_col)
