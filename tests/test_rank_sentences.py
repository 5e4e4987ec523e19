"""Sentence ranking against a plain version; frequent words; messy texts."""

import math
import re
from collections import Counter


def brute(docs, size):
    """Best sentence of every chunk, for texts without a chunk that breaks inside a word."""
    words = {i: re.findall(r"[a-z0-9]+", (t or "").lower()) for i, t in docs}
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for i, t in docs:
        tf, best = Counter(words[i]), []
        for s in [x.strip() for x in re.findall(r"[^.!?]*[.!?]+|[^.!?]+", t or "") if x.strip()]:
            ws = set(re.findall(r"[a-z0-9]+", s.lower()))
            total = sum(tf[w] * math.floor(1000 * math.log((len(docs) + 1) / (df[w] + 1))) for w in ws)
            best.append((total // len(ws) if ws else 0, s))
        if best:
            out[i] = max(best, key=lambda b: b[0])[1]  # the first of equals
    return out


def test_ranked_summaries_by_brute_force(spark):
    from vellum.operators.rank_sentences import ranked_summaries
    docs = [(i, f"the start number {i}. Rare{i} rare{i} word here! the the the? tail {i % 3}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, " \n "), (103, "..."), (104, "one sentence only"), (105, "Same. Same. Same.")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, summary string").repartition(4)
    got = {r["doc_id"]: r["summary"] for r in ranked_summaries(df).collect()}
    assert got == brute(docs, 4000)
    assert ranked_summaries(df.limit(0)).count() == 0


def test_every_chunk_gives_a_sentence(spark):
    from pyspark.sql import functions as F
    from vellum.functions.chunk import chunk_text
    from vellum.operators.rank_sentences import ranked_summaries
    text = " ".join(f"Part {i} speaks of topic{i} and topic{i}." + " filler the words." * 10 for i in range(12))
    df = spark.createDataFrame([(1, text), (2, "filler the words.")], "doc_id long, text string")
    whole = ranked_summaries(df, size=600).where("doc_id = 1").first()["summary"]
    chunks = df.where("doc_id = 1").select(chunk_text(F.col("text"), 600).alias("c")).first()["c"]
    picked = re.findall(r"[^.]+\.", whole)
    assert len(chunks) > 3 and len(picked) == len(chunks)
    assert all(p.strip() in c for p, c in zip(picked, chunks)) and sum("topic" in p for p in picked) >= len(chunks) - 1


def test_rare_words_by_shuffle_give_the_same(spark, monkeypatch):
    from vellum.operators import rank_sentences
    docs = [(i, f"the start number {i}. Rare{i} rare{i} word here! the the the? ... tail {i % 3}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda: sorted(map(tuple, rank_sentences.ranked_summaries(df).collect()))
    whole = key()
    monkeypatch.setattr(rank_sentences, "MAX_WORDS", 0)
    assert key() == whole and dict(whole) == brute(docs, 4000)


def test_words_are_dealt_by_the_bytes_of_the_texts(spark, monkeypatch):
    """Tasks grow in number with the texts, not in size."""
    from vellum.session import parts_for
    df = spark.range(50).selectExpr("id", "repeat('ab', 1000) AS text")
    assert parts_for(df, "text", 1000) == 100 and parts_for(df, "text", 1 << 30) == int(spark.conf.get("spark.sql.shuffle.partitions"))
