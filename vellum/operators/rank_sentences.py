"""H11 by sentence ranking: a summary that takes a sentence from every chunk.

A word weighs its count in the document times its rarity over all documents; a
sentence scores the mean weight of its distinct words.  Each chunk gives its
best sentence, in the text's order.  All in whole numbers, so that any engine
ranks alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.chunk import CHUNK_SIZE, chunk_text
from vellum.functions.text import js_trim
from vellum.llm.common import cut
from vellum.session import parts_for

SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"
WORD = r"[\p{L}\p{N}]+"
#: Words that this share of the documents hold have their rarity broadcast: a hundred documents' words at most.
FREQUENT = 0.01
#: Words whose rarity is broadcast whole at most; bytes of text whose sentences and words a task holds, about.
MAX_WORDS = 500_000
TASK_BYTES = 4 << 20


def sentences(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE) -> DataFrame:
    """(id, chunk, pos, sentence) of every chunk's sentences, blank ones left out."""
    chunks = docs.select(F.col(id_col).alias("id"), F.posexplode(chunk_text(F.col(text_col), size)).alias("chunk", "piece"))
    cut = chunks.select("id", "chunk", F.posexplode(F.regexp_extract_all("piece", F.lit(f"({SENTENCE})"), F.lit(1))).alias("pos", "sentence"))
    return cut.withColumn("sentence", js_trim(F.col("sentence"))).where("sentence <> ''")


def rarities(words: DataFrame, n_docs: int) -> DataFrame:
    """(word, df, rarity) of `words` (id, word): floor(1000 ln((n + 1) / (df + 1))), a stored table."""
    df = words.distinct().groupBy("word").agg(F.count("*").alias("df"))
    return cut(df.select("word", "df", F.floor(1000 * F.log((F.lit(n_docs) + 1) / (F.col("df") + 1))).cast("long").alias("rarity")), "word-rarity")


def with_rarity(rows: DataFrame, rarity: DataFrame, n_docs: int) -> DataFrame:
    """`rows` (word) with its rarity, null without a word: by broadcast while the table is small, else that of frequent words alone."""
    if rarity.count() <= MAX_WORDS:
        return rows.join(F.broadcast(rarity.drop("df")), "word", "left")
    often = F.col("df") >= max(2.0, FREQUENT * n_docs)
    common, rare = rarity.where(often).drop("df"), rarity.where(~often).drop("df")
    left = rows.join(F.broadcast(common.select("word")), "word", "left_anti").join(rare, "word", "left")
    return rows.join(F.broadcast(common), "word").unionByName(left)


def ranked_summaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_SIZE) -> DataFrame:
    """(id, summary) of every document that has a sentence: the best of each chunk, ties to the earlier one.

    Ids must be unique. Sentences without a word score 0. Null and blank texts
    have no row. Rarity counts all documents of `docs`. Sentences are dealt by
    document once, over as many tasks as the texts' bytes ask for; counts and
    scores are windows and aggregates over that.
    """
    n_docs = docs.count()
    parts = parts_for(docs, text_col, TASK_BYTES)
    told = cut(sentences(docs.select(id_col, text_col).repartition(parts, id_col), id_col, text_col, size), "sentences")
    found = F.regexp_extract_all(F.lower("sentence"), F.lit(f"({WORD})"), F.lit(1))
    words = told.select("id", "chunk", "pos", found.alias("words")).repartition(parts, "id").select("id", "chunk", "pos", F.explode_outer("words").alias("word"))
    rarity = rarities(told.select("id", F.explode(F.array_distinct(found)).alias("word")), n_docs)
    # a row for each sentence and word of it; a sentence without words has one without a word
    each = words.groupBy("id", "chunk", "pos", "word").agg(F.count("word").alias("n"))
    each = each.withColumn("tf", F.sum("n").over(Window.partitionBy("id", "word")))
    scored = with_rarity(each, rarity, n_docs).groupBy("id", "chunk", "pos").agg(F.expr("sum(tf * rarity)").alias("sum"), F.count("word").alias("n"))
    score = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.expr("sum div n")).otherwise(0)
    best = scored.groupBy("id", "chunk").agg(F.min_by("pos", F.struct(-score, "pos")).alias("pos"))
    key = F.struct("id", "chunk", "pos")  # null ids meet as well
    picked = told.join(best.select(key.alias("key")), key == F.col("key"), "left_semi")
    picked = picked.groupBy("id", "chunk").agg(F.min("sentence").alias("sentence"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "sentence")))
    return picked.groupBy(F.col("id").alias(id_col)).agg(F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ").alias("summary"))
