"""The corpus pipeline: each stage is one of the operators, applied to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import cut, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the lexicon is learned from the labelled ones among `docs`."""
    from vellum.llm.toxicity import fit_documents, score
    model = fit_documents(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, out="__score").filter("__score < 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the least id."""
    from vellum.llm.simhash import keep_one
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    from vellum.llm.decontam import drop_contaminated
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens."""
    from vellum.llm.packing import pack_documents
    from vellum.llm.queries import tokenizer
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("simhash", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Tokenizers and learned weights have no SQL form; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs


REGISTRY = {"pipeline": (run, ORACLE_SQL)}
