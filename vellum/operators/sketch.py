"""A3 approximately: distinct urls as mergeable HyperLogLog sketches.

A snapshot, or a batch of changes, is one small sketch per group (about 16 KB);
sketches are united, never the urls, so that a count over years of batches
reads a row for each.  A url that several batches hold counts once.  Deletions
need the exact form (`dedupe.distinct_urls`).
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2^LG_K registers; the standard error of an estimate is about 1.04 / sqrt(2^LG_K), 0.8 %.
LG_K = 14
STANDARD_ERROR = 1.04 / math.sqrt(1 << LG_K)


def url_sketches(df: DataFrame, by: list[str], url_col: str = "url") -> DataFrame:
    """(*by, sketch): the distinct non-empty urls of each group; a partial aggregate, so no group meets in one task.

    Null and empty urls do not count. A group without any has an empty sketch.
    """
    url = F.when(F.col(url_col) != "", F.col(url_col))
    return df.groupBy(*by).agg(F.hll_sketch_agg(url, LG_K).alias("sketch"))


def united(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(*by, sketch): one sketch a group of all its sketches."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """The sketches' estimated counts as `n_urls`."""
    return sketches.withColumn("n_urls", F.hll_sketch_estimate("sketch")).drop("sketch")


def add_batch(df: DataFrame, root: str, batch_id: int, by: list[str], url_col: str = "url") -> None:
    """Store the sketches of one batch at `root/batch=<id>`; writing a batch again replaces it."""
    url_sketches(df, by, url_col).write.mode("overwrite").parquet(os.path.join(root, f"batch={batch_id}"))


def stored_estimates(spark: SparkSession, root: str, by: list[str]) -> DataFrame:
    """(*by, n_urls) over all batches stored at `root`."""
    return estimates(united(spark.read.parquet(root), by))
