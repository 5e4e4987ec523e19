"""Dedupe and key joins.

All of them are equi-joins or aggregates on a key.  "First per key" is a
`min_by` aggregate, which runs partially on the map side, so a url or key
holding a third of all rows costs one partial row per partition, not a
window partition of that size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import truthy


def distinct_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """A3: the set of non-empty urls."""
    return df.select(F.col(url_col).alias("url")).where(truthy(F.col("url"))).distinct()


def new_only(candidates: DataFrame, existing: DataFrame, url_col: str = "url") -> DataFrame:
    """Candidates with a url that is not already in the library (empty urls ignored on both sides)."""
    have = distinct_urls(existing, url_col)
    c = candidates.where(truthy(F.col(url_col)))
    return c.join(have, c[url_col] == have["url"], "left_anti") if url_col != "url" else c.join(have, "url", "left_anti")


def dedupe_batch(items: DataFrame, url_col: str = "url", pos_col: str = "pos", failed_col: str | None = None) -> DataFrame:
    """One item per url, the first in position order; with `failed_col`, a failed
    first attempt lets the next one win (order by (failed, pos))."""
    order = F.struct(*( [F.col(failed_col).cast("int")] if failed_col else []), F.col(pos_col))
    row = F.struct(*[F.col(c) for c in items.columns])
    return items.where(truthy(F.col(url_col))).groupBy(url_col).agg(F.min_by(row, order).alias("_r")).select("_r.*")


def match_by_key(library: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """For each key, the first record (id order) whose bookmark id equals it -> (key, id)."""
    firsts = (library.where(F.col("metadata.bookmark_id").isNotNull())
              .groupBy(F.col("metadata.bookmark_id").alias(key_col)).agg(F.min("id").alias("id")))
    return keys.select(key_col).distinct().join(firsts, key_col, "left")
