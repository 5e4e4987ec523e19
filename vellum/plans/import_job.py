"""End-to-end jobs: bulk import (M6) and per-bookmark create (M8).

Bulk import is one DataFrame plan:
    tree -> pre-order bookmarks (S6) -> not already stored (J1, anti-join)
    -> first per url (J2) -> join pages by url -> extract (H8) -> summary (H11)
    -> compose (P1) -> embed (V1) -> records (M1) and per-item statuses (A4)
The batch loop, pause and cancel flag of the item-at-a-time original have no
counterpart: Spark schedules the partitions.  The anti-join runs before the
extraction and embedding, so the expensive steps only see new urls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as P
from vellum.operators.dedupe import dedupe_batch, new_only
from vellum.operators.embed import HASH_MODEL, embed_udf
from vellum.operators.library import METADATA_TYPE, add_records
from vellum.operators.summarize import summarize_frame
from vellum.sources.library_io import one_page_per_url
from vellum.sources.tree import flatten_tree


def page_contents(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, extracted) for the distinct `urls` that have a page: the document's text, else the fetch path's (H8)."""
    from vellum.operators.page_text import extract_with_fallback

    # stored: its size is measured, and two extractions read it
    found = extract_with_fallback(_stored(one_page_per_url(pages, urls), "url-pages"), "url", "html")
    return found.select("url", F.struct("success", "content", F.col("title"), "error").alias("extracted"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to scratch and read back: later steps read it without working it out again."""
    from vellum.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bulk_import(tree: DataFrame, pages: DataFrame, existing: DataFrame, embedder=None, summarizer=None,
                model: str = HASH_MODEL) -> tuple[DataFrame, DataFrame]:
    """M6: (new records, item statuses (pos, url, status, error)).

    Of the items that name one new url the first is tried; where it fails the
    next one is, and so on.  Every round is a stored table, so that the model
    sees an item once; there are as many rounds as failed items of one url.
    """
    marks = _stored(flatten_tree(tree, ordered=False), "import-marks")
    left = new_only(marks, existing)
    contents = _stored(page_contents(pages, left), "import-pages")
    done = None
    while True:
        j = dedupe_batch(left, url_col="url", pos_col="path").join(contents, "url", "left")
        j = summarize_frame(j, "url", "extracted", "summary", summarizer)
        composed = P.compose_text(F.col("title"), F.col("url"), F.col("summary"), F.lit(""))
        fallback = F.concat(F.coalesce("title", F.lit("")), F.lit(" - "), F.coalesce("url", F.lit("")))
        j = j.withColumn("text", F.coalesce(F.nullif(composed, F.lit("")), fallback)).drop("extracted")
        j = _stored(j.withColumn("_e", embed_udf(embedder)(F.col("text"))), "import-tried")
        done = j if done is None else done.unionByName(j)
        failed = j.where(~F.col("_e.success"))
        left = left.join(failed.select("url"), "url", "left_semi").join(done.select("path"), "path", "left_anti")
        if not failed.limit(1).count() or not left.limit(1).count():
            break
        left = _stored(left, "import-left")
    ok = done.where(F.col("_e.success"))
    recs = add_records(None, ok.select(
        "text", F.col("_e.embedding").alias("embedding"), F.size("_e.embedding").alias("dimensions"),
        F.lit(model).alias("model"), F.lit(None).cast("timestamp").alias("ts"),
        F.struct(F.lit("bookmark").alias("type"), F.col("url"), F.col("title"), F.col("id").alias("bookmark_id"),
                 F.col("date_added"), F.col("summary"),
                 F.lit("").alias("notes"), F.lit(None).cast("map<string,string>").alias("extra")).cast(METADATA_TYPE).alias("metadata")),
        id_cols=["metadata.bookmark_id", "text"])
    tried = done.select(F.col("path").alias("pos"), "url",
                        F.when(F.col("_e.success"), F.lit("success")).otherwise(F.lit("failure")).alias("status"),
                        F.col("_e.error").alias("error"))
    # every other item names a url that is stored already, or that an item before it brought in
    rest = marks.join(done.select("path"), "path", "left_anti")
    skipped = rest.select(F.col("path").alias("pos"), "url", F.lit("skip").alias("status"), F.lit(None).cast("string").alias("error"))
    return recs, tried.unionByName(skipped)


def process_bookmarks(created: DataFrame, pages: DataFrame | None = None, embedder=None, summarizer=None,
                      model: str = HASH_MODEL) -> DataFrame:
    """M8: each created bookmark with a url -> a record carrying its bookmark id (no url dedupe).

    With `pages`, the page of each url is extracted and summarised first, as
    the create handler does; without it the summary is null.  Keeps
    `event_id` and `key` next to the record columns.
    """
    c = created.where(P.truthy(F.col("url")))
    if pages is not None:
        # each distinct url is fetched and summarised once, however many events name it
        sums = summarize_frame(page_contents(pages, c), "url", "extracted", "summary", summarizer).select("url", "summary")
        c = c.join(sums, "url", "left")
    else:
        c = c.withColumn("summary", F.lit(None).cast("string"))
    composed = P.compose_text(F.col("title"), F.col("url"), F.col("summary"), F.lit(""))
    text = P.text_fallback(composed, F.col("title"), F.col("url"), F.col("key"))
    c = c.withColumn("text", text).withColumn("_e", embed_udf(embedder)(F.col("text")))
    return c.where(F.col("_e.success")).select(
        "event_id", "key", "text", F.col("_e.embedding").alias("embedding"),
        F.size("_e.embedding").alias("dimensions"), F.lit(model).alias("model"), F.col("ts"),
        F.struct(F.lit("bookmark").alias("type"), F.col("url"), F.col("title"), F.col("key").alias("bookmark_id"),
                 F.coalesce(F.col("ts"), F.current_timestamp()).alias("date_added"),
                 F.col("summary"), F.lit("").alias("notes"), F.lit(None).cast("map<string,string>").alias("extra")).cast(METADATA_TYPE)
        .alias("metadata"))


def add_bookmarks(current: DataFrame, created: DataFrame, pages: DataFrame | None = None, embedder=None, summarizer=None,
                  model: str = HASH_MODEL) -> DataFrame:
    """M8 stored: `current` with a record, id included, for every created bookmark that could be embedded.

    The id hangs on the event, so that the same event gives the same record
    again; a bookmark that is created twice has two records, as each create
    adds one.
    """
    new = process_bookmarks(created, pages, embedder, summarizer, model)
    return add_records(current, new, id_cols=["event_id", "key"], batch="create")
