"""Derived inputs built from the given tables (the same definitions as the SQL oracles).

* library  : documents + vector (embeddings) + time (events) + url/title (pages)
             + first conversation turn as the note; the keyed record table.
* changes  : events as bookmark create/change/remove events keyed by user.
* items    : events as task items with a status, grouped in runs by user.
* tree     : region -> nation -> supplier as a bookmark tree; suppliers carry urls.
* existing : the https pages, the library side of the new-only import join.

All joins are equi-joins on the record key, so consecutive joins reuse one
hash partitioning of the key instead of re-shuffling the left side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.html import page_title

# Model ids assigned round-robin to library records.
LIBRARY_MODELS = ["Xenova/all-MiniLM-L6-v2", "Xenova/bge-small-en-v1.5", "custom-model"]
SELECTED_MODEL = "Xenova/all-MiniLM-L6-v2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table feeding CPU-heavy row work (regex chains, chunk walks): at least one task per core."""
    from vellum.session import spread

    return spread(table(spark, sf_dir, name))


def millis(ts: Column) -> Column:
    """Epoch millis of a TIMESTAMP or TIMESTAMP_NTZ (session time zone is UTC)."""
    return F.unix_millis(ts.cast("timestamp"))


def record_id(key: Column) -> Column:
    return F.concat(F.lit("emb_"), F.lpad(key.cast("string"), 12, "0"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    pages = heavy_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url",
                                                       page_title(F.col("html")).alias("title"))
    notes = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull()) \
        .groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("note"))
    j = docs.join(emb, "doc_id", "left").join(ev, "doc_id", "left").join(pages, "doc_id", "left") \
        .join(notes, "doc_id", "left")
    models = F.array(*[F.lit(m) for m in LIBRARY_MODELS])
    has_vec = F.col("embedding").isNotNull()
    has_url = F.col("url").isNotNull()
    return j.select(
        record_id(F.col("doc_id")).alias("id"),
        "doc_id",
        "text",
        "embedding",
        F.when(has_vec, F.size("embedding")).alias("dimensions"),
        F.when(has_vec, F.element_at(models, (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int"))).alias("model"),
        F.col("ts"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.struct(
            F.when(has_url, F.lit("bookmark")).alias("type"),
            F.col("url"),
            F.col("title"),
            F.when(has_url, F.col("doc_id").cast("string")).alias("bookmark_id"),
            F.col("ts").alias("date_added"),
            F.when(F.col("lang") == "en", F.substring("text", 1, 120)).alias("summary"),
            F.coalesce(F.col("note"), F.lit("")).alias("notes"),
            F.lit(None).cast("map<string,string>").alias("extra"),
        ).alias("metadata"),
    )


def flat_library(lib: DataFrame) -> DataFrame:
    """Scalar view of the library (what the oracle compares)."""
    return lib.select("id", "text", F.col("dimensions").cast("long").alias("dimensions"), "model",
                      millis(F.col("ts")).alias("ts_ms"),
                      F.col("metadata.type").alias("type"), F.col("metadata.url").alias("url"),
                      F.col("metadata.title").alias("title"), F.col("metadata.bookmark_id").alias("bookmark_id"),
                      F.col("metadata.summary").alias("summary"), F.col("metadata.notes").alias("notes"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), "url")
    op = (F.when(F.col("event_type") == "signup", "created")
          .when(F.col("event_type").isin("view", "click", "purchase"), "changed")
          .when(F.col("event_type") == "error", "removed"))
    return ev.join(pages, "user_id", "left").select(
        op.alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.concat(F.lit("bookmark "), F.col("user_id").cast("string"), F.lit(" v"), F.col("event_id").cast("string"))
        .alias("title"),
        "url",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type").isin("view", "signup", "purchase"), "success")
              .when(F.col("event_type") == "click", "skip")
              .when(F.col("event_type") == "error", "failure"))
    is_err = F.col("event_type") == "error"
    return ev.select(
        F.col("user_id").alias("run_id"),
        F.when(F.pmod(F.col("user_id"), F.lit(3)) == 0, "regeneration").otherwise("import").alias("task"),
        F.col("event_id").alias("pos"),
        status.alias("status"),
        F.when(is_err, F.concat(F.lit("failed item "), F.col("event_id").cast("string"))).alias("error"),
        (is_err & (F.col("value") > 40)).alias("thrown"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent_id, title, url, sort_key): regions are roots, suppliers are bookmarks."""
    r = table(spark, sf_dir, "region")
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("s_suppkey"), "url")
    key = lambda c: F.lpad(c.cast("string"), 12, "0")
    regions = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                       F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"),
                       F.lit(None).cast("string").alias("url"), key(F.col("r_regionkey")).alias("sort_key"))
    nations = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                       F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
                       F.col("n_name").alias("title"), F.lit(None).cast("string").alias("url"),
                       key(F.col("n_nationkey")).alias("sort_key"))
    sups = s.join(pages, "s_suppkey", "left").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent_id"),
        F.col("s_name").alias("title"), "url", key(F.col("s_suppkey")).alias("sort_key"))
    return regions.unionByName(nations).unionByName(sups)


def existing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").startswith("https://")).select("url")
