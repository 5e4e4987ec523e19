"""Sources and sinks (S1-S5, S7, S8): the library table, JSON backups, pages, free text.

A backup is a JSON array of whole records (2-space indent).  A single array
file can only be read by one task, so the export writes one array per
partition file (each is a valid backup on its own, and together they are the
whole library) and the import reads a directory of them in parallel; JSON
Lines directories are accepted too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.library import LIBRARY_SCHEMA, METADATA_TYPE, add_records, conform, is_importable

# Backup metadata: the store's field names, times as epoch millis. Any other key goes to and comes from `extra`.
BACKUP_METADATA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("bookmarkId", T.StringType()),
    T.StructField("dateAdded", T.LongType()),
    T.StructField("summary", T.StringType()),
    T.StructField("notes", T.StringType()),
])

# JSON backup record; metadata is read as its JSON text, then split into known and other keys.
BACKUP_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("dimensions", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("updatedAt", T.LongType()),
    T.StructField("metadata", T.StringType()),
])


#: Lines of a backup that its writer puts out at a time.
FRAME_ROWS = 512


def scan_library(df_or_path, spark: SparkSession | None = None) -> DataFrame:
    """All records (a DataFrame passes through; a path is read with the fixed schema)."""
    if isinstance(df_or_path, DataFrame):
        return conform(df_or_path) if set(df_or_path.columns) != set(c.name for c in LIBRARY_SCHEMA) else df_or_path
    return spark.read.schema(LIBRARY_SCHEMA).parquet(df_or_path)


def write_library(df: DataFrame, path: str, files: int | None = None, mode: str = "errorifexists") -> str:
    """Write a library snapshot range-partitioned and sorted by id.

    Each file then covers a disjoint id range and its row groups carry tight
    min/max statistics, so a lookup by id (S2) or a join on id reads only the
    files and row groups that can hold the key.  A snapshot goes to a fresh
    directory; readers of the previous one are never disturbed.
    """
    out = conform(df)
    n = files or max(1, out.sparkSession.sparkContext.defaultParallelism)
    out.repartitionByRange(n, "id").sortWithinPartitions("id").write.mode(mode).parquet(path)
    return path


def get_by_id(df: DataFrame, record_id: str) -> DataFrame:
    """One record or nothing; the equality filter reaches the Parquet scan."""
    return df.where(F.col("id") == F.lit(record_id))


def scan_newest_first(df: DataFrame) -> DataFrame:
    """S3: newest first; ties (and missing times) in id order."""
    return df.orderBy(F.col("ts").desc_nulls_last(), F.col("id").asc())


def _backup_lines(df: DataFrame) -> DataFrame:
    """(line): each record as one line of JSON, the other keys next to the known ones in its metadata."""
    m = F.col("metadata")
    every = {"ignoreNullFields": "false"}
    record = F.to_json(F.struct(
        "id", "text", F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("dimensions").cast("long").alias("dimensions"), "model",
        F.unix_millis("ts").alias("timestamp"), F.unix_millis("updated_at").alias("updatedAt")), every)
    known = F.to_json(F.struct(
        m["type"].alias("type"), m["url"].alias("url"), m["title"].alias("title"),
        m["bookmark_id"].alias("bookmarkId"), F.unix_millis(m["date_added"]).alias("dateAdded"),
        m["summary"].alias("summary"), m["notes"].alias("notes")), every)
    other = F.to_json(m["extra"], every)
    inner = lambda c: F.substring(c, 2, F.length(c) - 2)  # noqa: E731 - without its braces
    meta = F.when(F.coalesce(F.size(m["extra"]), F.lit(0)) > 0, F.concat(F.lit("{"), inner(known), F.lit(","), inner(other), F.lit("}"))) \
        .otherwise(known)
    return conform(df).select(F.concat(F.lit("{"), inner(record), F.lit(',"metadata":'), meta, F.lit("}")).alias("line"))


def _from_backup(df: DataFrame) -> DataFrame:
    m = F.from_json("metadata", BACKUP_METADATA)
    other = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, _v: ~k.isin(BACKUP_METADATA.fieldNames()))
    return df.select(
        "id", "text", F.col("embedding").cast("array<float>").alias("embedding"),
        F.col("dimensions").cast("int").alias("dimensions"), "model",
        F.timestamp_millis("timestamp").alias("ts"), F.timestamp_millis("updatedAt").alias("updated_at"),
        F.when(F.col("metadata").isNotNull(), F.struct(
            m["type"].alias("type"), m["url"].alias("url"), m["title"].alias("title"),
            m["bookmarkId"].alias("bookmark_id"), F.timestamp_millis(m["dateAdded"]).alias("date_added"),
            m["summary"].alias("summary"), m["notes"].alias("notes"),
            F.when(F.size(other) > 0, other).alias("extra"))).cast(METADATA_TYPE).alias("metadata"))


def backup_file_name(ts_col=None):
    """S5 file name: `embeddings-backup-<ISO time with : and . replaced by ->.json`."""
    ts = ts_col if ts_col is not None else F.current_timestamp()
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(F.lit("embeddings-backup-"), F.regexp_replace(iso, "[:.]", "-"), F.lit(".json"))


def export_backup(df: DataFrame, path: str, lines: bool = False) -> str:
    """Write the library as JSON-array backup files, one per partition; returns the path.

    With `lines` the files are JSON Lines, written by Spark alone: the form
    to choose for a large library, as its files can be split when read.  Rows are rendered with `to_json` on the JVM side; a streaming pass per
    partition adds the brackets and commas with one row of look-ahead, so no
    partition is ever gathered into one value.
    """
    rec = _backup_lines(df)
    if lines:
        rec.write.mode("overwrite").text(path)
        return path
    js = rec.select(F.concat(F.lit("  "), "line").alias("line"))

    def frame(batches):
        """Lines with brackets and commas, the last line of a batch held back; Arrow strings throughout."""
        import pyarrow as pa
        import pyarrow.compute as pc

        held, started = None, False
        for batch in batches:
            lines = batch.column(0)
            if not len(lines):
                continue
            if not started:
                lines, started = pa.concat_arrays([pa.array(["[\n" + lines[0].as_py()], lines.type), lines.slice(1)]), True
            if held is not None:
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(held, "", ",")], names=["value"])
            for s in range(0, len(lines) - 1, FRAME_ROWS):
                some = lines.slice(s, min(FRAME_ROWS, len(lines) - 1 - s))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(some, "", ",")], names=["value"])
            held = pa.array([lines[-1].as_py()], lines.type)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(held, "]", "\n")], names=["value"])

    js.mapInArrow(frame, "value string").write.mode("overwrite").text(path)
    return path


def read_backup(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Read backup files (JSON arrays, or with `lines` JSON Lines) into the library schema, ids kept.

    With `split` an array file is read by many tasks (`json_array`), and one that is no array is an error.
    """
    if split:
        from vellum.sources.json_array import read_json_array

        return conform(_from_backup(read_json_array(spark, path).select(F.from_json("json", BACKUP_SCHEMA).alias("r")).select("r.*")))
    raw = spark.read.schema(BACKUP_SCHEMA).option("multiLine", str(not lines).lower()).json(path)
    return conform(_from_backup(raw))


def check_backup_is_array(spark: SparkSession, path: str) -> None:
    """S4 guard: every backup file must start with '[' (a bare object is not a backup)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    firsts = (lines.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("o"), "value")
              .groupBy("f").agg(F.min_by("value", "o").alias("first"))
              .where(~F.ltrim(F.col("first")).startswith("[")))
    if firsts.limit(1).count():
        raise ValueError("Invalid format: expected an array")


def import_backup(spark: SparkSession, path: str, on_conflict: str | None = None,
                  current: DataFrame | None = None, batch: str | None = None, lines: bool = False) -> DataFrame:
    """Keep items with a present embedding and non-empty text; every item gets a new id.

    The new id hashes the import batch, the file and the row's position in
    its split (stable when a task is retried), so importing the same backup
    twice yields two sets of records, as the reference does.  With
    `on_conflict="skip"`, items whose content (text, time, model) is already
    in `current` are dropped instead.
    """
    if not lines:
        check_backup_is_array(spark, path)
    recs = read_backup(spark, path, lines).where(is_importable(F.col("embedding"), F.col("text")))
    token = F.lit(batch if batch is not None else f"{path}#{uuid.uuid4().hex}")  # fixed here: every action on the frame gives the same ids
    recs = recs.withColumn("_origin", F.concat_ws("#", token, F.input_file_name(),
                                                  F.monotonically_increasing_id().cast("string")))
    if on_conflict == "skip" and current is not None:
        have = current.select("text", "ts", "model").distinct()
        recs = recs.join(have, [recs.text.eqNullSafe(have.text), recs.ts.eqNullSafe(have.ts),
                                recs.model.eqNullSafe(have.model)], "left_anti")
    return add_records(None, recs.drop("id").drop("updated_at"), id_cols=["_origin"])


def read_pages(pages: DataFrame, status_col: str | None = None) -> DataFrame:
    """Pages as fetch results; a non-2xx status becomes `HTTP <status>`."""
    if status_col and status_col in pages.columns:
        st = F.col(status_col)
        ok = st.between(200, 299)
        return pages.withColumn("success", ok).withColumn(
            "error", F.when(~ok, F.concat(F.lit("HTTP "), st.cast("string"))))
    return pages.withColumn("success", F.lit(True)).withColumn("error", F.lit(None).cast("string"))


def ingest_text(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, store: bool = True,
                factory=None) -> DataFrame:
    """Embed free texts; only successful embeddings are stored (when `store` is set)."""
    from vellum.operators.embed import HASH_MODEL, embed

    keep = keep or []
    e = embed(df.select(*keep, text_col), text_col, factory=factory, model=HASH_MODEL)
    if store:
        e = e.where(F.col("emb.success"))
    return e.select(*keep, F.col(f"emb.text").alias("text"), F.col("emb.embedding").alias("embedding"),
                    F.col("emb.dimensions").alias("dimensions"), F.col("emb.model").alias("model"),
                    F.col("emb.success").alias("success"), F.col("emb.error").alias("error"))


def store_texts(df: DataFrame, current: DataFrame | None, text_col: str = "text", keep: list[str] | None = None,
                factory=None, now=None) -> DataFrame:
    """S8 stored: `current` with a record for every text that could be embedded: id, time, vector, model.

    `keep` names the columns that tell the texts apart (they go into the id);
    without it, equal texts are numbered.
    """
    keep = keep or []
    e = ingest_text(df, text_col, keep, factory=factory)
    blank = F.struct(*[(F.lit("text") if f.name == "type" else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA_TYPE.fields])
    new = e.select(*keep, "text", "embedding", "dimensions", "model", blank.alias("metadata"))
    return add_records(current, new, id_cols=[*keep, "text"] if keep else None, now=now)


def one_page_per_url(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, html) for the distinct `urls`: of several crawls of a url the longest page, then the greatest.

    The urls are broadcast into the scan while they are small, so that the
    html of other pages is dropped where it is read.
    """
    from vellum.operators.library import sized_broadcast

    wanted = urls.select("url").where(F.col("url").isNotNull()).distinct()
    found = pages.select("url", "html").join(sized_broadcast(wanted), "url", "left_semi")
    return found.groupBy("url").agg(F.max_by("html", F.struct(F.length("html"), "html")).alias("html"))
