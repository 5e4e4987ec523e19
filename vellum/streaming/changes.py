"""Change capture (S9, T1-T3) in batch and Structured Streaming form.

A change event is (op, key, ts, event_id, title, url).  The state of a key is
its last *effective* event by (ts, event_id): a create or change without a
url is skipped; a remove always applies.  "Last by (ts, event_id)" is an
associative merge, so applying events in one batch or in many micro-batches
gives the same state, and a replayed micro-batch changes nothing.

Streaming: `readStream` over change files -> `foreachBatch`, which folds the
batch into the keyed state and writes a new snapshot directory named by the
batch id (a retry overwrites the same directory; readers take the highest
committed one).  The state is a table keyed by `key`, so the fold is an
aggregate with map-side partials, never a per-key list.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import compose_text, truthy

CHANGE_SCHEMA = T.StructType([
    T.StructField("op", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
])
OPS = ("created", "changed", "removed")


def read_changes_batch(df: DataFrame) -> DataFrame:
    """S9 batch form: the change events with a known op, in the change schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHANGE_SCHEMA.fields]) \
        .where(F.col("op").isin(*OPS))


def read_changes_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming source of change files (Parquet) with the fixed schema."""
    r = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def effective(changes: DataFrame) -> DataFrame:
    """Drop creates/changes without a url (the handlers return early on them)."""
    return changes.where((F.col("op") == "removed") | truthy(F.col("url")))


def latest_per_key(changes: DataFrame) -> DataFrame:
    """The last effective event of every key, as a partial aggregate."""
    ev = effective(changes)
    order = F.struct("ts", "event_id")
    payload = F.struct("op", "ts", "event_id", "title", "url")
    return ev.groupBy("key").agg(F.max_by(payload, order).alias("s")).select("key", "s.*")


def key_state(changes: DataFrame) -> DataFrame:
    """T1 latest state: (key, live, title, url, text, event_id, ts) per key seen."""
    last = latest_per_key(changes)
    live = last.op != "removed"
    return last.select(
        "key", live.alias("live"),
        F.when(live, F.col("title")).alias("title"), F.when(live, F.col("url")).alias("url"),
        F.when(live, compose_text(F.col("title"), F.col("url"), F.lit(None).cast("string"), F.lit(""))).alias("text"),
        "event_id", "ts", "op")


def fold_state(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Merge a micro-batch into the keyed state (idempotent, order-free)."""
    cols = ["op", "key", "ts", "event_id", "title", "url"]
    new = latest_per_key(batch)
    if state is None:
        return new.select(*cols)
    return latest_per_key(state.select(*cols).unionByName(new.select(*cols))).select(*cols)



#: Columns that a patch replaces.
PATCHED = ("text", "embedding", "dimensions", "model", "ts", "metadata", "updated_at")


def change_delta(matches: DataFrame, old_meta: DataFrame, state: DataFrame, embedder=None, now=None,
                 summaries: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """The library delta of a set of key states: library columns plus `_kind` (insert / patch / delete).

    `matches` is (key, id) of the first record per key (J3, id null when
    none), `old_meta` is (id, metadata) of the matched records, `summaries`
    is an optional (url, summary) of freshly summarised pages.  A removed key
    deletes its record.  A live key with a record is patched: the summary is
    refreshed when a new one is truthy (H12), the text is recomposed from the
    new title and url with that summary and the stored notes, re-embedded,
    and the vector goes in with its dimensions, model and time.  A live key
    without a record inserts a new bookmark record.
    """
    from vellum.functions.text import compose_text, refresh_summary
    from vellum.operators.embed import HASH_MODEL, embed_udf
    from vellum.operators.library import METADATA_TYPE, add_records, conform

    now = now if now is not None else F.current_timestamp()
    model = model or HASH_MODEL
    st = state.join(matches, "key", "left")
    deletes = conform(st.where(~F.col("live") & F.col("id").isNotNull()).select("id")) \
        .withColumn("_kind", F.lit("delete"))
    live = st.where(F.col("live"))
    live = live.join(summaries.select("url", F.col("summary").alias("_new_summary")), "url", "left") \
        if summaries is not None else live.withColumn("_new_summary", F.lit(None).cast("string"))
    fallback = F.concat(F.coalesce("title", F.lit("")), F.lit(" - "), F.coalesce("url", F.lit("")))
    upd = live.where(F.col("id").isNotNull()).join(old_meta.select("id", F.col("metadata").alias("_old")), "id")
    upd = upd.withColumn("_summary", refresh_summary(F.col("_new_summary"), F.col("_old.summary")))
    upd = upd.withColumn("text", F.coalesce(F.nullif(compose_text(F.col("title"), F.col("url"), F.col("_summary"),
                                                                  F.col("_old.notes")), F.lit("")), fallback))
    upd = upd.withColumn("_e", embed_udf(embedder)(F.col("text")))
    patches = upd.where(F.col("_e.success")).select(
        "id", "text", F.col("_e.embedding").alias("embedding"), F.size("_e.embedding").alias("dimensions"),
        F.lit(model).alias("model"), "ts", now.alias("updated_at"),
        F.col("_old").withField("title", F.col("title")).withField("url", F.col("url"))
        .withField("summary", F.col("_summary")).alias("metadata"))
    patches = conform(patches).withColumn("_kind", F.lit("patch"))
    new = live.where(F.col("id").isNull()).withColumn("text", F.coalesce(F.nullif(
        compose_text(F.col("title"), F.col("url"), F.col("_new_summary"), F.lit("")), F.lit("")), fallback))
    new = new.withColumn("_e", embed_udf(embedder)(F.col("text")))
    fresh = new.where(F.col("_e.success")).select(
        F.col("text"), F.col("_e.embedding").alias("embedding"), F.size("_e.embedding").alias("dimensions"),
        F.lit(model).alias("model"), F.col("ts"),
        F.struct(F.lit("bookmark").alias("type"), F.col("url"), F.col("title"), F.col("key").alias("bookmark_id"),
                 F.col("ts").alias("date_added"), F.col("_new_summary").alias("summary"),
                 F.lit("").alias("notes"), F.lit(None).cast("map<string,string>").alias("extra")).cast(METADATA_TYPE).alias("metadata"))
    # the id hangs on the key alone: the same record whichever of its events came first
    inserts = add_records(None, fresh, id_cols=["metadata.bookmark_id"], batch="change").withColumn("_kind", F.lit("insert"))
    return deletes.unionByName(patches).unionByName(inserts)


def resolve_delta(delta: DataFrame) -> DataFrame:
    """Fold every id's deltas (ordered by `_batch`) into one row.

    `_kind`: the latest kind (a delete hides the record, a later patch revives
    it); `_last`: the latest patch; `_ins`: the inserted record, if any.
    """
    from vellum.operators.library import LIBRARY_COLUMNS

    patch = F.struct("_kind", *PATCHED)
    record = F.struct(*[F.col(c) for c in LIBRARY_COLUMNS])
    is_ins = F.col("_kind") == "insert"
    is_patch = F.col("_kind") == "patch"
    return delta.groupBy("id").agg(
        F.max_by("_kind", "_batch").alias("_kind"),
        F.max_by(F.when(is_patch, patch), F.when(is_patch, F.col("_batch"))).alias("_last"),
        F.max_by(F.when(is_ins, record), F.when(is_ins, F.col("_batch"))).alias("_ins"))


def apply_delta(library: DataFrame, delta: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """Merge-on-read: base records patched or dropped by their latest delta, plus inserted records.

    The resolved delta is small and is broadcast after a size check; the
    base is never shuffled.  `keep_deleted` also returns deleted records in
    their last state (what a revived key is patched from).
    """
    from vellum.operators.library import LIBRARY_SCHEMA, conform, sized_broadcast

    res = resolve_delta(delta if "_batch" in delta.columns else delta.withColumn("_batch", F.lit(0)))
    last, ins = F.col("_last"), F.col("_ins")
    gone = F.lit(False) if keep_deleted else (F.col("_kind") == "delete")
    patched = last.isNotNull()
    j = conform(library).join(sized_broadcast(res), "id", "left") \
        .where(~F.coalesce(gone, F.lit(False)) & ins.isNull())
    cols = []
    for f in LIBRARY_SCHEMA.fields:
        c = f.name
        if c in PATCHED:
            cols.append(F.when(F.coalesce(patched, F.lit(False)), last[c]).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    base = j.select(*cols)
    added = res.where(ins.isNotNull() & ~gone).select(*[
        (F.when(patched, last[f.name]).otherwise(ins[f.name]) if f.name in PATCHED else ins[f.name]).alias(f.name)
        for f in LIBRARY_SCHEMA.fields])
    return base.unionByName(added)


def page_summaries(urls: DataFrame, pages: DataFrame, summarizer=None) -> DataFrame:
    """(url, summary) for each distinct url that has a page: extract once, summarise once."""
    from vellum.operators.summarize import summarize_frame
    from vellum.plans.import_job import page_contents

    return summarize_frame(page_contents(pages, urls), "url", "extracted", "summary", summarizer).select("url", "summary")


def apply_changes(library: DataFrame, changes: DataFrame, embedder=None, now=None,
                  pages: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """T1 on the library (batch): match by bookmark id (J3), then apply the change delta.

    With `pages`, the page of every live key is summarised and refreshes the
    stored summary (H12), as the change handler does.  The delta is written
    to scratch when this is called.
    """
    from vellum.operators.dedupe import match_by_key

    from vellum.session import scratch_path

    st = key_state(changes)
    matches = match_by_key(library, st.select("key"))
    summaries = page_summaries(st.where(F.col("live")), pages) if pages is not None else None
    delta = change_delta(matches, library.select("id", "metadata"), st, embedder, now, summaries, model)
    path = scratch_path(library.sparkSession, "change-delta")
    delta.write.parquet(path)  # resolved more than once below; the model sees each text once
    return apply_delta(library, library.sparkSession.read.schema(delta.schema).parquet(path))


def library_view(spark: SparkSession, base: str, root: str, upto: int | None = None,
                 keep_deleted: bool = False) -> DataFrame:
    """The library as of the deltas written so far (merge-on-read over `root/delta/batch=<n>`)."""
    from vellum.sources.library_io import scan_library

    lib = scan_library(base, spark)
    delta_root = os.path.join(root, "delta")
    done = [b for b in _batches(spark, delta_root) if upto is None or b < upto]
    if not done:
        return lib
    paths = [os.path.join(delta_root, f"batch={b}") for b in done]
    delta = spark.read.option("basePath", delta_root).parquet(*paths).withColumnRenamed("batch", "_batch")
    return apply_delta(lib, delta, keep_deleted)


def key_index(lib: DataFrame) -> DataFrame:
    """(key, id): the first record (id order) of every bookmark id, a small table."""
    return lib.where(F.col("metadata.bookmark_id").isNotNull()).groupBy(
        F.col("metadata.bookmark_id").alias("key")).agg(F.min("id").alias("id"))


def compact_library(spark: SparkSession, base: str, root: str, out: str) -> str:
    """Fold all deltas into a new id-sorted base snapshot (run now and then, not per batch)."""
    from vellum.sources.library_io import write_library

    return write_library(library_view(spark, base, root), out)


def snapshot_writer(root: str):
    """`foreachBatch` function: fold the batch into the last snapshot, write `root/batch=<id>`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [b for b in _batches(spark, root) if b < batch_id]
        prev = spark.read.parquet(os.path.join(root, f"batch={done[-1]}")) if done else None
        state = fold_state(prev, read_changes_batch(batch))
        state.write.mode("overwrite").parquet(os.path.join(root, f"batch={batch_id}"))

    return write


def library_writer(root: str, initial: str, embedder=None, pages: DataFrame | None = None, model: str | None = None):
    """`foreachBatch` function: T1 on a library kept as a base snapshot plus per-batch deltas.

    Per micro-batch:
    1. fold the events into the order-free key state (`root/state/batch=<id>`),
       so a late older event is a no-op; take the merged newest event of
       every key the batch touched;
    2. match keys to records through the key index (`root/index/batch=<id>`,
       one small row per bookmark id), never through the library itself;
    3. read the metadata of the matched records only, by a semi-join with
       the matched ids (broadcast while they are small);
    4. write the delta (inserts, patches, deletes) to `root/delta/batch=<id>`
       and the updated index.
    Every write is an overwrite keyed by batch id, so a replayed batch
    rewrites the same files.  Read with `library_view`; fold with
    `compact_library`.
    """
    from vellum.operators.library import sized_broadcast
    from vellum.sources.library_io import scan_library

    state_root, index_root = os.path.join(root, "state"), os.path.join(root, "index")
    delta_root = os.path.join(root, "delta")

    def latest(spark, where, batch_id):
        done = [b for b in _batches(spark, where) if b < batch_id]
        return os.path.join(where, f"batch={done[-1]}") if done else None

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ev = read_changes_batch(batch)
        prev = latest(spark, state_root, batch_id)
        state_path = os.path.join(state_root, f"batch={batch_id}")
        fold_state(spark.read.parquet(prev) if prev else None, ev).write.mode("overwrite").parquet(state_path)
        touched = key_state(spark.read.parquet(state_path).join(ev.select("key").distinct(), "key", "left_semi"))

        idx_prev = latest(spark, index_root, batch_id)
        index = spark.read.parquet(idx_prev) if idx_prev else key_index(scan_library(initial, spark))
        matches = touched.select("key").join(index, "key", "left")
        ids = matches.where(F.col("id").isNotNull()).select("id")
        view = library_view(spark, initial, root, upto=batch_id, keep_deleted=True).select("id", "metadata")
        old_meta = view.join(sized_broadcast(ids), "id", "left_semi")
        summaries = page_summaries(touched.where(F.col("live")), pages) if pages is not None else None
        delta = change_delta(matches, old_meta, touched, embedder, None, summaries, model)
        delta_path = os.path.join(delta_root, f"batch={batch_id}")
        delta.write.mode("overwrite").parquet(delta_path)

        # a deleted record keeps its index entry: a later live state of the key revives it
        d = spark.read.parquet(delta_path)
        added = d.where(F.col("_kind") == "insert").select(F.col("metadata.bookmark_id").alias("key"), "id")
        new_index = index.unionByName(added.select("key", "id")).groupBy("key").agg(F.min("id").alias("id"))
        new_index.write.mode("overwrite").parquet(os.path.join(index_root, f"batch={batch_id}"))

    return write


def run_library_stream(spark: SparkSession, source: str, initial: str, root: str, checkpoint: str,
                       max_files_per_trigger: int | None = None, embedder=None, pages: DataFrame | None = None,
                       model: str | None = None) -> DataFrame:
    """T1 end to end: change files -> micro-batches -> deltas; returns the library view after them."""
    stream = read_changes_stream(spark, source, max_files_per_trigger)
    q = (stream.writeStream.foreachBatch(library_writer(root, initial, embedder, pages, model))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return library_view(spark, initial, root)


def run_change_stream(spark: SparkSession, source: str, state_root: str, checkpoint: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """T1/T3 driver: process all available change files in micro-batches, return the final state."""
    stream = read_changes_stream(spark, source, max_files_per_trigger)
    q = (stream.writeStream.foreachBatch(snapshot_writer(state_root))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    batches = _batches(spark, state_root)
    if not batches:
        return spark.createDataFrame([], CHANGE_SCHEMA)
    return spark.read.parquet(os.path.join(state_root, f"batch={batches[-1]}"))


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Committed batches: those whose folder has Spark's success marker, so that none is read half-written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def committed(name: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(root, name, "_SUCCESS"))
        return p.getFileSystem(conf).exists(p)

    return sorted(int(d.split("=")[1]) for d in _list_dirs(spark, root) if d.startswith("batch=") and committed(d))


def _list_dirs(spark: SparkSession, root: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def debounce(events: DataFrame, key: str, ts: str, gap: str = "500 milliseconds",
             payload: str | None = None, block: str = "1 hour", tie: str = "event_id") -> DataFrame:
    """T2 (batch): one row per burst (session) of a key: the last payload, and the burst's span.

    A new burst starts when the previous event of the key is `gap` or more
    earlier.  Same output as `session_window` (session.start, session.end =
    last + gap), computed without a per-key window so one very busy key is
    spread over its time blocks:

    1. rows are partitioned by (key, block); inside a block a lag gives the
       previous time and a "new burst" flag for every row but the first;
    2. per block: first and last time and the count of inner flags
       (an aggregate on the same partitioning, no new shuffle);
    3. over the few blocks of a key: the previous block's last time decides
       the first row's flag, and a running sum gives the bursts before the block;
    4. burst id = bursts before + first flag + running count inside the block;
       bursts are a partial aggregate.
    """
    gap_us, block_us = _micros(gap), _micros(block)
    tie = tie if tie in events.columns else None
    keys = [F.col("_t")] + ([F.col(tie)] if tie else [])
    e = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))) \
        .withColumn("_b", F.floor(F.col("_t") / block_us))
    wi = Window.partitionBy(key, "_b").orderBy(*keys)
    e = e.withColumn("_rn", F.row_number().over(wi)).withColumn("_prev", F.lag("_t").over(wi))
    e = e.withColumn("_inner", F.when((F.col("_rn") > 1) & (F.col("_t") - F.col("_prev") >= gap_us), 1).otherwise(0))
    stats = e.groupBy(key, "_b").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"),
                                     F.sum("_inner").alias("_n_inner"))
    wb = Window.partitionBy(key).orderBy("_b")
    stats = stats.withColumn("_head", F.when(F.lag("_last").over(wb).isNull()
                                             | (F.col("_first") - F.lag("_last").over(wb) >= gap_us), 1).otherwise(0))
    stats = stats.withColumn("_before", F.coalesce(
        F.sum(F.col("_head") + F.col("_n_inner")).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = e.join(stats.select(key, "_b", "_head", "_before"), [key, "_b"])
    run = F.sum("_inner").over(wi.rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("_sid", F.col("_before") + F.col("_head") + run)
    pay = F.col(payload) if payload else F.struct(*[F.col(c) for c in events.columns])
    order = F.struct(*keys)
    g = e.groupBy(key, "_sid").agg(F.min("_t").alias("_s"), F.max("_t").alias("_e"),
                                   F.count(F.lit(1)).alias("n_events"), F.max_by(pay, order).alias("last"))
    session = F.struct(F.timestamp_micros(F.col("_s")).alias("start"),
                       F.timestamp_micros(F.col("_e") + gap_us).alias("end"))
    return g.select(key, session.alias("session"), "n_events", "last")


def _micros(interval: str) -> int:
    """'6 hours' / '500 milliseconds' -> microseconds."""
    n, unit = interval.split()
    scale = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6,
             "day": 86400 * 10**6}[unit.rstrip("s")]
    return int(float(n) * scale)


def debounce_stream(events: DataFrame, key: str, ts: str, gap: str, watermark: str,
                    payload: str | None = None) -> DataFrame:
    """T2 streaming: watermark on event time, session windows, append mode emits closed bursts."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", watermark)
    pay = F.col(payload) if payload else F.struct(*[F.col(c) for c in events.columns])
    order = F.struct("_t", *[F.col(c) for c in ("event_id",) if c in events.columns])
    return e.groupBy(F.col(key), F.session_window("_t", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max_by(pay, order).alias("last"))


def micro_batches(spark: SparkSession, source: str, schema: T.StructType, checkpoint: str,
                  max_files_per_trigger: int = 1) -> list[dict]:
    """Process files in bounded micro-batches; returns per-batch progress (rows per batch)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(source)
    seen: list[dict] = []

    def count(batch: DataFrame, batch_id: int) -> None:
        seen.append({"batch_id": batch_id, "rows": batch.count()})

    q = (stream.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return seen
