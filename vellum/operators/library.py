"""The keyed record table and its mutations.

Plain Parquet has no MERGE, so every mutation is `new = f(current, changes)`:
equi-joins on `id` (both sides hash-partitioned on the key, so at scale it is
one shuffle per side and AQE splits a skewed key), written to a fresh
snapshot directory by the caller.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import text as P
from vellum.functions.vectors import dimension_ok

METADATA_TYPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("bookmark_id", T.StringType()),
    T.StructField("date_added", T.TimestampType()),
    T.StructField("summary", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),  # any other key, as text
])

LIBRARY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("dimensions", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("metadata", METADATA_TYPE),
])

LIBRARY_COLUMNS = [f.name for f in LIBRARY_SCHEMA.fields]


# Change sets up to this many bytes are broadcast into the join with the library.
BROADCAST_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast `df` only when its bytes, summed over all rows, are under the bound; otherwise both sides shuffle.

    A mutation usually touches a few records of a large library: broadcasting
    the change set keeps the library where it is instead of shuffling all of
    it.  The measure is a partial sum (one row per partition travels) and runs
    `df`: give it change sets as they are stored, before any model call.
    """
    def width(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(t, T.ArrayType):
            each = F.lit(16) if not isinstance(t.elementType, (T.FloatType, T.DoubleType)) else F.lit(8)
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * each + 16
        if isinstance(t, T.StructType):
            return sum((width(c[f.name], f.dataType) for f in t.fields), F.lit(8))
        if isinstance(t, T.MapType):
            return F.coalesce(F.length(F.to_json(c)), F.lit(0)) * 2 + 32
        return F.lit(16)

    row = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32))
    size = df.agg(F.sum(row.cast("long")).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def one_per_id(patch: DataFrame, order: str | None = None) -> DataFrame:
    """One row per id: the last by `order`, else the greatest row, so that a repeated id cannot repeat its record."""
    cols = [c for c in patch.columns if c != "id"]
    if not cols:
        return patch.distinct()
    # the json text orders rows of any type, maps and arrays included
    by = F.struct(*([F.col(order)] if order else []), F.to_json(F.struct(*cols)))
    return patch.groupBy("id").agg(F.max_by(F.struct(*cols), by).alias("_one")).select("id", "_one.*")


def metadata_struct(col: Column, names) -> Column:
    """A metadata struct that has the fields `names`, widened to the full metadata type (absent keys null)."""
    fields = [(col[f.name] if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA_TYPE.fields]
    return F.when(col.isNotNull(), F.struct(*fields))


def conform(df: DataFrame) -> DataFrame:
    """Select the library columns in schema order, adding missing columns and metadata fields as nulls."""
    cols = []
    for f in LIBRARY_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name == "metadata" and isinstance(df.schema[f.name].dataType if f.name in df.columns else None, T.StructType):
            c = metadata_struct(c, df.schema[f.name].dataType.fieldNames())
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def normalize_metadata(df: DataFrame, col: str = "metadata") -> DataFrame:
    """Notes null -> ''; summary stays null when absent."""
    m = F.col(col)
    return df.withColumn(col, F.when(m.isNotNull(), m.withField("notes", F.coalesce(m["notes"], F.lit("")))))


def is_importable(embedding, text) -> Column:
    """Embedding present (an empty array passes) and text non-empty."""
    e, t = P._c(embedding), P._c(text)
    return F.coalesce(e.isNotNull() & (t != ""), F.lit(False))


def has_dim(df: DataFrame, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """The index dimension comes from the first record (id order) with a non-empty vector.

    `min_by` is a partial aggregate, so finding it is one pass with a one-row
    result, used as a scalar subquery.
    """
    v = F.col(vec_col)
    first = df.where(v.isNotNull() & (F.size(v) > 0)).agg(F.min_by(F.size(v), F.col(id_col)).alias("_dim"))
    return df.withColumn("has_dim", dimension_ok(v, first.scalar()))


def patch_from_labels(labels: DataFrame) -> DataFrame:
    """A patch table derived from labels: toxic rows lose their text; every row gets a new title."""
    return labels.select(
        F.concat(F.lit("emb_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"),
        F.when(F.col("toxic") == 1, F.lit("withheld")).alias("text"),
        F.struct(F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("title")).alias("metadata"),
    )


def _patch_metadata(patch: DataFrame, col: str) -> Column:
    """A patch's metadata struct widened to the full metadata type (absent keys null)."""
    return metadata_struct(F.col(col), patch.schema["metadata"].dataType.fieldNames())


def apply_patch(current: DataFrame, patch: DataFrame, now: Column | None = None) -> DataFrame:
    """Shallow merge by id; every column the patch has wins (null included); metadata replaced whole.

    Returns the new table; `updated_at` is set on patched rows.  Patches for
    unknown ids are dropped here (see `update_records` for the rejects); of
    several patches for one id the greatest row counts (`one_per_id`).
    """
    now = now if now is not None else F.current_timestamp()
    patch = one_per_id(patch)
    pcols = [c for c in patch.columns if c != "id"]
    p = patch.select("id", *[F.col(c).alias(f"_p_{c}") for c in pcols]).withColumn("_hit", F.lit(True))
    j = current.join(sized_broadcast(p), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for f in LIBRARY_SCHEMA.fields:
        c = f.name
        if c == "id":
            out.append(F.col("id"))
        elif c == "updated_at":
            out.append(F.when(hit, now).otherwise(F.col("updated_at")).alias(c))
        elif c == "metadata" and "metadata" in pcols:
            meta = _patch_metadata(patch, "_p_metadata")
            out.append(F.when(hit, meta).otherwise(F.col("metadata")).alias(c))
        elif c in pcols:
            out.append(F.when(hit, F.col(f"_p_{c}").cast(f.dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return normalize_metadata(j.select(*out))


def deep_patch_metadata(current: DataFrame, patch: DataFrame) -> DataFrame:
    """P5: view-side merge; every field and metadata key that the patch has wins, null included.

    A key that the patch's schema lacks keeps its old value; so does all
    metadata where the patch's metadata is null as a whole.
    """
    patch = one_per_id(patch)
    given = set(patch.schema["metadata"].dataType.fieldNames()) if "metadata" in patch.columns else set()
    pcols = [c for c in patch.columns if c != "id"]
    p = patch.select("id", *[F.col(c).alias(f"_p_{c}") for c in pcols]).withColumn("_hit", F.lit(True))
    j = current.join(sized_broadcast(p), "id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for f in LIBRARY_SCHEMA.fields:
        c = f.name
        if c == "metadata" and "metadata" in pcols:
            pm = _patch_metadata(patch, "_p_metadata")
            old = F.col("metadata")
            empty = F.create_map().cast("map<string,string>")
            both = F.map_concat(F.coalesce(old["extra"], empty), F.coalesce(pm["extra"], empty))  # the patch's keys win
            merged = F.struct(*[(both if m.name == "extra" and m.name in given else pm[m.name] if m.name in given
                                 else old[m.name]).alias(m.name) for m in METADATA_TYPE.fields])
            out.append(F.when(hit & F.col("_p_metadata").isNotNull(), merged).otherwise(F.col("metadata")).alias(c))
        elif c in pcols and c != "id":
            out.append(F.when(hit, F.col(f"_p_{c}").cast(f.dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def update_records(current: DataFrame, patch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: (new table, rejected patches whose id is unknown)."""
    rejects = patch.join(current.select("id"), "id", "left_anti")
    return apply_patch(current, patch), rejects


def record_id_from(*cols: Column) -> Column:
    """M1: a deterministic id from content (stable across retries, unlike a clock + random)."""
    return F.concat(F.lit("emb_"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256), 1, 24))


def add_records(current: DataFrame | None, new: DataFrame, id_cols: list[str] | None = None,
                now: Column | None = None, batch: str = "") -> DataFrame:
    """M1: assign ids, default a missing or zero time to now, normalise metadata, append.

    The id hashes the optional `batch` token and the given values of
    `id_cols`, which must tell the rows apart (an origin, a position); never
    the clock, so the same input and token give the same ids again.  Without
    `id_cols` it hashes text and time, and rows equal in both are numbered, so
    that every record has an id of its own.
    """
    now = now if now is not None else F.current_timestamp()
    n = new
    if "ts" not in n.columns:
        n = n.withColumn("ts", F.lit(None).cast("timestamp"))
    parts = ([F.lit(batch)] if batch else []) + [F.col(c) for c in id_cols or ["text", "ts"]]
    n = n.withColumn("id", record_id_from(*parts))
    if id_cols is None:
        twin = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.to_json(F.struct(*new.columns)))))
        n = n.withColumn("_twin", twin).withColumn("id", F.when(F.col("_twin") > 1, record_id_from(F.col("id"), F.col("_twin")))
                                                   .otherwise(F.col("id"))).drop("_twin")
    n = n.withColumn("ts", F.when(F.unix_millis(F.col("ts").cast("timestamp")) != 0, F.col("ts")).otherwise(now))
    if "metadata" not in n.columns:
        n = n.withColumn("metadata", F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in METADATA_TYPE.fields]))
    n = normalize_metadata(conform(n))
    return n if current is None else conform(current).unionByName(n)


def delete_records(current: DataFrame, ids: DataFrame) -> DataFrame:
    """M3: remove the given ids; unknown ids are fine."""
    return current.join(sized_broadcast(ids.select("id").distinct()), "id", "left_anti")


def clear_library(current: DataFrame) -> DataFrame:
    """M4: an empty table with the same schema."""
    return conform(current).limit(0)


def update_notes(current: DataFrame, notes: DataFrame, embedder=None, model: str | None = None,
                 now: Column | None = None) -> DataFrame:
    """M5: normalised note -> recomposed text (else the old text) -> re-embed -> patch.

    `notes` is (id, note); records without a note row are untouched.
    """
    from vellum.operators.embed import HASH_MODEL

    now = now if now is not None else F.current_timestamp()
    n = one_per_id(notes.select("id", P.normalize_note(F.col("note")).alias("_note"))).withColumn("_hit", F.lit(True))
    j = current.join(sized_broadcast(n), "id", "left")
    m = F.col("metadata")
    text = F.coalesce(F.nullif(P.compose_text(m["title"], m["url"], m["summary"], F.col("_note")), F.lit("")),
                      F.col("text"))
    return _reembedded(j.withColumn("_text", F.when(F.col("_hit"), text)), embedder, model or HASH_MODEL, now,
                       m.withField("notes", F.col("_note")))


def _reembedded(df: DataFrame, embedder, model: str, now: Column, metadata: Column | None = None) -> DataFrame:
    """Records with a `_text` get it with a new vector, where the model succeeds: one projection, one call per record."""
    from vellum.operators.embed import embed_udf

    df = df.withColumn("_e", embed_udf(embedder, skip_null=True)(F.col("_text")))
    hit = F.col("_text").isNotNull() & F.coalesce(F.col("_e.success"), F.lit(False))
    new = {"text": F.col("_text"), "embedding": F.col("_e.embedding"), "dimensions": F.size("_e.embedding"), "model": F.lit(model),
           "ts": now, "updated_at": now} | ({"metadata": metadata} if metadata is not None else {})
    return normalize_metadata(df.select(*[
        (F.when(hit, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)) if f.name in new else F.col(f.name)).alias(f.name)
        for f in LIBRARY_SCHEMA.fields]))


def stale_model(df: DataFrame, selected: str) -> DataFrame:
    """Records whose model is not the selected one (null model counts as stale)."""
    return df.where(~F.coalesce(F.col("model") == selected, F.lit(False)))


def regenerate_all(current: DataFrame, selected: str | None = None, embedder=None, model: str | None = None,
                   now: Column | None = None) -> DataFrame:
    """M7: recompose (else old text), re-embed, patch text/embedding/dimensions/model/ts; metadata untouched.

    With `selected` set only stale records (J4) are re-embedded; the
    reference re-embeds everything, which is `selected=None`.
    """
    from vellum.operators.embed import HASH_MODEL

    now = now if now is not None else F.current_timestamp()
    m = F.col("metadata")
    text = F.coalesce(F.nullif(P.compose_text(m["title"], m["url"], m["summary"], m["notes"]), F.lit("")),
                      F.col("text"))
    stale = F.lit(True) if selected is None else ~F.coalesce(F.col("model") == selected, F.lit(False))
    return _reembedded(current.withColumn("_text", F.when(stale, text)), embedder, model or HASH_MODEL, now)


def library_card(lib: DataFrame) -> DataFrame:
    """The library view, one row per record, newest first."""
    from vellum.plans.derived import millis

    m = F.col("metadata")
    cards = lib.select(
        "id",
        P.record_kind(m["url"]).alias("kind"),
        P.display_title(m["title"], F.col("text")).alias("title_line"),
        P.short_url(m["url"], P.LIBRARY_URL_PATH_CUT, P.LIBRARY_URL_RAW_CUT).alias("url_line"),
        P.has_summary(m["summary"]).alias("has_summary"),
        P.truncate_text(P.note_preview(m["notes"]), 220).alias("note_line"),
        P.truncate_text(F.col("text"), 200).alias("text_line"),
        P.short_model(F.col("model")).alias("model_chip"),
        F.concat(F.col("dimensions").cast("string"), F.lit("d")).alias("dim_chip"),
        millis(F.col("ts")).alias("ts_ms"),
    )
    return cards.orderBy(F.col("ts_ms").desc_nulls_last(), "id")


def result_card(hits: DataFrame) -> DataFrame:
    """The search view over scored records (similarity + record columns)."""
    m = F.col("metadata")
    return hits.select(
        "qid", "id", "rank",
        P.match_percent(F.col("sim")).alias("match"),
        F.when(P.truthy(m["url"]), F.lit("Bookmark")).alias("badge"),
        P.display_title(m["title"], F.col("text"), "search").alias("title_line"),
        F.when(P.truthy(m["notes"]), P.truncate_text(m["notes"], 180)).alias("note_line"),
        F.when(P.truthy(m["url"]), P.short_url(m["url"], P.SEARCH_URL_PATH_CUT, P.SEARCH_URL_RAW_CUT)).alias("url_line"),
    )
