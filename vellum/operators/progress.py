"""Task progress (A1-A9, T4-T6, U3, S10) over item-status tables.

An item table has one row per processed item: (run_id, task, pos, status,
error, thrown).  Counters are grouped aggregates (partial + final, so a run
holding a third of all items costs one partial row per partition).  Running
values are prefix sums computed in blocks of positions: block totals are
summed with a window over the (few) blocks of a run, then each block is
scanned on its own, so no window partition grows beyond one block even when a
single run dominates the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Status sentences per task (running; finished; cancelled).
TASK_TEXT = {
    "import": {
        "running": "Importing bookmarks... {processed}/{total} ({percent}%)",
        "finished": "Import complete! {success} imported, {skipped} skipped, {failed} failed",
        "cancelled": "Import cancelled. {success} imported, {skipped} skipped, {failed} failed",
    },
    "regeneration": {
        "running": "Re-generating embeddings... {processed}/{total} ({percent}%)",
        "finished": "Regeneration complete! {success} regenerated, {failed} failed",
        "cancelled": "Regeneration cancelled. {success} regenerated, {failed} failed",
    },
}
UNKNOWN_ERROR = "Unknown processing error"
BLOCK = 1 << 16


def _is_failed() -> Column:
    return (F.col("status") == "failure") | F.coalesce(F.col("thrown"), F.lit(False))


def _is_skipped() -> Column:
    return (F.col("status") == "skip") & ~_is_failed()


def _is_success() -> Column:
    return ~_is_failed() & ~_is_skipped()


def count_records(df: DataFrame) -> DataFrame:
    """A1: the record count."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def library_stats(df: DataFrame) -> DataFrame:
    """A2: count, size (sum of text lengths), rounded average dimension, oldest/newest time.

    An empty library gives 0, 0, 0, null, null; the average is always named
    `average_dimensions`.
    """
    from vellum.plans.derived import millis

    return df.agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("total_size"),
        F.coalesce(F.floor(F.avg("dimensions") + 0.5), F.lit(0)).cast("long").alias("average_dimensions"),
        F.min(millis(F.col("ts"))).alias("oldest_ms"),
        F.max(millis(F.col("ts"))).alias("newest_ms"),
    )


def task_counters(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A4: total, processed, success, skipped, failed per task run."""
    keys = keys or ["run_id", "task"]
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.lit(1)).alias("processed"),
        F.count_if(_is_success()).alias("success"),
        F.count_if(_is_skipped()).alias("skipped"),
        F.count_if(_is_failed()).alias("failed"),
    )


def task_error(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A5: the last thrown error, else the first returned failure's error."""
    keys = keys or ["run_id", "task"]
    thrown_msg = F.coalesce(F.col("error"), F.lit(UNKNOWN_ERROR))
    it = items.select(*keys, "pos",
                      F.when(F.col("thrown"), thrown_msg).alias("_thrown"),
                      F.when((F.col("status") == "failure") & ~F.col("thrown") & F.col("error").isNotNull()
                             & (F.col("error") != ""), F.col("error")).alias("_returned"),
                      F.when(F.col("thrown"), F.col("pos")).alias("_tpos"),
                      F.when((F.col("status") == "failure") & ~F.col("thrown") & F.col("error").isNotNull()
                             & (F.col("error") != ""), F.col("pos")).alias("_rpos"))
    agg = it.groupBy(*keys).agg(F.max_by("_thrown", "_tpos").alias("_t"), F.min_by("_returned", "_rpos").alias("_r"))
    return agg.select(*keys, F.coalesce("_t", "_r").alias("error"))


def percent(processed: Column, total: Column) -> Column:
    """Math.round(processed / total * 100); 0 when total is 0."""
    return F.when(total > 0, F.floor(processed * 100.0 / total + 0.5)).otherwise(F.lit(0)).cast("long")


def running_progress(items: DataFrame, part: str = "run_id", order: str = "pos", block: int = BLOCK) -> DataFrame:
    """T4: cumulative counters after every item of a run, by position.

    Two-level scan: block totals -> exclusive prefix per block (window over
    blocks) -> running sum inside each block (window over one block).
    """
    flags = items.withColumn("_b", F.floor(F.col(order) / block)) \
        .withColumn("_s", _is_success().cast("long")).withColumn("_k", _is_skipped().cast("long")) \
        .withColumn("_f", _is_failed().cast("long"))
    blocks = flags.groupBy(part, "_b").agg(F.count(F.lit(1)).alias("_bn"), F.sum("_s").alias("_bs"),
                                           F.sum("_k").alias("_bk"), F.sum("_f").alias("_bf"))
    wb = Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(part)
    pre = blocks.select(part, "_b",
                        F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_pn"),
                        F.coalesce(F.sum("_bs").over(wb), F.lit(0)).alias("_ps"),
                        F.coalesce(F.sum("_bk").over(wb), F.lit(0)).alias("_pk"),
                        F.coalesce(F.sum("_bf").over(wb), F.lit(0)).alias("_pf"),
                        F.sum("_bn").over(wt).alias("total"))
    j = flags.join(pre, [part, "_b"])
    wi = Window.partitionBy(part, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(
        *[c for c in items.columns],
        F.col("total").cast("long").alias("total"),
        (F.col("_pn") + F.count(F.lit(1)).over(wi)).cast("long").alias("processed"),
        (F.col("_ps") + F.sum("_s").over(wi)).cast("long").alias("success_count"),
        (F.col("_pk") + F.sum("_k").over(wi)).cast("long").alias("skipped_count"),
        (F.col("_pf") + F.sum("_f").over(wi)).cast("long").alias("failed_count"),
    )


def blocked_lag(df: DataFrame, part: str, order: str, value: str, out: str, block: int = BLOCK,
                tie: str | None = None) -> DataFrame:
    """The previous row's `value` within `part` by (`order`, `tie`), computed per block of `order`.

    The last value of every block comes from a partial `max_by`; a window
    over the (few) blocks of a part carries it to the next block, and the
    lag inside a block only sees that block's rows.
    """
    keys = [F.col(order)] + ([F.col(tie)] if tie else [])
    b = df.withColumn("_b", F.floor(F.col(order) / block))
    last = b.groupBy(part, "_b").agg(F.max_by(value, F.struct(*keys)).alias("_last"))
    wb = Window.partitionBy(part).orderBy("_b")
    carry = last.select(part, "_b", F.lag("_last").over(wb).alias("_carry"))
    wi = Window.partitionBy(part, "_b").orderBy(*keys)
    j = b.join(carry, [part, "_b"])
    first_in_block = F.row_number().over(wi) == 1
    return j.withColumn(out, F.when(first_in_block, F.col("_carry")).otherwise(F.lag(value).over(wi))) \
        .drop("_b", "_carry")


def emit_on_increase(progress: DataFrame, part: str = "run_id", order: str = "pos", block: int = BLOCK) -> DataFrame:
    """T5: pass a running-progress row only when the success count is above every earlier one while the task runs.

    The count never falls within a run, so the row before holds the highest
    count so far, whether rows come per item or as snapshots of many items.
    """
    lagged = blocked_lag(progress, part, order, "success_count", "_prev", block)
    rose = F.col("success_count") > F.coalesce(F.col("_prev"), F.lit(0))
    return lagged.where(rose & (F.col("processed") < F.col("total"))).drop("_prev")


def suppress_repeats(df: DataFrame, part: str, order: str, key: str, block: int = BLOCK) -> DataFrame:
    """Drop a row whose key equals the previous row's key (null-safe)."""
    lagged = blocked_lag(df, part, order, key, "_prev", block)
    return lagged.where(~F.col("_prev").eqNullSafe(F.col(key))).drop("_prev")


def task_summary(counters: DataFrame, errors: DataFrame | None = None, is_processing: Column | None = None,
                 cancelled: Column | None = None) -> DataFrame:
    """The status sentence and its type (loading / error / success) per task run."""
    df = counters if errors is None else counters.join(errors, [c for c in ["run_id", "task"] if c in errors.columns],
                                                       "left")
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    proc = is_processing if is_processing is not None else F.col("processed") < F.col("total")
    canc = cancelled if cancelled is not None else F.lit(False)
    pct = percent(F.col("processed"), F.col("total"))

    cols = {"processed": F.col("processed"), "total": F.col("total"), "percent": pct,
            "success": F.col("success"), "skipped": F.col("skipped"), "failed": F.col("failed")}

    def fmt(template: str) -> Column:
        names = re.findall(r"\{(\w+)\}", template)
        pattern = re.sub(r"\{\w+\}", "%s", template.replace("%", "%%"))
        return F.format_string(pattern, *[cols[n].cast("string") for n in names])

    text = None
    for task, t in TASK_TEXT.items():
        sentence = F.when(proc, fmt(t["running"])).when(canc, fmt(t["cancelled"])) \
            .otherwise(fmt(t["finished"]))
        text = F.when(F.col("task") == task, sentence) if text is None else text.when(F.col("task") == task, sentence)
    kind = F.when(proc, "loading").when(F.col("error").isNotNull() & (F.col("error") != ""), "error").otherwise("success")
    return df.withColumn("text", text).withColumn("type", F.when(text.isNotNull(), kind))


def task_flags(progress: DataFrame, cancelled: Column | None = None) -> DataFrame:
    """Has-activity and has-remaining-work on each progress row."""
    canc = cancelled if cancelled is not None else F.lit(False)
    err = F.col("error").isNotNull() & (F.col("error") != "") if "error" in progress.columns else F.lit(False)
    proc = F.col("processed") < F.col("total")
    has_activity = proc | (F.col("processed") > 0) | err | canc
    remaining = proc | ((F.col("total") > 0) & (F.col("processed") < F.col("total")) & ~err & ~canc)
    return progress.withColumn("has_activity", has_activity).withColumn("has_remaining_work", remaining)


def task_state(counters: DataFrame, requested: DataFrame, current_task: Column | str) -> DataFrame:
    """Counters of the requested task if it is the current one, else its all-zero state."""
    cur = F.lit(current_task) if isinstance(current_task, str) else current_task
    j = requested.join(counters.where(F.col("task") == cur), requested["requested"] == counters["task"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select("requested", F.col("requested").alias("active_task"), z("total"), z("processed"), z("success"),
                    z("skipped"), z("failed"))


def observed_counters(items: DataFrame) -> DataFrame:
    """Counters as Observation metrics of a pass over the items, returned as one row."""
    from pyspark.sql import Observation

    obs = Observation("progress")
    watched = items.observe(obs, F.count(F.lit(1)).alias("processed"), F.count_if(_is_success()).alias("success"),
                            F.count_if(_is_skipped()).alias("skipped"), F.count_if(_is_failed()).alias("failed"))
    watched.write.format("noop").mode("overwrite").save()
    m = obs.get
    return items.sparkSession.createDataFrame(
        [(int(m["processed"]), int(m["success"]), int(m["skipped"]), int(m["failed"]))],
        "processed long, success long, skipped long, failed long")


def process_items(items: DataFrame, fn, keep: list[str]) -> DataFrame:
    """Run `fn(row_dict) -> {status, error}` per item; an exception is a failure with its message."""
    from pyspark.sql import types as T

    fields = [items.schema[c] for c in keep]
    schema = T.StructType(fields + [T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
                                    T.StructField("thrown", T.BooleanType())])

    def run(it):
        for pdf in it:
            st, er, th = [], [], []
            for rec in pdf.to_dict("records"):
                try:
                    r = fn(rec) or {}
                    s = r.get("status")
                    st.append(s if s in ("skip", "failure") else "success")
                    er.append(r.get("error"))
                    th.append(False)
                except Exception as exc:  # noqa: BLE001 - counted as failed, as the item loop does
                    st.append("failure")
                    er.append(str(exc) or UNKNOWN_ERROR)
                    th.append(True)
            out = pdf[keep].copy()
            out["status"], out["error"], out["thrown"] = st, er, th
            yield out

    return items.mapInPandas(run, schema)

