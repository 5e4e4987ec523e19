"""S10 / T4 in Structured Streaming: per-batch progress counters from `observe()`.

A stream of item statuses is observed with named metrics (processed,
success, skipped, failed); every micro-batch's values reach the driver
through a `StreamingQueryListener` and are folded into cumulative counters,
the snapshot the item loop broadcasts after each batch.  Only the metric
rows (one per batch) reach the driver, never the items.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from vellum.operators.progress import _is_failed, _is_skipped, _is_success

METRICS = "progress"
PROGRESS_WAIT_S = 30  # for the last batch's progress event, after the stream has ended


def observe_items(items: DataFrame, name: str = METRICS) -> DataFrame:
    """Attach the per-batch counters to a (streaming) item DataFrame."""
    return items.observe(name, F.count(F.lit(1)).alias("processed"), F.count_if(_is_success()).alias("success"),
                         F.count_if(_is_skipped()).alias("skipped"), F.count_if(_is_failed()).alias("failed"))


class ProgressListener(StreamingQueryListener):
    """Collects the observed counters of each micro-batch and keeps running totals."""

    def __init__(self, name: str = METRICS):
        self.name = name
        self.batches: list[dict] = []
        self.totals = {"processed": 0, "success": 0, "skipped": 0, "failed": 0}

    def onQueryStarted(self, event):  # noqa: N802 - Spark's callback names
        pass

    def onQueryProgress(self, event):  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        for k in self.totals:
            self.totals[k] += int(row[k] or 0)
        self.batches.append({"batch_id": event.progress.batchId, **{k: int(row[k] or 0) for k in self.totals},
                             **{f"total_{k}": v for k, v in self.totals.items()}})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


def run_progress_stream(spark: SparkSession, items_path: str, schema: str, checkpoint: str,
                        max_files_per_trigger: int = 1) -> DataFrame:
    """Stream item files in micro-batches and return one cumulative progress row per batch.

    Raises TimeoutError when the last batch's progress does not arrive.
    """
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger)) \
            .parquet(items_path)
        q = (observe_items(stream).writeStream.format("noop").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        # listener events arrive asynchronously: wait until the last batch's progress is in
        last = (q.lastProgress or {}).get("batchId")
        deadline = time.time() + PROGRESS_WAIT_S
        while last is not None and not any(b["batch_id"] == last for b in listener.batches) \
                and time.time() < deadline:
            time.sleep(0.05)
        if last is not None and not any(b["batch_id"] == last for b in listener.batches):
            raise TimeoutError(f"progress of batch {last} did not arrive in {PROGRESS_WAIT_S} s; the counts are not whole")
    finally:
        spark.streams.removeListener(listener)
    cols = "batch_id long, processed long, success long, skipped long, failed long, " \
           "total_processed long, total_success long, total_skipped long, total_failed long"
    return spark.createDataFrame([tuple(b[c.split()[0]] for c in cols.split(", ")) for b in listener.batches], cols)


def progress_writer(root: str):
    """`foreachBatch` function: cumulative counters after every micro-batch, kept in storage.

    The batch's counts (one aggregate row) are added to the newest snapshot
    below this batch id and written to `root/batch=<id>`; a restarted stream
    picks up the stored totals, and a replayed batch rewrites the same file.
    """
    import os

    from vellum.operators.progress import task_counters
    from vellum.streaming.changes import _batches

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cur = task_counters(batch.withColumn("_all", F.lit(1)), keys=["_all"]).drop("_all", "total")
        done = [b for b in _batches(spark, root) if b < batch_id]
        if done:
            prev = spark.read.parquet(os.path.join(root, f"batch={done[-1]}"))
            cur = cur.unionByName(prev.drop("batch_id")).agg(
                *[F.sum(c).alias(c) for c in ("processed", "success", "skipped", "failed")])
        cur = cur.select(F.lit(batch_id).cast("long").alias("batch_id"),
                         *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                           for c in ("processed", "success", "skipped", "failed")])
        cur.coalesce(1).write.mode("overwrite").parquet(os.path.join(root, f"batch={batch_id}"))

    return write
