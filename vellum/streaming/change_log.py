"""T1 as a levelled log: a micro-batch reads what its keys touch, not the library.

Every key's newest entry says which event it stands at, which record is its
own, and, once changed, the record itself.  Entries lie in runs.  A run is
dealt into slots by the leading bits of the key's hash, as many as its rows ask
for, so that each slot is a narrow range of hashes in a folder of its own, and
has a Bloom filter over its keys.  The bottom run is an index of the library's
bookmark ids; a micro-batch adds a run on top; FAN runs of a level are merged
into one of the next, so that an entry is rewritten once a level.

A micro-batch looks its keys up in the filters, reads the slots that may hold
them, and nothing else of the log or the library.  The manifest of a batch
lists its runs and is written last: a batch that fails, or is run again, leaves
the state before it as it was.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.library import LIBRARY_COLUMNS, LIBRARY_SCHEMA, METADATA_TYPE, sized_broadcast
from vellum.sources.library_io import scan_library, write_library
from vellum.streaming.changes import (_list_dirs, change_delta, latest_per_key, page_summaries, read_changes_batch, read_changes_stream)

#: Rows of a slot on average, at most.
SLOT_ROWS = 4096
#: Runs of a level that are merged into one of the next.
FAN = 4
#: Bloom filter of a slot: bitmaps of 32,768 bits, and bits per key.
BITMAP_BITS, BITMAPS, PROBES = 32768, 4, 4
#: Slots that are named in a scan's filter at most; beyond them a run is read whole and joined.
MAX_NAMED = 10_000
MAX_BITS = 30

ENTRY = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("h", T.LongType()), T.StructField("batch", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("live", T.BooleanType()), T.StructField("metadata", METADATA_TYPE),
    T.StructField("record", T.StructType([T.StructField(f.name, f.dataType) for f in LIBRARY_SCHEMA.fields])),
])
_RUN = "run string, level int, bits int, rows long, base string"


@dataclass(frozen=True)
class Run:
    run: str
    level: int  # the bottom run has level -1
    bits: int
    rows: int
    base: str


def _slot(h: Column, bits: int) -> Column:
    return (F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0)).cast("long")


def _probes(h: Column) -> Column:
    """The bits of a key in its slot's filter."""
    return F.array(*[F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BITMAP_BITS * BITMAPS)) for i in range(PROBES)])


def newest(entries: DataFrame) -> DataFrame:
    """One entry per key: the one of the latest batch."""
    cols = [f.name for f in ENTRY.fields if f.name != "key"]
    return entries.groupBy("key").agg(F.max_by(F.struct(*cols), "batch").alias("e")).select("key", "e.*")


class ChangeLog:
    """The log at `root` over the library snapshot `base` (a path written by `write_library`)."""

    def __init__(self, spark: SparkSession, root: str, base: str):
        self.spark, self.root = spark, root
        if not self._manifests():
            found = scan_library(base, spark)
            first = found.where(F.col("metadata.bookmark_id").isNotNull()).groupBy(F.col("metadata.bookmark_id").alias("key")) \
                .agg(F.min_by(F.struct("id", "metadata"), "id").alias("r"))
            index = self._entries(first, {"batch": F.lit(-1), "id": F.col("r.id"), "live": F.lit(True), "metadata": F.col("r.metadata")})
            self._commit("start", [self._write(index, "index-start", -1, found.count(), base)])

    # ---- manifests

    def _manifests(self, before: int | None = None) -> list[tuple[int, int, str]]:
        """(batch, version, folder) of the committed manifests, oldest first."""
        out = []
        for name in _list_dirs(self.spark, os.path.join(self.root, "manifest")):
            batch, _, version = name.partition(".")
            at = (-1 if batch == "start" else int(batch), int(version or 0), name)
            if (before is None or at[0] < before) and self._exists(os.path.join("manifest", name, "_SUCCESS")):
                out.append(at)
        return sorted(out)

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs that the newest manifest lists, of batches before `before`."""
        name = self._manifests(before)[-1][2]
        rows = self.spark.read.schema(_RUN).parquet(os.path.join(self.root, "manifest", name)).collect()  # a row a run
        return sorted((Run(**r.asDict()) for r in rows), key=lambda r: (-r.level, r.run))

    def _commit(self, name: str, runs: list[Run]) -> None:
        rows = self.spark.createDataFrame([(r.run, r.level, r.bits, r.rows, r.base) for r in runs], _RUN)
        rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(self.root, "manifest", name))

    # ---- runs

    @staticmethod
    def _entries(df: DataFrame, given: dict[str, Column]) -> DataFrame:
        cols = {"key": F.col("key"), "h": F.xxhash64("key")} | given
        return df.select(*[cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY.fields])

    def _write(self, entries: DataFrame, name: str, level: int, most: int, base: str) -> Run:
        """Store entries (at most `most`, of distinct keys) as a run with its filters."""
        bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, most / SLOT_ROWS)))))
        path = os.path.join(self.root, "run", name)
        placed = entries.withColumn("slot", _slot(F.col("h"), bits))
        placed.repartition("slot").sortWithinPartitions("slot", "h").write.mode("overwrite").partitionBy("slot").parquet(path)
        held = self._read(Run(name, level, bits, 0, base)).select("slot", "h")
        probes = held.select("slot", F.explode(_probes(F.col("h"))).alias("bit"))
        bitmaps = probes.groupBy("slot", F.expr(f"bit div {BITMAP_BITS}").alias("bitmap")).agg(
            F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bits"))
        sizes = held.groupBy("slot").agg(F.count("*").alias("rows"))
        bitmaps.join(sizes, "slot").repartitionByRange("slot").sortWithinPartitions("slot").write.mode("overwrite") \
            .parquet(os.path.join(self.root, "bloom", name))
        return Run(name, level, bits, held.count(), base)

    def _read(self, run: Run, slots: list[int] | None = None) -> DataFrame:
        schema = T.StructType([*ENTRY.fields, T.StructField("slot", T.LongType())])
        rows = self.spark.read.schema(schema).parquet(os.path.join(self.root, "run", run.run))
        return rows if slots is None else rows.where(F.col("slot").isin(slots))

    def _may_hold(self, keys: DataFrame, runs: list[Run]) -> DataFrame:
        """(run, slot, key, rows) for every key that a run's filters don't exclude; `rows` are the slot's."""
        out = None
        for run in runs:
            asked = keys.select("key", _slot(F.col("h"), run.bits).alias("slot"), F.explode(_probes(F.col("h"))).alias("bit"))
            asked = asked.select("key", "slot", F.expr(f"bit div {BITMAP_BITS}").alias("bitmap"), (F.col("bit") % BITMAP_BITS).cast("int").alias("bit"))
            filters = self.spark.read.schema("slot long, bitmap long, bits binary, rows long").parquet(os.path.join(self.root, "bloom", run.run))
            byte = F.conv(F.hex(F.expr("substring(bits, bit div 8 + 1, 1)")), 16, 10).cast("int")
            found = asked.join(filters, ["slot", "bitmap"]).where(F.getbit(byte, F.col("bit") % 8) == 1)
            found = found.groupBy("slot", "key").agg(F.count("*").alias("n"), F.first("rows").alias("rows")).where(F.col("n") == PROBES)
            found = found.select(F.lit(run.run).alias("run"), "slot", "key", "rows")
            out = found if out is None else out.unionByName(found)
        return out

    def lookup(self, keys: DataFrame, before: int | None = None) -> tuple[DataFrame, dict[str, int]]:
        """(the newest entry of each of `keys` (key) that has one; what was read: runs, slots, rows)."""
        runs = self.runs(before)
        keys = keys.select("key", F.xxhash64("key").alias("h"))
        hits = self._stored(self._may_hold(keys, runs), "hits")
        named = hits.groupBy("run", "slot").agg(F.first("rows").alias("rows"))
        slots = named.limit(MAX_NAMED + 1).collect()
        whole = len(slots) > MAX_NAMED
        out = self.spark.createDataFrame([], ENTRY)
        for run in runs:
            wanted = [r["slot"] for r in slots if r["run"] == run.run]
            if wanted or whole:
                rows = self._read(run, None if whole else wanted).drop("slot")
                out = out.unionByName(rows.join(sized_broadcast(hits.where(F.col("run") == run.run).select("key")), "key", "left_semi"))
        read = {"runs": len({r["run"] for r in slots}), "slots": len(slots), "rows": sum(r["rows"] for r in slots)}
        if whole:
            read = {"runs": len(runs), "slots": sum(1 << r.bits for r in runs), "rows": sum(r.rows for r in runs)}
        return newest(out), read

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written to scratch, so that it is worked out once."""
        from vellum.session import scratch_path

        path = scratch_path(self.spark, f"log-{name}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # ---- changes

    def apply(self, batch: DataFrame, batch_id: int, embedder=None, pages: DataFrame | None = None, model: str | None = None,
              now: Column | None = None) -> dict[str, int]:
        """Fold a micro-batch of change events into the log; returns what it read. Applying it again changes nothing.

        Of a key's events the last effective one counts, and none that is not
        newer than the key's entry.  The model sees each text once.
        """
        events = self._stored(latest_per_key(read_changes_batch(batch)), "events")
        found, read = self.lookup(events, batch_id)
        prev = self._stored(found.select("key", *[F.col(c).alias(f"_{c}") for c in ("ts", "event_id", "id", "live", "metadata", "record")]), "prev")
        late = F.struct("ts", "event_id") <= F.struct("_ts", "_event_id")
        newer = events.join(prev, "key", "left").where(F.col("_event_id").isNull() | ~F.coalesce(late, F.lit(False)))
        state = newer.select("key", (F.col("op") != "removed").alias("live"), "title", "url", "ts", "event_id", "op")
        matches = newer.select("key", F.col("_id").alias("id"))
        old = newer.where(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), F.col("_metadata").alias("metadata"))
        summaries = page_summaries(state.where("live"), pages) if pages is not None else None
        delta = self._stored(change_delta(matches, old, state, embedder, now, summaries, model), "delta")

        record = F.struct(*[F.col(c) for c in LIBRARY_COLUMNS]).alias("new")
        inserted = delta.where("_kind = 'insert'").select(F.col("metadata.bookmark_id").alias("key"), "_kind", record)
        others = delta.where("_kind <> 'insert'").join(matches.where("id IS NOT NULL"), "id").select("key", "_kind", record)
        done = newer.join(inserted.unionByName(others), "key", "left")
        written = F.coalesce(F.col("_kind").isin("insert", "patch"), F.lit(False))
        gone = F.coalesce(F.col("_kind") == "delete", F.lit(False))
        entries = self._entries(done, {
            "batch": F.lit(batch_id), "ts": F.col("ts"), "event_id": F.col("event_id"), "op": F.col("op"),
            "id": F.when(written, F.col("new.id")).otherwise(F.col("_id")),
            "live": F.when(written, True).when(gone, False).otherwise(F.coalesce("_live", F.lit(False))),
            "metadata": F.when(written, F.col("new.metadata")).otherwise(F.col("_metadata")),
            "record": F.when(written, F.col("new")).when(~gone, F.col("_record"))})
        runs = self.runs(batch_id)
        runs.append(self._write(entries, f"batch-{batch_id}", 0, events.count(), runs[0].base))
        self._commit(str(batch_id), self._merged(runs, batch_id))
        return read

    def _merged(self, runs: list[Run], batch_id: int) -> list[Run]:
        """Runs after merging every level that has FAN of them; the bottom run stays."""
        level = 0
        while any(r.level >= level for r in runs):
            same = [r for r in runs if r.level == level]
            if len(same) >= FAN:
                rows = self._read(same[0])
                for r in same[1:]:
                    rows = rows.unionByName(self._read(r))
                one = self._write(newest(rows.drop("slot")), f"level-{level + 1}-to-{batch_id}", level + 1, sum(r.rows for r in same), same[0].base)
                runs = [r for r in runs if r.level != level] + [one]
            level += 1
        return runs

    def view(self, before: int | None = None) -> DataFrame:
        """The library with all changes: base records that no entry replaces or deletes, and the entries' records."""
        runs = self.runs(before)
        base = scan_library(runs[0].base, self.spark)
        changed = [self._read(r).drop("slot") for r in runs if r.level >= 0]
        if not changed:
            return base
        rows = changed[0]
        for r in changed[1:]:
            rows = rows.unionByName(r)
        last = newest(rows).where(F.col("id").isNotNull() & (F.col("record").isNotNull() | ~F.col("live")))
        kept = base.join(sized_broadcast(last.select("id")), "id", "left_anti")
        return kept.unionByName(last.where(F.col("live")).select("record.*"))

    def compact(self, out: str) -> str:
        """Fold all changes into a new snapshot at `out`; the log goes on from it with one run.

        Between two batches of a stream.  Entries keep the events that they
        stand at, so that a late older event still changes nothing, and what a
        deleted key would be revived from.
        """
        write_library(self.view(), out)
        runs = self.runs()
        rows = self._read(runs[0])
        for r in runs[1:]:
            rows = rows.unionByName(self._read(r))
        bottom = newest(rows.drop("slot")).withColumn("record", F.lit(None).cast(ENTRY["record"].dataType))
        at, version, _ = self._manifests()[-1]
        name = "start" if at < 0 else str(at)
        self._commit(f"{name}.{version + 1}", [self._write(bottom, f"index-{name}.{version + 1}", -1, sum(r.rows for r in runs), out)])
        return out


def run_logged_stream(spark: SparkSession, source: str, base: str, root: str, checkpoint: str, max_files_per_trigger: int | None = None,
                      embedder=None, pages: DataFrame | None = None, model: str | None = None) -> tuple[DataFrame, list[dict[str, int]]]:
    """T1 end to end: change files -> micro-batches -> log; the library view after them, and what each batch read."""
    log, read = ChangeLog(spark, root, base), []

    def write(batch: DataFrame, batch_id: int) -> None:
        read.append({"batch_id": batch_id} | log.apply(batch, batch_id, embedder, pages, model))

    query = (read_changes_stream(spark, source, max_files_per_trigger).writeStream.foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return log.view(), read
