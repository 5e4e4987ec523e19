"""T4, T5 and T6 as one stateful stream: running counters of every task run, whatever order its items arrive in.

A run's items are numbered when it starts (`seq`, 1 to `total`), as a task's
queue knows its length.  Per run the state holds the next number due, the
counters up to it, and the items that came early, in blocks of numbers.  A
micro-batch moves the counters on over all items that are now without a gap,
so that each item's row is emitted once, with the same counters as the batch
query `running_progress` gives it.  State lives in the checkpoint: a restarted
query goes on where it stopped, and items that a source delivers again are
known by their number and dropped.

Runs are dealt by hash to shards, the keys of the stream, and within a shard
to pages, the entries of its state: many short runs share a call, a frame and
an entry, and a micro-batch reads and writes the pages of its runs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ITEM_SCHEMA = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("task", T.StringType()), T.StructField("seq", T.LongType()),
                            T.StructField("total", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("status", T.StringType()),
                            T.StructField("error", T.StringType()), T.StructField("thrown", T.BooleanType()), T.StructField("ts", T.TimestampType())])

PROGRESS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("task", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("pos", T.LongType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("thrown", T.BooleanType()), T.StructField("total", T.LongType()), T.StructField("processed", T.LongType()),
    T.StructField("success_count", T.LongType()), T.StructField("skipped_count", T.LongType()), T.StructField("failed_count", T.LongType()),
    T.StructField("lost_count", T.LongType()),
    T.StructField("rose", T.BooleanType()),     # T5: the success count is above every earlier one while the run goes on
    T.StructField("changed", T.BooleanType()),  # T6: the status differs from the item's before
])

#: Numbers in a block of early items; a block of a page is one entry of the state.
SEQ_BLOCK = 4096
#: Keys of the stream, and pages of runs in each; fixed for the life of a checkpoint.
SHARDS = 1024
PAGES = 8
#: Items of a shard that are handled at once, and blocks of a run that are read ahead at most.
HANDLED_ROWS = 1 << 19
AHEAD = 64
_ITEM = ["seq", "pos", "status", "error", "thrown"]
#: Where a run stands: next number due, counters, items given up, status of the item before, task, total and early items.
_COUNTS = ["due", "success", "skipped", "failed", "lost", "total", "held"]
_RUNS = pa.schema([("run_id", pa.int64())] + [(n, pa.int64()) for n in _COUNTS] + [("last", pa.string()), ("task", pa.string())])
_EARLY = pa.schema([("run_id", pa.int64()), ("seq", pa.int64()), ("pos", pa.int64()), ("status", pa.string()), ("error", pa.string()),
                    ("thrown", pa.bool_())])
_WAITS = pa.schema([("run_id", pa.int64()), ("page", pa.int64())])
#: Entries of the state are Arrow record batches of these columns.
_ENTRY = T.StructType([T.StructField("rows", T.BinaryType())])


def _objects(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    out = np.empty(len(column), dtype=object)
    out[:] = column.to_pylist()
    return out


def _passed(at: dict, i: np.ndarray, items: pa.Table) -> pd.DataFrame:
    """Progress rows of `items`, of runs `i` in order, whose numbers follow on from `at` without a gap; `at` goes on past them."""
    seq, status = items["seq"].to_numpy(), _objects(items["status"])
    head = np.r_[True, i[1:] != i[:-1]]
    first = np.flatnonzero(head)
    last, of, runs = np.r_[first[1:], len(i)] - 1, np.cumsum(head) - 1, i[first]

    def upto(flags: np.ndarray, name: str) -> np.ndarray:
        c = np.cumsum(flags)
        return at[name][i] + c - (c - flags)[first][of]

    failed = (status == "failure").astype(bool) | items["thrown"].fill_null(False).to_numpy()
    skipped = (status == "skip").astype(bool) & ~failed
    success = ~failed & ~skipped
    before = np.r_[at["last"][:1], status[:-1]]
    before[first] = at["last"][runs]
    changed = (before != status).astype(bool)
    changed[first[at["due"][runs] - at["lost"][runs] == 1]] = True  # nothing came before the first item, not even a null status
    out = items.select(_ITEM).to_pandas(integer_object_nulls=True)
    out["task"], out["total"] = at["task"][i], at["total"][i]
    out["success_count"], out["skipped_count"], out["failed_count"] = upto(success, "success"), upto(skipped, "skipped"), upto(failed, "failed")
    out["lost_count"] = at["lost"][i]
    out["processed"] = seq - at["lost"][i]
    out["rose"] = success & (seq < at["total"][i])
    out["changed"] = changed
    at["due"][runs] = seq[last] + 1
    for name in ("success", "skipped", "failed"):
        at[name][runs] = out[f"{name}_count"].to_numpy()[last]
    at["last"][runs] = status[last]
    return out


def advance(at: dict, items: pd.DataFrame) -> tuple[dict, pd.DataFrame]:
    """Counters after each of one run's `items`, whose numbers follow on from `at` without a gap; the state after the last."""
    some = {n: np.array([v], dtype=object if n in ("last", "task") else np.int64) for n, v in at.items()}
    schema = pa.schema([_EARLY.field(n) for n in _ITEM])
    out = _passed(some, np.zeros(len(items), np.int64), pa.Table.from_pandas(items[_ITEM], schema=schema, preserve_index=False))
    return {n: v[0] if n in ("last", "task") else int(v[0]) for n, v in some.items()}, out


class ItemProgress(StatefulProcessor):
    """The runs of one shard.  `patience_ms`: how long after the newest event time of its early items a run's gap is waited for; None: for ever."""

    def __init__(self, patience_ms: int | None = None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        key = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
        self.runs = handle.getMapState("runs", key("page"), _ENTRY)
        self.early = handle.getMapState("early", key("page", "block"), _ENTRY)
        self.waits = handle.getMapState("waits", key("ms"), _ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest: dict[tuple[int, int], int] = {}
        for part in _joined(rows):
            if self.patience_ms is not None:
                for run, ts in part.groupby(["run_id", "page"])["ts"].max().dropna().items():
                    newest[run] = max(newest.get(run, 0), int(ts.timestamp() * 1000))
            pages, run, seq = (part[c].to_numpy(np.int64) for c in ("page", "run_id", "seq"))
            at = self._runs_of(np.unique(pages))
            self._begin(at, part, run)
            i = at["index"].get_indexer(run)
            due = np.flatnonzero((seq >= at["due"][i]) & (seq <= at["total"][i]))  # others are passed already or out of range
            yield from self._move(at, i[due], _items(part.iloc[due]), np.unique(i))
            self._store(at)
        if newest:
            at = self._runs_of(np.unique([page for _, page in newest]))
            i = at["index"].get_indexer([run for run, _ in newest])
            self._wait(at, i, np.array(list(newest.values()), np.int64) + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The wait for a gap of some runs is over: its items count as lost, and the early ones after it follow."""
        ms = int(expiredTimerInfo.getExpiryTimeInMs())
        who = self._get(self.waits, (ms,), _WAITS)
        if who is None:
            return
        self.waits.removeKey((ms,))
        at = self._runs_of(np.unique(who["page"].to_numpy()))
        i = at["index"].get_indexer(who["run_id"].to_numpy())
        i = i[at["held"][i] > 0]
        for k in i:
            first = self._first_early(int(at["page"][k]), int(at["run_id"][k]))
            at["lost"][k] += first - at["due"][k]
            at["due"][k] = first
        yield from self._move(at, i[:0], _EARLY.empty_table(), i)
        self._store(at)
        self._wait(at, i, np.full(len(i), ms + self.patience_ms))

    def close(self) -> None:
        pass

    # ---- state

    @staticmethod
    def _get(state, key: tuple, schema: pa.Schema) -> pa.Table | None:
        if not state.containsKey(key):
            return None
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(state.getValue(key)[0])), schema)])

    @staticmethod
    def _put(state, key: tuple, rows: pa.Table) -> None:
        state.updateValue(key, (rows.combine_chunks().to_batches()[0].serialize().to_pybytes(),))

    def _runs_of(self, pages: np.ndarray) -> dict:
        """All runs of `pages`, a column each; `index` finds a run's row, `stored` tells pages whose entry is behind."""
        found = [(p, self._get(self.runs, (int(p),), _RUNS)) for p in pages]
        rows = pa.concat_tables([_RUNS.empty_table()] + [t for _, t in found if t is not None])
        at = {n: rows[n].to_numpy().copy() for n in ("run_id", *_COUNTS)} | {n: _objects(rows[n]) for n in ("last", "task")}
        at["page"] = np.repeat(np.array([p for p, _ in found], np.int64), [0 if t is None else len(t) for _, t in found])
        return at | {"index": pd.Index(at["run_id"]), "behind": set()}

    @staticmethod
    def _begin(at: dict, part: pd.DataFrame, run: np.ndarray) -> None:
        """Rows for the runs of `part` that the state does not know; the first item tells task and total."""
        new = np.flatnonzero(at["index"].get_indexer(run) < 0)
        if not len(new):
            return
        new = new[np.sort(np.unique(run[new], return_index=True)[1])]
        some = part.iloc[new]
        zero, none = np.zeros(len(new), np.int64), np.full(len(new), None, dtype=object)
        rows = {n: zero for n in _COUNTS} | {"run_id": run[new], "page": some["page"].to_numpy(np.int64), "due": zero + 1,
                                             "total": some["total"].to_numpy(np.int64), "last": none,
                                             "task": _objects(pa.array(some["task"], pa.string(), from_pandas=True))}
        for n, v in rows.items():
            at[n] = np.concatenate([at[n], v])
        at["index"] = pd.Index(at["run_id"])
        at["behind"].update(rows["page"].tolist())

    def _store(self, at: dict) -> None:
        for page in at["behind"]:
            of = np.flatnonzero(at["page"] == page)
            self._put(self.runs, (int(page),), pa.table([pa.array(at[f.name][of], f.type) for f in _RUNS], schema=_RUNS))
        at["behind"] = set()

    def _move(self, at: dict, i: np.ndarray, items: pa.Table, runs: np.ndarray) -> Iterator[pd.DataFrame]:
        """Hold `items` of the runs `i`, and pass over those of `runs` from the number due on, as far as there is no gap.

        Of equal numbers the first counts.  Blocks that items fall into or that
        hold a run's next number are read; those after them once it gets there.
        """
        had: dict[tuple[int, int], int] = {}
        new = np.ones(len(i), bool)
        want = set(zip(at["page"][i].tolist(), (items["seq"].to_numpy() // SEQ_BLOCK).tolist()))
        ahead, grown = 1, set()
        while True:
            want |= {(int(at["page"][k]), b) for k in runs if at["due"][k] <= at["total"][k]
                     for b in range(int(at["due"][k]) // SEQ_BLOCK, min(int(at["due"][k]) // SEQ_BLOCK + ahead, int(at["total"][k]) // SEQ_BLOCK + 1))}
            want -= had.keys()
            if not want:
                break
            found = {k: self._get(self.early, k, _EARLY) for k in sorted(want)}
            had |= {k: 0 if t is None else len(t) for k, t in found.items()}
            held = pa.concat_tables([_EARLY.empty_table()] + [t for t in found.values() if t is not None])
            i = np.concatenate([at["index"].get_indexer(held["run_id"].to_numpy()), i])
            new = np.concatenate([np.zeros(len(held), bool), new])
            items = pa.concat_tables([held, items])
            seq = items["seq"].to_numpy()
            order = np.lexsort((seq, i))  # stable: what was held comes before what came, and that in its order
            so, no = i[order], seq[order]
            order = order[np.r_[True, (so[1:] != so[:-1]) | (no[1:] != no[:-1])]] if len(order) else order
            i, new, items = i[order], new[order], items.take(pa.array(order))
            seq = items["seq"].to_numpy()
            head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
            nth = np.arange(len(i)) - np.repeat(head, np.diff(np.r_[head, len(i)]))
            ready = seq - at["due"][i] == nth
            runs, came = np.unique(i[ready]), i[ready & ~new]
            if len(runs):
                at["behind"].update(at["page"][runs].tolist())
                np.subtract.at(at["held"], came, 1)
                grown.update(zip(at["page"][came].tolist(), (seq[ready & ~new] // SEQ_BLOCK).tolist()))
                of = i[ready]
                yield self._rows(at, of, _passed(at, of, items.filter(pa.array(ready))))
                i, new, items = i[~ready], new[~ready], items.filter(pa.array(~ready))
            ahead, want = min(2 * ahead, AHEAD), set()
        np.add.at(at["held"], i[new], 1)
        at["behind"].update(at["page"][i[new]].tolist())
        page, block = at["page"][i], items["seq"].to_numpy() // SEQ_BLOCK
        grown.update(zip(page[new].tolist(), block[new].tolist()))
        order = np.lexsort((block, page))
        page, block, items = page[order], block[order], items.take(pa.array(order))
        cuts = np.flatnonzero(np.r_[True, (page[1:] != page[:-1]) | (block[1:] != block[:-1])]) if len(page) else []
        left = {(int(page[a]), int(block[a])): items.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], len(page)])}
        for k in sorted(grown):
            if k in left:
                self._put(self.early, k, left[k])
            elif had[k]:
                self.early.removeKey(k)

    def _first_early(self, page: int, run: int) -> int:
        for _, block in sorted(k for k in self.early.keys() if k[0] == page):
            rows = self._get(self.early, (page, block), _EARLY)
            seq = rows["seq"].to_numpy()[rows["run_id"].to_numpy() == run]
            if len(seq):
                return int(seq.min())
        raise ValueError(f"run {run} holds no early items")

    def _wait(self, at: dict, i: np.ndarray, until: np.ndarray) -> None:
        """Timers for those of the runs `i` that still have a gap before early items."""
        gap = (at["due"][i] <= at["total"][i]) & (at["held"][i] > 0)
        for ms in np.unique(until[gap]).tolist():
            who = i[gap & (until == ms)]
            had = self._get(self.waits, (ms,), _WAITS) or _WAITS.empty_table()
            now = pa.table([pa.array(at[c][who], pa.int64()) for c in _WAITS.names], schema=_WAITS)
            self._put(self.waits, (ms,), pa.concat_tables([had, now]).group_by(_WAITS.names).aggregate([]).cast(_WAITS))
            self.handle.registerTimer(ms)

    @staticmethod
    def _rows(at: dict, i: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
        rows["run_id"] = at["run_id"][i]
        return rows[[f.name for f in PROGRESS_SCHEMA.fields]]


def _joined(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames, joined to about HANDLED_ROWS rows each."""
    some, n = [], 0
    for part in rows:
        some.append(part)
        n += len(part)
        if n >= HANDLED_ROWS:
            yield pd.concat(some, ignore_index=True)
            some, n = [], 0
    if some:
        yield pd.concat(some, ignore_index=True) if len(some) > 1 else some[0]


def _items(part: pd.DataFrame) -> pa.Table:
    cols = [pa.array(part[f.name], f.type, mask=part["no_pos"].to_numpy(bool)) if f.name == "pos" else
            pa.array(part[f.name], f.type, from_pandas=True) for f in _EARLY]
    return pa.table(cols, schema=_EARLY)


def item_progress_stream(items: DataFrame, patience: str | None = None) -> DataFrame:
    """The progress rows of a stream of items (ITEM_SCHEMA), in append mode.

    Without `patience` a gap is waited for, however long.  With it ("10
    minutes") event time counts: when the stream's newest time is that much
    past the newest of a run's early items, the missing ones are given up
    (`lost_count`) and the run goes on.  Rows without a run or a number are
    dropped.  A run's items are handled by one task, HANDLED_ROWS of them at a
    time; the state read and written is the pages of a micro-batch's runs and
    the blocks its items fall into or reach.
    """
    from vellum.streaming.changes import _micros

    items = items.where(F.col("run_id").isNotNull() & F.col("seq").isNotNull() & F.col("total").isNotNull())
    timed = patience is not None
    if timed:
        items = items.withWatermark("ts", patience)
    page = F.pmod(F.xxhash64("run_id"), F.lit(SHARDS * PAGES))
    cols = [F.coalesce(c, F.lit(0)).alias(c) if c == "pos" else F.col(c) for c in ITEM_SCHEMA.names if timed or c != "ts"]
    items = items.select((page % SHARDS).alias("shard"), page.alias("page"), F.col("pos").isNull().alias("no_pos"), *cols)
    processor = ItemProgress(_micros(patience) // 1000 if timed else None)
    return items.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=PROGRESS_SCHEMA, outputMode="Append", timeMode="EventTime" if timed else "None")


def emitted(progress: DataFrame) -> DataFrame:
    """T5 on the stream: rows at which the success count rose while the run went on."""
    return progress.where("rose")


def without_repeats(progress: DataFrame) -> DataFrame:
    """T6 on the stream: rows whose status differs from the item's before."""
    return progress.where("changed")


def numbered_items(items: DataFrame, order: str = "pos") -> DataFrame:
    """Items of finished runs in ITEM_SCHEMA: each run's items numbered by `order`, as its queue was."""
    from vellum.operators.progress import running_progress

    rows = running_progress(items, order=order)
    cols = {"seq": F.col("processed"), "total": F.col("total")}
    return rows.select(*[cols.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ITEM_SCHEMA.fields])


def run_item_progress(spark: SparkSession, source: str, out: str, checkpoint: str, max_files_per_trigger: int | None = 1,
                      patience: str | None = None) -> DataFrame:
    """All item files of `source` that are new, in micro-batches; returns the progress table written so far at `out`.

    The RocksDB state store keeps state on the executors' disks, with changes in the checkpoint folder.
    """
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        reader = spark.readStream.schema(ITEM_SCHEMA)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        query = (item_progress_stream(reader.parquet(source), patience).writeStream.format("parquet").outputMode("append")
                 .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    return spark.read.schema(PROGRESS_SCHEMA).parquet(out)
