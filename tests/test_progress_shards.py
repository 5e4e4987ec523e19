"""Progress of many runs in one shard: calls and state follow pages, not runs; blocks, chunks, gaps and timers inside a shard."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_streams import COLS, item, progress_of


class Entries(dict):
    """A map state in memory."""

    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__  # noqa: N815


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Entries())

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def shard(patience_ms=None):
    from vellum.streaming.item_progress import ItemProgress
    processor = ItemProgress(patience_ms)
    processor.init(Handle())
    return processor


def frame(rows):
    """Items as a shard's call gets them; runs lie in two pages."""
    names = ["run_id", "task", "seq", "total", "pos", "status", "error", "thrown", "ts"]
    part = pd.DataFrame(rows, columns=names)
    return part.assign(page=part["run_id"] % 2, no_pos=part["pos"].isna(), pos=part["pos"].fillna(0).astype("int64"))


def rows_of(frames):
    return [dict(zip(f.columns, r)) for f in frames for r in f.itertuples(index=False)]


@pytest.fixture
def small(monkeypatch):
    from vellum.streaming import item_progress as module
    for name, n in (("SEQ_BLOCK", 4), ("HANDLED_ROWS", 11), ("AHEAD", 2)):
        monkeypatch.setattr(module, name, n)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_a_shard_in_any_order(small, seed):
    rng = random.Random(seed)
    runs = {r: [(100 * r + 3 * i, rng.choice(["success", "skip", "failure", None]), rng.choice([True, False, False, None])) for i in range(n)]
            for r, n in ((1, 70), (2, 9), (3, 1), (4, 33), (7, 4))}
    rows = [item(r, i, len(v), *x) for r, v in runs.items() for i, x in enumerate(v, 1)]
    rng.shuffle(rows)
    want = {r: progress_of(v) for r, v in runs.items()}
    processor, got, came = shard(), {r: [] for r in runs}, {r: set() for r in runs}
    for a in range(0, len(rows), 23):
        batch = rows[max(0, a - 5):a + 23] + rng.sample(rows[:a + 1], min(a, 4))  # some come again
        batch += [item(1, 0, 70, 5), item(1, 71, 70, 5)]  # out of range
        rng.shuffle(batch)
        for r in rows_of(processor.handleInputRows((0,), (frame(batch[b:b + 7]) for b in range(0, len(batch), 7)), None)):
            assert r["seq"] == r["processed"] and r["lost_count"] == 0 and r["total"] == len(runs[r["run_id"]]) and r["task"] == "import"
            got[r["run_id"]].append(tuple(r[c] for c in COLS))
        for r in batch:
            came[r[0]].add(r[2])
        for r, v in want.items():
            due = next(n for n in range(1, len(v) + 2) if n > len(v) or n not in came[r])
            assert sorted(got[r]) == sorted(v[:due - 1])  # as far as there is no gap
    assert {r: sorted(v) for r, v in got.items()} == {r: sorted(v) for r, v in want.items()}
    assert not processor.early and len(processor.runs) == 2


def test_gaps_of_a_shard_are_given_up_run_by_run(small):
    processor = shard(60_000)
    first = [item(1, 1, 20, 1), item(1, 19, 20, 9), item(2, 2, 5, 9), item(2, 4, 5, 8), item(3, 1, 2, 9)]
    got = rows_of(processor.handleInputRows((0,), iter([frame(first)]), None))
    assert sorted((r["run_id"], r["seq"]) for r in got) == [(1, 1), (3, 1)]
    (ms,) = processor.handle.timers  # both newest early items are of the same time; run 3 waits for none
    expire = lambda t: sorted((r["run_id"], r["seq"], r["processed"], r["lost_count"], r["changed"])
                              for r in rows_of(processor.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda: t))))
    assert expire(ms) == [(1, 19, 2, 17, False), (2, 2, 1, 1, True)]
    assert processor.handle.timers == [ms, ms + 60_000] and expire(ms) == []
    assert expire(ms + 60_000) == [(2, 4, 2, 2, False)]
    assert not processor.early and not processor.waits and len(processor.handle.timers) == 2


def test_state_entries_follow_the_pages_not_the_runs(spark, tmp_path, monkeypatch):
    from vellum.streaming import item_progress as module
    monkeypatch.setattr(module, "SHARDS", 4, raising=False)
    monkeypatch.setattr(module, "PAGES", 2, raising=False)
    src, n, conf = str(tmp_path / "src"), 600, "spark.sql.streaming.stateStore.providerClass"
    big = 2 ** 53
    rows = spark.range(n).selectExpr("id AS run_id", "explode(array(1L, 2L, 3L)) AS seq").selectExpr(
        "run_id", "'import' AS task", "seq", "3L AS total", f"if(seq = 3, NULL, {big} + 10 * run_id + seq) AS pos", "'success' AS status",
        "cast(NULL AS string) AS error", "false AS thrown", "timestamp'2024-01-01' AS ts")
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        entries = []
        for some in ("seq <> 2", "seq = 2"):
            rows.where(some).coalesce(1).write.mode("append").parquet(src)
            query = (module.item_progress_stream(spark.readStream.schema(module.ITEM_SCHEMA).parquet(src)).writeStream.format("parquet")
                     .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
            query.awaitTermination()
            entries.append(query.recentProgress[0].stateOperators[0].numRowsTotal)
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    assert max(entries) <= 2 * 2 * 4 * 2  # a row and its key's row for each page, of runs and of early items
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.where("processed = seq AND success_count = seq AND rose = (seq < 3) AND changed = (seq = 1)").count() == 3 * n
    assert got.where(F.when(F.col("seq") == 3, F.col("pos").isNull()).otherwise(F.expr(f"pos = {big} + 10 * run_id + seq"))).count() == 3 * n
