"""Stateful streams: files in any order, restarts, repeated deliveries, gaps."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL


def progress_of(rows):
    """Counters by hand for one run's items, in order."""
    s = k = f = 0
    out, prev = [], object()
    for i, (pos, status, thrown) in enumerate(rows, 1):
        bad = status == "failure" or bool(thrown)
        skip = status == "skip" and not bad
        s, k, f = s + (not bad and not skip), k + skip, f + bad
        out.append((pos, i, s, k, f, not bad and not skip and i < len(rows), status != prev))
        prev = status
    return out


COLS = ["pos", "processed", "success_count", "skipped_count", "failed_count", "rose", "changed"]


def item(run, seq, total, pos, status="success", thrown=False, ts=None):
    return (run, "import", seq, total, pos, status, None, thrown, ts or dt.datetime(2024, 1, 1) + dt.timedelta(seconds=pos))


def test_advance_counts_and_flags():
    from vellum.streaming.item_progress import advance
    items = pd.DataFrame([[1, 10, "success", None, False], [2, 11, "success", None, True], [3, 12, None, None, None], [4, 13, "skip", None, False]],
                         columns=["seq", "pos", "status", "error", "thrown"])
    start = {"due": 1, "success": 0, "skipped": 0, "failed": 0, "lost": 0, "last": None, "task": "import", "total": 4}
    at, out = advance(start, items)
    assert out["success_count"].tolist() == [1, 1, 2, 2] and out["failed_count"].tolist() == [0, 1, 1, 1] and out["skipped_count"].tolist() == [0, 0, 0, 1]
    assert out["rose"].tolist() == [True, False, True, False] and out["changed"].tolist() == [True, False, True, True]
    assert (at["due"], at["success"], at["last"]) == (5, 2, "skip")
    half, first = advance(start, items[:2])
    _, second = advance(half, items[2:])
    assert pd.concat([first, second])["changed"].tolist() == out["changed"].tolist()


def test_progress_stream_over_restarts_and_repeats(spark, tmp_path, monkeypatch):
    from vellum.streaming import item_progress as module
    rng = random.Random(3)
    monkeypatch.setattr(module, "SEQ_BLOCK", 8)
    runs = {r: [(100 * r + 3 * i, rng.choice(["success", "skip", "failure"]), rng.random() < 0.1) for i in range(n)] for r, n in ((1, 40), (2, 7), (3, 1))}
    rows = [item(r, i, len(v), pos, status, thrown) for r, v in runs.items() for i, (pos, status, thrown) in enumerate(v, 1)]
    rng.shuffle(rows)
    rows += [(None, "import", 1, 1, 1, "success", None, False, None), (1, "import", None, 40, 1, "success", None, False, None)]
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))

    def deliver(some):
        spark.createDataFrame(some, module.ITEM_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def table():
        got = module.run_item_progress(spark, src, out, ckpt)
        return {r: sorted(tuple(x[c] for c in COLS) for x in got.where(f"run_id = {r}").collect()) for r in runs}

    want = {r: sorted(progress_of(v)) for r, v in runs.items()}
    deliver(rows[:14])
    first = table()
    assert all(set(first[r]).issubset({(*w[:5], w[5], w[6]) for w in want[r]}) for r in runs) and first != want
    deliver(rows[10:30])  # a new query on the same checkpoint; some items come again
    deliver(rows[30:])
    assert table() == want
    deliver(rows[:5])  # after the end
    assert table() == want


def test_progress_stream_gives_gaps_up(spark, tmp_path):
    from vellum.streaming.item_progress import ITEM_SCHEMA, run_item_progress
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))

    def deliver(some):
        spark.createDataFrame(some, ITEM_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        return run_item_progress(spark, src, out, ckpt, patience="60 seconds")

    assert deliver([item(1, 1, 6, 1), item(1, 4, 6, 4), item(1, 5, 6, 5)]).count() == 1
    late = dt.datetime(2024, 1, 1, 1)
    deliver([item(2, 1, 1, 1, ts=late)])
    got = deliver([item(2, 1, 1, 1, ts=late)])  # the watermark of the batch before has passed the wait
    rows = sorted((r["seq"], r["processed"], r["lost_count"]) for r in got.where("run_id = 1").collect())
    assert rows == [(1, 1, 0), (4, 2, 2), (5, 3, 2)]
    got = deliver([item(1, 6, 6, 6, ts=late), item(1, 2, 6, 2, ts=late)])
    assert sorted((r["seq"], r["processed"]) for r in got.where("run_id = 1").collect())[-1] == (6, 4)
    assert got.where("run_id = 1").count() == 4  # number 2 came too late


def test_stream_equals_batch_on_the_tables(spark, tmp_path):
    from vellum.operators.progress import emit_on_increase, running_progress, suppress_repeats
    from vellum.plans.derived import items
    from vellum.streaming.item_progress import emitted, numbered_items, run_item_progress, without_repeats
    it = items(spark, SF_SMALL)
    src = str(tmp_path / "src")
    numbered_items(it).orderBy(F.xxhash64("pos")).repartition(3).write.parquet(src)
    got = run_item_progress(spark, src, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    batch = running_progress(it)
    same = lambda a, b: a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    cols = ["run_id", "pos", "status", "error", "thrown", "total", "processed", "success_count", "skipped_count", "failed_count"]
    assert same(got.select(cols), batch.select(cols))
    assert same(emitted(got).select("run_id", "pos"), emit_on_increase(batch).select("run_id", "pos"))
    assert same(without_repeats(got).select("run_id", "pos"), suppress_repeats(it, "run_id", "pos", "status").select("run_id", "pos"))


def events(rows):
    """(op, key, second, event_id, title) as change events."""
    t0 = dt.datetime(2024, 1, 1)
    return [(op, key, t0 + dt.timedelta(seconds=s), e, title, None if title is None else f"http://x/{key}") for op, key, s, e, title in rows]


def flat(df):
    m = F.col("metadata")
    rows = df.select("id", "text", "embedding", "dimensions", "model", "ts", m["type"], m["url"], m["title"], m["bookmark_id"], m["summary"], m["notes"]).collect()
    return sorted(([str(x) for x in r] for r in rows))


def make_library(spark, path, n):
    from vellum.sources.library_io import write_library
    lib = spark.range(n).selectExpr(
        "format_string('emb_%08d', id) AS id", "concat('text ', id) AS text", "array(1f, 0f) AS embedding", "2 AS dimensions", "'m' AS model",
        "timestamp'2023-01-01' AS ts", "named_struct('type', 'bookmark', 'url', concat('http://x/', id), 'title', concat('t', id), 'bookmark_id', "
        "cast(id AS string), 'date_added', timestamp'2023-01-01', 'summary', 's', 'notes', if(id % 2 = 0, 'note', '')) AS metadata")
    return write_library(lib, path, files=3)


def test_change_log_equals_batch_in_any_order(spark, tmp_path, monkeypatch):
    from vellum.sources.library_io import scan_library
    from vellum.streaming import change_log
    from vellum.streaming.changes import CHANGE_SCHEMA, apply_changes, read_changes_batch
    monkeypatch.setattr(change_log, "SLOT_ROWS", 32)
    monkeypatch.setattr(change_log, "FAN", 2)
    rng = random.Random(9)
    base = make_library(spark, str(tmp_path / "base"), 100)
    rows = []
    for e in range(160):
        op = rng.choice(["created", "changed", "changed", "removed"])
        rows.append((op, str(rng.randrange(60, 140)), rng.randrange(50), e, None if op == "removed" or rng.random() < 0.1 else f"v{e}"))
    rows += [("removed", "1", 1, 1000, None), ("other", "2", 1, 1001, "x")]
    rng.shuffle(rows)
    want = flat(apply_changes(scan_library(base, spark), read_changes_batch(spark.createDataFrame(events(rows), CHANGE_SCHEMA))))
    log = change_log.ChangeLog(spark, str(tmp_path / "log"), base)
    for i in range(4):
        part = spark.createDataFrame(events(rows[i::4]), CHANGE_SCHEMA)
        log.apply(part, i)
        if i == 1:
            before = flat(log.view())
            log.apply(part, i)  # the same batch again
            assert flat(log.view()) == before
        if i == 2:
            before = flat(log.view())
            log.compact(str(tmp_path / "base2"))
            assert flat(log.view()) == before and len(log.runs()) == 1
    assert flat(log.view()) == want
    log.apply(spark.createDataFrame(events(rows[:40]), CHANGE_SCHEMA), 4)  # late, older events
    assert flat(log.view()) == want
    assert max(r.level for r in change_log.ChangeLog(spark, str(tmp_path / "log"), base).runs()) >= 0  # opened again


def test_change_log_reads_with_the_batch_not_the_library(spark, tmp_path, monkeypatch):
    from vellum.streaming import change_log
    from vellum.streaming.changes import CHANGE_SCHEMA
    monkeypatch.setattr(change_log, "SLOT_ROWS", 64)
    batch = spark.createDataFrame(events([("changed", str(k), 1, k, "new") for k in (3, 77, 1500, 900000)]), CHANGE_SCHEMA)
    read = []
    for n in (2000, 16000):
        log = change_log.ChangeLog(spark, str(tmp_path / f"log{n}"), make_library(spark, str(tmp_path / f"base{n}"), n))
        read.append(log.apply(batch, 0)["rows"])
        again = log.apply(batch, 1)  # known events: the batch's own run is read too, and no record changes
        assert again["rows"] <= read[-1] + 8 and log.view().where("text LIKE '%new%'").count() == 4
    assert all(0 < r <= 5 * 2 * 64 for r in read)  # the slots of a few keys, at either size


def test_failed_batch_leaves_the_log_as_it_was(spark, tmp_path):
    import pytest
    from vellum.streaming import change_log
    from vellum.streaming.changes import CHANGE_SCHEMA
    log = change_log.ChangeLog(spark, str(tmp_path / "log"), make_library(spark, str(tmp_path / "base"), 20))
    before, batch = flat(log.view()), spark.createDataFrame(events([("changed", "3", 1, 1, "new")]), CHANGE_SCHEMA)
    commit = log._commit
    log._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        log.apply(batch, 0)
    assert flat(log.view()) == before
    log._commit = commit
    log.apply(batch, 0)
    assert sum("new" in r[1] for r in flat(log.view())) == 1


def test_changes_call_the_model_once_a_key(spark, tmp_path):
    from vellum.sources.library_io import scan_library
    from vellum.streaming.changes import CHANGE_SCHEMA, apply_changes
    seen = str(tmp_path / "seen")
    open(seen, "w").close()

    def counting():
        def run(texts):
            with open(seen, "a") as f:
                f.writelines("x\n" for _ in texts)
            return [[1.0, 0.0] for _ in texts]
        return run

    base = make_library(spark, str(tmp_path / "base"), 20)
    rows = events([("changed", str(k), 1, k, "new") for k in range(5)] + [("created", str(k), 1, k, "new") for k in range(100, 103)])
    out = apply_changes(scan_library(base, spark), spark.createDataFrame(rows, CHANGE_SCHEMA).coalesce(1), embedder=counting)
    assert out.where("text LIKE '%new%'").count() == 8
    assert len(open(seen).readlines()) == 8
