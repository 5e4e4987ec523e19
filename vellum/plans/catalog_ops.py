"""Registered queries for dedupe, aggregates, mutations, streaming and hooks (J, A, M, T, U2, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.plans import sqlparts as S
from vellum.plans.catalog import LIB, _long, chunk_sql, query, summary_ctes
from vellum.plans.derived import SELECTED_MODEL, changes, existing_urls, heavy_table, items, library, millis, table, tree

# ---------------------------------------------------------------- J: dedupe and key joins


@query("new_only", "SELECT page_id, url FROM pages WHERE url <> '' AND url NOT IN "
                   "(SELECT url FROM pages WHERE url LIKE 'https://%')")
def q_new_only(spark, sf):
    from vellum.operators.dedupe import new_only
    return new_only(table(spark, sf, "pages").select("page_id", "url"), existing_urls(spark, sf))


_SHIFT = 1_000_000_000


@query("dedupe_batch", f"""
WITH runs AS (
  SELECT page_id, url, page_id AS pos, url LIKE 'http://%' AS failed FROM pages
  UNION ALL SELECT page_id, url, page_id + {_SHIFT}, false FROM pages)
SELECT url, pos, page_id FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY CAST(failed AS INTEGER), pos) AS rn FROM runs
  WHERE url <> '') WHERE rn = 1""")
def q_dedupe_batch(spark, sf):
    from vellum.operators.dedupe import dedupe_batch
    p = table(spark, sf, "pages").select("page_id", "url")
    runs = p.select("page_id", "url", F.col("page_id").alias("pos"), F.col("url").startswith("http://").alias("failed")) \
        .unionByName(p.select("page_id", "url", (F.col("page_id") + _SHIFT).alias("pos"), F.lit(False).alias("failed")))
    return dedupe_batch(runs, failed_col="failed").select("url", "pos", "page_id")


@query("match_by_key", S.with_(S.LIBRARY, S.CHANGES) + """
SELECT k.key, (SELECT min(id) FROM library l WHERE l.bookmark_id = k.key) AS id
FROM (SELECT DISTINCT key FROM changes) k""")
def q_match_by_key(spark, sf):
    from vellum.operators.dedupe import match_by_key
    return match_by_key(library(spark, sf), changes(spark, sf))


@query("stale_model", LIB + f"SELECT id, model FROM library WHERE model IS NULL OR model <> '{SELECTED_MODEL}'")
def q_stale_model(spark, sf):
    from vellum.operators.library import stale_model
    return stale_model(library(spark, sf), SELECTED_MODEL).select("id", "model")


# ---------------------------------------------------------------- A: aggregates
@query("count_records", LIB + "SELECT count(*) AS count FROM library")
def q_count_records(spark, sf):
    from vellum.operators.progress import count_records
    return count_records(library(spark, sf))


@query("library_stats", LIB + """
SELECT count(*) AS count, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_size,
       CAST(coalesce(floor(avg(dimensions) + 0.5), 0) AS BIGINT) AS average_dimensions,
       min(ts_ms) AS oldest_ms, max(ts_ms) AS newest_ms FROM library""")
def q_library_stats(spark, sf):
    from vellum.operators.progress import library_stats
    return library_stats(library(spark, sf))


@query("distinct_urls", LIB + "SELECT DISTINCT url FROM library WHERE url <> ''")
def q_distinct_urls(spark, sf):
    from vellum.operators.dedupe import distinct_urls
    return distinct_urls(library(spark, sf).select(F.col("metadata.url").alias("url")))


@query("distinct_urls_estimate", "SELECT event_type, count(DISTINCT user_id) AS n_exact, true AS within_bound FROM events GROUP BY event_type")
def q_distinct_urls_estimate(spark, sf):
    """Distinct users' urls per kind of event: sketches of two halves united, held against the exact count."""
    from vellum.operators.sketch import STANDARD_ERROR, estimates, united, url_sketches
    ev = table(spark, sf, "events").select("event_type", F.concat(F.lit("http://user/"), F.col("user_id").cast("string")).alias("url"), "event_id")
    halves = url_sketches(ev.where("event_id % 2 = 0"), ["event_type"]).unionByName(url_sketches(ev.where("event_id % 2 = 1"), ["event_type"]))
    exact = ev.groupBy("event_type").agg(F.countDistinct("url").alias("n_exact"))
    both = estimates(united(halves, ["event_type"])).join(exact, "event_type")
    within = F.abs(F.col("n_urls") - F.col("n_exact")) <= F.greatest(F.lit(1.0), 3 * STANDARD_ERROR * F.col("n_exact"))
    return both.select("event_type", "n_exact", within.alias("within_bound"))


_COUNTERS = """
counters AS (
  SELECT run_id, task, count(*) AS total, count(*) AS processed,
         count(*) FILTER (WHERE NOT (status = 'failure' OR thrown) AND NOT (status = 'skip')) AS success,
         count(*) FILTER (WHERE status = 'skip' AND NOT (status = 'failure' OR thrown)) AS skipped,
         count(*) FILTER (WHERE status = 'failure' OR thrown) AS failed
  FROM items GROUP BY run_id, task)"""


@query("task_counters", S.with_(S.ITEMS, _COUNTERS) + "SELECT * FROM counters")
def q_task_counters(spark, sf):
    from vellum.operators.progress import task_counters
    return task_counters(items(spark, sf))


_ERRORS = """
errs AS (
  SELECT run_id, task, coalesce(
    arg_max(CASE WHEN thrown THEN coalesce(error, 'Unknown processing error') END, CASE WHEN thrown THEN pos END),
    arg_min(CASE WHEN status = 'failure' AND NOT thrown AND error <> '' THEN error END,
            CASE WHEN status = 'failure' AND NOT thrown AND error <> '' THEN pos END)) AS error
  FROM items GROUP BY run_id, task)"""


@query("task_error", S.with_(S.ITEMS, _ERRORS) + "SELECT * FROM errs")
def q_task_error(spark, sf):
    from vellum.operators.progress import task_error
    return task_error(items(spark, sf))


_PROGRESS = """
progress AS (
  SELECT run_id, task, pos, status, error, thrown,
         count(*) OVER (PARTITION BY run_id) AS total,
         count(*) OVER w AS processed,
         sum(CASE WHEN NOT (status = 'failure' OR thrown) AND status <> 'skip' THEN 1 ELSE 0 END) OVER w AS success_count,
         sum(CASE WHEN status = 'skip' AND NOT (status = 'failure' OR thrown) THEN 1 ELSE 0 END) OVER w AS skipped_count,
         sum(CASE WHEN status = 'failure' OR thrown THEN 1 ELSE 0 END) OVER w AS failed_count
  FROM items WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _progress(spark, sf):
    from vellum.operators.progress import running_progress
    return running_progress(items(spark, sf), block=512)


@query("running_progress", S.with_(S.ITEMS, _PROGRESS) + """
SELECT run_id, pos, CAST(total AS BIGINT) AS total, CAST(processed AS BIGINT) AS processed,
       CAST(success_count AS BIGINT) AS success_count, CAST(skipped_count AS BIGINT) AS skipped_count,
       CAST(failed_count AS BIGINT) AS failed_count FROM progress""")
def q_running_progress(spark, sf):
    return _progress(spark, sf).select("run_id", "pos", "total", "processed", "success_count", "skipped_count",
                                       "failed_count")


@query("task_percent", S.with_(S.ITEMS, _PROGRESS) + """
SELECT run_id, pos, CAST(CASE WHEN total > 0 THEN floor(processed * 100.0 / total + 0.5) ELSE 0 END AS BIGINT) AS percent
FROM progress""")
def q_task_percent(spark, sf):
    from vellum.operators.progress import percent
    return _progress(spark, sf).select("run_id", "pos", percent(F.col("processed"), F.col("total")).alias("percent"))


@query("task_summary", S.with_(S.ITEMS, _COUNTERS, _ERRORS) + """
SELECT c.run_id, c.task,
  CASE WHEN c.task = 'import' THEN 'Import complete! ' || c.success || ' imported, ' || c.skipped || ' skipped, '
                                   || c.failed || ' failed'
       ELSE 'Regeneration complete! ' || c.success || ' regenerated, ' || c.failed || ' failed' END AS text,
  CASE WHEN e.error <> '' THEN 'error' ELSE 'success' END AS type
FROM counters c LEFT JOIN errs e ON e.run_id = c.run_id AND e.task = c.task""")
def q_task_summary(spark, sf):
    from vellum.operators.progress import task_counters, task_error, task_summary
    it = items(spark, sf)
    return task_summary(task_counters(it), task_error(it)).select("run_id", "task", "text", "type")


@query("task_summary_running", S.with_(S.ITEMS, _PROGRESS) + """
SELECT run_id, pos,
  CASE WHEN processed < total THEN
    CASE WHEN task = 'import' THEN 'Importing bookmarks... ' ELSE 'Re-generating embeddings... ' END
    || processed || '/' || total || ' ('
    || CAST(CASE WHEN total > 0 THEN floor(processed * 100.0 / total + 0.5) ELSE 0 END AS BIGINT) || '%)'
  ELSE CASE WHEN task = 'import' THEN 'Import complete! ' || success_count || ' imported, ' || skipped_count
         || ' skipped, ' || failed_count || ' failed'
       ELSE 'Regeneration complete! ' || success_count || ' regenerated, ' || failed_count || ' failed' END
  END AS text,
  CASE WHEN processed < total THEN 'loading' ELSE 'success' END AS type
FROM progress""")
def q_task_summary_running(spark, sf):
    from vellum.operators.progress import task_summary
    p = _progress(spark, sf).select("run_id", "task", "pos", "total", "processed",
                                    F.col("success_count").alias("success"), F.col("skipped_count").alias("skipped"),
                                    F.col("failed_count").alias("failed"))
    return task_summary(p).select("run_id", "pos", "text", "type")


@query("task_flags", S.with_(S.ITEMS, _PROGRESS) + """
SELECT run_id, pos, (processed < total) OR processed > 0 AS has_activity,
       (processed < total) OR (total > 0 AND processed < total) AS has_remaining_work FROM progress""")
def q_task_flags(spark, sf):
    from vellum.operators.progress import task_flags
    p = _progress(spark, sf).select("run_id", "pos", "processed", "total")
    return task_flags(p).select("run_id", "pos", "has_activity", "has_remaining_work")


@query("task_state", S.with_(S.ITEMS, _COUNTERS) + """
, cur AS (SELECT arg_max(run_id, ts) AS run_id FROM items),
req AS (SELECT * FROM (VALUES ('import'), ('regeneration')) AS r(requested))
SELECT r.requested, r.requested AS active_task,
  CAST(coalesce(c.total, 0) AS BIGINT) AS total, CAST(coalesce(c.processed, 0) AS BIGINT) AS processed,
  CAST(coalesce(c.success, 0) AS BIGINT) AS success, CAST(coalesce(c.skipped, 0) AS BIGINT) AS skipped,
  CAST(coalesce(c.failed, 0) AS BIGINT) AS failed
FROM req r LEFT JOIN (SELECT counters.* FROM counters JOIN cur ON cur.run_id = counters.run_id) c
  ON c.task = r.requested""")
def q_task_state(spark, sf):
    from vellum.operators.progress import task_counters, task_state
    it = items(spark, sf)
    cur_run = it.agg(F.max_by("run_id", "ts").alias("r"))
    counters = task_counters(it).join(cur_run, F.col("run_id") == F.col("r")).drop("r")
    req = spark.createDataFrame([("import",), ("regeneration",)], "requested string")
    return task_state(counters, req, F.col("task"))


# ---------------------------------------------------------------- T: change capture and running progress
@query("apply_changes", S.with_(S.CHANGES) + f"""
, eff AS (SELECT * FROM changes WHERE op = 'removed' OR url <> ''),
last AS (SELECT key, arg_max(op, (ts, event_id)) AS op, arg_max(title, (ts, event_id)) AS title,
                arg_max(url, (ts, event_id)) AS url, max((ts, event_id))[2] AS event_id FROM eff GROUP BY key)
SELECT key, op <> 'removed' AS live, CASE WHEN op <> 'removed' THEN title END AS title,
       CASE WHEN op <> 'removed' THEN url END AS url,
       CASE WHEN op <> 'removed' THEN {S.compose('title', 'url', 'NULL', "''")} END AS text, event_id
FROM last""")
def q_apply_changes(spark, sf):
    from vellum.streaming.changes import key_state
    return key_state(changes(spark, sf)).select("key", "live", "title", "url", "text", "event_id")


_APPLIED = S.with_(S.LIBRARY, S.CHANGES) + f"""
, eff AS (SELECT * FROM changes WHERE op IN ('created', 'changed') AND url <> '' OR op = 'removed'),
last AS (SELECT key, arg_max(op, (ts, event_id)) AS op, arg_max(title, (ts, event_id)) AS title,
                arg_max(url, (ts, event_id)) AS url FROM eff GROUP BY key),
matched AS (SELECT l.*, (SELECT min(id) FROM library r WHERE r.bookmark_id = l.key) AS id FROM last l),
kept AS (
  SELECT r.id, CASE WHEN m.key IS NULL THEN r.text ELSE {S.compose('m.title', 'm.url', 'r.summary', 'r.notes')} END AS text,
         CASE WHEN m.key IS NULL THEN r.dimensions ELSE 64 END AS dimensions, CASE WHEN m.key IS NULL THEN r.model ELSE 'vellum/hash-embed' END AS model,
         r.type, CASE WHEN m.key IS NULL THEN r.url ELSE m.url END AS url, CASE WHEN m.key IS NULL THEN r.title ELSE m.title END AS title,
         r.bookmark_id, r.summary, r.notes
  FROM library r LEFT JOIN matched m ON m.id = r.id WHERE m.key IS NULL OR m.op <> 'removed')
SELECT * FROM kept UNION ALL
SELECT 'emb_' || substr(sha256('change|' || key), 1, 24), {S.compose('title', 'url', 'NULL', "''")}, 64, 'vellum/hash-embed', 'bookmark', url, title, key,
       NULL, '' FROM matched WHERE id IS NULL AND op <> 'removed'"""


def _applied(out):
    m = F.col("metadata")
    return out.select("id", "text", _long(F.col("dimensions")).alias("dimensions"), "model",
                      *[m[c].alias(c) for c in ("type", "url", "title", "bookmark_id", "summary", "notes")])


@query("apply_changes_library", _APPLIED)
def q_apply_changes_library(spark, sf):
    from vellum.streaming.changes import apply_changes, read_changes_batch
    return _applied(apply_changes(library(spark, sf), read_changes_batch(changes(spark, sf))))


@query("apply_changes_log", _APPLIED)
def q_apply_changes_log(spark, sf):
    from vellum.session import scratch_path
    from vellum.sources.library_io import write_library
    from vellum.streaming.change_log import run_logged_stream
    from vellum.streaming.changes import read_changes_batch
    base, src = write_library(library(spark, sf), scratch_path(spark, "log-base")), scratch_path(spark, "log-changes")
    read_changes_batch(changes(spark, sf)).repartition(2, F.xxhash64("event_id")).write.parquet(src)
    return _applied(run_logged_stream(spark, src, base, scratch_path(spark, "log"), scratch_path(spark, "log-ckpt"), 1)[0])


_GAP_US = 6 * 3600 * 1_000_000


@query("debounce", f"""
WITH e AS (SELECT user_id, ts, event_id, event_type,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= {_GAP_US} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT user_id, min(epoch_us(ts)) // 1000 AS start_ms, (max(epoch_us(ts)) + {_GAP_US}) // 1000 AS end_ms,
       count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS last_event_type
FROM s GROUP BY user_id, sid""")
def q_debounce(spark, sf):
    from vellum.streaming.changes import debounce
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    d = debounce(ev, "user_id", "ts", "6 hours", payload="event_type")
    return d.select("user_id", millis(F.col("session.start")).alias("start_ms"),
                    millis(F.col("session.end")).alias("end_ms"), "n_events",
                    F.col("last").alias("last_event_type"))


@query("micro_batches", None)
def q_micro_batches(spark, sf):
    from vellum.session import scratch_path
    from vellum.streaming.changes import CHANGE_SCHEMA, micro_batches, read_changes_batch
    src = scratch_path(spark, "changes-src")
    read_changes_batch(changes(spark, sf)).repartition(4).write.parquet(src)
    seen = micro_batches(spark, src, CHANGE_SCHEMA, scratch_path(spark, "changes-ckpt"), max_files_per_trigger=1)
    return spark.createDataFrame([(s["batch_id"], s["rows"]) for s in seen], "batch_id long, rows long")


@query("emit_on_increase", S.with_(S.ITEMS, _PROGRESS) + """
SELECT run_id, pos, CAST(success_count AS BIGINT) AS success_count FROM progress
WHERE status NOT IN ('failure', 'skip') AND NOT thrown AND processed < total AND success_count > 0""")
def q_emit_on_increase(spark, sf):
    from vellum.operators.progress import emit_on_increase
    return emit_on_increase(_progress(spark, sf)).select("run_id", "pos", "success_count")


@query("suppress_repeats", S.with_(S.ITEMS) + """
SELECT run_id, pos, status FROM (
  SELECT run_id, pos, status, lag(status) OVER (PARTITION BY run_id ORDER BY pos) AS prev FROM items)
WHERE prev IS DISTINCT FROM status""")
def q_suppress_repeats(spark, sf):
    from vellum.operators.progress import suppress_repeats
    it = items(spark, sf).select("run_id", "pos", "status")
    return suppress_repeats(it, "run_id", "pos", "status", block=512)


@query("progress_stream", S.with_(S.ITEMS, _PROGRESS) + """
SELECT run_id, pos, CAST(row_number() OVER w AS BIGINT) AS seq, CAST(total AS BIGINT) AS total, CAST(processed AS BIGINT) AS processed,
       CAST(success_count AS BIGINT) AS success_count, CAST(skipped_count AS BIGINT) AS skipped_count,
       CAST(failed_count AS BIGINT) AS failed_count,
       success_count > coalesce(max(success_count) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         AND processed < total AS rose,
       status IS DISTINCT FROM lag(status) OVER w AS changed
FROM progress WINDOW w AS (PARTITION BY run_id ORDER BY pos)""")
def q_progress_stream(spark, sf):
    from vellum.session import scratch_path
    from vellum.streaming.item_progress import numbered_items, run_item_progress
    src = scratch_path(spark, "items-src")
    it, half = numbered_items(items(spark, sf)), -(-spark.sparkContext.defaultParallelism // 2)
    it.repartition(2 * half, F.xxhash64("pos")).write.parquet(src)  # files hold items of all runs, in no order; half of them a micro-batch
    out = run_item_progress(spark, src, scratch_path(spark, "items-progress"), scratch_path(spark, "items-ckpt"), half)
    return out.select("run_id", "pos", "seq", "total", "processed", "success_count", "skipped_count", "failed_count", "rose", "changed")


# ---------------------------------------------------------------- M: mutations
@query("add_records", """
SELECT 'emb_' || substr(sha256(CAST(d.doc_id AS VARCHAR) || '|' || d.text), 1, 24) AS id,
       '' AS notes, true AS summary_missing, (epoch_us(e.ts) // 1000) AS ts_ms
FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id""")
def q_add_records(spark, sf):
    from vellum.operators.library import add_records
    d = table(spark, sf, "documents").select("doc_id", "text")
    ev = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    recs = add_records(None, d.join(ev, "doc_id", "left"), id_cols=["doc_id", "text"])
    return recs.select("id", F.col("metadata.notes").alias("notes"),
                       F.col("metadata.summary").isNull().alias("summary_missing"), millis(F.col("ts")).alias("ts_ms"))


_PATCH2 = """
patch AS (
  SELECT 'emb_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, 'quality ' || CAST(quality AS VARCHAR) AS p_title
  FROM labels
  UNION ALL
  SELECT 'emb_' || lpad(CAST(doc_id + 1000000000 AS VARCHAR), 12, '0'), 'quality ' || CAST(quality AS VARCHAR)
  FROM labels WHERE toxic = 1)"""


@query("update_records", S.with_(S.LIBRARY, _PATCH2) + """
SELECT p.id, p.p_title AS title, CASE WHEN l.id IS NULL THEN 'rejected' ELSE 'updated' END AS status
FROM patch p LEFT JOIN library l ON l.id = p.id""")
def q_update_records(spark, sf):
    from vellum.operators.library import update_records
    lab = table(spark, sf, "labels")
    mk = lambda c: F.concat(F.lit("emb_"), F.lpad(c.cast("string"), 12, "0"))
    title = F.struct(F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("title"))
    patch = lab.select(mk(F.col("doc_id")).alias("id"), title.alias("metadata")).unionByName(
        lab.where(F.col("toxic") == 1).select(mk(F.col("doc_id") + 1_000_000_000).alias("id"), title.alias("metadata")))
    new, rejects = update_records(library(spark, sf), patch)
    upd = new.where(F.col("updated_at").isNotNull()).select("id", F.col("metadata.title").alias("title"),
                                                            F.lit("updated").alias("status"))
    rej = rejects.select("id", F.col("metadata.title").alias("title"), F.lit("rejected").alias("status"))
    return upd.unionByName(rej)


@query("delete_records", LIB + "SELECT id FROM library WHERE id NOT IN "
                               "(SELECT 'emb_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') FROM labels WHERE toxic = 1)")
def q_delete_records(spark, sf):
    from vellum.operators.library import delete_records
    lab = table(spark, sf, "labels").where(F.col("toxic") == 1).select(
        F.concat(F.lit("emb_"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"))
    return delete_records(library(spark, sf), lab).select("id")


@query("clear_library", LIB + "SELECT id, text FROM library WHERE false")
def q_clear_library(spark, sf):
    from vellum.operators.library import clear_library
    return clear_library(library(spark, sf)).select("id", "text")


@query("update_notes", S.with_(S.LIBRARY) + f"""
SELECT l.id,
  CASE WHEN c.conv_id IS NULL THEN l.text
       ELSE coalesce(nullif({S.compose('l.title', 'l.url', 'l.summary', S.js_trim('c.text'))}, ''), l.text) END AS text,
  CASE WHEN c.conv_id IS NULL THEN l.notes ELSE coalesce({S.js_trim('c.text')}, '') END AS notes,
  CASE WHEN c.conv_id IS NULL THEN l.dimensions ELSE 64 END AS dimensions,
  CASE WHEN c.conv_id IS NULL THEN l.model ELSE 'vellum/hash-embed' END AS model
FROM library l LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) c
  ON c.conv_id = l.doc_id""")
def q_update_notes(spark, sf):
    from vellum.operators.library import update_notes
    lib = library(spark, sf)
    last = table(spark, sf, "conversations").where(F.col("text").isNotNull()).groupBy("conv_id").agg(F.max_by("text", "turn").alias("note"))
    notes = last.select(F.concat(F.lit("emb_"), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("id"), "note")
    out = update_notes(lib, notes)
    return out.select("id", "text", F.col("metadata.notes").alias("notes"), _long(F.col("dimensions")).alias("dimensions"),
                      "model")


@query("regenerate_all", LIB + f"""
SELECT id,
  CASE WHEN model = '{SELECTED_MODEL}' THEN text
       ELSE coalesce(nullif({S.compose('title', 'url', 'summary', 'notes')}, ''), text) END AS text,
  CASE WHEN model = '{SELECTED_MODEL}' THEN model ELSE 'vellum/hash-embed' END AS model,
  CASE WHEN model = '{SELECTED_MODEL}' THEN dimensions ELSE 64 END AS dimensions
FROM library""")
def q_regenerate_all(spark, sf):
    from vellum.operators.library import regenerate_all
    out = regenerate_all(library(spark, sf), selected=SELECTED_MODEL)
    return out.select("id", "text", "model", _long(F.col("dimensions")).alias("dimensions"))


_CREATED = f"""(SELECT c.event_id, c.key, c.title, c.url, {S.fallback_content('d')} AS content
  FROM changes c LEFT JOIN document d ON d.id = c.url WHERE c.op = 'created' AND c.url <> '')"""
_BY_URL = S.document_ctes("(SELECT url, arg_max(html, (length(html), html)) AS html FROM pages WHERE url IS NOT NULL GROUP BY url)", "url", "html")


@query("process_bookmark", "WITH RECURSIVE " + S.CHANGES.strip() + "," + _BY_URL + ", " + summary_ctes(_CREATED, "event_id", "content", "url")
       + f"""
SELECT c.event_id, c.key, s.summary,
       coalesce(nullif({S.compose('c.title', 'c.url', 's.summary', "''")}, ''),
                nullif({S.js_trim("coalesce(c.title, '') || ' - ' || coalesce(c.url, '')")}, ''), c.key) AS text,
       CAST(64 AS BIGINT) AS dimensions, c.key AS bookmark_id
FROM {_CREATED} c LEFT JOIN summ s ON s.k = c.event_id""")
def q_process_bookmark(spark, sf):
    from vellum.plans.import_job import process_bookmarks
    created = changes(spark, sf).where(F.col("op") == "created")
    recs = process_bookmarks(created, pages=table(spark, sf, "pages"))
    return recs.select("event_id", "key", F.col("metadata.summary").alias("summary"), "text",
                       _long(F.col("dimensions")).alias("dimensions"), F.col("metadata.bookmark_id").alias("bookmark_id"))


@query("create_bookmarks", S.with_(S.LIBRARY, S.CHANGES) + f"""
SELECT id, text, notes, bookmark_id FROM library UNION ALL
SELECT 'emb_' || substr(sha256('create|' || event_id || '|' || key), 1, 24), {S.compose('title', 'url', 'NULL', "''")}, '', key
FROM changes WHERE op = 'created' AND url <> ''""")
def q_create_bookmarks(spark, sf):
    from vellum.plans.import_job import add_bookmarks
    out = add_bookmarks(library(spark, sf), changes(spark, sf).where(F.col("op") == "created"))
    m = F.col("metadata")
    return out.select("id", "text", m["notes"].alias("notes"), m["bookmark_id"].alias("bookmark_id"))


def _bulk_import_sql() -> str:
    flat = """
twalk AS (
  SELECT id, title, url, sort_key AS path FROM tree WHERE parent_id IS NULL
  UNION ALL
  SELECT t.id, t.title, t.url, w.path || '/' || t.sort_key FROM tree t JOIN twalk w ON t.parent_id = w.id),
bm AS (SELECT id, title, url, path FROM twalk WHERE url <> ''),
fresh AS (SELECT * FROM bm WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE 'https://%')),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY path) AS rn FROM fresh) WHERE rn = 1),
pg AS (SELECT f.id AS bid, f.title, f.url, """ + S.fallback_content("d") + """ AS content
       FROM firsts f LEFT JOIN document d ON d.id = f.url),"""
    chunks = chunk_sql("(SELECT * FROM pg WHERE regexp_matches(url, '(?i)^https?://') AND content <> '')",
                       "bid", "content")
    rest = f""",
sums AS (SELECT k, pos, {S.js_trim(S.summary120('chunk'))} AS s FROM kept),
good AS (SELECT k, pos, s FROM sums WHERE s <> ''),
agg AS (SELECT k, count(*) AS n, string_agg(s, ' ' ORDER BY pos) AS joined, min(s) AS only FROM good GROUP BY k),
summ AS (
  SELECT pg.bid, pg.title, pg.url,
    CASE WHEN a.n IS NULL THEN NULL WHEN a.n = 1 THEN a.only
         ELSE coalesce(nullif({S.js_trim(S.summary120('a.joined'))}, ''),
                       {S.js_trim('a.joined')}) END AS summary
  FROM pg LEFT JOIN agg a ON a.k = pg.bid)
SELECT bid AS bookmark_id, title, url, summary,
  coalesce(nullif({S.compose('title', 'url', 'summary', "''")}, ''), coalesce(title, '') || ' - ' || coalesce(url, ''))
    AS text,
  CAST(64 AS BIGINT) AS dimensions, 'bookmark' AS type
FROM summ"""
    return "WITH RECURSIVE " + S.TREE.strip() + "," + _BY_URL + "," + flat + chunks + rest


@query("bulk_import", _bulk_import_sql())
def q_bulk_import(spark, sf):
    from vellum.plans.import_job import bulk_import
    recs, _status = bulk_import(tree(spark, sf), table(spark, sf, "pages"), existing_urls(spark, sf))
    m = F.col("metadata")
    return recs.select(m["bookmark_id"].alias("bookmark_id"), m["title"].alias("title"), m["url"].alias("url"),
                       m["summary"].alias("summary"), "text", _long(F.col("dimensions")).alias("dimensions"),
                       m["type"].alias("type"))


@query("bulk_import_status", S.with_(S.TREE, """
twalk AS (
  SELECT id, url, sort_key AS path FROM tree WHERE parent_id IS NULL
  UNION ALL
  SELECT t.id, t.url, w.path || '/' || t.sort_key FROM tree t JOIN twalk w ON t.parent_id = w.id)""") + """
SELECT path AS pos, url,
       CASE WHEN url LIKE 'https://%' OR row_number() OVER (PARTITION BY url ORDER BY path) > 1 THEN 'skip' ELSE 'success' END AS status,
       CAST(NULL AS VARCHAR) AS error
FROM twalk WHERE url <> ''""")
def q_bulk_import_status(spark, sf):
    from vellum.plans.import_job import bulk_import
    _recs, status = bulk_import(tree(spark, sf), table(spark, sf, "pages"), existing_urls(spark, sf))
    return status


# ---------------------------------------------------------------- U2, U3: summariser and item callbacks
@query("summarizer", "WITH RECURSIVE " + chunk_sql("documents", "doc_id", "text")
       + f"\nSELECT k AS doc_id, CAST(pos AS BIGINT) AS pos, {S.summary120('chunk', 40)} AS summary FROM kept")
def q_summarizer(spark, sf):
    from vellum.functions.chunk import chunk_text
    from vellum.operators.summarize import first_words_summarizer, summarizer_udf
    d = heavy_table(spark, sf, "documents").select("doc_id", chunk_text(F.col("text")).alias("chunks"))
    s = d.select("doc_id", summarizer_udf(first_words_summarizer)(F.col("chunks")).alias("sums"))
    return s.select("doc_id", F.posexplode("sums").alias("pos", "summary")).select(
        "doc_id", _long(F.col("pos")).alias("pos"), "summary")


@query("process_items", S.with_(S.ITEMS, _COUNTERS) + "SELECT * FROM counters")
def q_process_items(spark, sf):
    from vellum.operators.progress import process_items, task_counters
    ev = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", "value")
    ev = ev.withColumn("task", F.when(F.pmod(F.col("run_id"), F.lit(3)) == 0, "regeneration").otherwise("import"))

    def handle(rec):
        et = rec["event_type"]
        if et == "error":
            if rec["value"] > 40:
                raise RuntimeError(f"failed item {rec['event_id']}")
            return {"status": "failure", "error": f"failed item {rec['event_id']}"}
        if et == "click":
            return {"status": "skip"}
        return {"status": "success"}

    out = process_items(ev, handle, keep=["run_id", "task", "event_id"])
    return task_counters(out.withColumnRenamed("event_id", "pos"))

