"""Registered queries: one per build unit, each with its DuckDB oracle (or None).

Every query reads the given tables whole (or data Spark derives from them).
Outputs are scalar columns; similarities are rounded to 6 places, integers
are BIGINT, times are epoch millis, so the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans import sqlparts as S
from vellum.plans.derived import changes, existing_urls, flat_library, heavy_table, items, library, millis, table, tree

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def _long(c):
    return c.cast("long")


LIB = S.with_(S.LIBRARY)
LIB_COLS = "id, text, dimensions, model, ts_ms, type, url, title, bookmark_id, summary, notes"

# ---------------------------------------------------------------- S: scans, sources, sinks


@query("scan_library", LIB + f"SELECT {LIB_COLS} FROM library")
def q_scan_library(spark, sf):
    from vellum.sources.library_io import scan_library
    return flat_library(scan_library(library(spark, sf)))


@query("get_by_id", LIB + f"SELECT {LIB_COLS} FROM library WHERE id = 'emb_000000000007'")
def q_get_by_id(spark, sf):
    from vellum.sources.library_io import get_by_id
    return flat_library(get_by_id(library(spark, sf), "emb_000000000007"))


@query("scan_newest_first", LIB + "SELECT id, ts_ms FROM library ORDER BY ts_ms DESC NULLS LAST, id")
def q_scan_newest_first(spark, sf):
    from vellum.sources.library_io import scan_newest_first
    return scan_newest_first(library(spark, sf)).select("id", millis(F.col("ts")).alias("ts_ms"))


_IMPORT_COLS = "text, dimensions, model, ts_ms, type, url, title, bookmark_id, summary, notes"


@query("import_backup", LIB + f"SELECT {_IMPORT_COLS} FROM library WHERE embedding IS NOT NULL AND text <> ''")
def q_import_backup(spark, sf):
    from vellum.session import scratch_path
    from vellum.sources.library_io import export_backup, import_backup
    path = scratch_path(spark, "backup")
    export_backup(library(spark, sf), path)
    got = import_backup(spark, path)
    return flat_library(got).drop("id")


@query("export_backup", LIB + f"SELECT {LIB_COLS} FROM library")
def q_export_backup(spark, sf):
    from vellum.session import scratch_path
    from vellum.sources.library_io import export_backup, read_backup
    path = scratch_path(spark, "backup")
    export_backup(library(spark, sf), path)
    return flat_library(read_backup(spark, path))


@query("read_backup_split", LIB + f"SELECT {LIB_COLS} FROM library")
def q_read_backup_split(spark, sf):
    """The library exported as one array file, which many tasks read; its joins run before the one task that writes it."""
    from vellum.llm.common import cut
    from vellum.session import scratch_path
    from vellum.sources.library_io import export_backup, read_backup
    path = scratch_path(spark, "backup-one")
    export_backup(cut(library(spark, sf), "library").coalesce(1), path)
    return flat_library(read_backup(spark, path, split=True))


@query("flatten_tree", S.with_(S.TREE, """
walk AS (
  SELECT id, title, url, sort_key AS path FROM tree WHERE parent_id IS NULL
  UNION ALL
  SELECT t.id, t.title, t.url, w.path || '/' || t.sort_key FROM tree t JOIN walk w ON t.parent_id = w.id
)""") + "SELECT id, title, url, path FROM walk WHERE url IS NOT NULL AND url <> ''")
def q_flatten_tree(spark, sf):
    from vellum.sources.tree import flatten_tree
    return flatten_tree(tree(spark, sf)).select("id", "title", "url", "path")


@query("read_pages", "SELECT page_id, url, true AS success, CAST(NULL AS VARCHAR) AS error, "
                     "CAST(length(html) AS BIGINT) AS n_chars FROM pages")
def q_read_pages(spark, sf):
    from vellum.sources.library_io import read_pages
    return read_pages(table(spark, sf, "pages")).select("page_id", "url", "success", "error",
                                                        _long(F.length("html")).alias("n_chars"))


_CONV = "(SELECT conv_id * 1000 + turn AS k0, text FROM conversations)"


@query("ingest_text", S.with_(S.hash_buckets_cte("hb", _CONV, "k0", "text"), S.hash_vec_cte("hv", "hb")) + """
SELECT k // 1000 AS conv_id, k % 1000 AS turn, CAST(64 AS BIGINT) AS dimensions, 'vellum/hash-embed' AS model,
       CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM hv""")
def q_ingest_text(spark, sf):
    from vellum.plans.catalog_vectors import vector_rows
    from vellum.sources.library_io import ingest_text
    rec = ingest_text(table(spark, sf, "conversations"), text_col="text", keep=["conv_id", "turn"])
    return vector_rows(rec, "embedding", "conv_id", "turn", _long(F.col("dimensions")).alias("dimensions"), "model")


@query("store_texts", LIB + """
SELECT id, text, dimensions, model, type FROM library
UNION ALL
SELECT 'emb_' || substr(sha256(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR) || '|' || coalesce(text, '')), 1, 24),
       text, CAST(64 AS BIGINT), 'vellum/hash-embed', 'text' FROM conversations""")
def q_store_texts(spark, sf):
    from vellum.sources.library_io import store_texts
    out = store_texts(table(spark, sf, "conversations"), library(spark, sf), text_col="text", keep=["conv_id", "turn"])
    return out.select("id", "text", _long(F.col("dimensions")).alias("dimensions"), "model", F.col("metadata.type").alias("type"))


@query("bookmark_changes", S.with_(S.CHANGES) + "SELECT op, key, ts_ms, event_id, title, url FROM changes")
def q_bookmark_changes(spark, sf):
    from vellum.streaming.changes import read_changes_batch
    return read_changes_batch(changes(spark, sf)).select("op", "key", millis(F.col("ts")).alias("ts_ms"),
                                                         "event_id", "title", "url")


@query("progress_sink", S.with_(S.ITEMS) + """
SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'success') AS success,
       count(*) FILTER (WHERE status = 'skip') AS skipped,
       count(*) FILTER (WHERE status NOT IN ('success', 'skip') OR status IS NULL) AS failed FROM items""")
def q_progress_sink(spark, sf):
    from vellum.operators.progress import observed_counters
    return observed_counters(items(spark, sf))


# ---------------------------------------------------------------- P: projections and scalar functions
from vellum.functions import text as P  # noqa: E402


@query("compose_text", LIB + f"SELECT id, {S.compose('title', 'url', 'summary', 'notes')} AS composed FROM library")
def q_compose_text(spark, sf):
    lib = library(spark, sf)
    m = F.col("metadata")
    return lib.select("id", P.compose_text(m["title"], m["url"], m["summary"], m["notes"]).alias("composed"))


@query("text_fallback", LIB + f"""
SELECT id, coalesce(nullif({S.compose('title', 'url', 'summary', "''")}, ''),
       nullif({S.js_trim("coalesce(title, '') || ' - ' || coalesce(url, '')")}, ''), id) AS embed_text FROM library""")
def q_text_fallback(spark, sf):
    lib = library(spark, sf)
    m = F.col("metadata")
    composed = P.compose_text(m["title"], m["url"], m["summary"], F.lit(""))
    return lib.select("id", P.text_fallback(composed, m["title"], m["url"], F.col("id")).alias("embed_text"))


@query("normalize_metadata", S.with_(S.LIBRARY) + """
SELECT l.id, c.turn, coalesce(c.text, '') AS notes, l.summary, l.summary IS NULL AS summary_missing
FROM library l LEFT JOIN conversations c ON c.conv_id = l.doc_id""")
def q_normalize_metadata(spark, sf):
    from vellum.operators.library import normalize_metadata
    lib = library(spark, sf)
    raw_notes = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("raw"))
    j = lib.join(raw_notes, "doc_id", "left").withColumn("metadata", F.col("metadata").withField("notes", F.col("raw")))
    return j.select("id", "turn", "metadata").transform(normalize_metadata).select(
        "id", "turn", F.col("metadata.notes").alias("notes"), F.col("metadata.summary").alias("summary"),
                      F.col("metadata.summary").isNull().alias("summary_missing"))


_PATCH_SQL = """
patch AS (
  SELECT 'emb_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id,
         CASE WHEN toxic = 1 THEN 'withheld' END AS text, 'quality ' || CAST(quality AS VARCHAR) AS p_title
  FROM labels
)"""


@query("apply_patch", S.with_(S.LIBRARY, _PATCH_SQL) + """
SELECT l.id, CASE WHEN p.id IS NOT NULL THEN p.text ELSE l.text END AS text,
       CASE WHEN p.id IS NOT NULL THEN p.p_title ELSE l.title END AS title,
       CASE WHEN p.id IS NOT NULL THEN NULL ELSE l.url END AS url,
       CASE WHEN p.id IS NOT NULL THEN '' ELSE l.notes END AS notes,
       CASE WHEN p.id IS NOT NULL THEN NULL ELSE l.summary END AS summary,
       p.id IS NOT NULL AS updated
FROM library l LEFT JOIN patch p ON p.id = l.id""")
def q_apply_patch(spark, sf):
    from vellum.operators.library import apply_patch, patch_from_labels
    lib = library(spark, sf)
    out = apply_patch(lib, patch_from_labels(table(spark, sf, "labels")))
    return out.select("id", "text", F.col("metadata.title").alias("title"), F.col("metadata.url").alias("url"),
                      F.col("metadata.notes").alias("notes"), F.col("metadata.summary").alias("summary"),
                      F.col("updated_at").isNotNull().alias("updated"))


@query("deep_patch_metadata", S.with_(S.LIBRARY, _PATCH_SQL) + """
SELECT l.id, CASE WHEN p.id IS NOT NULL THEN p.text ELSE l.text END AS text,
       CASE WHEN p.id IS NOT NULL THEN p.p_title ELSE l.title END AS title,
       l.url, l.notes, l.summary
FROM library l LEFT JOIN patch p ON p.id = l.id""")
def q_deep_patch(spark, sf):
    from vellum.operators.library import deep_patch_metadata, patch_from_labels
    lib = library(spark, sf)
    out = deep_patch_metadata(lib, patch_from_labels(table(spark, sf, "labels")))
    return out.select("id", "text", F.col("metadata.title").alias("title"), F.col("metadata.url").alias("url"),
                      F.col("metadata.notes").alias("notes"), F.col("metadata.summary").alias("summary"))


@query("is_http_url", LIB + "SELECT id, coalesce(url <> '' AND regexp_matches(url, '(?i)^https?://'), false) AS is_http "
                            "FROM library")
def q_is_http_url(spark, sf):
    lib = library(spark, sf)
    return lib.select("id", P.is_http_url(F.col("metadata.url")).alias("is_http"))


@query("is_importable", LIB + "SELECT id, coalesce(embedding IS NOT NULL AND text <> '', false) AS importable FROM library")
def q_is_importable(spark, sf):
    from vellum.operators.library import is_importable
    lib = library(spark, sf)
    return lib.select("id", is_importable(F.col("embedding"), F.col("text")).alias("importable"))


@query("has_dim", LIB + """
SELECT id, coalesce(embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) =
  (SELECT len(embedding) FROM library WHERE embedding IS NOT NULL AND len(embedding) > 0 ORDER BY id LIMIT 1), false)
  AS has_dim FROM library""")
def q_has_dim(spark, sf):
    from vellum.operators.library import has_dim
    return has_dim(library(spark, sf)).select("id", "has_dim")


@query("truncate_text", f"SELECT doc_id, {S.trunc('text', 80)} AS t80, {S.trunc('text', 100)} AS t100, "
                        f"{S.trunc('text', 200)} AS t200 FROM documents")
def q_truncate_text(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", P.truncate_text("text", 80).alias("t80"), P.truncate_text("text", 100).alias("t100"),
                    P.truncate_text("text", 200).alias("t200"))


@query("short_url", f"SELECT page_id, {S.short_url('url', 30, 50)} AS library_url, "
                    f"{S.short_url('url', 40, 60)} AS search_url FROM pages")
def q_short_url(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", P.short_url("url", 30, 50).alias("library_url"),
                    P.short_url("url", 40, 60).alias("search_url"))


@query("short_model", LIB + f"SELECT id, {S.short_model('model')} AS model_name FROM library")
def q_short_model(spark, sf):
    return library(spark, sf).select("id", P.short_model("model").alias("model_name"))


_K2_SQL = """
SELECT qid, vec_id, round(sim, 6) AS sim, CAST(rank AS BIGINT) AS rank FROM (
  SELECT q.vec_id AS qid, e.vec_id, {cos} AS sim,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round({cos}, 12) DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON true
) WHERE rank <= {k}"""


def _k2(spark, sf, k=5):
    from vellum.operators.search import batch_topk
    e = table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    return batch_topk(e, q, k, id_col="vec_id", qid_col="qid", qvec_col="qv")


@query("match_percent", "SELECT qid, vec_id, " + S.match_percent("sim") + " AS match FROM ("
       + _K2_SQL.format(cos=S.cos("q.embedding", "e.embedding"), k=5) + ")")
def q_match_percent(spark, sf):
    return _k2(spark, sf).select("qid", "vec_id", P.match_percent("sim").alias("match"))


@query("record_kind", LIB + "SELECT id, CASE WHEN url <> '' THEN 'bookmark' ELSE 'text' END AS kind FROM library")
def q_record_kind(spark, sf):
    return library(spark, sf).select("id", P.record_kind(F.col("metadata.url")).alias("kind"))


@query("display_title", LIB + f"""
SELECT id, CASE WHEN {S.truthy('title')} THEN title ELSE {S.trunc('text', 80)} END AS library_title,
       {S.trunc(f"CASE WHEN {S.truthy('title')} THEN title ELSE text END", 120)} AS search_title FROM library""")
def q_display_title(spark, sf):
    lib = library(spark, sf)
    return lib.select("id", P.display_title(F.col("metadata.title"), F.col("text")).alias("library_title"),
                      P.display_title(F.col("metadata.title"), F.col("text"), "search").alias("search_title"))


@query("has_summary", LIB + f"SELECT id, coalesce({S.js_trim('summary')} <> '', false) AS has_summary, "
                            f"coalesce({S.js_trim('notes')}, '') AS note_preview FROM library")
def q_has_summary(spark, sf):
    lib = library(spark, sf)
    return lib.select("id", P.has_summary(F.col("metadata.summary")).alias("has_summary"),
                      P.note_preview(F.col("metadata.notes")).alias("note_preview"))


@query("note_changed", S.with_(S.LIBRARY) + f"""
SELECT l.id, c.turn, coalesce({S.js_trim("coalesce(c.text, l.notes || '  ')")}, '') <> coalesce({S.js_trim('l.notes')}, '')
       AS changed
FROM library l LEFT JOIN conversations c ON c.conv_id = l.doc_id""")
def q_note_changed(spark, sf):
    lib = library(spark, sf)
    drafts = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("draft"))
    j = lib.join(drafts, "doc_id", "left")
    draft = F.coalesce(F.col("draft"), F.concat(F.col("metadata.notes"), F.lit("  ")))
    return j.select("id", "turn", P.note_changed(draft, F.col("metadata.notes")).alias("changed"))


@query("normalize_note", f"SELECT item_id, coalesce({S.js_trim('text')}, '') AS normalized, "
                         f"coalesce({S.js_trim('text')}, '') <> '' AS valid_query FROM benchmark")
def q_normalize_note(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", P.normalize_note("text").alias("normalized"),
                    (P.normalize_note("text") != "").alias("valid_query"))


@query("model_dims", LIB + """
SELECT id, model, CAST(CASE model WHEN 'Xenova/all-MiniLM-L6-v2' THEN 384 WHEN 'Xenova/all-mpnet-base-v2' THEN 768
  WHEN 'Xenova/bge-small-en-v1.5' THEN 384 WHEN 'Xenova/bge-base-en-v1.5' THEN 768
  WHEN 'nomic-ai/nomic-embed-text-v1.5' THEN 768 END AS BIGINT) AS declared_dim,
  CASE WHEN model IN ('Xenova/all-MiniLM-L6-v2', 'Xenova/all-mpnet-base-v2', 'Xenova/bge-small-en-v1.5',
    'Xenova/bge-base-en-v1.5', 'nomic-ai/nomic-embed-text-v1.5') THEN 'registered' ELSE 'custom' END AS model_class
FROM library""")
def q_model_dims(spark, sf):
    lib = library(spark, sf).select("id", "model")
    return P.model_dims(lib).select("id", "model", _long(F.col("declared_dim")).alias("declared_dim"), "model_class")


_CARD_SQL = f"""
SELECT id, CASE WHEN url <> '' THEN 'bookmark' ELSE 'text' END AS kind,
  CASE WHEN {S.truthy('title')} THEN title ELSE {S.trunc('text', 80)} END AS title_line,
  {S.short_url('url', 30, 50)} AS url_line,
  coalesce({S.js_trim('summary')} <> '', false) AS has_summary,
  {S.trunc(f"coalesce({S.js_trim('notes')}, '')", 220)} AS note_line,
  {S.trunc('text', 200)} AS text_line,
  {S.short_model('model')} AS model_chip,
  CAST(dimensions AS VARCHAR) || 'd' AS dim_chip,
  ts_ms
FROM library"""


@query("library_card", LIB + _CARD_SQL)
def q_library_card(spark, sf):
    from vellum.operators.library import library_card
    return library_card(library(spark, sf))


# ---------------------------------------------------------------- H: HTML and long text
from vellum.functions import html as H  # noqa: E402
from vellum.functions.chunk import chunk_text  # noqa: E402


@query("strip_noise_blocks", f"SELECT page_id, {S.strip_noise('html')} AS stripped FROM pages")
def q_strip_noise(spark, sf):
    return heavy_table(spark, sf, "pages").select("page_id", H.strip_noise_blocks("html").alias("stripped"))


@query("select_main", f"SELECT page_id, {S.select_main(S.strip_noise('html'))} AS main FROM pages")
def q_select_main(spark, sf):
    return heavy_table(spark, sf, "pages").select("page_id", H.select_main(H.strip_noise_blocks("html")).alias("main"))


@query("strip_tags", f"SELECT page_id, {S.strip_tags(S.select_main(S.strip_noise('html')))} AS bare FROM pages")
def q_strip_tags(spark, sf):
    p = heavy_table(spark, sf, "pages")
    return p.select("page_id", H.strip_tags(H.select_main(H.strip_noise_blocks("html"))).alias("bare"))


@query("collapse_ws", f"SELECT doc_id, {S.collapse('text')} AS collapsed FROM documents")
def q_collapse_ws(spark, sf):
    return heavy_table(spark, sf, "documents").select("doc_id", P.collapse_ws("text").alias("collapsed"))


@query("extract_content", f"SELECT page_id, true AS success, {S.extract('html')} AS content, "
                          f"CAST(length({S.extract('html')}) AS BIGINT) AS n_chars FROM pages")
def q_extract_content(spark, sf):
    p = heavy_table(spark, sf, "pages").select("page_id", H.extract_content("html").alias("r"))
    return p.select("page_id", F.col("r.success").alias("success"), F.col("r.content").alias("content"),
                    _long(F.length("r.content")).alias("n_chars"))


@query("extract_content_dom", "WITH " + S.document_ctes("pages", "page_id", "html") + """
SELECT id AS page_id, success, content, title FROM document""")
def q_extract_content_dom(spark, sf):
    from vellum.operators.page_text import extract_pages
    return extract_pages(heavy_table(spark, sf, "pages")).select("page_id", "success", "content", "title")


@query("page_title", f"SELECT page_id, {S.page_title('html')} AS title FROM pages")
def q_page_title(spark, sf):
    return heavy_table(spark, sf, "pages").select("page_id", H.page_title("html").alias("title"))


@query("extract_with_fallback", "WITH " + S.document_ctes("pages", "page_id", "html") + f"""
SELECT id AS page_id, html IS NOT NULL AS success, {S.fallback_content()} AS content FROM document""")
def q_extract_with_fallback(spark, sf):
    from vellum.operators.page_text import extract_with_fallback
    return extract_with_fallback(heavy_table(spark, sf, "pages")).select("page_id", "success", "content")


def chunk_sql(src: str, key: str, text: str, size: int = 4000, max_chunks: int = 1 << 30) -> str:
    """Recursive walk of the chunking rule; emits (key, pos, chunk) for kept chunks."""
    dot_w = f"substr(t, start + 2, least(start + {size}, L) - start + 1)"
    sp_w = f"substr(t, start + 2, least(start + {size}, L) - start)"
    endx = (f"CASE WHEN least(start + {size}, L) >= L THEN L "
            f"WHEN strpos(reverse({dot_w}), ' .') > 0 THEN start + 1 + length({dot_w}) - strpos(reverse({dot_w}), ' .') "
            f"WHEN strpos(reverse({sp_w}), ' ') > 0 THEN start + 1 + length({sp_w}) - strpos(reverse({sp_w}), ' ') "
            f"ELSE least(start + {size}, L) END")
    return f"""
walk(k, t, L, start, n, piece) AS (
  SELECT {key}, {text}, length({text}), 0, 0, CAST(NULL AS VARCHAR) FROM {src} WHERE {text} IS NOT NULL
  UNION ALL
  SELECT k, t, L, e, n + CASE WHEN p <> '' THEN 1 ELSE 0 END, p FROM (
    SELECT k, t, L, start, n, e, {S.js_trim('substr(t, start + 1, e - start)')} AS p
    FROM (SELECT *, {endx} AS e FROM walk WHERE start < L AND n < {max_chunks})
  )
),
kept AS (
  SELECT k, CAST(n - 1 AS BIGINT) AS pos, piece AS chunk FROM walk WHERE piece <> ''
  UNION ALL
  SELECT {key}, 0, substr({text}, 1, {size}) FROM {src} x
  WHERE {text} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM walk w WHERE w.k = x.{key} AND w.piece <> '')
)"""


@query("chunk_text", "WITH RECURSIVE " + chunk_sql("documents", "doc_id", "text")
       + "\nSELECT k AS doc_id, pos, chunk FROM kept")
def q_chunk_text(spark, sf):
    d = heavy_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("pos", "chunk")) \
        .select("doc_id", _long(F.col("pos")).alias("pos"), "chunk")


@query("summarize_chunks", "WITH RECURSIVE " + chunk_sql("documents", "doc_id", "text")
       + f"\nSELECT k AS doc_id, pos, {S.summary120('chunk')} AS summary FROM kept")
def q_summarize_chunks(spark, sf):
    from vellum.operators.summarize import default_summary
    d = heavy_table(spark, sf, "documents")
    c = d.select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("pos", "chunk"))
    return c.select("doc_id", _long(F.col("pos")).alias("pos"), default_summary(F.col("chunk")).alias("summary"))


def summary_ctes(src: str, key: str, content: str, url: str) -> str:
    """CTEs ending in `summ(k, summary)`: H11 with the default summariser over rows of `src`.

    Only the CTE bodies; put them after a `WITH RECURSIVE` (the chunk walk recurses).
    """
    return chunk_sql(f"(SELECT * FROM {src} WHERE regexp_matches({url}, '(?i)^https?://') AND {content} <> '')",
                     key, content) + f""",
sums AS (SELECT k, pos, {S.js_trim(S.summary120('chunk'))} AS s FROM kept),
good AS (SELECT k, pos, s FROM sums WHERE s <> ''),
agg AS (SELECT k, count(*) AS n, string_agg(s, ' ' ORDER BY pos) AS joined, min(s) AS one_s FROM good GROUP BY k),
summ AS (
  SELECT k, CASE WHEN n = 1 THEN one_s
                 ELSE coalesce(nullif({S.js_trim(S.summary120('joined'))}, ''),
                               {S.js_trim('joined')}) END AS summary
  FROM agg)"""


def summarize_doc_sql(src: str, key: str, content: str, url: str) -> str:
    """H11 with the default summariser, over (key, content, url) rows of `src`."""
    return ("WITH RECURSIVE " + summary_ctes(src, key, content, url)
            + f"\nSELECT x.{key} AS page_id, s.summary FROM {src} x LEFT JOIN summ s ON s.k = x.{key}")


_PAGE_CONTENT = f"(SELECT page_id, url, {S.extract('html')} AS content FROM pages)"


@query("summarize_doc", summarize_doc_sql(_PAGE_CONTENT, "page_id", "content", "url"))
def q_summarize_doc(spark, sf):
    from vellum.operators.summarize import summarize_doc
    p = heavy_table(spark, sf, "pages").select("page_id", "url", H.extract_content("html").alias("r"))
    return p.select("page_id", summarize_doc(F.col("url"), F.col("r")).alias("summary"))


@query("summarize_ranked", "WITH RECURSIVE " + chunk_sql("documents", "doc_id", "text") + f""",
cut AS (SELECT k, pos AS chunk, unnest(range(len(t))) AS pos, unnest(t) AS raw FROM (
  SELECT k, pos, regexp_extract_all(chunk, '([^.!?]*[.!?]+|[^.!?]+)', 1) AS t FROM kept)),
parts AS (SELECT * FROM (SELECT k, chunk, pos, {S.js_trim('raw')} AS sentence FROM cut) WHERE sentence <> ''),
words AS (SELECT k, chunk, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}]+')) AS word FROM parts),
counts AS (SELECT k, word, count(*) AS tf FROM words GROUP BY k, word),
rarity AS (SELECT word, CAST(floor(1000 * ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1))) AS BIGINT) AS r FROM counts GROUP BY word),
scores AS (SELECT w.k, w.chunk, w.pos, CAST(sum(c.tf * r.r) AS BIGINT) // count(*) AS score
  FROM (SELECT DISTINCT * FROM words) w JOIN counts c ON c.k = w.k AND c.word = w.word JOIN rarity r ON r.word = w.word GROUP BY 1, 2, 3),
ranked AS (SELECT p.k, p.chunk, p.sentence, row_number() OVER (PARTITION BY p.k, p.chunk ORDER BY coalesce(s.score, 0) DESC, p.pos) AS rn
  FROM parts p LEFT JOIN scores s ON s.k = p.k AND s.chunk = p.chunk AND s.pos = p.pos)
SELECT k AS doc_id, string_agg(sentence, ' ' ORDER BY chunk) AS summary FROM ranked WHERE rn = 1 GROUP BY k""")
def q_summarize_ranked(spark, sf):
    from vellum.operators.rank_sentences import ranked_summaries
    return ranked_summaries(heavy_table(spark, sf, "documents"))


@query("refresh_summary", S.with_(S.LIBRARY) + """
SELECT l.id, c.turn, coalesce(nullif(c.text, ''), l.summary) AS summary
FROM library l LEFT JOIN conversations c ON c.conv_id = l.doc_id""")
def q_refresh_summary(spark, sf):
    lib = library(spark, sf)
    new = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("new"))
    return lib.join(new, "doc_id", "left").select(
        "id", "turn", P.refresh_summary(F.col("new"), F.col("metadata.summary")).alias("summary"))


@query("preview", LIB + f"""
SELECT id, CASE WHEN {S.truthy('c')} THEN substr(c, 1, 50) ELSE 'embedding' END AS preview
FROM (SELECT id, coalesce(nullif({S.compose('title', 'url', 'summary', 'notes')}, ''), text) AS c FROM library)""")
def q_preview(spark, sf):
    lib = library(spark, sf)
    m = F.col("metadata")
    c = F.coalesce(F.nullif(P.compose_text(m["title"], m["url"], m["summary"], m["notes"]), F.lit("")), F.col("text"))
    return lib.select("id", P.preview(c).alias("preview"))



@query("note_preview", LIB + f"SELECT id, coalesce({S.js_trim('notes')}, '') AS note_preview, "
                             f"{S.trunc(f'''coalesce({S.js_trim('notes')}, '')''', 220)} AS note_line FROM library")
def q_note_preview(spark, sf):
    lib = library(spark, sf)
    prev = P.note_preview(F.col("metadata.notes"))
    return lib.select("id", prev.alias("note_preview"), P.truncate_text(prev, 220).alias("note_line"))


@query("normalize_query", f"SELECT item_id, {S.js_trim('text')} AS query FROM benchmark WHERE {S.js_trim('text')} <> ''")
def q_normalize_query(spark, sf):
    from vellum.functions.text import normalize_query
    return normalize_query(table(spark, sf, "benchmark"), "text").select("item_id", F.col("text").alias("query"))


# The rest of the registry lives in two sibling modules; importing them registers their queries.
from vellum.plans import catalog_ops, catalog_vectors  # noqa: E402,F401
