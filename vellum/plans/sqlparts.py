"""SQL building blocks for the DuckDB oracles (the same rules as the Spark columns)."""

from __future__ import annotations

# JS whitespace class in RE2 syntax.
WS = r"[\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
NL2 = "chr(10) || chr(10)"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def truthy(x: str) -> str:
    return f"coalesce({x} <> '', false)"


def trunc(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n}) || '...' END"


def decode(x: str) -> str:
    # The named character references decoded in titles.
    for k, v in [("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&apos;", "''''"),
                 ("&nbsp;", "chr(160)"), ("&amp;", "'&'")]:
        x = f"replace({x}, '{k}', {v})"
    return x


def strip_noise(x: str) -> str:
    # Elements removed before main-text selection, in this order.
    for t in ["script", "style", "nav", "header", "footer", "aside"]:
        x = f"regexp_replace({x}, '(?i)<{t}[\\s\\S]*?</{t}>', ' ', 'g')"
    return x


def select_main(x: str) -> str:
    m = r"'(?i)<main[^>]*>([\s\S]*?)</main>'"
    a = r"'(?i)<article[^>]*>([\s\S]*?)</article>'"
    return (f"CASE WHEN regexp_matches({x}, {m}) THEN regexp_extract({x}, {m}, 1) "
            f"WHEN regexp_matches({x}, {a}) THEN regexp_extract({x}, {a}, 1) ELSE {x} END")


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def extract(x: str) -> str:
    return collapse(strip_tags(select_main(strip_noise(x))))


def page_title(x: str) -> str:
    og_tag = r"""'(?i)<meta\b[^>]*\bproperty\s*=\s*["'']og:title["''][^>]*>'"""
    content = r"""'(?i)\bcontent\s*=\s*(?:"([^"]*)"|''([^'']*)'')'"""
    tag = f"regexp_extract({x}, {og_tag}, 0)"
    og = decode(f"(regexp_extract({tag}, {content}, 1) || regexp_extract({tag}, {content}, 2))")
    title = decode(rf"regexp_extract({x}, '(?i)<title[^>]*>([\s\S]*?)</title>', 1)")
    return (f"CASE WHEN {og} <> '' THEN {og} "
            f"ELSE trim(regexp_replace({title}, '[\\t\\n\\f\\r ]+', ' ', 'g')) END")


def compose(title: str, url: str, summary: str, notes: str) -> str:
    parts = [f"CASE WHEN {truthy(c)} THEN '{lbl}' || {c} END"
             for lbl, c in (("Title: ", title), ("URL: ", url), ("Summary: ", summary), ("Notes: ", notes))]
    return f"concat_ws({NL2}, {', '.join(parts)})"


URL_RE = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^@/?#]*@)?([^:/?#]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?'"
OPAQUE_RE = r"'^([A-Za-z][A-Za-z0-9+.\-]*):([^?#]*)(\?[^#]*)?'"
SPECIAL = "('ftp', 'file', 'http', 'https', 'ws', 'wss')"


def short_url(u: str, path_cut: int, raw_cut: int) -> str:
    scheme = f"lower(regexp_extract({u}, {OPAQUE_RE}, 1))"
    host = f"lower(regexp_extract({u}, {URL_RE}, 2))"
    hier = (f"(coalesce(regexp_matches({u}, {URL_RE}), false) AND ({host} <> '' OR {scheme} NOT IN {SPECIAL} "
            f"OR {scheme} = 'file'))")
    opaque = (f"(coalesce(regexp_matches({u}, {OPAQUE_RE}), false) AND {scheme} NOT IN {SPECIAL} "
              f"AND NOT coalesce(regexp_matches({u}, {URL_RE}), false))")
    path0 = f"regexp_extract({u}, {URL_RE}, 3)"
    path = f"(CASE WHEN {path0} = '' AND {scheme} IN {SPECIAL} THEN '/' ELSE {path0} END)"
    q = f"regexp_extract({u}, {URL_RE}, 4)"
    pq = f"({path} || CASE WHEN length({q}) > 1 THEN {q} ELSE '' END)"
    oq = f"regexp_extract({u}, {OPAQUE_RE}, 3)"
    opq = f"(regexp_extract({u}, {OPAQUE_RE}, 2) || CASE WHEN length({oq}) > 1 THEN {oq} ELSE '' END)"
    return (f"CASE WHEN NOT {truthy(u)} THEN '' WHEN {hier} THEN {host} || {trunc(pq, path_cut)} "
            f"WHEN {opaque} THEN {trunc(opq, path_cut)} ELSE {trunc(u, raw_cut)} END")


def short_model(m: str) -> str:
    return f"CASE WHEN NOT {truthy(m)} THEN 'Unknown' WHEN strpos({m}, '/') > 0 THEN split_part({m}, '/', 2) ELSE {m} END"


def match_percent(s: str) -> str:
    return f"printf('%.1f', floor(round({s}, 6) * 1000 + 0.5) / 10) || '% match'"


def summary120(x: str, n: int = 120) -> str:
    """Default summariser: the first n whitespace-separated words of the trimmed text."""
    return f"array_to_string(list_slice(string_split_regex({js_trim(x)}, '{WS}+'), 1, {n}), ' ')"


LIBRARY = f"""
library AS (
  SELECT 'emb_' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS id, d.doc_id, d.text, d.lang, e.embedding,
         CASE WHEN e.embedding IS NOT NULL THEN CAST(len(e.embedding) AS BIGINT) END AS dimensions,
         CASE WHEN e.embedding IS NOT NULL
              THEN (['Xenova/all-MiniLM-L6-v2', 'Xenova/bge-small-en-v1.5', 'custom-model'])[(d.doc_id % 3) + 1] END
              AS model,
         ev.ts AS ts, (epoch_us(ev.ts) // 1000) AS ts_ms,
         CASE WHEN p.url IS NOT NULL THEN 'bookmark' END AS type, p.url, p.title,
         CASE WHEN p.url IS NOT NULL THEN CAST(d.doc_id AS VARCHAR) END AS bookmark_id,
         CASE WHEN d.lang = 'en' THEN substr(d.text, 1, 120) END AS summary,
         coalesce(c.text, '') AS notes
  FROM documents d
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  LEFT JOIN events ev ON ev.event_id = d.doc_id
  LEFT JOIN (SELECT page_id, url, {page_title('html')} AS title FROM pages) p ON p.page_id = d.doc_id
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) c ON c.conv_id = d.doc_id
)"""

CHANGES = """
changes AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'created'
              WHEN event_type IN ('view', 'click', 'purchase') THEN 'changed'
              WHEN event_type = 'error' THEN 'removed' END AS op,
         CAST(user_id AS VARCHAR) AS key, ts, (epoch_us(ts) // 1000) AS ts_ms, event_id,
         'bookmark ' || CAST(user_id AS VARCHAR) || ' v' || CAST(event_id AS VARCHAR) AS title, p.url
  FROM events LEFT JOIN pages p ON p.page_id = events.user_id
)"""

ITEMS = """
items AS (
  SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'regeneration' ELSE 'import' END AS task,
         event_id AS pos,
         CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN 'success'
              WHEN event_type = 'click' THEN 'skip' WHEN event_type = 'error' THEN 'failure' END AS status,
         CASE WHEN event_type = 'error' THEN 'failed item ' || CAST(event_id AS VARCHAR) END AS error,
         (event_type = 'error' AND value > 40) AS thrown, ts
  FROM events
)"""

TREE = """
tree AS (
  SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS title,
         CAST(NULL AS VARCHAR) AS url, lpad(CAST(r_regionkey AS VARCHAR), 12, '0') AS sort_key FROM region
  UNION ALL
  SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), n_name, CAST(NULL AS VARCHAR),
         lpad(CAST(n_nationkey AS VARCHAR), 12, '0') FROM nation
  UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), s_name, p.url,
         lpad(CAST(s_suppkey AS VARCHAR), 12, '0') FROM supplier LEFT JOIN pages p ON p.page_id = supplier.s_suppkey
)"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


def unit(v: str) -> str:
    """Unit-normalised DOUBLE[] (zero vector stays zero)."""
    return (f"(CASE WHEN sqrt(list_sum(list_transform(CAST({v} AS DOUBLE[]), lambda x: x * x))) = 0 "
            f"THEN CAST({v} AS DOUBLE[]) ELSE list_transform(CAST({v} AS DOUBLE[]), "
            f"lambda x: x / sqrt(list_sum(list_transform(CAST({v} AS DOUBLE[]), lambda y: y * y)))) END)")


def cos(a: str, b: str) -> str:
    na = f"sqrt(list_sum(list_transform(CAST({a} AS DOUBLE[]), lambda x: x * x)))"
    nb = f"sqrt(list_sum(list_transform(CAST({b} AS DOUBLE[]), lambda x: x * x)))"
    return (f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 "
            f"ELSE list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / ({na} * {nb}) END)")


def hash_buckets_cte(name: str, src: str, key: str, text: str, dim: int = 64) -> str:
    """(key, bucket, cnt) of the hashed bag of words."""
    return f"""
{name} AS (
  SELECT {key} AS k, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {dim} AS bucket, count(*) AS cnt
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS tok FROM {src})
  GROUP BY ALL
)"""


def hash_vec_cte(name: str, buckets: str, dim: int = 64) -> str:
    """(k, pos, value) dense unit vector per key from bucket counts, as float32 like the Spark column."""
    return f"""
{name} AS (
  SELECT k, bucket AS pos,
         CAST(CAST(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS value
  FROM {buckets}
)"""


def _names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def document_ctes(src: str, key: str, html: str) -> str:
    """CTEs ending in `document(id, success, content, title)`: main text and title of the pages in `src` by element spans (H6)."""
    from html.entities import html5

    from vellum.operators import page_text as D

    q = lambda x: x.replace("'", "''")
    token, tag, last = q(D.TOKEN), q(D.TAG), D.LAST
    refs = ", ".join(f"('{n}', '{q(v)}')" for n, v in sorted(html5.items()))

    def attr(name: str) -> str:
        return "(" + " || ".join(f"regexp_extract(token, '{q(D.attribute_pattern(name))}', {i})" for i in (1, 2, 3)) + ")"

    def part(t: str) -> str:
        code = (f"CASE WHEN length({t}) > 12 THEN -1 WHEN regexp_matches({t}, '^&#[0-9]') THEN TRY_CAST(regexp_extract({t}, '^&#([0-9]+)', 1) AS BIGINT) "
                f"ELSE TRY_CAST('0x' || regexp_extract({t}, '^&#[xX]([0-9A-Fa-f]+)', 1) AS BIGINT) END")
        return (f"CASE WHEN starts_with({t}, '&#') AND length({t}) > 2 THEN (SELECT CASE WHEN c <= 0 OR c > 1114111 OR c BETWEEN 55296 AND 57343 "
                f"THEN chr(65533) ELSE chr(CAST(c AS INTEGER)) END FROM (SELECT {code} AS c)) ELSE coalesce(r.stands, {t}) END")

    families = ""
    for f, (items, enders, scopes) in D.ITEMS.items():
        families += f""",
dx_{f}0 AS (SELECT *, coalesce(sum(CASE WHEN tag IN {_names(scopes)} THEN CASE WHEN open THEN 1 ELSE -1 END ELSE 0 END) OVER (
    PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nest FROM dx_level WHERE tag IN {_names(enders + scopes)}),
dx_{f} AS (SELECT id, pos, stop FROM (SELECT id, pos, tag, open, lead(pos) OVER (PARTITION BY id, nest ORDER BY pos) AS stop FROM dx_{f}0
    WHERE NOT (tag IN {_names(scopes)} AND open)) WHERE open AND tag IN {_names(items)})"""
    sooner = " UNION ALL ".join(f"SELECT * FROM dx_{f}" for f in ["p", *D.ITEMS])
    tests = {"tag": "tag = '{}'", "role": "role = '{}'", "id": "ident = '{}'", "class": "list_contains(css, '{}')"}
    nth = " ".join(f"WHEN {tests[k].format(v)} THEN {i}" for i, (k, v) in enumerate(D.CONTENT_SELECTORS))
    return f"""
dx_ref(name, stands) AS (VALUES {refs}),
dx_page AS (SELECT {key} AS id, {html} AS html FROM {src}),
dx_tok0 AS (SELECT id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (SELECT id, regexp_extract_all(html, '{token}', 1) AS t FROM dx_page)),
dx_tok1 AS (SELECT *, lower(regexp_extract(token, '{tag}', 1)) AS tag FROM dx_tok0),
dx_tok AS (SELECT *, tag <> '' AND starts_with(token, '</') AS close, tag <> '' AND NOT starts_with(token, '</') AND NOT ends_with(token, '/>')
    AND tag NOT IN {_names([*D.VOID, 'script', 'style', 'title'])} AS open FROM dx_tok1),
dx_level AS (SELECT *, CASE WHEN open THEN depth ELSE depth + 1 END AS lv FROM (
    SELECT *, sum(CASE WHEN open THEN 1 ELSE -1 END) OVER (PARTITION BY id, tag ORDER BY pos) AS depth FROM dx_tok WHERE open OR close)),
dx_own AS (SELECT * FROM (SELECT id, pos, tag, open, coalesce(lead(pos) OVER (PARTITION BY id, tag, lv ORDER BY pos), {last}) AS stop FROM dx_level) WHERE open),
dx_p AS (SELECT id, pos, stop FROM (SELECT id, pos, tag, open, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS stop FROM dx_level
    WHERE tag IN {_names(D.ENDS_P)}) WHERE open AND tag = 'p'){families},
dx_span AS (SELECT o.id, o.pos, o.tag, least(o.stop, coalesce(s.stop, {last})) AS stop FROM dx_own o LEFT JOIN ({sooner}) s ON s.id = o.id AND s.pos = o.pos),
dx_body AS (SELECT id, min(pos) AS b, arg_min(stop, pos) AS e FROM dx_span WHERE tag = 'body' GROUP BY id),
dx_open AS (SELECT t.id, t.pos, t.tag, s.stop, b.b, {attr('role')} AS role, {attr('id')} AS ident,
    string_split_regex({attr('class')}, '[\\t\\n\\f\\r ]+') AS css,
    (SELECT count(*) FROM dx_span a WHERE a.id = t.id AND a.tag = 'article' AND a.pos <= t.pos AND t.pos < a.stop) AS articles
  FROM dx_tok t JOIN dx_span s ON s.id = t.id AND s.pos = t.pos LEFT JOIN dx_body b ON b.id = t.id WHERE t.open),
dx_noise AS (SELECT id, pos, stop FROM dx_open WHERE tag IN {_names(D.DROP_TAGS)} OR (tag IN {_names(D.DROP_OUTSIDE_ARTICLE)} AND articles = 0)
    OR role IN {_names(D.DROP_ROLES)} OR ident IN {_names(D.DROP_IDS)} OR list_has_any(css, {list(D.DROP_CLASSES)}) OR (tag = 'head' AND b IS NULL)),
dx_kept AS (SELECT t.* FROM dx_tok t LEFT JOIN dx_body b ON b.id = t.id WHERE (b.b IS NULL OR (t.pos > b.b AND t.pos < b.e))
    AND NOT EXISTS (SELECT 1 FROM dx_noise n WHERE n.id = t.id AND n.pos <= t.pos AND t.pos < n.stop)),
dx_box AS (SELECT id, min(nth * 1000000000 + pos) AS first, arg_min(pos, nth * 1000000000 + pos) AS pos, arg_min(stop, nth * 1000000000 + pos) AS stop
  FROM (SELECT o.id, o.pos, o.stop, CASE {nth} END AS nth FROM dx_open o SEMI JOIN dx_kept k ON k.id = o.id AND k.pos = o.pos) WHERE nth IS NOT NULL GROUP BY id),
dx_text AS (SELECT k.id, k.pos, {part('k.token')} AS part FROM dx_kept k LEFT JOIN dx_box x ON x.id = k.id
    LEFT JOIN dx_ref r ON k.token = '&' || r.name
  WHERE k.tag = '' AND NOT regexp_matches(k.token, '^<[!?/]') AND (x.id IS NULL OR (k.pos > x.pos AND k.pos < x.stop))),
dx_content AS (SELECT id, {collapse("string_agg(part, '' ORDER BY pos)")} AS content FROM dx_text GROUP BY id),
dx_raw AS (
  SELECT id, true AS og, arg_min({attr('content')}, pos) AS raw FROM dx_tok WHERE tag = 'meta' AND NOT close AND {attr('property')} = 'og:title' GROUP BY id
  UNION ALL SELECT id, false, arg_min(regexp_extract(token, '(?i)^<title\\b[^>]*>([\\s\\S]*?)(?:</title\\s*>|\\z)', 1), pos) FROM dx_tok
  WHERE tag = 'title' AND NOT close GROUP BY id),
dx_tparts AS (SELECT id, og, unnest(range(len(t))) AS pos, unnest(t) AS token FROM (
    SELECT id, og, regexp_extract_all(raw, '({D.REFERENCE}|[^&]+|&)', 1) AS t FROM dx_raw)),
dx_titles AS (SELECT p.id, p.og, string_agg({part('p.token')}, '' ORDER BY p.pos) AS title FROM dx_tparts p LEFT JOIN dx_ref r ON p.token = '&' || r.name GROUP BY p.id, p.og),
dx_title AS (SELECT id, coalesce(max(title) FILTER (WHERE og AND title <> ''),
    max(trim(regexp_replace(title, '[\\t\\n\\f\\r ]+', ' ', 'g'))) FILTER (WHERE NOT og)) AS title FROM dx_titles GROUP BY id),
document AS (SELECT p.id, p.html IS NOT NULL AS success, CASE WHEN p.html IS NOT NULL THEN coalesce(c.content, '') END AS content,
    CASE WHEN p.html IS NOT NULL THEN coalesce(t.title, '') END AS title, p.html
  FROM dx_page p LEFT JOIN dx_content c ON c.id = p.id LEFT JOIN dx_title t ON t.id = p.id)"""


def fallback_content(d: str = "document") -> str:
    """H8's text of a row of `document`: its content, else the fetch path's."""
    return f"CASE WHEN {d}.success AND {d}.content <> '' THEN {d}.content ELSE {extract(d + '.html')} END"
