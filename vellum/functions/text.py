"""Scalar text columns (P1-P20): JS-compatible trim/whitespace, display helpers.

All functions build JVM-side Column expressions, so they stay inside
whole-stage codegen and are pushed through Catalyst like any built-in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ECMAScript WhiteSpace + LineTerminator set that JS `\s` and
# `String.prototype.trim` use (Java regex syntax).
JS_WS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# The embedding models a user can pick, their descriptions and
# the default model id.
MODEL_REGISTRY = [
    ("Xenova/all-MiniLM-L6-v2", "all-MiniLM-L6-v2 (Default)", "Fast, lightweight, 384 dimensions"),
    ("Xenova/all-mpnet-base-v2", "all-mpnet-base-v2", "Better quality, 768 dimensions"),
    ("Xenova/bge-small-en-v1.5", "BGE Small", "Optimized for retrieval, 384 dimensions"),
    ("Xenova/bge-base-en-v1.5", "BGE Base", "Better retrieval, 768 dimensions"),
    ("nomic-ai/nomic-embed-text-v1.5", "Nomic Embed v1.5", "High quality, 768 dimensions"),
]
DEFAULT_MODEL = "Xenova/all-MiniLM-L6-v2"

# Display cut lengths (library view, search view).
LIBRARY_URL_PATH_CUT, LIBRARY_URL_RAW_CUT = 30, 50
SEARCH_URL_PATH_CUT, SEARCH_URL_RAW_CUT = 40, 60


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(expr: Column, fn) -> Column:
    """Evaluate `expr` once and pass it to `fn` (a one-element `transform`).

    Catalyst does not share a repeated sub-expression inside one column, so a
    costly value (a regex chain, a chunk walk) used several times is bound
    here instead of being rebuilt at each use.
    """
    return F.element_at(F.transform(F.array(expr), fn), 1)


# The same set as plain characters, for `btrim`.
JS_WS_CHARS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                0x205F, 0x3000, 0xFEFF]))


def js_trim(c) -> Column:
    """`String.prototype.trim`: strips the JS whitespace set from both ends (no regex)."""
    return F.btrim(_c(c), F.lit(JS_WS_CHARS))


def collapse_ws(c) -> Column:
    """H4: runs of JS whitespace -> one space, then trim."""
    return F.trim(F.regexp_replace(_c(c), f"{JS_WS}+", " "))


def truthy(c) -> Column:
    """JS truthiness of a string: not null and not empty."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def truncate_text(c, n: int) -> Column:
    """`len<=n ? s : s[0:n] + '...'`."""
    c = _c(c)
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...")))


def compose_text(title, url, summary, notes) -> Column:
    """The non-empty of `Title:`, `URL:`, `Summary:`, `Notes:` joined by a blank line."""
    parts = []
    for label, col in (("Title: ", title), ("URL: ", url), ("Summary: ", summary), ("Notes: ", notes)):
        col = _c(col)
        parts.append(F.when(truthy(col), F.concat(F.lit(label), col)))
    return F.concat_ws("\n\n", *parts)


def text_fallback(composed, title, url, key=None) -> Column:
    """Composed text, else trim(title + ' - ' + url), else the key."""
    alt = js_trim(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" - "), F.coalesce(_c(url), F.lit(""))))
    cols = [F.nullif(_c(composed), F.lit("")), F.nullif(alt, F.lit(""))]
    if key is not None:
        cols.append(_c(key))
    return F.coalesce(*cols)


def is_http_url(c) -> Column:
    """Non-empty and starts with http:// or https:// (any case)."""
    c = _c(c)
    return F.coalesce(truthy(c) & c.rlike("(?i)^https?://"), F.lit(False))


def normalize_note(c) -> Column:
    """Trim; missing -> ''."""
    return F.coalesce(js_trim(_c(c)), F.lit(""))


def normalize_query(df, col: str = "query"):
    """P17 (query form): trim the query and reject empty ones."""
    return df.withColumn(col, js_trim(F.col(col))).where(F.coalesce(F.col(col) != "", F.lit(False)))


def note_changed(draft, stored) -> Column:
    """Trimmed draft differs from the trimmed stored note."""
    return normalize_note(draft) != normalize_note(stored)


def record_kind(url) -> Column:
    """`bookmark` when a url is present, else `text`."""
    return F.when(truthy(url), F.lit("bookmark")).otherwise(F.lit("text"))


def display_title(title, text, view: str = "library") -> Column:
    """Title else text cut at 80 (library); search cuts either at 120."""
    if view == "search":
        return truncate_text(F.when(truthy(title), _c(title)).otherwise(_c(text)), 120)
    return F.when(truthy(title), _c(title)).otherwise(truncate_text(text, 80))


def has_summary(summary) -> Column:
    """Summary present and not blank after trim."""
    return F.coalesce(js_trim(_c(summary)) != F.lit(""), F.lit(False))


def note_preview(notes) -> Column:
    """The trimmed note ('' when missing)."""
    return normalize_note(notes)


def short_model(model) -> Column:
    """Second segment of `model.split('/')`; no slash -> whole; missing -> Unknown."""
    m = _c(model)
    return (F.when(~truthy(m), F.lit("Unknown"))
            .when(F.instr(m, "/") > 0, F.split_part(m, F.lit("/"), F.lit(2)))
            .otherwise(m))


def match_percent(sim) -> Column:
    """`(sim*100).toFixed(1) + '% match'` (half-up on the similarity first rounded to 6 places)."""
    return F.concat(F.format_string("%.1f", F.floor(F.round(_c(sim), 6) * 1000 + 0.5) / 10), F.lit("% match"))


# URL pieces, parsed the way the WHATWG URL parser treats well-formed urls:
# scheme://[userinfo@]host[:port]path[?query][#fragment] (special schemes need
# a host, except file:, and get path '/' when empty); a non-special scheme
# without '//' has no host and an opaque path (mailto:, javascript:).
# Anything else counts as unparsable.
_URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^@/?#]*@)?([^:/?#]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"
_OPAQUE_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):([^?#]*)(\?[^#]*)?"
# The special schemes of the URL standard.
SPECIAL_SCHEMES = ["ftp", "file", "http", "https", "ws", "wss"]


def short_url(url, path_cut: int = LIBRARY_URL_PATH_CUT, raw_cut: int = LIBRARY_URL_RAW_CUT) -> Column:
    """P10: host + (path+query cut at `path_cut` with '...'); unparsable -> raw cut."""
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, _OPAQUE_RE, 1))
    special = scheme.isin(*SPECIAL_SCHEMES)
    host = F.lower(F.regexp_extract(u, _URL_RE, 2))
    hier = F.coalesce(u.rlike(_URL_RE), F.lit(False)) & ((host != "") | ~special | (scheme == "file"))
    opaque = F.coalesce(u.rlike(_OPAQUE_RE), F.lit(False)) & ~special & ~F.coalesce(u.rlike(_URL_RE), F.lit(False))
    path = F.regexp_extract(u, _URL_RE, 3)
    path = F.when((path == "") & special, F.lit("/")).otherwise(path)
    query = F.regexp_extract(u, _URL_RE, 4)
    o_path, o_query = F.regexp_extract(u, _OPAQUE_RE, 2), F.regexp_extract(u, _OPAQUE_RE, 3)

    def cut(pq):
        return F.when(F.char_length(pq) > path_cut, F.concat(F.substring(pq, 1, path_cut), F.lit("..."))).otherwise(pq)

    def search(q):
        return F.when(F.char_length(q) > 1, q).otherwise(F.lit(""))

    raw = F.when(F.char_length(u) > raw_cut, F.concat(F.substring(u, 1, raw_cut), F.lit("..."))).otherwise(u)
    return (F.when(~truthy(u), F.lit(""))
            .when(hier, F.concat(host, cut(F.concat(path, search(query)))))
            .when(opaque, cut(F.concat(o_path, search(o_query))))
            .otherwise(raw))


def preview(text, n: int = 50) -> Column:
    """First 50 chars, else the word `embedding`."""
    t = _c(text)
    return F.when(truthy(t), F.substring(t, 1, n)).otherwise(F.lit("embedding"))


def refresh_summary(new, old) -> Column:
    """The new summary if truthy, else keep the stored one."""
    return F.coalesce(F.nullif(_c(new), F.lit("")), _c(old))


def model_registry_df(spark):
    """P20 lookup table: model id -> declared dimension (tiny, fixed)."""
    rows = [(mid, name, desc) for mid, name, desc in MODEL_REGISTRY]
    df = spark.createDataFrame(rows, "model_id string, model_name string, description string")
    return df.withColumn("declared_dim",
                         F.regexp_extract("description", r"(\d+) dimensions", 1).cast("int"))


def model_dims(df, model_col: str = "model"):
    """P20: attach the declared dimension; unknown ids are `custom` with null dim.

    The registry has five rows, so the broadcast is bounded by construction.
    """
    reg = model_registry_df(df.sparkSession).select("model_id", "declared_dim")
    out = df.join(F.broadcast(reg), F.col(model_col) == F.col("model_id"), "left")
    return (out.withColumn("model_class", F.when(F.col("model_id").isNull(), F.lit("custom"))
                           .otherwise(F.lit("registered")))
            .drop("model_id"))
