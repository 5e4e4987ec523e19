"""Regex HTML extraction (H1-H5, H7) as pure Column expressions.

The fetch-path extractor is a chain of regex rewrites, so on Spark it is a
chain of `regexp_replace` / `regexp_extract` calls: no Python, full codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import _c, collapse_ws, truthy

# Elements removed before main-text selection, in this order.
NOISE_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
# Main-text containers tried in this order.
MAIN_TAGS = ["main", "article"]
# Characters of a content preview, an explicit choice.
PREVIEW_CHARS = 5000

# The named character references decoded in titles.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\xa0"), ("&amp;", "&")]


def _block(tag: str) -> str:
    return rf"(?i)<{tag}[\s\S]*?</{tag}>"


def strip_noise_blocks(html) -> Column:
    """H1: delete script/style/nav/header/footer/aside blocks (non-greedy, first close)."""
    c = _c(html)
    for t in NOISE_TAGS:
        c = F.regexp_replace(c, _block(t), " ")
    return c


def _first_body(x: Column, tag: str):
    r"""(found, body) of the first `<tag ...>body</tag>`, from positions instead of a capture.

    The leftmost match of `<tag[^>]*>([\s\S]*?)</tag>` starts at the first
    `<tag` (case-insensitive), its body begins after the next `>`, and ends at
    the first `</tag>` after that; if that closing tag is missing, no later
    start can match either.  Three linear scans, no backtracking capture.
    """
    start = F.regexp_instr(x, F.lit(f"(?i)<{tag}"), F.lit(0))
    gt = F.call_function("locate", F.lit(">"), x, start + len(tag) + 1)
    rest = x.substr(gt + 1, F.lit(2147483647))
    close = F.regexp_instr(rest, F.lit(f"(?i)</{tag}>"), F.lit(0))
    return (start > 0) & (gt > 0) & (close > 0), rest.substr(F.lit(1), close - 1)


def select_main(html) -> Column:
    """H2: first <main> body, else first <article> body, else everything.

    Every reference to the (noise-stripped) input sits in the same codegen'd
    projection, where subexpression elimination computes it once.
    """
    x = _c(html)
    out = None
    for t in MAIN_TAGS:
        hit, body = _first_body(x, t)
        out = F.when(hit, body) if out is None else out.when(hit, body)
    return out.otherwise(x)


def strip_tags(html) -> Column:
    """H3: every `<...>` tag becomes a space; entities stay as they are."""
    return F.regexp_replace(_c(html), r"<[^>]+>", " ")


def extract_text(html, max_chars: int | None = None) -> Column:
    """H1 -> H2 -> H3 -> H4: the whole text, or its first `max_chars` characters."""
    text = collapse_ws(strip_tags(select_main(strip_noise_blocks(html))))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def extract_content(html, max_chars: int | None = None) -> Column:
    """H5: the fetch-path result struct {success, content, title, error}."""
    h = _c(html)
    # No CASE around the chain: a null page gives a null text anyway, and an
    # unconditional chain lets codegen compute the stripped page once.
    return F.struct(
        h.isNotNull().alias("success"),
        extract_text(h, max_chars).alias("content"),
        F.lit(None).cast("string").alias("title"),
        F.when(h.isNull(), F.lit("empty response")).alias("error"),
    )


def decode_entities(c) -> Column:
    c = _c(c)
    for k, v in ENTITIES:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


_OG_TAG = r"""(?i)<meta\b[^>]*\bproperty\s*=\s*["']og:title["'][^>]*>"""
_CONTENT_ATTR = r"""(?i)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"


def page_title(html) -> Column:
    """H7: og:title meta content, else the document title.

    The document title is the <title> text with entities decoded and ASCII
    whitespace stripped and collapsed, as a DOM reports it.
    """
    h = _c(html)
    tag = F.regexp_extract(h, _OG_TAG, 0)
    og = decode_entities(F.concat(F.regexp_extract(tag, _CONTENT_ATTR, 1), F.regexp_extract(tag, _CONTENT_ATTR, 2)))
    title = F.trim(F.regexp_replace(decode_entities(F.regexp_extract(h, _TITLE, 1)), r"[\t\n\f\r ]+", " "))
    return F.when(og != "", og).otherwise(title)
