"""A page tree built per page, to hold the DataFrame form of H6 against.

Selector matching needs a tree, which SQL expressions cannot build, so this
one step runs in Python: the stdlib `html.parser` builds a small element tree
per page, noise elements are dropped, the first content container in priority
order is chosen (else the body), and its text content is whitespace-collapsed.
Pages stay in their partitions; only the html column crosses to
Python, in Arrow batches.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements dropped before choosing the content container.
DROP_TAGS = {"script", "style", "noscript", "iframe", "nav", "aside"}
DROP_OUTSIDE_ARTICLE = {"header", "footer"}
DROP_ROLES = {"navigation", "banner"}
DROP_CLASSES = {"advertisement", "ad", "ads", "sidebar", "social-share", "comments"}
DROP_IDS = {"comments"}
# Content containers, in priority order (kind, value).
CONTENT_SELECTORS = [("tag", "main"), ("tag", "article"), ("role", "main"), ("class", "main-content"),
                     ("class", "content"), ("class", "post-content"), ("class", "article-content"),
                     ("class", "entry-content"), ("id", "content")]
# Elements without content (the HTML standard's void elements).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track",
        "wbr"}

# Start tags that end an open <p>, as the HTML standard lists them.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure",
          "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol",
          "p", "pre", "search", "section", "table", "ul"}
# For a start tag, the open elements it ends and the containers it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
P_SCOPE = {"button", "caption", "html", "table", "td", "th", "template", "object"}

_JS_WS = re.compile("[" + "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]+")
_ASCII_WS = re.compile(r"[\t\n\f\r ]+")


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None)
        self.cur = self.root

    def _end(self, tags, scope):
        """Close the nearest open element of `tags`, unless one of `scope` lies between."""
        n = self.cur
        while n is not None and n.tag not in scope:
            if n.tag in tags:
                self.cur = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ENDS_P:
            self._end({"p"}, P_SCOPE)
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _classes(n: _Node) -> set:
    return set(n.attrs.get("class", "").split())


def _drop(n: _Node, in_article: bool) -> bool:
    if n.tag in DROP_TAGS:
        return True
    if n.tag in DROP_OUTSIDE_ARTICLE and not in_article:
        return True
    if n.attrs.get("role") in DROP_ROLES or n.attrs.get("id") in DROP_IDS:
        return True
    return bool(_classes(n) & DROP_CLASSES)


def _clean(top: _Node) -> None:
    """Drop noise elements below `top`, at any depth."""
    p, inside = top, False
    while p is not None:
        inside = inside or p.tag == "article"
        p = p.parent
    stack = [(top, inside)]
    while stack:
        n, inside = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or not _drop(c, inside)]
        stack.extend((c, inside or c.tag == "article") for c in n.children if not isinstance(c, str))


def _matches(n: _Node, kind: str, value: str) -> bool:
    if kind == "tag":
        return n.tag == value
    if kind == "class":
        return value in _classes(n)
    return n.attrs.get(kind) == value


def _first(n: _Node, kind: str, value: str):
    stack = [n]
    while stack:
        x = stack.pop()
        if x is not n and _matches(x, kind, value):
            return x
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return None


def _text(n: _Node) -> str:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x.children))
    return "".join(out)


def _find_tag(n: _Node, tag: str):
    return _first(n, "tag", tag)


def extract_dom(html: str) -> dict:
    """One page -> {success, content, title, error}."""
    try:
        b = _Builder()
        b.feed(html)
        b.close()
        root = b.root
        head_title = None
        og = None
        for meta in _iter(root, "meta"):
            if meta.attrs.get("property") == "og:title":
                og = meta.attrs.get("content")
                break
        t = _find_tag(root, "title")
        if t is not None:
            head_title = _ASCII_WS.sub(" ", _text(t)).strip(" ")
        body = _find_tag(root, "body")
        if body is None:  # the implied body: everything outside <head>
            body = root
            body.children = [c for c in body.children if isinstance(c, str) or c.tag != "head"]
            for c in body.children:
                if not isinstance(c, str) and c.tag == "html":
                    c.children = [g for g in c.children if isinstance(g, str) or g.tag != "head"]
        _clean(body)
        container = None
        for kind, value in CONTENT_SELECTORS:
            container = _first(body, kind, value)
            if container is not None:
                break
        container = container or body
        text = _JS_WS.sub(" ", _text(container)).strip(" ")
        return {"success": True, "content": text, "title": og or head_title or "", "error": None}
    except Exception as exc:  # noqa: BLE001 - reported as a failed extraction
        return {"success": False, "content": None, "title": None, "error": str(exc) or type(exc).__name__}


def _iter(n: _Node, tag: str):
    stack = [n]
    while stack:
        x = stack.pop()
        if x.tag == tag:
            yield x
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))


_RESULT = T.StructType([T.StructField("success", T.BooleanType()), T.StructField("content", T.StringType()),
                        T.StructField("title", T.StringType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_RESULT)
def _dom_udf(html: pd.Series) -> pd.DataFrame:
    rows = [extract_dom(h) if isinstance(h, str) else
            {"success": False, "content": None, "title": None, "error": "empty response"} for h in html]
    return pd.DataFrame(rows, columns=["success", "content", "title", "error"])


def extract_content_dom(html) -> Column:
    """H6: the DOM-path result struct."""
    return _dom_udf(html if isinstance(html, Column) else F.col(html))


def extract_with_fallback(html) -> Column:
    """H8: the DOM result when it succeeded, else the regex (fetch-path) result."""
    from vellum.functions.html import extract_content

    dom = extract_content_dom(html)
    rx = extract_content(html)
    return F.when(dom["success"], dom).otherwise(rx.cast(_RESULT))
