r"""H6 / H8: main text and title of pages as a document reports them, by DataFrame steps.

A page is cut into tokens (tags, character references, text).  What a page's
elements span follows from running sums and next rows over its tokens: an element ends at the
end tag of its own name that balances it, a paragraph, list item, term or cell
also where the next one or its list or table ends, and else at the page's end.
Noise elements are spans whose tokens are dropped, the content container is the
first span of the best selector, and the text left in it is joined by position.

Windows run over one page's tokens, so a task holds pages, never a table.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.html import extract_content
from vellum.functions.text import collapse_ws

# Elements dropped before choosing the content container.
DROP_TAGS = ["script", "style", "noscript", "iframe", "nav", "aside"]
DROP_OUTSIDE_ARTICLE = ["header", "footer"]
DROP_ROLES = ["navigation", "banner"]
DROP_CLASSES = ["advertisement", "ad", "ads", "sidebar", "social-share", "comments"]
DROP_IDS = ["comments"]
# Content containers, in priority order (kind, value).
CONTENT_SELECTORS = [("tag", "main"), ("tag", "article"), ("role", "main"), ("class", "main-content"),
                     ("class", "content"), ("class", "post-content"), ("class", "article-content"),
                     ("class", "entry-content"), ("id", "content")]
# Elements without content (the HTML standard's void elements).
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
# Start tags that end an open paragraph, as the HTML standard lists them.
ENDS_P = ["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
          "table", "ul"]
# Elements that end where the next of them begins, what ends them, and the elements that they lie in.
ITEMS = {"li": (["li"], ["li"], ["ul", "ol", "menu"]), "dl": (["dt", "dd"], ["dt", "dd"], ["dl"]),
         "td": (["td", "th"], ["td", "th", "tr", "thead", "tbody", "tfoot"], ["table"])}

REFERENCE = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?"
TOKEN = ("(?i)(" + "|".join([
    r"<!--[\s\S]*?(?:-->|\z)", r"<script\b[^>]*>[\s\S]*?(?:</script\s*>|\z)", r"<style\b[^>]*>[\s\S]*?(?:</style\s*>|\z)",
    r"<title\b[^>]*>[\s\S]*?(?:</title\s*>|\z)", r"""</?[a-z][^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""", r"<[!?/][^>]*>",
    REFERENCE, r"[^<&]+", r"[<&]"]) + ")")
TAG = r"^</?([A-Za-z][^\s/>]*)"
LAST = 1 << 40  # the end of a span that no tag ends
#: Bytes of pages whose tokens a task holds, about: tokens and their sorts take a hundred times as much.
TASK_BYTES = 4 << 20


def attribute_pattern(name: str) -> str:
    return rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(token: Column, name: str) -> Column:
    return F.concat(*[F.regexp_extract(token, attribute_pattern(name), i) for i in (1, 2, 3)])


def reference_names(spark) -> DataFrame:
    """(name, stands): the standard's named character references, with and without semicolon as it lists them (2,231 rows)."""
    return spark.createDataFrame(sorted(html5.items()), "name string, stands string")


def _decoded(df: DataFrame, token: str, out: str) -> DataFrame:
    """Add `out`: the character that a reference token stands for, else the token as it is."""
    t = F.col(token)
    code = F.coalesce(F.conv(F.regexp_extract(t, r"^&#([0-9]+)", 1), 10, 10), F.conv(F.regexp_extract(t, r"^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10))
    code = F.when(F.length(t) > 12, F.lit(-1)).otherwise(code.try_cast("long"))
    bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    names = F.broadcast(reference_names(df.sparkSession))
    named = df.withColumn("_name", F.when(t.startswith("&") & (F.length(t) > 1), F.substring(t, 2, 64)))
    joined = named.join(names, named["_name"] == names["name"], "left")
    return joined.withColumn(out, F.when(t.startswith("&#") & (F.length(t) > 2), char).otherwise(F.coalesce("stands", t))).drop("_name", "name", "stands")


def page_tokens(pages: DataFrame) -> DataFrame:
    """(id, pos, token, tag, close, open) of `pages` (id, html)."""
    tok = pages.select("id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(1))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", TAG, 1))
    close = F.col("token").startswith("</") & (F.col("tag") != "")
    whole = F.col("tag").isin(*VOID, "script", "style", "title") | F.col("token").endswith("/>")
    return tok.withColumn("pos", F.col("pos").cast("long")).withColumn("tag", tag).withColumn("close", close) \
        .withColumn("open", (F.col("tag") != "") & ~F.col("close") & ~whole)


def _with_ends(tok: DataFrame) -> DataFrame:
    """Add `end` to every start tag of an element that has content: the first token that is not part of it."""
    step = F.when(F.col("open"), 1).when(F.col("close"), -1).otherwise(0)
    own = Window.partitionBy("id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(step).over(own)
    tok = tok.withColumn("level", F.when(F.col("open"), depth).when(F.col("close"), depth + 1).otherwise(F.lit(-LAST)))
    tok = tok.withColumn("end", F.lead("pos").over(Window.partitionBy("id", "tag", "level").orderBy("pos")))
    element = F.col("open") | F.col("close")

    def sooner(tok: DataFrame, member: Column, items: list[str], *keys: str) -> DataFrame:
        tok = tok.withColumn("member", member & element)
        following = F.lead("pos").over(Window.partitionBy("id", "member", *keys).orderBy("pos"))
        return tok.withColumn("end", F.when(F.col("member") & F.col("open") & F.col("tag").isin(items), F.least("end", following)).otherwise(F.col("end")))

    tok = sooner(tok, F.col("tag").isin(ENDS_P), ["p"])
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    for items, enders, scopes in ITEMS.values():
        nest = F.coalesce(F.sum(F.when(F.col("tag").isin(scopes), step).otherwise(0)).over(before), F.lit(0))
        # the start tag of an inner list or table lies at the outer level, and ends nothing there
        member = F.col("tag").isin(enders) | (F.col("tag").isin(scopes) & F.col("close"))
        tok = sooner(tok.withColumn("nest", nest), member, items, "nest")
    return tok.withColumn("end", F.when(F.col("open"), F.coalesce("end", F.lit(LAST)))).drop("level", "member", "nest")


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """H6: (id, success, content, title, error), a row for each page; ids must be unique.

    A null page is an empty response.  A page without a body tag is all body
    but for its head.  `&name;` is decoded where the standard lists the name,
    numbers where they name a character, else U+FFFD.  The tokens are dealt by
    page once, over as many tasks as the pages' bytes ask for; every step up to
    the joined text is a window over that.
    """
    from vellum.session import parts_for

    pages = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    tok = _with_ends(page_tokens(pages.repartition(parts_for(pages, "html", TASK_BYTES), "id")))
    here = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def inside(starts: Column) -> Column:
        """Whether an element whose start tag is among `starts` spans the token."""
        return F.coalesce(F.max(F.when(starts, F.col("end"))).over(here) > F.col("pos"), F.lit(False))

    opened = lambda c: F.when(F.col("open"), c)
    css = F.split(_attribute(F.col("token"), "class"), r"[\t\n\f\r ]+")
    tok = tok.withColumns({"role": opened(_attribute(F.col("token"), "role")), "ident": opened(_attribute(F.col("token"), "id")), "css": opened(css),
                           "in_article": inside(F.col("open") & (F.col("tag") == "article")),
                           "body": F.min(F.when(F.col("open") & (F.col("tag") == "body"), F.struct("pos", "end"))).over(page)})
    noise = (F.col("tag").isin(DROP_TAGS) | (F.col("tag").isin(DROP_OUTSIDE_ARTICLE) & ~F.col("in_article")) | F.col("role").isin(DROP_ROLES)
             | F.col("ident").isin(DROP_IDS) | F.arrays_overlap("css", F.array(*map(F.lit, DROP_CLASSES))) | ((F.col("tag") == "head") & F.col("body").isNull()))
    tok = tok.withColumn("noise", F.col("open") & F.coalesce(noise, F.lit(False)))
    within = F.col("body").isNull() | ((F.col("pos") > F.col("body.pos")) & (F.col("pos") < F.col("body.end")))
    tok = tok.withColumn("kept", within & ~inside(F.col("noise")))

    tests = {"tag": lambda v: F.col("tag") == v, "role": lambda v: F.col("role") == v, "id": lambda v: F.col("ident") == v,
             "class": lambda v: F.array_contains("css", v)}
    nth = F.lit(None).cast("int")
    for i, (kind, value) in reversed(list(enumerate(CONTENT_SELECTORS))):
        nth = F.when(tests[kind](value), F.lit(i)).otherwise(nth)
    tok = tok.withColumn("nth", F.when(F.col("open") & F.col("kept"), nth))
    tok = tok.withColumn("box", F.min(F.when(F.col("nth").isNotNull(), F.struct("nth", "pos", "end"))).over(page))
    text = tok.where(F.col("kept") & (F.col("tag") == "") & ~F.col("token").rlike(r"^<[!?/]")
                     & (F.col("box").isNull() | ((F.col("pos") > F.col("box.pos")) & (F.col("pos") < F.col("box.end")))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    content = _decoded(text.select("id", "pos", "token"), "token", "part").groupBy("id").agg(collapse_ws(joined).alias("content"))
    out = pages.select("id", F.col("html").isNotNull().alias("success")).join(content, "id", "left").join(page_titles(pages), "id", "left")
    ok = F.col("success")
    return out.select(F.col("id").alias(id_col), "success", F.when(ok, F.coalesce("content", F.lit(""))).alias("content"),
                      F.when(ok, F.coalesce("title", F.lit(""))).alias("title"), F.when(~ok, F.lit("empty response")).alias("error"))


def page_titles(pages: DataFrame) -> DataFrame:
    """(id, title) of `pages` (id, html): the og:title, else the title element, with all named references decoded."""
    heads = pages.select("id", F.posexplode(F.filter(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(1)),
                                                      lambda t: t.rlike(r"(?i)^<(?:title|meta)[\s/>]"))).alias("pos", "token"))
    meta = F.lower(F.substring("token", 1, 5)) == "<meta"
    og = meta & (_attribute(F.col("token"), "property") == "og:title")
    inner = F.regexp_extract("token", r"(?i)^<title\b[^>]*>([\s\S]*?)(?:</title\s*>|\z)", 1)
    found = heads.where(og | ~meta).select("id", "pos", og.alias("og"), F.when(og, _attribute(F.col("token"), "content")).otherwise(inner).alias("raw"))
    found = found.groupBy("id", "og").agg(F.min_by("raw", "pos").alias("raw"))
    parts = found.select("id", "og", F.posexplode(F.regexp_extract_all("raw", F.lit(f"({REFERENCE}|[^&]+|&)"), F.lit(1))).alias("pos", "token"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "")
    found = _decoded(parts, "token", "part").groupBy("id", "og").agg(whole.alias("title"))
    title = F.when(F.col("og"), F.col("title")).otherwise(F.trim(F.regexp_replace("title", r"[\t\n\f\r ]+", " ")))
    return found.withColumn("title", title).groupBy("id").agg(F.max_by("title", F.when(F.col("title") != "", F.col("og"))).alias("title"))


def extract_with_fallback(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """H8: the document's result where it has content, else the fetch path's (H5), with the document's title."""
    document = extract_pages(pages, id_col, html_col)
    fetched = pages.select(id_col, extract_content(F.col(html_col)).alias("fetched"))
    both = document.join(fetched, id_col)
    ok = F.col("success") & (F.col("content") != "")
    return both.select(id_col, F.when(ok, True).otherwise(F.col("fetched.success")).alias("success"),
                       F.when(ok, F.col("content")).otherwise(F.col("fetched.content")).alias("content"), "title",
                       F.when(~ok, F.col("fetched.error")).alias("error"))
