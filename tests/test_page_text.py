"""H6 / H8 as DataFrame steps against a page tree, and the import that uses them."""

import random

from dom_reference import extract_dom
from pyspark.sql import functions as F

CASES = [
    "<html><head><title>T</title></head><body><header>site</header><article><header>Head</header><p>Body</p><div class='ad x'>buy</div>"
    "<noscript>js</noscript></article><footer>f</footer></body></html>",
    '<head><meta property="og:title" content="OG &amp; more"><title>Plain</title></head>',
    "<html><head><title>Only title</title></head><p>Text here</p></html>",
    "<body>" + "<div>" * 300 + "in" + "</div>" * 300,
    "<body><ul>" + "".join(f"<li>i{i}" for i in range(150)),
    "<body><p class=ad>buy<p>real content", "<body><ul><li class=ad>buy<li>kept</ul>", "<body>" + "x" * 9000,
    "<body><ul><li class=ad>a<ul><li>b</li></ul><li>c<ul><li class='ad'>d<li>e</ul></ul>f",
    "<body><table><tr><td class=ads>a<td>b</tr><tr><th>c<td class=sidebar>d</table>e", "<body><dl><dt>a<dd class=ad>b<dt>c</dl>",
    "<body>a &lt; b &amp;&copy; &#65;&#x42; &unknown; &amp c &nbsp; d & e &#0; &#xD800;</body>",
    "<body><nav>n<nav>m</nav>o</nav>kept<aside>a</aside></body>trailing",
    "<body><div id=content>by id</div><div class='post-content'>by class</div></body>", "<body><div role='main'>r</div><main>m <b>b</b></main></body>",
    "<body><div class=content><div class='comments'>c</div>text<div role=banner>b</div></div>", "", "plain text", "<!-- only --><!doctype html>",
    "<body><script>var a = '<p>x</p>';</script>y<style>p{}</style>z<iframe>i</iframe></body>", "<body><img alt='a > b'>after<br/>line</body>",
    "<body><nav><article><header>h</header></article></nav><article class='ad'>gone</article><article>second <header>kept</header></article></body>",
    "<TITLE> A \n B &quot;C&quot; </TITLE><BODY><MAIN>Upper</MAIN></BODY>", "<body><p>one<div>two</div></p>three", "<body></p>a</div>b</body>",
]


def test_spans_equal_a_page_tree(spark):
    from vellum.operators.page_text import extract_pages
    rng = random.Random(8)
    parts = ["<p>", "</p>", "<div>", "</div>", "<div class='ad'>", "</div>", "<article>", "</article>", "<b>", "</b>", "text", " more ", "&amp;", "<br>",
             "<header>", "</header>", "<!-- c -->", "<span id=comments>", "</span>"]

    def nested(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["text", " more ", "&amp;", "<br>", "<!-- c -->"])
        tag, attr = rng.choice([("div", ""), ("div", " class='ad'"), ("article", ""), ("header", ""), ("section", " role=navigation"), ("b", ""), ("main", ""), ("span", " id=comments")])
        return f"<{tag}{attr}>" + "".join(nested(depth - 1) for _ in range(rng.randint(0, 3))) + f"</{tag}>"

    pages = CASES + ["<html><body>" + "".join(nested(5) for _ in range(4)) + "</body></html>" for _ in range(200)]
    df = spark.createDataFrame([*enumerate(pages), (10_000, None)], "page_id long, html string").repartition(4)
    got = {r["page_id"]: r for r in extract_pages(df).collect()}
    assert len(got) == len(pages) + 1 and got[10_000]["success"] is False and got[10_000]["error"] == "empty response" and parts
    for i, html in enumerate(pages):
        want = extract_dom(html)
        assert (got[i]["content"], got[i]["title"]) == (want["content"], want["title"]), html


def test_fallback_takes_the_fetch_path_where_the_document_is_empty(spark):
    from vellum.operators.page_text import extract_with_fallback
    df = spark.createDataFrame([(1, "<body><div class='ad'>only this</div></body>"), (2, "<body><p>x</p></body>"), (3, None)], "page_id long, html string")
    got = {r["page_id"]: (r["success"], r["content"], r["error"]) for r in extract_with_fallback(df).collect()}
    assert got == {1: (True, "only this", None), 2: (True, "x", None), 3: (False, None, "empty response")}


def test_failed_first_item_lets_the_next_one_try(spark):
    from vellum.plans.import_job import bulk_import

    def picky():
        def run(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[1.0, 0.0] for _ in texts]
        return run

    tree = spark.createDataFrame([("r", None, "root", None, "0"), ("a", "r", "bad one", "http://u/1", "1"), ("b", "r", "bad two", "http://u/1", "2"),
                                  ("c", "r", "good", "http://u/1", "3"), ("d", "r", "later", "http://u/1", "4"), ("e", "r", "bad", "http://u/2", "5"),
                                  ("f", "r", "known", "http://u/3", "6")], "id string, parent_id string, title string, url string, sort_key string")
    pages = spark.createDataFrame([("http://u/1", "<body><p>page text</p></body>")], "url string, html string")
    recs, status = bulk_import(tree, pages, spark.createDataFrame([("http://u/3",)], "url string"), embedder=picky)
    got = {r["pos"].split("/")[-1]: (r["status"], r["error"]) for r in status.collect()}
    assert {k: v[0] for k, v in got.items()} == {"1": "failure", "2": "failure", "3": "success", "4": "skip", "5": "failure", "6": "skip"}
    assert [(r["metadata"]["title"], r["metadata"]["summary"]) for r in recs.collect()] == [("good", "page text")]
    assert recs.where(F.col("id").isNull()).count() == 0
