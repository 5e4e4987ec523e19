"""Hand-made cases for the branches the generated tables do not reach."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import html as H
from vellum.functions import text as P
from vellum.functions.chunk import chunk_text
from dom_reference import extract_dom
from vellum.functions.vectors import cosine_similarity, dimension_check


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def chunks_in_duckdb(texts, size, max_chunks=1 << 30):
    """The chunking rule as the oracles state it, over {id: text}."""
    import duckdb
    import pandas as pd

    from vellum.plans.catalog import chunk_sql

    con = duckdb.connect()
    con.register("src", pd.DataFrame({"k0": list(texts), "v": list(texts.values())}))
    rows = con.execute(f"WITH RECURSIVE {chunk_sql('src', 'k0', 'v', size, max_chunks)} SELECT k, chunk FROM kept ORDER BY k, pos").fetchall()
    out = {}
    for k, c in rows:
        out.setdefault(k, []).append(c)
    return out


# ---------------------------------------------------------------- H9 chunking
@pytest.mark.parametrize("text,size,expect", [
    ("x" * 25, 10, ["x" * 10, "x" * 10]),                      # no space, no stop: hard cuts
    ("a" * 9 + ". " + "b" * 20, 10, ["a" * 9 + ".", "b" * 9]),   # sentence break inside the window
    ("short text", 100, ["short text"]),                       # shorter than size: one chunk
    ("", 10, [""]),                                            # empty text: one empty chunk
    ("   ", 2, ["  "]),                                        # only blanks: the raw first window
])
def test_chunk_cases(spark, text, size, expect):
    got = one(spark, chunk_text(F.col("v"), size, 2), text)
    assert got == expect == chunks_in_duckdb({0: text}, size, 2)[0]


def test_chunk_sentence_break_at_size_gives_size_plus_one(spark):
    text = "a" * 10 + ". " + "b" * 30
    got = one(spark, chunk_text(F.col("v"), 10, 2), text)
    assert got[0] == "a" * 10 + "." and len(got[0]) == 11
    assert got == chunks_in_duckdb({0: text}, 10, 2)[0]


def test_chunk_blank_windows_do_not_count(spark):
    text = "word " + " " * 50 + "tail words here"
    got = one(spark, chunk_text(F.col("v"), 8, 2), text)
    assert got == chunks_in_duckdb({0: text}, 8, 2)[0]


def test_chunks_cover_whole_documents_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for size in (200, 4000):
        for r in docs.select("text", chunk_text(F.col("text"), size).alias("c")).collect():
            assert "".join("".join(r["c"]).split()) == "".join(r["text"].split()) or not r["text"].strip()
            assert all(c == c.strip() and len(c) <= size + 1 for c in r["c"]) or not r["text"].strip()


# ---------------------------------------------------------------- H5 / H6 / H7 extraction
def test_main_beats_article(spark):
    html = "<body><article>art</article><main>the main</main></body>"
    assert one(spark, H.extract_text(F.col("v")), html) == "the main"


def test_nested_nav_removal_stops_at_first_close(spark):
    html = "<body><nav>a<nav>b</nav>c</nav>d</body>"
    assert one(spark, H.extract_text(F.col("v")), html) == "c d"


def test_unclosed_script_keeps_text(spark):
    html = "<body><script>var x = 1; hello</body>"
    assert one(spark, H.extract_text(F.col("v")), html) == "var x = 1; hello"


def test_entities_not_decoded_and_nbsp_is_space(spark):
    assert one(spark, H.extract_text(F.col("v")), "<p>a&nbsp;b</p>") == "a&nbsp;b"
    assert one(spark, H.extract_text(F.col("v")), "<p>a\xa0\xa0b</p>") == "a b"


def test_dom_header_inside_article_kept_ads_dropped():
    html = ("<html><head><title>T</title></head><body><header>site</header><article><header>Head</header>"
            "<p>Body</p><div class='ad x'>buy</div><noscript>js</noscript></article><footer>f</footer></body></html>")
    r = extract_dom(html)
    assert r["success"] and r["content"] == "HeadBody" and r["title"] == "T"


def test_og_title_beats_title(spark):
    html = '<head><meta property="og:title" content="OG &amp; more"><title>Plain</title></head>'
    assert one(spark, H.page_title(F.col("v")), html) == "OG & more"
    assert extract_dom(html)["title"] == "OG & more"


def test_title_whitespace_collapsed(spark):
    assert one(spark, H.page_title(F.col("v")), "<title>\n  A \t B  </title>") == "A B"


# ---------------------------------------------------------------- P: scalar functions
def test_compose_cases(spark):
    df = spark.createDataFrame([("", "", None, ""), (None, "http://u", None, None)],
                               "t string, u string, s string, n string")
    got = [r[0] for r in df.select(P.compose_text("t", "u", "s", "n")).collect()]
    assert got == ["", "URL: http://u"]


def test_text_fallback_dash(spark):
    df = spark.createDataFrame([("", "", "", "key")], "c string, t string, u string, k string")
    assert df.select(P.text_fallback("c", "t", "u", "k")).first()[0] == "-"


def test_short_url_cases(spark):
    bad = "x" * 61
    assert one(spark, P.short_url(F.col("v"), 40, 60), bad) == "x" * 60 + "..."
    assert one(spark, P.short_url(F.col("v"), 30, 50), "HTTPS://Ex.COM:8080") == "ex.com/"
    assert one(spark, P.short_url(F.col("v"), 30, 50), "http://a.b/p?q=1#frag") == "a.b/p?q=1"
    assert one(spark, P.short_url(F.col("v"), 30, 50), None) == ""
    assert one(spark, P.short_url(F.col("v"), 30, 50), "mailto:someone@example.org?subject=hi") == \
        "someone@example.org?subject=hi"
    assert one(spark, P.short_url(F.col("v"), 30, 50), "javascript:void(0)") == "void(0)"
    assert one(spark, P.short_url(F.col("v"), 30, 50), "file:///tmp/notes.txt") == "/tmp/notes.txt"
    assert one(spark, P.short_url(F.col("v"), 30, 50), "http://") == "http://"
    assert one(spark, P.short_url(F.col("v"), 30, 50), "foo://h/p") == "h/p"


def test_short_model_and_kind(spark):
    df = spark.createDataFrame([("org/name",), ("plain",), (None,)], "m string")
    assert [r[0] for r in df.select(P.short_model("m")).collect()] == ["name", "plain", "Unknown"]
    assert one(spark, P.record_kind(F.col("v")), "") == "text"


def test_match_percent(spark):
    df = spark.createDataFrame([(0.12345,), (1.0,), (0.0,)], "s double")
    assert [r[0] for r in df.select(P.match_percent("s")).collect()] == ["12.3% match", "100.0% match", "0.0% match"]


# ---------------------------------------------------------------- V6 / V9
def test_cosine_zero_and_mismatch(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(cosine_similarity("a", "b")).first()[0] == 0.0
    bad = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception):
        bad.select(cosine_similarity("a", "b")).collect()
    assert bad.select(cosine_similarity("a", "b", on_mismatch="null")).first()[0] is None
    with pytest.raises(Exception):
        bad.select(dimension_check(F.col("b"), 2)).collect()


# ---------------------------------------------------------------- K1 / K10
def test_exact_topk_k_over_n_and_ties(spark):
    from vellum.operators.search import batch_topk, exact_topk

    lib = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    got = exact_topk(lib, [1.0, 0.0], 10).collect()
    assert [r["id"] for r in got] == [1, 3, 2]
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<float>")
    got2 = batch_topk(lib, q, 10).orderBy("rank").collect()
    assert [r["id"] for r in got2] == [1, 3, 2]


# ---------------------------------------------------------------- A2 / A5 / A6
def test_empty_library_stats(spark):
    from vellum.operators.library import LIBRARY_SCHEMA
    from vellum.operators.progress import library_stats

    empty = spark.createDataFrame([], LIBRARY_SCHEMA)
    r = library_stats(empty).first()
    assert (r["count"], r["total_size"], r["average_dimensions"], r["oldest_ms"], r["newest_ms"]) == (0, 0, 0, None, None)


def test_task_error_rules(spark):
    from vellum.operators.progress import task_error

    rows = [(1, "import", 1, "failure", "A", False), (1, "import", 2, "failure", "B", False),
            (2, "import", 1, "failure", "A", False), (2, "import", 2, "failure", "B", False),
            (2, "import", 3, "failure", "C", True)]
    it = spark.createDataFrame(rows, "run_id long, task string, pos long, status string, error string, thrown boolean")
    got = {r["run_id"]: r["error"] for r in task_error(it).collect()}
    assert got == {1: "A", 2: "C"}


def test_percent(spark):
    from vellum.operators.progress import percent

    df = spark.createDataFrame([(0, 0), (1, 8)], "p long, t long")
    assert [r[0] for r in df.select(percent(F.col("p"), F.col("t"))).collect()] == [0, 13]


# ---------------------------------------------------------------- S4
def test_import_backup_rules(spark, tmp_path):
    from vellum.sources.library_io import import_backup

    good = tmp_path / "good"
    good.mkdir()
    (good / "a.json").write_text('[{"id":"x","text":"t1","embedding":[],"dimensions":0},'
                                 '{"id":"y","text":"","embedding":[1.0]},{"id":"z","text":"t3"}]')
    got = import_backup(spark, str(good)).collect()
    assert [r["text"] for r in got] == ["t1"] and got[0]["embedding"] == []
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "a.json").write_text("[]")
    assert import_backup(spark, str(empty)).count() == 0
    obj = tmp_path / "obj"
    obj.mkdir()
    (obj / "a.json").write_text('{"id":"x","text":"t","embedding":[1.0]}')
    with pytest.raises(ValueError):
        import_backup(spark, str(obj))


# ---------------------------------------------------------------- T1
def test_changes_unknown_change_creates_and_double_remove(spark):
    import datetime as dt

    from vellum.streaming.changes import CHANGE_SCHEMA, key_state

    t0 = dt.datetime(2024, 1, 1)
    rows = [("changed", "k1", t0, 1, "T", "http://a"),
            ("created", "k2", t0, 2, "T2", "http://b"), ("removed", "k2", t0 + dt.timedelta(seconds=1), 3, None, None),
            ("removed", "k2", t0 + dt.timedelta(seconds=2), 4, None, None)]
    st = {r["key"]: r for r in key_state(spark.createDataFrame(rows, CHANGE_SCHEMA)).collect()}
    assert st["k1"]["live"] and st["k1"]["text"] == "Title: T\n\nURL: http://a"
    assert not st["k2"]["live"]


def test_reimport_gives_new_records_and_skip_mode(spark, tmp_path):
    from vellum.plans.derived import library
    from vellum.sources.library_io import export_backup, import_backup

    lib = library(spark, "/root/testdata/sf0.001")
    path = export_backup(lib, str(tmp_path / "bk"))
    a = import_backup(spark, path, batch="one")
    b = import_backup(spark, path, batch="two")
    n = a.count()
    assert n > 0 and a.select("id").distinct().count() == n
    assert a.unionByName(b).select("id").distinct().count() == 2 * n
    assert import_backup(spark, path, on_conflict="skip", current=a).count() == 0


def test_pooling_masks_padding_and_normalises():
    import numpy as np

    from vellum.operators.embed import onnx_embedder, pool_and_normalize

    hidden = np.array([[[1.0, 0.0], [3.0, 4.0], [100.0, 100.0]]])
    mask = np.array([[1, 1, 0]])
    out = pool_and_normalize(hidden, mask)
    assert np.allclose(out, [[2.0, 2.0]] / np.sqrt(8.0))
    assert np.allclose(pool_and_normalize(np.zeros((1, 2, 2)), np.ones((1, 2))), 0.0)
    with pytest.raises(FileNotFoundError):
        onnx_embedder("/nonexistent")()


@pytest.mark.parametrize("size,max_chunks", [(3, 2), (5, 3), (8, 2), (13, 4), (7, None)])
def test_chunk_random_whitespace_heavy_texts(spark, size, max_chunks):
    """Seeded random texts full of blanks, dots and NBSP: the expression equals the oracle's rule."""
    import random

    rnd = random.Random(size * 100 + (max_chunks or 0))
    alphabet = ["a", "b", ".", " ", " ", " ", "\n", "\t", "\xa0", ". "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r["i"]: r["c"] for r in df.select("i", chunk_text(F.col("v"), size, max_chunks).alias("c")).collect()}
    want = chunks_in_duckdb(dict(enumerate(texts)), size, max_chunks or 1 << 30)
    for i, t in enumerate(texts):
        assert got[i] == want[i], (size, max_chunks, repr(t))


def test_read_pages_status_codes(spark):
    from vellum.sources.library_io import read_pages

    df = spark.createDataFrame([(1, "http://a", "<p>x</p>", 200), (2, "http://b", "", 404), (3, "http://c", "", 503)],
                               "page_id long, url string, html string, status int")
    got = {r["page_id"]: (r["success"], r["error"]) for r in read_pages(df, "status").collect()}
    assert got == {1: (True, None), 2: (False, "HTTP 404"), 3: (False, "HTTP 503")}


def test_is_http_url_cases(spark):
    df = spark.createDataFrame([("HTTPS://x",), ("ftp://x",), ("",), (None,), ("http:/x",)], "u string")
    assert [r[0] for r in df.select(P.is_http_url("u")).collect()] == [True, False, False, False, False]


def test_og_title_single_quotes_and_attribute_order(spark):
    html = "<head><meta content='Single &amp; quoted' property='og:title'><title>T</title></head>"
    assert one(spark, H.page_title(F.col("v")), html) == "Single & quoted"


def test_dom_without_body_tag_skips_head():
    r = extract_dom("<html><head><title>Only title</title></head><p>Text here</p></html>")
    assert r["content"] == "Text here" and r["title"] == "Only title"


def test_js_whitespace_semantics_random(spark):
    """trim / collapse over the JS whitespace set (NBSP, U+2028, BOM, ...), checked against plain Python."""
    import random
    import re

    ws_cp = [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
             0xFEFF]
    ws = "".join(map(chr, ws_cp))
    not_ws = ["a", "\xe9", "\u200b", "\x1c", "x y"]  # zero-width space and \x1c are not JS whitespace
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(list(ws) + not_ws) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    got = {r["i"]: (r["t"], r["c"]) for r in
           df.select("i", P.js_trim("v").alias("t"), P.collapse_ws("v").alias("c")).collect()}
    run = re.compile("[" + re.escape(ws) + "]+")
    for i, t in enumerate(texts):
        assert got[i] == (t.strip(ws), run.sub(" ", t).strip(" ")), repr(t)


def test_deep_trees_are_walked_to_the_end(spark):
    from vellum.sources.tree import flatten_tree

    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"t{i}", f"http://x/{i}", "0") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, parent_id string, title string, url string, sort_key string")
    assert [r["depth"] for r in flatten_tree(df).collect()] == list(range(30))
    looped = df.unionByName(spark.createDataFrame([("n1", "n29", "t", "u", "0")], df.schema))
    with pytest.raises(ValueError):
        flatten_tree(looped)


def test_dom_takes_any_depth_and_implied_end_tags():
    deep = extract_dom("<body>" + "<div>" * 3000 + "in" + "</div>" * 3000)
    assert deep["success"] and deep["content"] == "in"
    items = extract_dom("<body><ul>" + "".join(f"<li>i{i}" for i in range(1500)))
    assert items["success"] and items["content"].startswith("i0i1") and items["content"].endswith("i1499")
    assert extract_dom("<body><p class=ad>buy<p>real content")["content"] == "real content"
    assert extract_dom("<body><ul><li class=ad>buy<li>kept</ul>")["content"] == "kept"
    assert len(extract_dom("<body>" + "x" * 9000)["content"]) == 9000


def test_cancelled_and_failed_runs(spark):
    from vellum.operators.progress import TASK_TEXT, task_flags, task_summary

    rows = [("import", 10, 4, 3, 0, 1, None, True), ("import", 10, 4, 3, 0, 1, "broken", False), ("regeneration", 10, 10, 9, 0, 1, None, False),
            ("import", 0, 0, 0, 0, 0, "no start", False)]
    df = spark.createDataFrame(rows, "task string, total long, processed long, success long, skipped long, failed long, error string, stop boolean")
    out = task_flags(task_summary(df, is_processing=F.lit(False), cancelled=F.col("stop")), F.col("stop")).collect()
    fill = lambda r, kind: TASK_TEXT[r["task"]][kind].format(
        percent=round(100 * r["processed"] / r["total"]) if r["total"] else 0, **{c: r[c] for c in ("processed", "total", "success", "skipped", "failed")})
    by = {(r["task"], r["error"]): r for r in out}
    assert by["import", None]["text"] == fill(by["import", None], "cancelled") and by["import", None]["type"] == "success"
    assert by["import", "broken"]["type"] == "error" and by["import", "broken"]["has_activity"]
    assert by["regeneration", None]["text"] == fill(by["regeneration", None], "finished") and not by["regeneration", None]["has_remaining_work"]
    assert by["import", "no start"]["has_activity"] and not by["import", "no start"]["has_remaining_work"]


def test_checkpoint_folder_is_the_sessions(spark):
    from vellum.session import checkpoint_dir, scratch_path

    where = checkpoint_dir(spark)
    assert where == spark.conf.get("spark.checkpoint.dir") and scratch_path(spark, "x").startswith(where)



def test_onnx_embedder_pools_all_windows_of_long_texts(tmp_path, monkeypatch):
    import sys
    import types

    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    from vellum.operators.embed import onnx_embedder

    tok = Tokenizer(models.WordLevel({"[PAD]": 0, "a": 1, "b": 2, "c": 3}, unk_token="[PAD]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "model.onnx").write_bytes(b"")

    class Session:  # a token's state is its one-hot id
        def __init__(self, *_, **__):
            pass

        def get_inputs(self):
            return []

        def run(self, _, feed):
            return [np.eye(4)[feed["input_ids"]]]

    monkeypatch.setitem(sys.modules, "onnxruntime", types.SimpleNamespace(InferenceSession=Session))
    got = onnx_embedder(str(tmp_path), max_length=4, batch_size=2)()(["a b", "a " * 4 + "b " * 3 + "c " * 12, None, "c"])
    want = np.array([[0, 1, 1, 0], [0, 4, 3, 12], [0, 0, 0, 0], [0, 0, 0, 1]], float)
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9))
