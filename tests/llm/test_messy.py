"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator and stage."""

import hashlib
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from .conftest import LONG, PASSAGE, row


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: [(x is None, x) for x in t])


def test_toxicity(spark, messy, nothing):
    from vellum.llm.toxicity import Model, fit_documents, score
    model = Model({" alpha ": 3.0, " wor": 1.0}, {" beta gamma "}, [-2.0, 1.0, 1.0, 1.0, 0.0])
    got = score(messy, model)
    assert got.count() == messy.count() and [c for c in got.columns if c == "score"] == ["score"]
    by = {(r["doc_id"], r["text"]): r["score"] for r in got.collect()}
    base = by[(3, "")]
    assert by[(2, None)] == by[(4, " \n\t ")] == base and all(0 <= v <= 1 for v in by.values())
    assert by[(1, "alpha beta gamma delta epsilon zeta")] > base and by[(5, LONG)] > base
    assert score(nothing, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert fit_documents(nothing, labels).entries == {}
    assert fit_documents(messy, labels.limit(0)).entries == {}


def test_fingerprints(spark, messy, nothing):
    from vellum.llm.iblt import fingerprint_documents
    got = fingerprint_documents(messy).collect()
    assert len(got) == messy.count()
    keyed = [(r["doc_id"], (r["text"] or "")) for r in messy.collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is None, i or 0, len(t)) for i, t in keyed)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[1] == prints[6] and len(prints[8]) == 1 and prints[2] == prints[3] == prints[4]
    assert fingerprint_documents(nothing).count() == 0
    alone = fingerprint_documents(spark.createDataFrame([row(1, "abcdefgh")], messy.schema)).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1.0


def test_decontamination(spark, messy, nothing):
    from vellum.llm.decontam import drop_contaminated, find_items
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "alpha beta"), (5, PASSAGE), (None, "word3x1 word3x2 word3x3 word3x4 word3x5 word3x6")],
                                  "item_id long, text string")
    got = rows(find_items(messy, bench), "doc_id", "item_id", "distance")
    assert got == sorted([(1, 4, 0), (6, 4, 0), (None, 4, 0), (8, 1, 0), (8, 1, 0), (8, 5, 0), (8, 5, 0), (5, None, 0), (12, None, 0)], key=lambda t: [(x is None, x) for x in t])
    left = drop_contaminated(messy, bench)
    assert left.columns == messy.columns and left.count() == messy.count() - 7
    assert find_items(nothing, bench).count() == 0 and find_items(messy, bench.limit(0)).count() == 0
    assert drop_contaminated(messy, bench.limit(0)).count() == messy.count()


def test_licenses(messy, nothing):
    from vellum.llm.licenses import scan
    assert rows(scan(messy), "doc_id", "license", "dice", "word_at") == [(11, "MIT", 1.0, 0)]
    assert scan(nothing).count() == 0 and scan(messy, templates=[]).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files(spark, messy, nothing, file):
    from tokenizers import Tokenizer
    from vellum.llm.queries import tokenizer
    from vellum.llm.token_store import read_tokens, write_tokens
    from vellum.session import scratch_path
    lib = Tokenizer.from_file(tokenizer(file))
    manifest = write_tokens(messy, scratch_path(spark, "t"), tokenizer(file))
    got = sorted(read_tokens(manifest).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"] or "") for r in messy.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    at = 0
    for g, (i, t) in zip(got, want, strict=True):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = write_tokens(nothing, scratch_path(spark, "t"), tokenizer(file))
    assert empty.count() == 0 and read_tokens(empty).count() == 0


def test_packing(messy, nothing):
    from vellum.llm.packing import pack_documents
    from vellum.llm.queries import tokenizer
    got = pack_documents(messy, tokenizer("byte_bpe_50k.json")).collect()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    due = []
    for r in messy.collect():
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        due.append((r["doc_id"], ids))
    for r in got:  # every piece is a run of its document's ids
        assert any(i == r["doc_id"] and len(ids) == r["doc_tokens"]
                   and zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for i, ids in due)
    assert sum(r["doc_tokens"] for r in got if r["start"] == 0) == sum(r["length"] for r in got) == sum(len(ids) for _, ids in due)
    assert sum(r["start"] == 0 for r in got) == messy.count()
    assert pack_documents(nothing, tokenizer("byte_bpe_50k.json")).count() == 0


def test_sharding(spark, messy, nothing):
    from vellum.llm.sharding import place
    got = place(messy, ["a", "b", "c"], size=101)
    assert got.count() == messy.count() and got.columns.count("slot") == 1 and got.columns.count("shard") == 1
    assert len({r["shard"] for r in got.filter("doc_id = 8").collect()}) == 1
    assert len({r["shard"] for r in got.filter("doc_id IS NULL").collect()}) == 1
    assert place(nothing, ["a"], size=101).count() == 0


def test_simhash(spark, messy, nothing):
    from vellum.llm.simhash import keep_one, near_duplicates
    got = rows(near_duplicates(messy), "doc_id", "component_id", "fingerprint")
    by = {g[0]: g[1:] for g in got}
    assert len(got) == messy.count() and by[2] == by[3] == by[4] == (2, "0" * 16) and by[6][0] == 1 and by[8][0] == 8
    assert {g[1] for g in got if g[0] is None} == {1, 2}
    kept = keep_one(messy)
    assert kept.columns == messy.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids.count(8) == 1 and 6 not in ids and {3, 4}.isdisjoint(ids) and {1, 2}.issubset(ids)
    assert near_duplicates(nothing).count() == 0 and keep_one(nothing).count() == 0


def test_urls(spark, nothing):
    from vellum.llm.queries import URL_RULES
    from vellum.llm.urlfilter import filter_urls, rule_table
    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?q#f", "x://example.org", "x://example.org/en/12", "x://myexample.org/en/1",
            "x://org/es/", "x://a..org/", "x://shop.com/FR/", "x://shop.com/fr/a", "x://shop.com/de/a", "x://com?/fr/", "x://u@example.org:80/es/",
            "x://org/" + "a/" * 20000, "x://" + "a." * 5000 + "org/", "https://A.Example.ORG/es/x?q#f"]
    df = spark.createDataFrame([(i, u, "?", "?") for i, u in enumerate(urls)], "page_id long, url string, Host string, rule string")
    out = filter_urls(df, rule_table(spark, URL_RULES))
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == len(urls) and out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]

    def brute(u):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, max(fits)[1], max(fits)[2]) if fits else (host, None, "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    # the way without a broadcast gives the same rows
    again = filter_urls(df, rule_table(spark, URL_RULES), broadcast_bytes=0)
    assert {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in again.collect()} == got
    assert filter_urls(df.limit(0), rule_table(spark, URL_RULES)).count() == 0
    assert filter_urls(df, rule_table(spark, [])).filter("verdict = 'allow' AND rule IS NULL").count() == len(urls)


def test_token_counts(messy, nothing):
    from vellum.llm.queries import tokenizer
    from vellum.llm.wordpiece import count_tokens
    got = count_tokens(messy, tokenizer("word_bpe_49k.json"))
    assert got.columns.count("n_tokens") == 1 and got.count() == messy.count()
    by = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in got.collect()}
    assert by[2] == by[3] == by[4] == (0, 0) and by[10] == (1, 1) and by[12][0] > 28000
    assert count_tokens(nothing, tokenizer("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, messy, nothing, stage):
    import corpus_pipeline
    name, fn = corpus_pipeline.STAGES[stage]
    for docs in (messy, nothing):
        out = fn(spark, docs, SF_SMALL)
        n = out.count()
        assert name == "packing" or (out.columns == docs.columns and n <= docs.count())
        assert bool(n) == bool(docs.count())
