"""Top-k joins, ranked search and tokenizer alignment against brute-force versions."""

import math
import random

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL


def brute_topk(rows, k):
    """rows: (vec_id, vector); each row whose id is divisible by 50 against all others of its length, in whole numbers."""
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (qid, q) in enumerate(live):
        if qid is None or qid % 50:
            continue
        hits = [(-max(1 - (1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, c)))), cid is None, cid or 0) for b, (cid, c) in enumerate(live) if a != b and len(c) == len(q)]
        out += [(qid, r, None if none else cid, -s) for r, (s, none, cid) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
def test_knn_join_by_brute_force(spark, monkeypatch, kind):
    from pyspark.sql import functions as F
    from vellum.llm import knn_join as module
    rng = np.random.default_rng(7)
    n, dim = 900, 8
    centres = rng.normal(size=(12, dim)) * (6 if kind == "clusters" else 0)
    x = rng.normal(size=(n, dim)) * (0.2 if kind == "clusters" else 1) + centres[rng.integers(0, 12, n)]
    if kind == "ties":
        x = np.round(x)
        x[rng.random(n) < 0.4] = x[0]  # one vector holds many rows
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(50, rows[50][1]), (50, rows[3][1]), (None, rows[4][1]), (None, rows[4][1])]
    monkeypatch.setattr(module, "BLOCK", 37)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = module.knn_join(df, F.col("vec_id") % 50 == 0, k=5, sizes=6, slice_rows=300)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_topk(rows, 5)


def test_knn_join_leaves_far_blocks_out():
    from vellum.llm.knn_join import _reach
    rng = np.random.default_rng(0)
    pivots = rng.normal(size=(6, 5)) * 50
    for _ in range(200):
        a, b = rng.integers(0, 6, 2)
        q, o = pivots[a] + rng.normal(size=(30, 5)) * rng.random() * 9, pivots[b] + rng.normal(size=(40, 5)) * rng.random() * 9
        near = {"cell": np.array([a]), "radius": np.array([np.linalg.norm(q - pivots[a], axis=1).max()])}
        bound = _reach(near, pivots, int(b), float(np.linalg.norm(o - pivots[b], axis=1).max()), float(np.linalg.norm(o, axis=1).max()))
        assert (q @ o.T).max() <= bound[0]


def test_knn_join_messy(spark):
    from pyspark.sql import functions as F
    from vellum.llm.knn_join import inner, knn_join
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.5, -0.25]), (50, None), (100, [1.0, None, 0.0]), (150, [nan, 0.0, 0.0]), (200, [inf, 0.0, 0.0]), (250, [1.0, 2.0]),
               (300, [3.0, -1.0]), (350, []), (400, []), (1, [1.0, 0.5, -0.25]), (2, [1.0, 0.5, -0.25]), (None, [9.0, 9.0, 9.0]), (450, [1e3, 1e3, 1e3]),
               (500, [0.001] * 7), (0, [1.0, 0.5, -0.25]), (550, [2e15, 1.0, 0.0])]
    rows = [(i, v, "x", 1.0) for i, v in vectors]
    schema = "vec_id long, embedding array<double>, rank string, score double"
    got = knn_join(spark.createDataFrame(rows, schema).repartition(3), F.col("vec_id") % 50 == 0, k=5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_topk(vectors, 5)
    assert knn_join(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame(rows[:1], schema)
    assert knn_join(one, F.col("vec_id") % 50 == 0).count() == 0  # no other row
    assert inner(np.array([[2.0 ** 60, 1]]), np.array([[8.0, 3], [0, 5]])).tolist() == [[(1 << 63) - 1, 5]]


def test_lexical_search_equals_its_oracle(spark):
    import harness
    for name in ("op11_lexical_search", "op12_topk_join"):
        assert harness.compare(spark, harness.duck(SF_SMALL), name, SF_SMALL)["status"] == "ok"


def brute_search(docs, items, k):
    from collections import Counter
    from vellum.llm.lexical import terms_of
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        if text is None:
            continue
        hits = []
        for i, b in bags:
            m = b and 75 + 25 * b.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in terms_of(text) if b[t])
            if s > 0:
                hits.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def test_lexical_search_by_brute_force(spark, monkeypatch):
    from vellum.llm import lexical
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["ÄÖ", "x-y", "Don't", "中文", "A"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([3, 3, 3, 8, 20, 90])))) for i in range(700)]
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w1 w2"), (900, None), (901, ""), (902, " .,- "), (903, "w1 " * 30000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12])))) for i in range(12)] + [(3, "w1 w1 w1"), (3, "w1 w1 w1"), (20, None), (21, "nowhere"), (None, "w2 W3")]
    monkeypatch.setattr(lexical, "FIRST_DOCS", 40)
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    want = brute_search(docs, items, 7)
    full = lexical.build_index(d, segment=64)
    assert full.segments.agg({"docs": "max"}).first()[0] < 120  # one stratum holds most documents
    for index in (full, lexical.build_index(d, lexical.query_terms(q), segment=64)):
        got = lexical.search(index, q, k=7)
        assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    monkeypatch.setattr(lexical, "QUERY_BYTES", 500)  # queries in blocks
    assert sorted((tuple(r) for r in lexical.search(full, q, k=7).collect()), key=str) == want
    assert lexical.search(full, q.limit(0)).count() == 0
    assert lexical.search(lexical.build_index(d.limit(0), lexical.query_terms(q)), q).count() == 0


def brute_alignment(docs):
    import hashlib
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer
    from vellum.llm.queries import tokenizer
    from vellum.llm.tokens import byte_letters
    a_lib, letters = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), byte_letters()
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))

    def ranges(ids, raws):
        ends = np.cumsum([len(r) for r in raws]).tolist()
        return list(zip(ids, [0, *ends[:-1]], ends))

    seen = []
    for i, text in docs:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            ids = a_lib.encode(" " + text, add_special_tokens=False).ids
            raw = [bytes(letters[c] for c in a_lib.id_to_token(t)) for t in ids]
            other = b_lib.encode(text)
            raw_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(t) else p.replace("▁", " ").encode() for t in other for p in [b_lib.id_to_piece(t)]]
            if b"".join(raw) == b"".join(raw_b) == b" " + text.encode():
                a, b = ranges(ids, raw), ranges(other, raw_b)
                n_a, n_b = len(a), len(b)
                ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
                start = 0
                for e in ends:
                    groups.append(",".join(str(t) for t, s, f in a if start <= s and f <= e) + "|" + ",".join(str(t) for t, s, f in b if start <= s and f <= e))
                    start = e
                links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        seen.append((i, n_a, n_b, groups, links))
    count = Counter(p for *_, links in seen for p in set(links))
    best = Counter()
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    return sorted(((i, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, groups, links in seen), key=str)


@pytest.mark.parametrize("hot_pairs", [1 << 20, 50, 0])
def test_alignment_by_brute_force(spark, hot_pairs):
    from vellum.llm.align import align_documents
    from vellum.llm.queries import tokenizer
    rng = random.Random(6)
    pieces = ["the ", "cat", "  ", "\n", "\t", "naïve", "中文", "🙂", "▁", "<0x41>", "<s>", "<|endoftext|>", "\x00", "é", "'ll", "2024", "　", " ​", "ation"]
    docs = [(i, "".join(rng.choices(pieces, k=rng.randint(1, 25)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " "), (203, "x" * 3000), (None, docs[0][1]), (None, docs[0][1]), (7, docs[3][1])] + [(300 + i, docs[5][1]) for i in range(300)]
    docs += [(r["doc_id"], r["text"][:1500]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40).collect()]
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, n_a string").repartition(4)
    got = align_documents(df, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"), hot_pairs=hot_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_alignment(docs)
    if not hot_pairs:
        assert align_documents(df.limit(0), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")).count() == 0
