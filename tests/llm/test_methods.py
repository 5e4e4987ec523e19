"""The operators against brute-force versions, round trips and held-out labels."""

import random
import zlib

import numpy as np
from conftest import SF_MID, SF_SMALL


def test_toxicity_on_held_out_labels(spark):
    from vellum.llm.queries import REGISTRY
    got = REGISTRY["op1_toxicity"][0](spark, SF_MID).join(spark.read.parquet(f"{SF_MID}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.9


def test_folding_and_exceptions():
    from vellum.llm.toxicity import Model, fold, matched
    assert fold("An ІDІОT, m0r0n; 5tup1d! ｌｏｓｅｒ pa$$ion é $$$ 1999") == " an idiot moron stupid loser passion e "
    auto = Model({" clown ": 2.0, " idio": 1.5, " idiot ": 3.0}, {" clown fish "}).automaton()
    text = " the clown fish saw a clown an idiot and idiotic clownish "
    assert sorted(matched(auto, text).values()) == [1.5, 2.0, 3.0]


def test_sketches_recover_differences(spark):
    from vellum.llm.iblt import differences
    rng = random.Random(3)
    sets = []
    for i in range(60):
        size = rng.choice([0, 1, 5, 20, 200, 1500])
        a = {rng.getrandbits(63) for _ in range(size)}
        b = {x for x in a if rng.random() < rng.choice([0.0, 0.5, 0.95, 1.0])} | {rng.getrandbits(63) for _ in range(rng.choice([0, 3, 300]))}
        sets.append((i, sorted(a), sorted(b)))
    df = spark.createDataFrame(sets, "key long, a array<long>, b array<long>")
    got = {r["key"]: (sorted(r["only_left"]), sorted(r["only_right"]), r["n_diff"]) for r in differences(df, ["key"]).collect()}
    for i, a, b in sets:
        left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        assert got[i] == (left, right, len(left) + len(right))


def test_edit_distance_and_recall(spark):
    from vellum.llm.decontam import benchmark_index, distance, edited, text_words
    rng = random.Random(1)

    def brute(p, t):
        prev = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            cur = [i]
            for j, b in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (a != b)))
            prev = cur
        return min(prev)

    for _ in range(300):
        p, t = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        assert distance(p, t) == brute(p, t)
    items = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    index = benchmark_index(items)
    noise = np.random.default_rng(5)
    exact = close = due = 0
    for i, r in enumerate(items):
        w = text_words(r["text"])
        pad = noise.integers(1, 1 << 62, 31 + i % 7, np.int64).astype(np.uint64)
        exact += (0, i) in index.verified(np.concatenate((pad, w, pad)), np.zeros(1, np.int64))
        for _ in range(5):
            copy = edited(w, len(w) // 10, noise)
            if brute(w.tolist(), copy.tolist()) <= 0.2 * len(w):
                due += 1
                close += (0, i) in index.verified(np.concatenate((pad, copy, pad)), np.zeros(1, np.int64))
    assert exact == len(items) and close >= 0.9 * due


def test_decontamination_recall_in_every_length_class():
    from vellum.llm.decontam import CLASSES, Parts, benchmark_index, recall
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [{"item_id": i, "text": " ".join(rng.choice(vocabulary, n))} for i, n in enumerate([n for n in (1, 3, 5, 8, 10, 12, 15, 20, 24, 30, 45, 80) for _ in range(60)])]
    index = benchmark_index(rows)
    assert sorted(i for items, _ in index.parts for i in items.tolist()) == list(range(len(rows))) and len(index.parts) == len(CLASSES)
    for items, part in index.parts:
        assert recall(part, list(range(len(items))), seed=77) >= 0.9
    assert any(isinstance(part, Parts) for _, part in index.parts) and any(not isinstance(part, Parts) for _, part in index.parts)


def test_short_benchmark_items_are_found_exactly(spark):
    from vellum.llm.decontam import find_items
    docs = spark.createDataFrame([(1, "say Yes, please do it"), (2, "nothing here"), (3, None), (4, "please yes do")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "yes please"), (2, "nothing"), (3, " - "), (4, None), (5, "do it now then")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in find_items(docs, bench).collect())
    assert got == [(1, 1, 0), (2, 2, 0)]


def test_decontamination_finds_exact_passages(spark):
    from vellum.llm.decontam import text_words
    from vellum.llm.queries import REGISTRY
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_MID}/benchmark.parquet").collect()
    holds = {(d["doc_id"], i["item_id"]) for d in docs for i in items if text_words(i["text"]).tobytes() in text_words(d["text"]).tobytes()}
    got = {(r["doc_id"], r["item_id"]): r for r in REGISTRY["op3_decontamination"][0](spark, SF_MID).collect()}
    assert holds and {k for k, r in got.items() if r["distance"] == 0} == holds
    assert all(r["distance"] <= 0.2 * r["item_words"] for r in got.values())


def test_licenses_by_brute_force(spark):
    from collections import Counter
    from vellum.llm.licenses import DICE, TEMPLATES, Templates, bigrams
    from vellum.llm.words import text_words
    known = Templates.of(TEMPLATES)
    rng = random.Random(2)
    filler = "lorem ipsum the of under license version work is a released".split()
    for _ in range(60):
        name, text = rng.choice(TEMPLATES)
        words = text.split()
        if rng.random() < 0.7:
            words[rng.randrange(len(words))] = "other"
        doc = " ".join([*rng.choices(filler, k=rng.randint(0, 30)), *words, *rng.choices(filler, k=rng.randint(0, 30))])
        pairs = bigrams(text_words(doc))
        best = 0.0
        for (n, bag, size) in zip(known.names, known.bags, known.sizes):
            for p in range(len(pairs)):
                m = min(size, len(pairs) - p)
                best = max(best, 2 * sum((Counter(pairs[p:p + m].tolist()) & bag).values()) / (size + m))
        got = known.matches(text_words(doc), np.zeros(1, np.int64))
        assert max([v[0] for v in got.values()], default=0.0) == (best if best >= DICE else 0.0)


def test_packed_bits():
    from vellum.llm.token_store import id_bits, pack, unpack
    rng = np.random.default_rng(0)
    for vocab in (2, 3, 1000, 32000, 49408, 65536, 65537, 200000):
        bits = id_bits(vocab)
        ids = rng.integers(0, vocab, 5001)
        raw = pack(ids, bits)
        assert len(raw) == -(-5001 * bits // 8)
        assert (unpack(raw, bits, 5001) == ids).all() and (unpack(raw, bits, 77, 1234) == ids[1234:1311]).all()


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer
    from vellum.llm.queries import tokenizer
    from vellum.llm.tokens import Encoder
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", " '", "'S", "1", "é", "e\u0301", "!", "?", "_", "\x85", "\xa0", "\u2003", "\x1c", "\x01",
                "\u200b", "\r\n", "Σ", "İ", "ſ", "²", "½", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "中", "🙂", "\u3000", "\u180e", "\ufeff",
                "A", "long" * 20]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(4000)] + [None, "x" * 30000, " " * 30000 + "y", "ab" * 9000]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCéßñ'. 1", k=rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choices(["'", "'s", "'re", "'ll", "'d", "a", "l", "é", "7", "!", " ", "\n", "\x1f", "_"], k=rng.randint(1, 12))) for _ in range(6000)]
    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        for plain in (False, True):
            enc, lib = Encoder(tokenizer(file), plain), Tokenizer.from_file(tokenizer(file))
            lib.encode_special_tokens = plain
            want = lib.encode_batch([t or "" for t in texts], add_special_tokens=False)
            assert enc.core is not None
            assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(texts)] == [w.ids for w in want]


def test_files_without_a_core_go_to_the_library(tmp_path):
    import json

    from vellum.llm.queries import tokenizer
    from vellum.llm.tokens import Encoder
    with open(tokenizer("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][1:] + spec["model"]["merges"][:1]  # ids no longer in merge order
    (tmp_path / "t.json").write_text(json.dumps(spec))
    enc = Encoder(str(tmp_path / "t.json"))
    assert enc.core is None and enc.ids("the end").tolist() == enc.lib.encode("the end").ids


def test_least_squares_fill_the_histogram():
    from vellum.llm.packing import combinations_of, slots, solve, whole_counts
    rng = np.random.default_rng(1)
    window = 64
    combos = combinations_of(window)
    assert (combos.sum(axis=1) == window).all() and len(np.unique(combos, axis=0)) == len(combos)
    hist = np.bincount(rng.integers(1, window, 20_000), minlength=window)
    x = solve(hist.astype(float), combos)
    assert (x >= 0).all()
    counts = whole_counts(x, hist, combos)
    used = sum(np.bincount(combos[:, j], counts, window) for j in range(3))
    assert (counts >= 0).all() and (used[1:] <= hist[1:]).all() and used[1:].sum() > 0.9 * hist.sum()
    entry = slots(combos, counts)
    for length in range(1, window):
        own = entry["length"] == length
        assert (entry["first"][own] == np.cumsum(entry["n"][own]) - entry["n"][own]).all() and entry["n"][own].sum() == used[length]


def test_lookup_table_is_even_and_stable():
    from vellum.llm.sharding import fill_table
    shards = [f"s{i}" for i in range(10)]
    table = np.array(fill_table(shards, 10007))
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = np.array(fill_table(shards[:-1], 10007))
    stay = table != 9
    assert (table[stay] == fewer[stay]).mean() > 0.75


def test_balls_link_as_all_pairs_do(spark):
    from vellum.llm.components import components
    from vellum.llm.simhash import ball_links
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 120, np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(4):
            for bit in rng.choice(64, rng.integers(1, 8), replace=False):
                b ^= 1 << int(bit)
            fps.add(b)
    fps |= {int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}  # a dense group
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= 4):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    want = {}
    for i in range(len(fps)):
        want.setdefault(root(i), set()).add(int(fps[i]))
    want = {frozenset(g) for g in want.values() if len(g) > 1}
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for variants, in_slice in ((1 << 30, 1 << 22), (1 << 12, 1 << 22), (1 << 16, 1 << 12)):
        got = {}
        for r in components(ball_links(df, 4, variants, in_slice)).collect():
            got.setdefault(r["root"], set()).add(r["node"] & (1 << 64) - 1)
        assert {frozenset(g) for g in got.values()} == want


def test_fingerprint_rule():
    import re
    import xxhash
    from vellum.llm.simhash import simhash64

    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        if not words:
            return 0
        parts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices(["a", "B", "É", " ", "\u00a0", "\x0b", "\x1c", "\n", "word ", "z. "], k=rng.randint(0, 60)))
        assert simhash64(text) == brute(text)


def test_longest_match_automaton():
    from vellum.llm.wordpiece import Automaton, entry_symbols, symbols

    def brute(s, vocabulary):
        at = n = 0
        while at < len(s):
            for k in range(len(s) - at, 0, -1):
                if tuple(s[at:at + k]) in vocabulary:
                    break
            else:
                return 1
            at, n = at + k, n + 1
        return n

    rng = random.Random(1)
    for _ in range(2000):
        entries = ["".join(rng.choices("ab", k=rng.randint(1, 4))) + rng.choice(["", "</w>"]) for _ in range(6)]
        s = symbols("".join(rng.choices("ab", k=rng.randint(1, 9))))
        assert Automaton(entries).length(s) == brute(s, {tuple(entry_symbols(e)) for e in entries})


def test_queries_match_their_sql(spark):
    from harness import duck, rows_of
    from vellum.llm.queries import REGISTRY
    con = duck(SF_SMALL)
    for name, (fn, sql) in REGISTRY.items():
        if sql:
            assert rows_of(fn(spark, SF_SMALL).toPandas()) == rows_of(con.execute(sql).fetchdf()), name


def test_pipeline_filters_take_effect(spark):
    import corpus_pipeline
    from vellum.llm.common import cut
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF_SMALL), name)
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] > kept[1] >= kept[2] == kept[3]
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_licenses_keep_their_own_names():
    """Standard notices that TEMPLATES does not hold in these words, and whole texts with a neighbour's notice inside."""
    from vellum.llm.licenses import OPENINGS, TEMPLATES, Templates, whole_texts
    from vellum.llm.words import text_words
    texts = dict(whole_texts())
    known = Templates.of([*TEMPLATES, *OPENINGS, *whole_texts()])

    def named(text):
        return {name for _, name in known.matches(text_words(f"first some other words {text} and some after it"), np.zeros(1, np.int64))}

    warranty = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details.")
    for name, of, version in (("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
                              ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("AGPL-3.0", "GNU Affero General Public License", "3")):
        assert named(f"Foo is free software: you can redistribute it and/or modify it under the terms of the {of} as published by the Free "
                     f"Software Foundation, either version {version} of the License, or (at your option) any later version. "
                     + warranty.format(of)) == {name}
    for code, title in (("BY", "Attribution"), ("BY-NC", "Attribution-NonCommercial"), ("BY-SA", "Attribution-ShareAlike"),
                        ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike")):
        for version in ("4.0 International", "3.0 Unported"):
            assert named(f"The photos are licensed under a Creative Commons {title} {version} License") == {f"CC-{code}-{version[:3]}"}
    assert named("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                 "conditions are met:") == {"BSD-family"}
    assert named("This software is licensed under the GNU General Public License") == {"GPL-family"}
    rng = random.Random(4)
    for name, text in texts.items():
        words = text.split()
        for i in rng.sample(range(len(words)), len(words) // 50):
            words[i] = "other"
        assert named(" ".join(words)) == {name}


def test_licenses_windows_equal_counted_bags():
    from collections import Counter
    from vellum.llm.licenses import Templates, bigrams
    from vellum.llm.words import text_words
    rng = random.Random(6)
    for _ in range(200):
        template, docs = [" ".join(rng.choices("abc", k=rng.randint(4, 12))) for _ in range(1)][0], [rng.choices("abcd", k=rng.randint(0, 30)) for _ in range(4)]
        known = Templates.of([("T", template)], 0.7)
        got = known.matches(text_words(" ".join(w for d in docs for w in d)), np.cumsum([0, *map(len, docs[:-1])]))
        n, bag = known.sizes[0], known.bags[0]
        for i, doc in enumerate(docs):
            pairs = bigrams(text_words(" ".join(doc))).tolist()
            want = max([2 * sum((Counter(pairs[p:p + n]) & bag).values()) / (n + min(n, len(pairs) - p)) for p in range(len(pairs))], default=0.0)
            assert got.get((i, "T"), (0.0,))[0] == (want if want >= 0.7 else 0.0)


def test_toxicity_keeps_all_firm_entries(spark, monkeypatch):
    """6,000 words of toxic rows only, and a frequent word that is hardly skewed."""
    import pytest
    from vellum.llm import toxicity
    rng = random.Random(8)
    words = list({"".join(rng.choices("bcdfghjklmnpqrstvw", k=9)) for _ in range(6000)})
    plain = [f"x{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    rows = [(" ".join(["often", *words[g::10]]), 1) for g in range(10) for _ in range(20)]
    rows += [(" ".join([*rng.sample(plain, 600), *["often"] * (i < 1400)]), 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(4)
    model = toxicity.fit(df)
    auto = model.automaton()
    assert all(toxicity.matched(auto, f" {w} ") for w in words)
    assert not toxicity.matched(auto, " often ")
    assert not any(w <= model.entries.get(e[:k], -1.0) for e, w in model.entries.items() for k in range(5, len(e)))
    monkeypatch.setattr(toxicity, "MAX_MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="broadcast"):
        toxicity.fit(df)


def test_keep_one_keeps_one_row_of_each_group(spark):
    from vellum.llm.simhash import keep_one, simhash64
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine", "an own text that stands by itself here")
    near = a + " iota"
    rows = [(1, b), (5, a), (5, b), (7, a), (None, a), (None, a), (None, c), (None, c), (9, None), (8, ""), (5, a), (3, near)]
    got = [tuple(r) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    groups = []  # by brute force over the fingerprints
    for r in rows:
        linked = [g for g in groups if any((simhash64(r[1]) ^ simhash64(o[1])).bit_count() <= 4 for o in g)]
        groups = [g for g in groups if g not in linked] + [sum(linked, []) + [r]]
    assert len(got) == len(groups)
    for g in groups:
        least = min((r[0] is None, r[0] or 0) for r in g)
        assert [x for x in got if x in g] and all((x[0] is None, x[0] or 0) == least for x in got if x in g)


def test_joins_with_hot_keys(spark):
    from pyspark.sql import functions as F
    from vellum.llm.common import hot_join
    many = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id")
    one = many.groupBy("k").agg(F.count("*").alias("__n"), F.max("id").alias("top"))
    got = hot_join(many, one, "k", 5000)
    want = many.join(one.drop("__n"), "k")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
