"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests (DataFrame functions only).

A sketch has cells of (count, xor of digests, xor of checks); a digest goes to
one cell of each of three parts. Sketches of two versions subtract cell by
cell, which leaves the digests in which they differ; peeling reads digests off
cells that hold one alone until all cells are empty. Where the sketch of fixed
size cannot be peeled, the versions are sketched anew, larger: split by digest
into as many sketches as the versions' sizes could need, and a part that still
fails into four, under other hashes, until every part is recovered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut, in_order, shuffle_partitions

PART = 8  # cells of a part; three parts make a sketch
LOAD = 8  # digests per sketch on retry
ROUNDS = 14  # peeling rounds; a sketch of 24 cells that needs more is retried
PARAGRAPH_WORDS = 16
#: A paragraph: a line, a long one in runs of PARAGRAPH_WORDS words (a word of over 64 characters counts as several).
PARAGRAPH = r"\S{1,64}(?:[^\S\n]*\S{1,64}){0,%d}" % (PARAGRAPH_WORDS - 1)
NO_ID = -(1 << 63)
HEAD_BYTES = 64 << 20


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; none for null or blank texts."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)),
                                        lambda p: F.xxhash64(p)))


def _let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _entry(count: str, digest: str, seed: int) -> str:
    """A digest with its check and its three cells."""
    cell = [f"CAST({j * PART} + pmod(xxhash64({digest}, {seed}, {j}), {PART}) AS INT)" for j in range(3)]
    return (f"named_struct('n', {count}, 'k', {digest}, 'x', {_check(digest, seed)}, 'a', {cell[0]}, 'b', {cell[1]}, 'c', {cell[2]})")


def _check(digest: str, seed: int) -> str:
    return f"(xxhash64({digest}, {seed}, 3) & 4294967295L)"


def sketch_sql(items: str, seed: int = 0) -> str:
    """Cells (n, k, x) of an array of (s, h): sign and digest."""
    zero = "named_struct('n', 0L, 'k', 0L, 'x', 0L)"
    add = "(z, q) -> named_struct('n', z.n + q.n, 'k', z.k ^ q.k, 'x', z.x ^ q.x)"
    return _let(f"transform({items}, q -> {_entry('CAST(q.s AS BIGINT)', 'q.h', seed)})", "es",
                f"transform(sequence(0, {3 * PART - 1}), i -> aggregate(filter(es, q -> q.a = i OR q.b = i OR q.c = i), {zero}, {add}))")


def subtract_sql(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'x', p.x ^ q.x))"


def peel_sql(cells: str, seed: int = 0) -> str:
    """(cells, found): what is left after peeling, and the digests found with the sign of the version that has them."""
    pure = (f"array_distinct(transform(filter(st.cells, z -> abs(z.n) = 1 AND z.x = {_check('z.k', seed)}), "
            f"z -> {_entry('z.n', 'z.k', seed)}))")
    take = "(z, q) -> named_struct('n', z.n - q.n, 'k', z.k ^ q.k, 'x', z.x ^ q.x)"
    step = ("IF(size(ps) = 0, st, named_struct('cells', transform(st.cells, (c, i) -> "
            f"aggregate(filter(ps, q -> q.a = i OR q.b = i OR q.c = i), c, {take})), "
            "'found', concat(st.found, transform(ps, q -> named_struct('s', q.n, 'h', q.k)))))")
    start = f"named_struct('cells', {cells}, 'found', CAST(array() AS ARRAY<STRUCT<s: BIGINT, h: BIGINT>>))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> {_let(pure, 'ps', step)})"


def empty_sql(cells: str) -> str:
    return f"forall({cells}, z -> z.n = 0 AND z.k = 0 AND z.x = 0)"


def signed_sql(left: str, right: str) -> str:
    return f"concat(transform({left}, h -> named_struct('s', 1, 'h', h)), transform({right}, h -> named_struct('s', -1, 'h', h)))"


def fingerprint_sql(cells: str) -> str:
    """A sketch as text: the cells' counts (4 bytes), digests (8) and checks (4), in base64."""
    cell = "concat(lpad(hex(z.n), 8, '0'), lpad(hex(z.k), 16, '0'), lpad(hex(z.x), 8, '0'))"
    return f"base64(unhex(array_join(transform({cells}, z -> {cell}), '')))"


def differences(pairs: DataFrame, keys: list[str], digests: bool = True) -> DataFrame:
    """`keys` with n_left, n_right and n_diff, and with `digests` the recovered ones as `only_left` and `only_right`.

    `pairs` has `keys` (unique, not null), `a` and `b` (arrays of distinct
    digests). Sketches of fixed size are subtracted and peeled first; where
    that fails, the digests are sketched anew in parts of about LOAD, and a
    part that fails again in four. Sketches number in proportion to the
    digests, however long a text. A round that leaves nothing is the last.
    """
    plus = "transform({0}, h -> named_struct('s', 1, 'h', h))"
    base = pairs.select(*keys, "a", "b", F.expr(peel_sql(subtract_sql(sketch_sql(plus.format("a")), sketch_sql(plus.format("b"))))).alias("st"))
    base = base.withColumn("ok", F.expr(empty_sql("st.cells")))
    whole = F.expr(signed_sql("a", "b"))
    work = base.select(*keys, F.size("a").alias("n_left"), F.size("b").alias("n_right"), F.lit(0).cast("long").alias("path"), "ok",
                       F.when(F.col("ok"), F.col("st.found")).alias("found"),
                       F.greatest(F.lit(1), F.ceil(F.size(whole) / F.lit(float(LOAD)))).cast("long").alias("parts"),
                       F.when(~F.col("ok"), whole).alias("items"))
    done, seed = [], 0
    while True:
        seed += 1
        sub = F.pmod(F.xxhash64(F.col("q.h"), F.lit(seed), F.lit(9)), F.col("parts"))
        # one row per digest of what failed; what is recovered passes as one row of its own, at path -1
        spread = (work.select(*keys, "n_left", "n_right", "path", "parts", "found", F.explode_outer("items").alias("q"))
                  .select(*keys, "n_left", "n_right", "found", F.when(F.col("q").isNull(), F.lit(-1)).otherwise(F.col("path") * F.col("parts") + sub).alias("path"), "q"))
        split = spread.groupBy(*keys, "n_left", "n_right", "path").agg(F.collect_list("q").alias("items"), F.first("found", True).alias("was"))
        fresh = split.withColumn("st", F.expr(f"IF(path < 0, NULL, {peel_sql(sketch_sql('items', seed), seed)})"))
        fresh = fresh.withColumn("ok", F.expr(f"path < 0 OR {empty_sql('st.cells')}"))
        found = F.coalesce(F.col("was"), F.col("st.found"))
        now = cut(fresh.select(*keys, "n_left", "n_right", "path", "ok", F.when(F.col("ok"), F.size(found)).cast("long").alias("n"),
                               *([F.when(F.col("ok"), found).alias("found")] if digests else []),
                               F.when(~F.col("ok"), F.col("items")).alias("items")), f"iblt-{seed}")
        done.append(now.filter("ok").drop("items", "ok", "path"))
        failed = now.filter("NOT ok")
        if failed.isEmpty():
            break
        work = failed.select(*keys, "n_left", "n_right", "path", F.lit(None).cast(signed_type()).alias("found"),
                             F.lit(4).cast("long").alias("parts"), "items")
    everything = done[0]
    for d in done[1:]:
        everything = everything.unionByName(d)
    sums = [F.sum("n").alias("n_diff")] + ([F.flatten(F.collect_list("found")).alias("f")] if digests else [])
    out = everything.groupBy(*keys, "n_left", "n_right").agg(*sums)
    if not digests:
        return out
    return out.select(*keys, "n_left", "n_right", "n_diff", F.expr("transform(filter(f, q -> q.s = 1), q -> q.h)").alias("only_left"),
                      F.expr("transform(filter(f, q -> q.s = -1), q -> q.h)").alias("only_right"))


def signed_type() -> str:
    return "array<struct<s: bigint, h: bigint>>"


def likeness(n_left: Column, n_right: Column, n_diff: Column) -> Column:
    """Shared among all distinct paragraphs (Jaccard); 1 if there are none."""
    both = n_left + n_right
    return F.when(both + n_diff == 0, F.lit(1.0)).otherwise((both - n_diff) / (both + n_diff))


def part_of(k1: Column, k2: Column, bounds: list) -> Column:
    """Number of the part that (k1, k2) belongs to, by the parts' least keys: a search in steps of the square root."""
    n = len(bounds)
    step = max(1, math.isqrt(n - 1) + 1) if n else 1
    b1, b2 = (F.lit([b[j] for b in bounds]) if n else F.array().cast("array<bigint>") for j in (0, 1))

    def starts(i: Column) -> Column:  # part i begins at or before the key
        x, y = F.get(b1, i), F.get(b2, i)
        return (x < k1) | ((x == k1) & (y <= k2))

    def among(base: Column, stride: int, count: int) -> Column:
        return F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: base + j * stride), starts))

    coarse = F.greatest(among(F.lit(0), step, -(-n // step) if n else 1) - 1, F.lit(0)) * step
    return coarse + F.greatest(among(coarse, 1, step) - 1, F.lit(0))


def tail_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, copies, id, text, n_chars, edited, p1, p2): one row per distinct (id, text), with the edited text and the key before.

    Edited: the last floor(n_chars / 4) code points replaced by the first as
    many (or all) of the next document's, by ascending id (nulls first, equal
    ids by text hash); after the last comes the first. A null text is empty.

    Texts move once: keys are range-partitioned first, and texts then go to
    the part of their key, where the next row is a window's. Across parts, one
    row per part is carried; their heads are broadcast, at most HEAD_BYTES.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key1, key2 = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text)
    keys = docs.select(key1.alias("k1"), key2.alias("k2"), F.length(text).cast("long").alias("n")).distinct()
    order = F.struct("k1", "k2")
    parts = shuffle_partitions(spark)
    while True:
        ends = (in_order(keys, ["k1", "k2"], "iblt-order", parts).groupBy("part")
                .agg(F.min(order).alias("low"), F.max(order).alias("high"), F.max_by("n", order).alias("n")).orderBy("part").collect())
        if parts == 1 or sum(4 * (e["n"] // 4) for e in ends) <= HEAD_BYTES:
            break
        parts = max(1, parts // 4)
    first = [(e["low"]["k1"], e["low"]["k2"]) for e in ends]
    last = [(e["high"]["k1"], e["high"]["k2"]) for e in ends]
    border = [(i, *first[(i + 1) % len(ends)], *last[i - 1], ends[i]["n"] // 4) for i in range(len(ends))]
    border = _literal_rows(spark, border, ["part", "f1", "f2", "l1", "l2", "tail"])

    rows = docs.select(key1.alias("k1"), key2.alias("k2"), F.col(id_col).alias("id"), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    wanted = F.broadcast(border.select(F.col("part").alias("b_part"), F.col("f1").alias("k1"), F.col("f2").alias("k2"), "tail"))
    heads = (docs.select(key1.alias("k1"), key2.alias("k2"), text.alias("text")).join(wanted, ["k1", "k2"])
             .groupBy("b_part").agg(F.first(F.expr("substring(text, 1, CAST(tail AS INT))")).alias("b_head")))
    border = F.broadcast(border.join(heads, border.part == heads.b_part).select("b_part", "l1", "l2", "b_head"))

    placed = rows.withColumn("part", part_of(F.col("k1"), F.col("k2"), first)).repartition(max(1, len(ends)), "part")
    same, near = Window.partitionBy("part", "k1", "k2"), Window.partitionBy("part").orderBy("k1", "k2")
    placed = placed.withColumn("rn", F.row_number().over(same.orderBy("k2"))).withColumn("copies", F.count("*").over(same)).filter("rn = 1")
    placed = (placed.withColumn("next", F.lead("text").over(near)).withColumn("p1", F.lag("k1").over(near)).withColumn("p2", F.lag("k2").over(near))
              .join(border, F.col("part") == F.col("b_part")))
    cut_at = "CAST(floor(n_chars / 4) AS INT)"
    edited = F.expr(f"concat(substring(text, 1, CAST(n_chars AS INT) - {cut_at}), substring(coalesce(next, b_head), 1, {cut_at}))")
    return placed.select("k1", "k2", "copies", "id", "text", "n_chars", edited.alias("edited"),
                         F.coalesce("p1", "l1").alias("p1"), F.when(F.col("p1").isNull(), F.col("l2")).otherwise(F.col("p2")).alias("p2"))


def _literal_rows(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of a few rows of longs."""
    columns = [F.lit([r[j] for r in rows]) if rows else F.array().cast("array<bigint>") for j in range(len(names))]
    return spark.range(1).select(F.inline(F.arrays_zip(*[c.alias(n) for c, n in zip(columns, names)])))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its fingerprint, that of its edited text, and the likeness to it and to the next document.

    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and the recovered numbers of differing paragraphs
    diff_edited and diff_next. Texts without a paragraph (null, empty, blank)
    have an empty sketch and are alike. Equal rows get equal results; a lone
    document is its own next one. Other columns are not read.
    """
    t = tail_edits(docs, id_col, text_col)
    t = cut(t.select("k1", "k2", "p1", "p2", "id", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                     paragraph_digests(F.col("text")).alias("d"), paragraph_digests(F.col("edited")).alias("e")), "iblt-digests")
    # the next one's digests go to the document before it; all that follows stays with the document
    nexts = t.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("d").alias("nd"))
    pairs = (t.select("k1", "k2", "d", "e").join(nexts.hint("merge"), ["k1", "k2"])
             .select("k1", "k2", F.explode(F.array(
                 F.struct(F.lit("e").alias("kind"), F.col("d").alias("a"), F.col("e").alias("b")),
                 F.struct(F.lit("n").alias("kind"), F.col("d").alias("a"), F.col("nd").alias("b")))).alias("p"))
             .select("k1", "k2", "p.*"))
    diff = differences(pairs, ["k1", "k2", "kind"], digests=False)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    like = likeness(F.col("n_left"), F.col("n_right"), F.col("n_diff"))
    diff = diff.groupBy("k1", "k2").agg(of("e", F.col("n_diff")).alias("diff_edited"), of("n", F.col("n_diff")).alias("diff_next"),
                                        of("e", like).alias("near_edited"), of("n", like).alias("near_next"))
    out = t.join(diff, ["k1", "k2"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    plus = "transform({0}, h -> named_struct('s', 1, 'h', h))"
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", F.expr(fingerprint_sql(sketch_sql(plus.format("d")))).alias("fingerprint"),
                      F.expr(fingerprint_sql(sketch_sql(plus.format("e")))).alias("edited_fingerprint"),
                      "near_edited", "near_next", "diff_edited", "diff_next")
