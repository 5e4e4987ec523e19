"""Sketches of distinct urls: error bound, union over batches, repeats."""

from pyspark.sql import functions as F


def test_sketches_unite_to_the_one_pass_sketch_within_the_bound(spark, tmp_path):
    from vellum.operators.sketch import STANDARD_ERROR, add_batch, estimates, stored_estimates, url_sketches
    rows = spark.range(120_000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("http://x/"), (F.col("id") % 90_000).cast("string")).alias("url"))
    rows = rows.unionByName(spark.createDataFrame([(0, None), (0, ""), (9, None)], "g long, url string"))
    whole = {r["g"]: r["n_urls"] for r in estimates(url_sketches(rows, ["g"])).collect()}
    exact = {r["g"]: r["n"] for r in rows.where("url <> ''").groupBy("g").agg(F.countDistinct("url").alias("n")).collect()}
    assert whole.pop(9) == 0 and set(whole) == set(exact)
    assert all(abs(whole[g] - n) <= 3 * STANDARD_ERROR * n for g, n in exact.items())
    root = str(tmp_path / "sketches")
    for b in range(3):
        add_batch(rows.where(F.pmod(F.xxhash64("url"), F.lit(4)).between(b, b + 1)), root, b, ["g"])  # batches overlap
    add_batch(rows.where(F.pmod(F.xxhash64("url"), F.lit(4)).between(1, 2)), root, 1, ["g"])  # a batch again
    united = {r["g"]: r["n_urls"] for r in stored_estimates(spark, root, ["g"]).collect()}
    assert all(abs(united[g] - whole[g]) <= 3 * STANDARD_ERROR * n for g, n in exact.items())


def test_small_groups_are_counted_exactly(spark):
    from vellum.operators.sketch import estimates, url_sketches
    rows = spark.createDataFrame([("a", f"u{i % 7}") for i in range(50)] + [("b", "u")], "g string, url string")
    assert {r["g"]: r["n_urls"] for r in estimates(url_sketches(rows, ["g"])).collect()} == {"a": 7, "b": 1}
    assert estimates(url_sketches(rows.limit(0), ["g"])).count() == 0
