"""Plan shape: pruning and pushdown reach the scan; search does not shuffle the library."""

from pyspark.sql import functions as F

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_topk_scans_two_columns_and_never_shuffles_vectors(spark, tmp_path):
    from vellum.operators.search import batch_topk

    # a library split over many files, as at scale: the scan alone spreads the work
    path = str(tmp_path / "emb")
    spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").repartition(16).write.parquet(path)
    e = spark.read.parquet(path)
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    p = plan(batch_topk(e, q, 5, id_col="vec_id", qvec_col="qv"))
    assert "MapInPandas" in p and "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p
    below = p[p.index("MapInPandas"):]
    assert "Exchange" not in below  # the library side reaches the scan without a shuffle
    assert "WindowGroupLimit" in p or "Window" in p


def test_single_file_input_gets_a_parallelism_floor(spark):
    from vellum.operators.search import batch_topk

    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")  # one file, one split
    q = e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    below = plan(batch_topk(e, q, 5, id_col="vec_id", qvec_col="qv")).split("MapInPandas", 1)[1]
    assert "RoundRobinPartitioning" in below and "hashpartitioning" not in below


def test_get_by_id_pushes_filter_to_parquet(spark, tmp_path):
    from vellum.plans.derived import library
    from vellum.sources.library_io import get_by_id, scan_library

    path = str(tmp_path / "lib")
    library(spark, SF_SMALL).write.parquet(path)
    p = plan(get_by_id(scan_library(path, spark), "emb_000000000007"))
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,emb_000000000007)]" in p


def test_extract_reads_only_html(spark):
    from vellum.functions.html import extract_text

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    p = plan(pages.select("page_id", extract_text(F.col("html")).alias("c")))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p
    assert "*(1) Project" in p  # the regex chain runs inside whole-stage codegen


def test_first_per_url_is_a_partial_aggregate(spark):
    from vellum.operators.dedupe import dedupe_batch

    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("url", F.col("page_id").alias("pos"))
    p = plan(dedupe_batch(pages))
    assert "partial_min_by" in p and "Window" not in p


def test_running_progress_windows_are_blocked(spark):
    from vellum.operators.progress import running_progress
    from vellum.plans.derived import items

    p = plan(running_progress(items(spark, SF_SMALL), block=64))
    assert "_b" in p and "partial_sum" in p.replace("partial_count", "partial_sum")


def test_model_udf_does_not_run_twice(spark):
    from vellum.operators.embed import embed

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    out = embed(docs, "text").where(F.col("emb.success"))
    p = plan(out)
    assert p.count("ArrowEvalPython") == 1


def test_snapshot_files_hold_disjoint_id_ranges(spark, tmp_path):
    from vellum.plans.derived import library
    from vellum.sources.library_io import get_by_id, scan_library, write_library

    path = write_library(library(spark, SF_SMALL), str(tmp_path / "snap"), files=4)
    lib = scan_library(path, spark)
    ranges = (lib.select(F.input_file_name().alias("f"), "id").groupBy("f")
              .agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("lo").collect())
    assert len(ranges) == 4 and all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))
    assert get_by_id(lib, "emb_000000000007").count() == 1


def test_small_patch_is_broadcast(spark):
    from vellum.operators.library import apply_patch, patch_from_labels
    from vellum.plans.derived import library, table

    out = apply_patch(library(spark, SF_SMALL), patch_from_labels(table(spark, SF_SMALL, "labels")))
    assert "BroadcastHashJoin" in plan(out)
