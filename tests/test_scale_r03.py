"""Steps whose tasks follow the input: backups, page text, neighbour descent, components."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_backup_frames_are_arrays_at_every_slice(spark, tmp_path, monkeypatch):
    from vellum.plans.derived import library
    from vellum.sources import library_io

    lib = library(spark, SF_SMALL).limit(7).coalesce(1)
    monkeypatch.setattr(library_io, "FRAME_ROWS", 2)
    for n in (0, 1, 7):
        path = str(tmp_path / f"b{n}")
        library_io.export_backup(lib.limit(n), path)
        texts = ["\n".join(r["value"] for r in spark.read.text(path).coalesce(1).collect())] if n else []
        assert [len(json.loads(t)) for t in texts] == ([n] if n else [])


def test_one_file_is_written_after_the_joins(spark, monkeypatch):
    from vellum.plans.catalog import REGISTRY
    from vellum.sources import library_io

    seen, before = [], library_io.export_backup
    monkeypatch.setattr(library_io, "export_backup", lambda df, path, **a: seen.append(_plan(df)) or before(df, path, **a))
    REGISTRY["read_backup_split"][0](spark, SF_SMALL)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_page_tokens_are_dealt_by_the_bytes_of_the_pages(spark, monkeypatch):
    from vellum.operators import page_text

    pages = spark.range(40).selectExpr("id AS page_id", "concat('<body><main>', repeat('a ', 500), id, '</main></body>') AS html")
    monkeypatch.setattr(page_text, "TASK_BYTES", 1000)
    got = page_text.extract_pages(pages)
    assert "RepartitionByExpression [id" in _plan(got) and ", 42" in _plan(got)  # 40 pages of some 1,040 bytes
    assert got.where("success AND content LIKE 'a a %'").count() == 40


def test_nodes_without_a_new_neighbour_get_no_vectors(spark):
    from vellum.operators.nn_descent import _candidates

    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)], "id long, vec array<double>")
    edge = [(a, b, 0.5) for a in range(6) for b in range(6) if a != b]
    edges = spark.createDataFrame(edge, "src long, dst long, sim double")
    assert _candidates(edges.withColumn("new", F.lit(False)), rows, 2, 5).count() == 0
    some = _candidates(edges.withColumn("new", F.lit(True)), rows, 2, 5)
    assert some.where("src IS NULL").count() == 6


def test_rounds_of_components_are_cut(spark, monkeypatch):
    from vellum.llm import components as c

    plans, before = [], c.cut
    monkeypatch.setattr(c, "cut", lambda df, name: plans.append(_plan(df)) or before(df, name))
    edges = before(spark.range(1, 30).selectExpr("id AS u", "id - 1 AS v"), "edges")
    assert {r["root"] for r in c.components(edges).collect()} == {0}
    assert max(p.count("Join") for p in plans) <= 4  # one join by frequent and other keys a plan
