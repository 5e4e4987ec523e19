"""Every registered query against its DuckDB oracle (sf0.001; the harness runs sf0.01 and sf0.1)."""

import pytest

from conftest import SF_SMALL
from harness import compare, duck

from __spark_entry__ import oracle_sql, queries

NAMES = sorted(queries())

# Without a SQL form; each is held against a brute-force version or a hand-made case elsewhere.
WITHOUT_SQL = {"ann_index_topk", "knn_graph_descent", "micro_batches"}


def _training_data_names():
    from __spark_entry__ import _training_data
    return set(_training_data())  # their tests are next to theirs


NAMES = [n for n in NAMES if n not in _training_data_names()]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_is_registered_with_a_callable():
    assert len(NAMES) >= 90
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL)
    assert r["status"] == ("no-oracle" if name in WITHOUT_SQL else "ok"), r


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["qid", "doc_id", "sim", "rank"]
