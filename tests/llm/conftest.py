import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       # names that operators use or return themselves
                       *[T.StructField(c, T.StringType()) for c in ("score", "fp", "slot", "shard", "host", "rule", "n_tokens", "part", "rest")]])

LONG = "\n".join(" ".join(f"word{i}x{j}" for j in range(40)) for i in range(700))
PASSAGE = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix the purple potion under moonlight"


def row(doc_id, text):
    return (doc_id, text, "en", *["?"] * 9)


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, clashing columns."""
    texts = [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "alpha beta gamma delta epsilon zeta"),
             (None, "alpha beta gamma delta epsilon zeta"), (None, None), (7, "ünï çödé 🙂 \u0085 a\u00a0b  c"), (8, f"before it {PASSAGE} and after"),
             (8, f"before it {PASSAGE} and after"), (9, "x" * 5000), (10, "one"), (12, f"{LONG} tail"), (11, "Released under the MIT License."),
             (13, "a <|endoftext|> b <|startoftext|><|ENDOFTEXT|>")]
    return spark.createDataFrame([row(*t) for t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
