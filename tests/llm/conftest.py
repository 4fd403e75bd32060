from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 12_000
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "Alpha  beta gamma\tdelta epsilon zeta ETA theta", "en", "a"),
    (2, "alpha beta gamma", "en", None),
    (3, "", "de", "a"),
    (4, None, None, None),
    (5, " \n\t ", "fr", "b"),
    (6, LONG, "en", "b"),
    (7, "x", "es", "b"),
    (8, "x", "es", "b"),
    (8, "x", "es", "b"),
    (None, "no id here at all, just words", "en", "a"),
    (None, None, None, None),
    (9, "ünïcödé 😀 tęxt \u0000 with marks", "en", "c"),
    (10, "alpha beta gamma delta epsilon zeta eta theta", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASHING = ["n_chars", "slot", "shard", "bucket", "spans", "rep", "target", "size", "key", "id", "score", "label", "record", "region", "node", "media", "own", "to", "_id"]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1).cast("long") for c in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
