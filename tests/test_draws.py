"""Draws that repeat are draws all the same."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import experiments, splits


def spread(spark, n, replicates, share=0.9):
    """Standard deviation of a resampled accuracy, by the binomial one."""
    draws = spark.range(replicates * n).select(F.expr(f"id div {n}").alias("b"), (splits.mixed(F.col("id")) % n).alias("r"))
    accuracy = [r["a"] for r in draws.groupBy("b").agg(F.avg((F.col("r") < int(share * n)).cast("double")).alias("a")).collect()]
    return np.std(accuracy) / math.sqrt(share * (1 - share) / n)


@pytest.mark.parametrize("n, replicates, off", [(1_000, 2000, 0.1), (100_000, 300, 0.15)])
def test_replicates_spread_like_a_binomial(spark, n, replicates, off):
    assert abs(spread(spark, n, replicates) - 1) < off


@pytest.mark.parametrize("n", [1_000, 100_000, 1_000_003, 2_500_000])
def test_a_resample_repeats_rows_as_it_should(spark, n):
    """Some 63.2 in 100 rows are drawn, and each tenth of them gets a tenth of the draws."""
    drawn = spark.range(n).select((splits.mixed(F.col("id"), seed=7) % n).alias("r"))
    distinct, tenth = drawn.select("r").distinct().count() / n, drawn.where(F.col("r") < n // 10).count() / n
    assert abs(distinct - 1 + math.exp(-1)) < 2 / math.sqrt(n) and abs(tenth - 0.1) < 2 / math.sqrt(n)


def test_intervals_agree_with_multinomial_counts(spark):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 4, 1500)
    pred = np.where(rng.random(1500) < 0.85, label, rng.integers(0, 4, 1500))
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(label, pred, strict=True))], "id long, label long, pred long")
    one, two = experiments.bootstrap(rows, "id", "label", "pred", 1000).first(), experiments.bootstrap_counts(rows, "label", "pred").first()
    for kind in ("f1", "acc"):
        width = two[f"{kind}_hi"] - two[f"{kind}_lo"]
        assert abs(one[f"{kind}_hi"] - one[f"{kind}_lo"] - width) < 0.1 * width and abs(one[f"{kind}_lo"] - two[f"{kind}_lo"]) < 0.1 * width


def test_the_number_is_the_same_everywhere(spark):
    keys = [(0, "x"), (-5, "y"), (1 << 62, "")]
    rows = spark.createDataFrame(keys, "a long, b string")
    got = [r[0] for r in rows.select(splits.mixed(F.col("a"), F.col("b"), seed=3)).collect()]
    want = [int(hashlib.md5(f"3:{a}:{b}".encode()).hexdigest()[:15], 16) for a, b in keys]
    sql = [duckdb.sql(f"SELECT {splits.mixed_sql('a', 'b', seed=3)} FROM (SELECT {a}::BIGINT AS a, '{b}' AS b)").fetchall()[0][0] for a, b in keys]
    assert got == want == sql


def test_samples_follow_no_progression(spark):
    """Ids in order: gaps between sampled ones vary as those of a random sample do."""
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    ids = sorted(r["doc_id"] for r in splits.sample(rows, "doc_id", 2000).collect())
    gaps = np.diff(ids)
    assert len(ids) == 2000 and len(set(gaps)) > 25 and 0.85 < gaps.std() / gaps.mean() < 1.1
    drawn = [r["doc_id"] for r in splits.resample(rows, "doc_id", 3000).collect()]
    assert len(drawn) == 3000 and 1200 < sum(i >= 10_000 for i in drawn) < 1800
