"""Picks from pools, early stops and the linear discrepancy against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lexmill.operators import discrepancy, drift, selection, stopping


@pytest.mark.parametrize("bins", [1024, 3, 1])
def test_picks_are_the_least_of_each_pool(spark, bins):
    rng = np.random.default_rng(2)
    pools = {"wide": rng.normal(size=900), "ties": rng.integers(0, 3, 300).astype(float), "flat": np.full(50, 2.0), "far": np.array([1e300, -1e300, 0.0, math.inf, -math.inf]), "none": rng.normal(size=5)}
    rows = [(k, i, float(x)) for k, v in pools.items() for i, x in enumerate(v)] + [("wide", 9000, None), ("ties", 9001, None)]
    want = {"wide": 123, "ties": 250, "flat": 7, "far": 3, "none": 0, "absent": 4}
    for more in (0, 10_000):  # and all of them
        asked = {k: n + more for k, n in want.items() if n}
        got = selection.smallest(spark.createDataFrame(rows, "k string, i long, x double"), ["k"], "x", "i", spark.createDataFrame(list(asked.items()), "k string, n long"), "n", bins).collect()
        for k in pools:
            order = sorted((math.inf if x is None else x, i) for p, i, x in rows if p == k)
            assert sorted(r["i"] for r in got if r["k"] == k) == sorted(i for _, i in order[: asked.get(k, 0)])


LOGS = {
    "climbs": ([0.1, 0.2, 0.3, 0.4], (4, 0.4, 4, 4, False)),
    "stops": ([0.1, 0.5, 0.4, 0.5, 0.3, 0.9], (2, 0.5, 5, 5, True)),  # an equal score is no gain; what comes later does not count
    "falls": ([0.9, 0.1, 0.1, 0.1], (1, 0.9, 4, 4, True)),
    "again": ([0.1, 0.0, 0.0, 0.2, 0.1, 0.1], (4, 0.2, 6, 6, False)),
    "nulls": ([None, 0.2, None, None, None, 0.7], (2, 0.2, 5, 5, True)),
    "empty": ([None, None], (None, None, 2, 2, False)),
    "short": ([0.3], (1, 0.3, 1, 1, False)),
}


def test_runs_stop_where_they_should(spark):
    rows = [(k, e, s) for k, (scores, _) in LOGS.items() for e, s in reversed(list(enumerate(scores, 1)))]
    log = spark.createDataFrame([*rows, *rows[:3]], "run string, e int, s double").repartition(4)
    got = {r["run"]: tuple(r)[1:] for r in stopping.early_stops(log, ["run"], "e", "s", 3).collect()}
    assert got == {k: want for k, (_, want) in LOGS.items()}
    least = {r["run"]: r["best_epoch"] for r in stopping.early_stops(log, ["run"], "e", "s", 9, 0.15).collect()}
    assert least["climbs"] == 3 and least["stops"] == 6
    assert stopping.early_stops(log.limit(0), ["run"], "e", "s", 3).count() == 0


def test_linear_discrepancy_is_within_its_error_of_the_exact_one(spark):
    rng = np.random.default_rng(0)
    for shift in (0.0, 1.0):
        z = np.concatenate((rng.normal(0, 1, (70, 5)), rng.normal(shift, 1, (50, 5))))
        rows = spark.createDataFrame([(i, int(i >= 70), v.tolist()) for i, v in enumerate(z)], "id long, side int, v array<double>").repartition(3)
        exact, _ = drift.mean_discrepancy(rows, "id", "side", "v")
        found, error, p = discrepancy.linear_discrepancy(rows, "id", "side", "v", draws=600)
        assert abs(found - exact) < 4 * error and 0 < error < 0.1 and (p < drift.alert_level()) == (shift > 0)
    assert discrepancy.linear_discrepancy(rows.where("side = 0"), "id", "side", "v")[2] == 1.0


def test_blocks_of_many_rows_keep_the_statistic(spark, monkeypatch):
    rng = np.random.default_rng(1)
    z = np.concatenate((rng.normal(0, 1, (400, 3)), rng.normal(0.8, 1, (300, 3))))
    rows = spark.createDataFrame([(i, int(i >= 400), v.tolist()) for i, v in enumerate(z)], "id long, side int, v array<double>")
    whole = discrepancy.linear_discrepancy(rows, "id", "side", "v", draws=200)
    monkeypatch.setattr(discrepancy, "MOST_BLOCKS", 60)
    blocks = discrepancy.linear_discrepancy(rows, "id", "side", "v", draws=200)
    assert np.allclose(whole[:2], blocks[:2], rtol=1e-9) and whole[2] == blocks[2] == 1 / 201
    sums = discrepancy.block_sums(rows, "id", "side", "v", 1.0, 8, 12).collect()
    assert {r["n"] for r in sums} <= {12, 4} and sum(r["n"] for r in sums) == 700 and len(sums) == 34 + 25
