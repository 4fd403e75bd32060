"""Every query against its SQL twin; those without one give whole rows with values in their ranges."""

from __future__ import annotations

import pytest

from lexmill.plans.catalogue import ORACLES, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()  # a count would leave columns out of the plan
    assert rows and all(len(r) == len(found.columns) for r in rows)
    for column in ("p", "mix_p", "embedding_mmd_p", "probability", "any"):
        assert column not in found.columns or all(0 <= r[column] <= 1 for r in rows)


def test_power_grows_with_the_window(spark, sf_dir):
    rows = {(r["size"], r["share"]): r for r in QUERIES["power_study"](spark, sf_dir).collect()}
    assert sorted(rows) == [(n, s) for n in (65, 130, 260, 520) for s in (0.0, 0.4)]
    assert all(r["any"] >= max(r[c] for c in ("confidence_drift", "unknown_rate", "mix_drift", "language_mix_drift", "embedding_drift")) for r in rows.values())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
