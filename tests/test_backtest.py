from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import backtest

DAYS, COUNTRIES, CONTEXT, HORIZONS, BURN_IN, RIDGE = 24, 6, 4, (1, 3), 12, 0.01


@pytest.fixture(scope="module")
def snapshots(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{c}", date(2024, 1, 1) + timedelta(7 * i), float(np.clip(0.4 + 0.2 * np.sin(i + c) + 0.1 * rng.random(), 0, 1)))
            for c in range(COUNTRIES) for i in range(DAYS) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "country string, snapshot_date date, risk double").cache()


def panel(snapshots):
    rows = snapshots.collect()
    dates = sorted({r.snapshot_date for r in rows})
    return {(r.country, dates.index(r.snapshot_date) + 1): r.risk for r in rows}


def test_every_fold_equals_its_own_refit(snapshots):
    at = panel(snapshots)
    x = lambda c, i: [1.0] + [at.get((c, i - k), 0.0) for k in range(CONTEXT)]
    want = {}
    for fold in range(BURN_IN + 1, DAYS + 1):
        for h in HORIZONS:
            known = [(x(c, i), at[c, i + h]) for c, i in at if i + h <= fold and (c, i + h) in at]
            a, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
            penalty = np.diag([0.0] + [RIDGE] * CONTEXT)
            beta = np.linalg.solve(a.T @ a + penalty, a.T @ y)
            want |= {(c, i, h): (float(np.clip(np.dot(beta, x(c, i)), 0, 1)), at.get((c, i + h))) for c, i in at if i == fold}
    rows = backtest.walk_forward(snapshots, "risk", CONTEXT, HORIZONS, BURN_IN, RIDGE).collect()
    got = {(r.country, r.fold, r.horizon): (r.predicted, r.actual) for r in rows}
    assert got.keys() == want.keys() and len(got) > 100
    for k, (p, a) in want.items():
        assert got[k][0] == pytest.approx(p, abs=2e-6) and got[k][1] == a


def test_no_fold_sees_later_snapshots(snapshots):
    cut = sorted({r.snapshot_date for r in snapshots.collect()})[17]
    run = lambda s: {(r.country, r.fold, r.horizon): r.predicted for r in backtest.walk_forward(s, "risk", CONTEXT, HORIZONS, BURN_IN).collect() if r.pivot_date <= cut}
    changed = snapshots.withColumn("risk", F.when(F.col("snapshot_date") > cut, 0.99).otherwise(F.col("risk")))
    assert run(snapshots) == run(changed)


def test_system_without_solution_carries_the_origin_forward(spark):
    rows = [("a", date(2024, 1, 1) + timedelta(i), 0.5) for i in range(10)]
    s = spark.createDataFrame(rows, "country string, snapshot_date date, risk double")
    got = backtest.walk_forward(s, "risk", 2, (1,), 5, 0.0).collect()
    assert got and {r.predicted for r in got} == {0.5}
    assert backtest.walk_forward(s.limit(0), "risk").collect() == []


def test_bootstrap_is_the_same_for_any_partitioning(snapshots):
    run = lambda s: sorted(map(tuple, backtest.bootstrap_intervals(backtest.bootstrap_forecasts(s, "risk", 6, 2, (1,), 14)).drop("actual").collect()))
    a, b = run(snapshots.repartition(5)), run(snapshots.coalesce(1))
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], abs=3e-6)
    assert all(lower <= p <= upper for *_, p, _, _, lower, upper in a) and any(lower < upper for *_, lower, upper in a)


def test_replicate_counts_are_poisson(spark):
    n = 20_000
    counts = dict(spark.range(n).select(backtest.poisson_counts(F.col("id").cast("string")).alias("k")).groupBy("k").count().collect())
    assert counts[0.0] / n == pytest.approx(0.3679, abs=0.012) and sum(k * c for k, c in counts.items()) / n == pytest.approx(1, abs=0.03)
