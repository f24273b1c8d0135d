"""Batched hold-out fits against one plain Newton fit per split."""

import numpy as np
import pytest

from spectraloom.operators import holdout as H

NAMES = ["fa", "fb", "fc"]


def _table(gaps):
    rng = np.random.default_rng(3)
    rows = []
    for side in ("L", "R"):
        for u in range(8):
            if side == "R" and u == 7:
                continue  # an animal that one side lacks
            for _ in range(int(rng.integers(1, 7))):
                x = rng.normal([u % 2, 5.0, 0.01 * u], [1.0, 3.0, 0.02]).tolist()
                if gaps and rng.random() < 0.2:
                    x[int(rng.integers(0, 2))] = [None, float("nan")][int(rng.integers(0, 2))]
                rows.append((side, f"u{u}", u % 2, *x))
    return rows


def _plain(x, y, test):
    med = np.nanmedian(x, axis=0)
    x, test = np.where(np.isnan(x), med, x), np.where(np.isnan(test), med, test)
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1
    a, b = (np.c_[np.ones(len(v)), (v - mean) / std] for v in (x, test))
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    beta = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta))
        g = a.T @ (w * (p - y)) + beta
        beta = beta - np.linalg.solve((a.T * (w * p * (1 - p))) @ a + np.eye(len(beta)), g)
    return beta, 1 / (1 + np.exp(-b @ beta))


@pytest.mark.parametrize("gaps", [False, True])
def test_every_fit_is_the_plain_one(spark, gaps):
    rows = _table(gaps)
    table = spark.createDataFrame(rows, "side string, unit_id string, label int, fa double, fb double, fc double").repartition(3)
    splits = [(s, f"u{u}") for s, pair in enumerate([(0, 1), (2, 3), (4, 5), (0, 7), (1, 3)]) for u in pair]
    tests = spark.createDataFrame(splits, "split_id bigint, unit_id string")
    pairs = [("L", "L"), ("L", "R"), ("R", "L")]
    fits = H.fit_all(H.plan_fits(table, tests, pairs, NAMES), table)
    assert len(fits.split) == 5 + 4 + 4 and fits.residual.max() < 1e-8  # u7 is missing on one side
    got = {(r.train_side, r.test_side, r.split_id, r.unit_id): r for r in H.predict_units(fits, table).collect()}
    held = {s: {u for t, u in splits if t == s} for s, _ in splits}
    side, unit, y = (np.array([r[i] for r in rows]) for i in range(3))
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in rows])
    seen = 0
    for f, (a, b, s) in enumerate(zip(fits.train_side, fits.test_side, fits.split.tolist())):
        common = set(unit[side == a]) & set(unit[side == b])
        train = (side == a) & np.isin(unit, sorted(common - held[s]))
        for u in held[s]:
            test = (side == b) & (unit == u)
            beta, prob = _plain(x[train], y[train], x[test])
            np.testing.assert_allclose(fits.coef[f], beta, atol=1e-6)
            row = got[a, b, s, u]
            assert (row.n, row.y, row.pred) == (test.sum(), y[test][0], int(prob.mean() >= 0.5))
            assert row.prob == pytest.approx(prob.mean(), abs=1e-6)
            seen += 1
    assert seen == len(got)


def test_nothing_to_fit(spark):
    table = spark.createDataFrame([("L", "u0", 0, 1.0, 1.0, 1.0)], "side string, unit_id string, label int, fa double, fb double, fc double")
    tests = spark.createDataFrame([(0, "u0")], "split_id bigint, unit_id string")
    fits = H.fit_all(H.plan_fits(table, tests, [("L", "L"), ("L", "R")], NAMES), table)
    assert len(fits.split) == 0 and H.predict_units(fits, table).count() == 0
