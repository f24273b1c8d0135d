"""Tests, folds and scores on small known cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.functions.tails import exact_u_p, incomplete_beta, normal_u_p, student_two_sided
from spectraloom.operators import classify as M
from spectraloom.operators import stats as J


def test_exact_mann_whitney_tail():
    assert exact_u_p(0, 3, 3) == pytest.approx(0.1)
    assert exact_u_p(9, 3, 3) == pytest.approx(0.1)
    assert exact_u_p(4.5, 3, 3) == pytest.approx(1.0)
    assert exact_u_p(0, 7, 7) == pytest.approx(2 / math.comb(14, 7))


def test_normal_tail_is_close_to_exact_for_moderate_groups():
    assert normal_u_p(20, 8, 8, 0) == pytest.approx(exact_u_p(20, 8, 8), abs=0.02)


def test_student_tail():
    assert student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert student_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)


def test_exact_p_has_no_jump_with_the_larger_group():
    """The exact tail depends on the smaller group's arrangements, whatever the other's size."""
    assert exact_u_p(0, 1, 1000) == pytest.approx(2 / 1001)
    assert exact_u_p(0, 1, 1001) == pytest.approx(2 / 1002)
    assert exact_u_p(3, 2, 5000) == pytest.approx(2 * 6 / math.comb(5002, 2))
    for n_a, n_b in ((3, 4), (5, 9), (8, 30)):
        ways = [1] + [0] * (n_a * n_b)
        for i in range(1, n_a + 1):  # q-binomial by plain polynomial steps
            for u in range(len(ways) - 1, n_b + i - 1, -1):
                ways[u] -= ways[u - n_b - i]
            for u in range(i, len(ways)):
                ways[u] += ways[u - i]
        for u in range(0, n_a * n_b + 1, 3):
            top = max(u, n_a * n_b - u)
            assert exact_u_p(u, n_a, n_b) == pytest.approx(min(1, 2 * sum(ways[top:]) / sum(ways)))


def test_delta_is_antisymmetric_and_binned(spark):
    df = spark.createDataFrame(
        [("m", g, float(v)) for g, vs in (("A", [1, 2, 2, 9]), ("B", [2, 3, 4])) for v in vs], "m string, g string, v double"
    )
    d = lambda g: J.cliffs_delta(df, ["m"], F.col("v"), F.col("g") == g).first().delta
    assert d("A") == pytest.approx(-d("B")) == pytest.approx((1 * 3 + 0 + 0 - 7) / 12, abs=1)
    x, y = np.array([1, 2, 2, 9]), np.array([2, 3, 4])
    assert d("A") == pytest.approx((np.sign(x[:, None] - y)).mean())
    lone = J.cliffs_delta(df.where("g = 'A'"), ["m"], F.col("v"), F.col("g") == "A").first()
    assert lone.delta is None
    labels = spark.createDataFrame([(0.1,), (-0.2,), (0.4,), (-0.9,), (0.0,), (None,)], "d double").select(
        J.effect_bin(F.col("d")).alias("e")
    )
    assert [r.e for r in labels.collect()] == [
        "negligible (A>B)", "small (A<B)", "medium (A>B)", "large (A<B)", "negligible (A=B)", "nan",
    ]


def test_welch_matches_formula(spark):
    a, b = [1.0, 2.0, 4.0, 8.0], [3.0, 3.5, 9.0]
    df = spark.createDataFrame([("m", True, v) for v in a] + [("m", False, v) for v in b], "m string, a boolean, v double")
    r = J.welch(df, ["m"], F.col("v"), F.col("a")).first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 3
    assert r.t == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / 3 + vb**2 / 2))
    assert r.stars == "ns" and 0 < r.p < 1
    single = J.welch(df.where("a OR v = 9"), ["m"], F.col("v"), F.col("a")).first()
    assert single.t is None and single.p is None


def test_bootstrap_draws_stay_in_their_group(spark):
    df = spark.createDataFrame([(f"i{i}", i < 12, float(i)) for i in range(30)], "id string, a boolean, v double")
    df = df.withColumn("m", F.lit("m"))
    draws = J.bootstrap_draws(df, ["m"], F.col("v"), F.col("a"), ["id"], 20).toPandas()
    sizes = draws.groupby(["rep", "is_a"]).size().unstack()
    assert (sizes[True] == 12).all() and (sizes[False] == 18).all()
    assert (draws[draws.is_a].value < 12).all() and draws.groupby("rep").value.sum().nunique() > 5
    ci = J.bootstrap_interval(J.bootstrap_draws(df, ["m"], F.col("v"), F.col("a"), ["id"], 20), ["m"], J.delta_statistic).first()
    assert ci.lo == ci.hi == -1.0


def test_max_t_finds_the_shifted_band(spark):
    rng = np.random.default_rng(0)
    rows = [
        (f"u{u}", u < 6, u % 2, k, float(rng.normal() + (8 if u < 6 and k == 3 else 0))) for u in range(12) for k in range(6)
    ]
    out = J.max_t(spark.createDataFrame(rows, "unit string, grp_a boolean, stratum int, band int, value double"), 99).toPandas()
    out = out.set_index("band").sort_index()
    assert len(out) == 6 and out.p.idxmin() == 3 and out.p.between(0.01, 1.0).all() and out.p[3] < 0.1


def test_max_t_does_not_depend_on_the_scale(spark):
    rng = np.random.default_rng(0)
    base = [(f"u{u}", u < 6, u % 2, k, float(rng.normal() + (8 if u < 6 and k == 3 else 0))) for u in range(12) for k in range(6)]
    schema = "unit string, grp_a boolean, stratum int, band int, value double"
    found = []
    for scale in (1.0, 1e-10):
        out = J.max_t(spark.createDataFrame([(*x[:4], x[4] * scale) for x in base], schema), 99)
        found.append([r.p for r in out.orderBy("band").collect()])
    assert found[0] == found[1] and min(found[0]) < 0.1


def test_folds_refuse_a_class_of_one(spark):
    units = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1)], "unit_id string, label int")
    with pytest.raises(ValueError, match="two at least"):
        M.stratified_folds(units, 3)


def test_best_threshold_without_any_score(spark):
    none = spark.createDataFrame([(0.1, 1, 0.7), (0.2, 1, 0.9)], "prob double, y int, other double").where("y = 0")
    assert M.best_threshold(M.threshold_table(none)).first().threshold == 0.5


def test_standardiser_uses_true_median_and_population_deviation(spark):
    rows = [(1.0,), (2.0,), (None,), (10.0,), (3.0,)]
    df = spark.createDataFrame(rows, "f double")
    got = sorted(r.features[0] for r in M.standardiser(df, ["f"])(df).collect())
    v = np.array([1.0, 2.0, 2.5, 10.0, 3.0])
    assert got == pytest.approx(sorted((v - v.mean()) / v.std()))


def test_holdout_splits_of_any_size(spark):
    units = spark.createDataFrame([(f"a{i}", 0) for i in range(5)] + [(f"b{i}", 1) for i in range(4)], "unit_id string, label int")
    splits = M.holdout_splits(units, n_test=3)
    assert splits.count() == math.comb(5, 3) * math.comb(4, 3)
    assert {r["count"] for r in M.holdout_tests(splits).groupBy("split_id").count().collect()} == {6}
    with pytest.raises(ValueError, match="are needed"):
        M.holdout_splits(units, n_test=2, n_train=3)


def test_folds_partition_and_keep_groups_together(spark):
    units = spark.createDataFrame([(f"u{i}", f"s{i % 9}", int(i % 9 > 3)) for i in range(90)], "unit_id string, sample_id string, label int")
    f = M.stratified_folds(units, 5).toPandas()
    assert len(f) == 90 and set(f.fold) == set(range(5))
    assert f.groupby(["label", "fold"]).size().unstack().apply(lambda r: r.max() - r.min() <= 1, axis=1).all()
    g = M.grouped_folds(units, 4).toPandas()
    assert len(g) == 90 and (g.groupby("sample_id").fold.nunique() == 1).all()
    roles = M.split_roles(units, M.leave_one_out(units)).toPandas()
    assert len(roles) == 90 * 90 and (roles[roles.role == "test"].split_id == roles[roles.role == "test"].unit_id).all()
    s = M.three_way_split(units).toPandas()
    assert (s.groupby("label").role.apply(lambda r: (r == "test").sum()) >= 4).all() and len(s) == 90


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(5)
    n = 300
    y = rng.integers(0, 2, n)
    prob = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.25, n), 0, 1), 2)
    pdf = pd.DataFrame({"unit_id": [str(i) for i in range(n)], "fold": rng.integers(0, 4, n), "y": y, "prob": prob})
    pdf.loc[0:2, "prob"] = np.nan
    return spark.createDataFrame(pdf), pdf


def roc_points(y, p):
    cuts = np.sort(np.unique(p))[::-1]
    return np.r_[0, [(p[y == 0] >= c).mean() for c in cuts]], np.r_[0, [(p[y == 1] >= c).mean() for c in cuts]]


def test_auc_and_mean_roc(preds):
    df, pdf = preds
    ok = pdf[np.isfinite(pdf.prob)]
    got = M.roc_auc(df, ["fold"]).toPandas().set_index("fold").auc
    curves = []
    for fold, part in ok.groupby("fold"):
        y, p = part.y.to_numpy(), part.prob.to_numpy()
        x, z = p[y == 1], p[y == 0]
        assert got[fold] == pytest.approx(((x[:, None] > z).sum() + 0.5 * (x[:, None] == z).sum()) / (len(x) * len(z)))
        fpr, tpr = roc_points(y, p)
        curve = np.interp(np.linspace(0, 1, 201), fpr, tpr)
        curve[0] = 0
        curves.append(curve)
    mean = M.mean_roc(df).toPandas().sort_values("fpr")
    want = np.mean(curves, axis=0)
    want[-1] = 1.0
    assert len(mean) == 201 and np.allclose(mean.mean_tpr, want)
    assert np.allclose(mean.sd_tpr, np.std(curves, axis=0, ddof=1))


def test_threshold_table_equals_counting(preds):
    df, pdf = preds
    table = M.threshold_table(df).toPandas().sort_values("threshold", ignore_index=True)
    assert len(table) == 181
    for r in table.itertuples():
        pred = pdf.prob >= r.threshold  # an undefined score counts as a negative decision
        assert (r.tp, r.fp) == ((pred & (pdf.y == 1)).sum(), (pred & (pdf.y == 0)).sum())
        assert r.tn + r.fn == (~pred).sum()
    best = M.best_threshold(M.threshold_table(df)).first()
    assert best.threshold == pytest.approx(table.loc[table.balanced_accuracy.round(12).idxmax(), "threshold"])
    flipped = df.where("NOT isnan(prob)").withColumn("prob", 1 - F.col("prob"))
    assert M.tuned_threshold(flipped).first().threshold == 0.5


def test_single_class_scores_are_undefined(spark):
    one = spark.createDataFrame([("a", 0, 1, 0.2), ("b", 0, 1, 0.7), ("c", 0, 1, 0.9)], "unit_id string, fold int, y int, prob double")
    assert M.roc_auc(one, ["fold"]).first().auc is None
    s = M.binary_scores(one, ["fold"], (F.col("prob") >= 0.5).cast("int")).first()
    assert s.specificity is None and s.recall == pytest.approx(2 / 3) and s.youden is None


def test_predictions_cover_every_unit_once(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i}", int(i % 2), float(rng.normal() + 3 * (i % 2)), float(rng.normal()) if i % 7 else None) for i in range(60)]
    table = spark.createDataFrame(rows, "unit_id string, label int, f1 double, f2 double")
    tests = M.stratified_folds(table.select("unit_id", "label"), 2).select(F.col("fold").alias("split_id"), "unit_id")
    out = M.fit_predict(table, tests, ["f1", "f2"]).toPandas()
    assert sorted(out.unit_id) == sorted(f"u{i}" for i in range(60))
    assert out.prob.between(0, 1).all() and (out.pred == out.y).mean() > 0.85
