"""Distributed order statistics, samples and running sums against plain computation."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom import session
from spectraloom.functions.arrays import hash_key
from spectraloom.operators import classify, sampling, scale
from spectraloom.operators.classify import holdout_splits, holdout_tests, training_thresholds
from spectraloom.operators.stats import preference_exact, rank_counts


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; values tie, and some are not finite."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.8, "hot", rng.choice(["x", "y", "z"], n)),
            "v": np.round(rng.lognormal(0, 2, n), 2),
            "a": rng.random(n) < 0.4,
            "id": np.arange(n),
        }
    )
    pdf.loc[:20, "v"] = np.nan
    pdf.loc[21:25, "v"] = np.inf
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["one"], "v": [4.5], "a": [True], "id": [n]})])
    return spark.createDataFrame(pdf).repartition(7), pdf


PROBS = {"q00": 0.0, "q03": 0.03, "q50": 0.5, "q975": 0.975, "q10": 1.0}


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_match_numpy(skewed, accuracy):
    df, pdf = skewed
    out = scale.exact_quantiles(df, ["g"], F.col("v"), PROBS, accuracy=accuracy).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        v = part.v[np.isfinite(part.v)]
        for name, p in PROBS.items():
            assert out.loc[g, name] == pytest.approx(np.percentile(v, 100 * p), rel=1e-12), (g, name)


@pytest.mark.parametrize("small", [0, 200, 1 << 40])
def test_quantiles_of_small_and_large_groups(skewed, small):
    """Groups are sorted, bracketed or both, by their size; rows without a key are in no group."""
    df, pdf = skewed
    df = df.unionByName(df.limit(3).withColumn("g", F.lit(None).cast("string")))
    out = scale.exact_quantiles(df, ["g"], F.col("v"), PROBS, small=small).toPandas().set_index("g")
    assert len(out) == pdf[np.isfinite(pdf.v)].g.nunique()
    for g, part in pdf.groupby("g"):
        v = part.v[np.isfinite(part.v)]
        for name, p in PROBS.items():
            assert out.loc[g, name] == pytest.approx(np.percentile(v, 100 * p), rel=1e-12), (g, name)


@pytest.mark.parametrize("small", [0, 200, 1 << 40])
def test_joint_quantiles(skewed, small):
    df, pdf = skewed
    empty = df.limit(1).select(F.lit("e").alias("g"), F.lit(float("nan")).alias("v"), "a", "id")
    df = df.unionByName(empty).withColumn("w", -F.col("id"))
    out = scale.joint_quantiles(df, ["g"], ["v", "w"], PROBS, small=small).toPandas().set_index("g")
    assert np.isnan(out.loc["e", "q50_v"]) and out.loc["e", "q50_w"] <= 0
    for g, part in pdf.groupby("g"):
        for c, v in (("v", part.v[np.isfinite(part.v)]), ("w", -part.id)):
            for name, p in PROBS.items():
                assert out.loc[g, f"{name}_{c}"] == pytest.approx(np.percentile(v, 100 * p), rel=1e-12), (g, name, c)


def test_small_groups_get_no_sketches(skewed, monkeypatch):
    """A sketch for each of very many small groups took most of the time."""
    monkeypatch.setattr(scale, "_bracketed_quantiles", lambda *a: pytest.fail("sketched"))
    assert scale.exact_quantiles(skewed[0], ["g"], F.col("v"), PROBS).count() > 1


def test_quantiles_survive_a_bad_sketch(skewed, monkeypatch):
    """A coarse sketch misses its ranks; the further pass must still give exact values."""
    df, pdf = skewed
    values = df.where(~F.isnan("v") & (F.col("v") < float("inf"))).select("g", F.col("v").alias("_v"))
    shifted = values.withColumn("_v", F.col("_v"))
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.array(*[F.lit(1e9 + i) for i in range(len(p))]))
    out = scale._bracketed_quantiles(shifted, ["g"], PROBS).toPandas().set_index("g")
    v = pdf[(pdf.g == "hot") & np.isfinite(pdf.v)].v
    assert out.loc["hot", "q50"] == pytest.approx(np.percentile(v, 50))


@pytest.mark.parametrize("k", [1, 7, 700, 10_000])
def test_hashed_take_equals_sort_and_limit(skewed, k):
    df, pdf = skewed
    got = scale.take_hashed(df, ["g"], hash_key("s", "id"), ["id"], k).select("g", "id").toPandas()
    import hashlib

    pdf = pdf.assign(h=[hashlib.md5(f"s|{i}".encode()).hexdigest() for i in pdf.id])
    want = pdf.sort_values(["h", "id"]).groupby("g").head(k)
    assert sorted(zip(got.g, got.id)) == sorted(zip(want.g, want.id))


@pytest.mark.parametrize("size", [3, 2000])
def test_bags_are_read_where_their_rows_lie(skewed, size):
    """Slots, many times the groups, were joined to the rows; the estimate still was that of the groups."""
    df, pdf = skewed
    df = df.unionByName(df.limit(3).withColumn("g", F.lit(None).cast("string")))
    bags = sampling.fixed_bags(df, ["g"], ["id"], size, ["v", "id"])
    plan = bags._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("Exchange")
    got = bags.toPandas()
    assert len(got) == size * pdf.g.nunique()
    import hashlib

    digest = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    for g, part in pdf.groupby("g"):
        kept = sorted(part.id, key=lambda i: digest("bag", i))[:size]
        n = len(kept)
        again = [int(digest("bag-again", g, s)[:8], 16) % n for s in range(1, size + 1)]
        rows = got[got.g == g].sort_values("slot")
        assert list(rows.slot) == list(range(1, size + 1))
        assert list(rows.id) == (kept if n == size else [kept[i] for i in again])
        assert rows.v.fillna(-1).tolist() == part.set_index("id").v.loc[list(rows.id)].fillna(-1).tolist()


@pytest.mark.parametrize("together", [False, True])
def test_running_totals(skewed, together):
    df, pdf = skewed
    df, pdf = df.where("NOT isnan(v) AND v < 1e300"), pdf[np.isfinite(pdf.v)]
    order = ["v"] if together else ["v", "id"]
    got = scale.running_totals(df, ["g"], order, {"run": F.col("id")}, ties_together=together)
    got = got.toPandas().sort_values(["g", "v", "id"])
    want = pdf.sort_values(["g", "v", "id"]).copy()
    want["run"] = want.groupby("g")["id"].cumsum()
    if together:
        want["run"] = want.groupby(["g", "v"])["run"].transform("max")
    assert list(got.run) == list(want.run)


def test_rank_counts_equal_all_pairs(skewed):
    df, pdf = skewed
    out = rank_counts(df, ["g"], F.col("v"), F.col("a")).toPandas().set_index("g")
    pref = preference_exact(df, ["g"], F.col("v"), F.col("a")).toPandas().set_index("g")
    for g, part in pdf[np.isfinite(pdf.v)].groupby("g"):
        x, y = part.v[part.a].to_numpy(), part.v[~part.a].to_numpy()
        wins, ties = (x[:, None] > y).sum(), (x[:, None] == y).sum()
        assert out.loc[g, "u"] == wins + ties / 2
        if len(x) and len(y):
            assert pref.loc[g, "p_a"] == pytest.approx(wins / (len(x) * len(y)))
            assert pref.loc[g, "p_tie"] == pytest.approx(ties / (len(x) * len(y)))


def test_training_thresholds_equal_numpy_per_split(spark):
    rng = np.random.default_rng(8)
    rows = [(f"u{i}", b, float(v)) for i in range(8) for b in ("p", "q") for v in np.round(rng.gamma(2, 1, 40 + 60 * i), 2)]
    bands = spark.createDataFrame(rows, "unit_id string, band string, value double")
    units = spark.createDataFrame([(f"u{i}", int(i > 3)) for i in range(8)], "unit_id string, label int")
    splits = holdout_splits(units)
    out = training_thresholds(bands, holdout_tests(splits)).toPandas()
    tests = {r.split_id: {r.a1, r.a2, r.b1, r.b2} for r in splits.collect()}
    assert len(tests) == 36 and len(out) == 72
    pdf = pd.DataFrame(rows, columns=["u", "b", "v"])
    for r in out.itertuples():
        v = pdf[(pdf.b == r.band) & ~pdf.u.isin(tests[r.split_id])].v
        assert r.num_thr == pytest.approx(max(np.percentile(v, 15), 1e-4))
        assert r.den_thr == pytest.approx(max(np.percentile(v, 3), 1e-2))


def test_training_thresholds_open_few_values(spark, monkeypatch):
    """What a split reads stays bounded: one cell of 64 held ever more values, each copied for every split."""
    rng = np.random.default_rng(5)
    ties = [0.5] * 3000 + [0.25] + [7.0] * 2000
    v = np.concatenate([rng.gamma(2, 1, 15_000), ties])
    rows = pd.DataFrame({"unit_id": [f"u{i % 6}" for i in range(len(v))], "band": "p", "value": rng.permutation(v)})
    units = spark.createDataFrame([(f"u{i}", int(i > 2)) for i in range(6)], "unit_id string, label int")
    splits, opened = holdout_splits(units), []

    def settled(df, label="settled"):
        out = session.settle(df, label)
        if label == "opened":
            cells = out.groupBy("band", "_cell").agg(F.count("_v").alias("n"), F.countDistinct("_v").alias("d"))
            opened.append(max(r.n for r in cells.collect() if r.d > 1))
        return out

    monkeypatch.setattr(classify, "settle", settled)
    out = training_thresholds(spark.createDataFrame(rows), holdout_tests(splits)).toPandas()
    assert len(opened) > 1 and opened[-1] <= 64 < opened[0]
    tests = {r.split_id: {r.a1, r.a2, r.b1, r.b2} for r in splits.collect()}
    assert len(out) == len(tests) == 9
    for r in out.itertuples():
        v = rows[~rows.unit_id.isin(tests[r.split_id])].value
        assert r.num_thr == pytest.approx(max(np.percentile(v, 15), 1e-4), rel=1e-12)
        assert r.den_thr == pytest.approx(max(np.percentile(v, 3), 1e-2), rel=1e-12)


def test_shared_folder_is_taken_from_the_session(spark):
    from spectraloom.session import settle, shared_folder

    out = settle(spark.range(3))
    assert all(shared_folder(spark) in f for f in out.inputFiles())


def test_intermediates_end_with_their_block(spark):
    def there(df):
        return os.path.exists(df.inputFiles()[0].removeprefix("file://"))

    rows = spark.range(3)
    with session.intermediates(spark):
        with session.intermediates(spark):
            first = session.settle(rows, "first")
            second = session.settle_outside(rows, "second")
            third = session.settle_outside(rows, "third", blocks=2)
        assert not there(first) and there(second) and third.count() == 3
    assert not there(second) and there(third)
    with pytest.raises(ZeroDivisionError), session.intermediates(spark):
        last = session.settle(rows, "last")
        raise ZeroDivisionError
    assert not there(last) and there(session.settle(rows))
