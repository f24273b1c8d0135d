"""Spectrum transforms on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.catalog import Axis, ratio_list
from spectraloom.functions import kernels
from spectraloom.operators import bands as B
from spectraloom.operators import spectra as C

Z = 40
AXIS = Axis.linspace(960.0, 1800.0, Z)
WN = np.array(AXIS.wn)


def frame(spark, arrays):
    rows = [(f"s{i}", i, 0, [None if v is None else float(v) for v in a]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "sample_id string, row int, col int, spectrum array<double>")


def back(df):
    return [np.array(r.spectrum, float) if r.spectrum is not None else None for r in df.orderBy("row").collect()]


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).normal(size=(9, Z)).cumsum(axis=1)


def test_savgol_reproduces_polynomials_at_every_point():
    x = np.arange(Z, dtype=float)
    y = 3 - 2 * x + 0.5 * x**2
    assert np.allclose(kernels.savgol_matrix(Z, 11, 2, 2) @ y, 1.0)
    assert np.allclose(kernels.savgol_matrix(Z, 11, 3, 0) @ (y + 0.01 * x**3), y + 0.01 * x**3)
    with pytest.raises(ValueError):
        kernels.savgol_matrix(Z, Z + 1, 2)


def test_even_savgol_window_is_read_half_a_step_off():
    x = np.arange(Z, dtype=float)
    line = 3.0 * x + 1
    m = kernels.savgol_matrix(Z, 10, 2, 0) @ line
    assert np.allclose(m[5 : Z - 5], line[5 : Z - 5] + 1.5)
    assert np.allclose(m[:5], line[:5]) and np.allclose(m[Z - 5 :], line[Z - 5 :])
    assert np.allclose(kernels.savgol_matrix(Z, 10, 2, 1) @ line, 3.0)


def test_linear_operators_match_numpy(spark, noise):
    df = frame(spark, noise)
    assert np.allclose(back(C.savgol(df, Z, 9, 2, 2)), noise @ kernels.savgol_matrix(Z, 9, 2, 2).T)
    grad = [np.array(r.g) for r in df.orderBy("row").select(C.gradient(F.col("spectrum"), AXIS).alias("g")).collect()]
    assert np.allclose(grad, np.gradient(noise, WN, axis=1))
    x = (WN - WN.mean()) / WN.std()
    fit = np.array([np.polyval(np.polyfit(x, s, 2), x) for s in noise])
    assert np.allclose(back(C.detrend(df, AXIS, 2)), noise - fit)
    pad = np.pad(noise, ((0, 0), (3, 3)), mode="reflect")
    smooth = np.array([np.convolve(p, np.ones(7) / 7, mode="valid") for p in pad])
    step = np.median(np.diff(WN))
    want = -np.gradient(np.gradient(smooth, step, axis=1), step, axis=1)
    assert np.allclose(back(C.smooth_second_derivative(df, AXIS, 7)), want)


def test_asymmetric_baseline_matches_dense_solve(spark, noise):
    d = np.diff(np.eye(Z), 2, axis=0)
    want = []
    for y in noise:
        w = np.ones(Z)
        for _ in range(10):
            base = np.linalg.solve(np.diag(w) + 1e4 * d.T @ d, w * y)
            w = 0.01 * (y > base) + 0.99 * (y < base)
        want.append(y - base)
    assert np.allclose(back(C.als_correct(frame(spark, noise), lam=1e4)), want, atol=1e-7)


def test_emsc_matches_least_squares_repeated(spark, noise):
    ref = noise.mean(axis=0)
    x = np.linspace(0, 1, Z)
    model = np.column_stack([np.ones(Z), ref, x, x**2, x**3, x**4])
    want = noise.copy()
    for _ in range(5):
        c = np.linalg.lstsq(model, want.T, rcond=None)[0]
        want = ((want.T - model[:, [0]] @ c[[0]] - model[:, 2:] @ c[2:]) / c[1]).T
    assert np.allclose(back(C.emsc(frame(spark, noise), ref, 4, 5)), want)


def test_resampling(spark, noise):
    df = frame(spark, noise)
    same = df.withColumn("spectrum", C.resample(F.col("spectrum"), Z))
    assert np.allclose(back(same), noise)
    wide = df.withColumn("spectrum", C.resample(F.col("spectrum"), 426))
    grid = np.linspace(960, 1800, 426)
    assert np.allclose(back(wide), [np.interp(grid, WN, s) for s in noise])


def test_band_count_and_background_alignment(spark):
    df = frame(spark, [[1, 2, 3], [1, 2, 3, 4, 5, 6]])
    assert [list(a) for a in back(df.withColumn("spectrum", C.align_bands(F.col("spectrum"), 5)))] == [
        [1, 1, 1, 2, 3], [2, 3, 4, 5, 6],
    ]
    bg = frame(spark, [np.arange(426), np.arange(400)])
    edge = back(bg.withColumn("spectrum", C.align_background(F.col("spectrum"), F.lit(421))))
    assert list(edge[0]) == list(np.arange(5, 426)) and list(edge[1][-3:]) == [399, 399, 399]
    zero = back(bg.withColumn("spectrum", C.align_background(F.col("spectrum"), F.lit(421), zero_fill=True)))
    assert list(zero[1][-2:]) == [0, 0]


def test_missing_background_is_skipped_or_an_error(spark):
    px = frame(spark, [[1.0] * 60, [2.0] * 60])
    bg = spark.createDataFrame([("s0", 2, [9.0] * 60), ("s0", 1, [0.5] * 60), ("s0", 0, [7.0] * 3)],
                               "sample_id string, priority int, spectrum array<double>")
    out = back(C.subtract_background(px, bg))
    assert out[0][0] == 0.5 and out[1][0] == 2.0
    with pytest.raises(Exception, match="background missing"):
        C.subtract_background(px, bg, strict=True).collect()


def test_gaps_are_filled_and_hopeless_spectra_dropped(spark):
    nan = float("nan")
    good = [nan, 1, nan, nan, 4, 5, 6, nan, 8, nan]
    out = back(C.fill_gaps(frame(spark, [good, [nan] * 6 + [1, 2, 3, 4]])))
    assert list(out[0]) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 8] and out[1] is None


def test_gaussian_map_mirrors_borders(spark):
    h, w, sigma = 5, 9, 3.0  # smaller than the radius, so mirroring repeats
    image = np.random.default_rng(2).normal(size=(h, w))
    df = spark.createDataFrame([(r, c, float(image[r, c])) for r in range(h) for c in range(w)], "row int, col int, v double")
    got = {(r.row, r.col): r.v for r in C.gaussian_map(df, [], sigma).collect()}
    k = np.array(C.gaussian_weights(sigma))
    scaled = image / np.abs(image).max()
    for axis in (0, 1):
        pad = [(12, 12) if a == axis else (0, 0) for a in (0, 1)]
        scaled = np.apply_along_axis(lambda v: np.convolve(v, k, mode="valid"), axis, np.pad(scaled, pad, mode="symmetric"))
    assert np.allclose([[got[r, c] for c in range(w)] for r in range(h)], scaled)
    holed = C.gaussian_map(df.where("NOT (row = 0 AND col = 0)"), [], 0.5)
    assert (0, 1) not in {(r.row, r.col) for r in holed.collect()}


def test_band_values(spark):
    s = [float("nan") if i == 20 else float((i * 7) % 11) for i in range(Z)]
    df = frame(spark, [s, [float("nan")] * Z])
    idx = [i for i in AXIS.window(1400.0, 60.0) if not np.isnan(s[i])]
    top = sorted((s[i] for i in idx), reverse=True)
    got = df.orderBy("row").select(
        B.band_topk_mean(AXIS, 1400.0, 60.0).alias("one"), B.band_topk_mean(AXIS, 1400.0, 60.0, 3).alias("three"),
        B.band_amplitude(AXIS, 1400.0, 60.0).alias("amp"), B.band_mean(AXIS, 1400.0, 60.0).alias("mean"),
        B.band_topk_mean(AXIS, 5000.0, 10.0).alias("empty"),
    ).collect()
    assert (got[0].one, got[0].three, got[0].amp, got[0].empty) == (top[0], pytest.approx(sum(top[:3]) / 3), top[0], None)
    assert got[0].mean == pytest.approx(np.mean([s[i] for i in idx]))
    assert got[1].one is None and got[1].mean is None


def test_ratio_guards_are_strict(spark):
    one = spark.range(1).select(
        B.guarded_ratio(F.lit(2.0), F.lit(1.0), F.lit(2.0), F.lit(0.5)).alias("at_limit"),
        B.guarded_ratio(F.lit(200.0), F.lit(1.0), F.lit(2.0), F.lit(0.5)).alias("capped"),
        B.guarded_ratio(F.lit(float("nan")), F.lit(1.0), F.lit(0.0), F.lit(0.5)).alias("nan"),
    ).first()
    assert (one.at_limit, one.capped, one.nan) == (None, 10.0, None)
    assert len(ratio_list()) == 26 and len({r for r, _, _ in ratio_list()}) == 26


def test_derivative_of_gappy_spectra(spark, noise):
    gappy = noise.copy()
    gappy[0, 4:7] = np.nan
    gappy[1, :-3] = np.nan
    out = back(C.second_derivative(frame(spark, gappy), Z, 15, 2))
    filled = gappy[0].copy()
    ok = np.isfinite(filled)
    filled = np.interp(np.arange(Z), np.arange(Z)[ok], filled[ok])
    m = kernels.savgol_matrix(Z, 15, 2, 2)
    assert np.allclose(out[0], m @ filled) and out[1] is None and np.allclose(out[2], m @ noise[2])


def test_kernels_follow_any_other_step(spark, noise):
    """Conditional array steps ahead of an Arrow kernel, as the full cleaning chain has them."""
    df = frame(spark, noise)
    bg = spark.createDataFrame([("s0", 1, [1.0] * 60)], "sample_id string, priority int, spectrum array<double>")
    cleaned = C.subtract_background(C.fill_gaps(df), bg)
    chain = C.normalise_area(C.shift_floor(C.als_correct(cleaned), 0.1), AXIS, [(1655.0, 30.0)])
    assert len(back(chain)) == len(noise)
    oriented = C.orient(df, C.sign_reference(df))
    assert len(back(C.savgol(oriented, Z, 9, 2, 2))) == len(noise)
