"""Transforms of whole spectra."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.catalog import EPS, FULL_BANDS, SHORT_BANDS, Axis
from spectraloom.functions import kernels
from spectraloom.functions.arrays import (
    add_all,
    divide_all,
    dot,
    is_finite,
    l1_norm,
    l2_norm,
    literal_array,
    max_abs,
    pick,
    total,
)
from spectraloom.operators.scale import exact_quantiles
from spectraloom.session import settle

S = "spectrum"


def _own_step(pixels: DataFrame) -> DataFrame:
    """Keep the spectrum a computed column of its own before an Arrow kernel reads it.

    The optimiser would otherwise merge the expression behind it into the kernel's
    argument, where conditional array lambdas cannot be evaluated.
    """
    return pixels.withColumn(S, F.explode(F.array(S)))


def align_bands(spectrum: Column, bands: int = FULL_BANDS, pad_nan: bool = False) -> Column:
    """Pad at the front with the first band (or NaN), or keep the last ``bands``."""
    size = F.size(spectrum)
    filler = F.lit(float("nan")) if pad_nan else F.get(spectrum, F.lit(0))
    padded = F.concat(F.array_repeat(filler, F.lit(bands) - size), spectrum)
    return F.when(size < bands, padded).when(size > bands, F.slice(spectrum, -bands, bands)).otherwise(spectrum)


def align_background(bg: Column, z: Column, zero_fill: bool = False) -> Column:
    """Background to ``z`` bands: full to short axis drops the first five points,
    otherwise cut or extend with the last value (or zero)."""
    size = F.size(bg)
    gap = F.greatest(z - size, F.lit(0))
    filler = F.lit(0.0) if zero_fill else F.element_at(bg, -1)
    extended = F.concat(F.slice(bg, F.lit(1), F.least(size, z)), F.array_repeat(filler, gap))
    dropped = FULL_BANDS - SHORT_BANDS
    special = (size == FULL_BANDS) & (z == SHORT_BANDS)
    return F.when(size == z, bg).when(special, F.slice(bg, dropped + 1, SHORT_BANDS)).otherwise(extended)


def choose_backgrounds(backgrounds: DataFrame) -> DataFrame:
    """A4: per sample the usable vector (over 50 points) of the first priority that exists."""
    usable = backgrounds.where(F.size(S) > 50)
    return usable.groupBy("sample_id").agg(F.min_by(S, "priority").alias("bg"))


def subtract_background(
    pixels: DataFrame, backgrounds: DataFrame, strict: bool = False, zero_non_finite: bool = False,
    zero_fill: bool = False,
) -> DataFrame:
    """Pixel minus its sample's aligned background; a missing one is skipped or an error."""
    # one vector per sample; settled, so it is broadcast exactly when it is small enough
    joined = pixels.join(settle(choose_backgrounds(backgrounds), "backgrounds"), "sample_id", "left")
    bg = F.col("bg")
    if strict:
        bg = F.when(bg.isNotNull(), bg).otherwise(F.raise_error(F.lit("background missing for a sample")))
    aligned = align_background(bg, F.size(S), zero_fill)
    less = F.when(bg.isNotNull(), F.zip_with(S, aligned, lambda a, b: a - b)).otherwise(F.col(S))
    if zero_non_finite:
        less = F.transform(less, lambda x: F.when(is_finite(x), x).otherwise(0.0))
    return joined.withColumn(S, less).drop("bg")


def resample(spectrum: Column, bands: int = FULL_BANDS) -> Column:
    """C4: linear interpolation onto ``bands`` points over the same range, for any input length."""
    last = F.size(spectrum) - 1
    scale = last / F.lit(float(max(bands - 1, 1)))

    def at(k: Column) -> Column:
        pos = F.least(k * scale, last.cast("double"))
        lo = F.floor(pos).cast("int")
        left, right = F.get(spectrum, lo), F.get(spectrum, F.least(lo + 1, last))
        return left + (right - left) * (pos - lo)

    moved = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), at)
    return F.when(F.size(spectrum) == bands, spectrum).otherwise(moved)


def shift_floor(pixels: DataFrame, floor: float) -> DataFrame:
    """Lift each spectrum so that its minimum is at least ``floor``."""
    lift = F.greatest(F.lit(0.0), F.lit(float(floor)) - F.array_min(S))
    return pixels.withColumn("_lift", lift).withColumn(S, add_all(F.col(S), F.col("_lift"))).drop("_lift")


def normalise(pixels: DataFrame, mode: str, reference: int | None = None, eps: float = EPS) -> DataFrame:
    """Divide by the L2 or L1 norm (plus eps), the largest magnitude, or a reference band."""
    s = F.col(S)
    scale = {
        "l2": lambda: l2_norm(s) + eps,
        "l1": lambda: l1_norm(s) + eps,
        "max": lambda: F.greatest(max_abs(s), F.lit(eps)),
        "reference": lambda: F.greatest(F.get(s, F.lit(reference)), F.lit(eps)),
    }[mode]()
    return pixels.withColumn("_scale", scale).withColumn(S, divide_all(s, F.col("_scale"))).drop("_scale")


def window_area(spectrum: Column, axis: Axis, center: float, halfwidth: float) -> Column:
    """Trapezoid area over a band window as one dot product with fixed weights."""
    idx = axis.window(center, halfwidth)
    if len(idx) < 2:
        return F.lit(1.0 if not idx else 0.0)
    wn = np.array([axis.wn[i] for i in idx])
    weights = np.zeros(len(idx))
    weights[:-1] += np.diff(wn) / 2
    weights[1:] += np.diff(wn) / 2
    return dot(pick(spectrum, idx), literal_array(weights))


def normalise_area(
    pixels: DataFrame, axis: Axis, windows: Sequence[tuple[float, float]], clip: bool = False
) -> DataFrame:
    """Divide by the area over one or two reference bands.

    A useless area counts as one; ``clip`` lifts it to eps instead.
    """
    areas = []
    for c, hw in windows:
        a = window_area(F.col(S), axis, c, hw)
        areas.append(F.greatest(a, F.lit(EPS)) if clip else F.when(is_finite(a) & (a > EPS), a).otherwise(1.0))
    scale = areas[0]
    for a in areas[1:]:
        scale = scale + a
    scale = scale if clip and len(areas) == 1 else scale + EPS
    return pixels.withColumn("_scale", scale).withColumn(S, divide_all(F.col(S), F.col("_scale"))).drop("_scale")


def detrend(pixels: DataFrame, axis: Axis, degree: int = 2, floor: float | None = None) -> DataFrame:
    """Remove the fitted polynomial; optionally lift to the floor again."""
    m = kernels.detrend_matrix(np.array(axis.wn), degree)
    out = _own_step(pixels).withColumn(S, kernels.apply_matrix(F.col(S), m))
    return out if floor is None else shift_floor(out, floor)


def als_correct(pixels: DataFrame, lam: float = 1e6, p: float = 0.01, rounds: int = 10) -> DataFrame:
    """Subtract the asymmetric-least-squares baseline."""
    return _own_step(pixels).withColumn(S, kernels.apply_als(F.col(S), lam, p, rounds))


def emsc(pixels: DataFrame, reference: Sequence[float], degree: int = 4, iterations: int = 1) -> DataFrame:
    """C11: scatter correction against one reference spectrum, repeated on request."""
    ref = np.asarray(reference, float)
    return _own_step(pixels).withColumn(S, kernels.apply_emsc(F.col(S), ref, degree, iterations))


def savgol(pixels: DataFrame, z: int, window: int, order: int, deriv: int = 0) -> DataFrame:
    """Local polynomial smoothing or derivative of complete spectra."""
    m = kernels.savgol_matrix(z, window, order, deriv)
    return _own_step(pixels).withColumn(S, kernels.apply_matrix(F.col(S), m))


def second_derivative(pixels: DataFrame, z: int, window: int = 15, order: int = 2) -> DataFrame:
    """C12 after C16: gaps are filled in the same batch pass; the window shrinks to the spectrum."""
    window = min(window, z - (z + 1) % 2)
    window -= 1 - window % 2
    if window < 5:
        return pixels.withColumn(S, F.lit(None).cast("array<double>"))
    m = kernels.savgol_matrix(z, window, order, 2)
    return _own_step(pixels).withColumn(S, kernels.apply_matrix_filled(F.col(S), m, 5))


def gradient(spectrum: Column, axis: Axis) -> Column:
    """Central differences over the axis, three fixed coefficients per band."""
    z = len(axis)
    m = kernels.gradient_matrix(np.array(axis.wn))
    left = literal_array([m[i, max(i - 1, 0)] if i > 0 else 0.0 for i in range(z)])
    mid = literal_array([m[i, i] for i in range(z)])
    right = literal_array([m[i, i + 1] if i < z - 1 else 0.0 for i in range(z)])
    before = F.concat(F.slice(spectrum, 1, 1), F.slice(spectrum, 1, z - 1))
    after = F.concat(F.slice(spectrum, 2, z - 1), F.slice(spectrum, z, 1))
    parts = [F.zip_with(a, b, lambda x, y: x * y) for a, b in ((before, left), (spectrum, mid), (after, right))]
    return F.zip_with(F.zip_with(parts[0], parts[1], lambda x, y: x + y), parts[2], lambda x, y: x + y)


def curve_derivatives(curves: DataFrame, axis: Axis, mean: str = "mean", error: str = "sd") -> DataFrame:
    """First and second derivative of a mean curve, and of its error curve."""
    return (
        curves.withColumn("d1", gradient(F.col(mean), axis))
        .withColumn("d1_err", gradient(F.col(error), axis))
        .withColumn("d2", gradient(F.col("d1"), axis))
        .withColumn("d2_err", gradient(F.col("d1_err"), axis))
    )


def smooth_second_derivative(
    pixels: DataFrame, axis: Axis, window: int = 7, flip: bool = True
) -> DataFrame:
    """C14: moving average, double gradient by the median step, sign flipped.

    The three steps are linear, so they are one matrix.
    """
    z = len(axis)
    step = float(np.median(np.diff(np.array(axis.wn))))
    g = kernels.gradient_matrix(np.arange(z) * step)
    m = g @ g @ kernels.moving_average_matrix(z, window)
    return _own_step(pixels).withColumn(S, kernels.apply_matrix(F.col(S), -m if flip else m))


def band_long(pixels: DataFrame, keep: Sequence[str]) -> DataFrame:
    return pixels.select(*keep, F.posexplode(S).alias("k", "v"))


def gathered(long: DataFrame, keys: Sequence[str], value: str, name: str = S) -> DataFrame:
    """Rows (keys, k, value) back to one array in band order; at most Z entries per group."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("k"), F.col(value).alias("v"))))
    return long.groupBy(*keys).agg(F.transform(listed, lambda e: e["v"]).alias(name))


def sign_reference(pixels: DataFrame, min_rows: int = 5) -> DataFrame:
    """One-row table holding the elementwise median (mean below ``min_rows``)."""
    long = band_long(pixels, [])
    q = exact_quantiles(long, ["k"], F.col("v"), {"med": 0.5})
    m = long.groupBy("k").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    per_band = q.join(m, "k").select(
        "k", F.when(F.col("n") >= min_rows, F.col("med")).otherwise(F.col("mean")).alias("v")
    )
    return gathered(per_band, [], "v", "ref")


def orient(pixels: DataFrame, reference: DataFrame) -> DataFrame:
    """Flip the spectra that point away from the reference (a one-row table)."""
    d = dot(F.col(S), F.col("ref"))
    return (
        pixels.crossJoin(F.broadcast(reference.limit(1)))
        .withColumn("_dot", d)
        .withColumn(S, F.when(F.col("_dot") < 0, F.transform(S, lambda x: -x)).otherwise(F.col(S)))
        .drop("_dot", "ref")
    )


def fill_gaps(pixels: DataFrame, min_good: int = 5) -> DataFrame:
    """Linear fill of NaN bands from their good neighbours, held flat at the ends.

    Too few good bands give NULL.  Complete spectra pass through untouched.
    """
    s = F.col(S)
    good = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: is_finite(F.get(s, i)))
    spotted = pixels.withColumn("_good", good)
    g = F.col("_good")

    def fill(x: Column, k: Column) -> Column:
        lo = F.array_max(F.filter(g, lambda i: i < k))
        hi = F.array_min(F.filter(g, lambda i: i > k))
        a, b = F.get(s, lo), F.get(s, hi)
        blend = a + (b - a) * F.try_divide((k - lo).cast("double"), (hi - lo).cast("double"))
        return F.when(is_finite(x), x).otherwise(F.coalesce(blend, a, b))

    filled = (
        F.when(F.size(g) == F.size(s), s)
        .when(F.size(g) >= min_good, F.transform(s, fill))
        .otherwise(F.lit(None).cast("array<double>"))
    )
    return spotted.withColumn(S, filled).drop("_good")


def anchor_first(spectrum: Column) -> Column:
    """C17: subtract the first band."""
    return add_all(spectrum, -F.get(spectrum, F.lit(0)))


def anchor_min(pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """C17: subtract the smallest value of the whole table, or of each subset."""
    low = pixels.groupBy(*keys).agg(F.min(F.array_min(F.filter(S, is_finite))).alias("_low"))
    joined = pixels.join(settle(low, "low"), list(keys)) if keys else pixels.crossJoin(F.broadcast(low))
    return joined.withColumn(S, add_all(F.col(S), -F.col("_low"))).drop("_low")


def anchor_groups(curves: DataFrame, reference: str, value: str = "mean") -> DataFrame:
    """C17: shift each group's curve to meet the reference group's at band 0."""
    first = curves.where(F.col("grp") == reference).select(F.get(value, F.lit(0)).alias("_at"))
    joined = curves.crossJoin(F.broadcast(first.limit(1)))
    offset = F.col("_at") - F.get(value, F.lit(0))
    return joined.withColumn(value, add_all(F.col(value), offset)).drop("_at")


def window_sum(spectrum: Column, axis: Axis, center: float, halfwidth: float = 7.0) -> Column:
    """Sum of the finite bands in a window; NULL when none is finite."""
    kept = F.filter(pick(spectrum, axis.window(center, halfwidth)), is_finite)
    return F.when(F.size(kept) > 0, total(kept))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return [float(x) for x in w / w.sum()]


def gaussian_map(image: DataFrame, keys: Sequence[str], sigma: float = 3.0, value: str = "v") -> DataFrame:
    """Scale by the largest magnitude, then blur along columns and rows in turn.

    The kernel is separable, so each pass gathers one line of the image (bounded by
    the detector, whatever the table holds) and moves every pixel once.  A missing
    pixel leaves every pixel it reaches undefined (absent).
    """
    keys = list(keys)
    shape = image.groupBy(*keys).agg(
        F.max(F.abs(value)).alias("_top"),
        (F.max("row") + 1).alias("_h"),
        (F.max("col") + 1).alias("_w"),
    )
    shaped = image.join(settle(shape, "shape"), keys) if keys else image.crossJoin(F.broadcast(shape))
    scaled = shaped.select(
        *keys, "row", "col", "_h", "_w",
        F.when(F.col("_top") > 0, F.col(value) / F.col("_top")).otherwise(F.col(value)).alias("_v"),
    )
    weights = gaussian_weights(sigma)
    for along, across, extent in (("row", "col", "_h"), ("col", "row", "_w")):
        lines = scaled.groupBy(*keys, across, "_h", "_w").agg(F.collect_list(F.struct(along, "_v")).alias("_l"))
        blurred = kernels.blur_lines(F.col(f"_l.{along}"), F.col("_l._v"), F.col(extent), weights)
        scaled = (
            lines.select(*keys, across, "_h", "_w", blurred.alias("_b"))
            .select(*keys, across, "_h", "_w", F.posexplode("_b").alias(along, "_v"))
            .where(~F.isnan("_v"))
        )
    return scaled.select(*keys, "row", "col", F.col("_v").alias(value))


def curve_table(long: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Long per-band statistics to one row of arrays per group."""
    listed = F.sort_array(F.collect_list(F.struct("k", *columns)))
    return long.groupBy(*keys).agg(listed.alias("_l")).select(
        *keys, *[F.col(f"_l.{c}").alias(c) for c in columns]
    )


