"""Band features and guarded ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.catalog import BAND_LIBRARY, EPS, RATIO_CAP, Axis, inline_table, ratio_list
from spectraloom.functions.arrays import finite_text, is_finite, null_if_not_finite, pick_text
from spectraloom.operators.scale import exact_quantiles
from spectraloom.operators.select import guard_thresholds

DEFAULT_HALFWIDTH = 10.0


def _topk_text(window: str, k: int) -> str:
    if k <= 1:
        return f"array_max({window})"
    top = f"slice(sort_array({window}, false), 1, {k})"
    return f"try_divide(aggregate({top}, 0D, (a, x) -> a + x), CAST(size({top}) AS double))"


def _window(axis: Axis, center: float, halfwidth: float | None) -> list[int]:
    if halfwidth is None or halfwidth <= 0:
        halfwidth = DEFAULT_HALFWIDTH
    return axis.window(center, halfwidth)


def band_topk_mean(axis: Axis, center: float, halfwidth: float, k: int = 1, column: str = "spectrum") -> Column:
    """Mean of the k largest values in the window; NULL for an empty window.

    The window is resolved on the axis when the plan is built, so each pixel only
    pays for one slice.
    """
    indices = _window(axis, center, halfwidth)
    if not indices:
        return F.lit(None).cast("double")
    return F.expr(_topk_text(finite_text(pick_text(column, indices)), min(k, len(indices))))


def spectrum_floor(column: str = "spectrum") -> Column:
    """Lowest finite value of a spectrum."""
    return F.expr(f"array_min({finite_text(column)})")


def band_amplitude(axis: Axis, center: float, halfwidth: float, k: int = 1, column: str = "spectrum") -> Column:
    """Band value above the lowest point of the spectrum."""
    return band_topk_mean(axis, center, halfwidth, k, column) - spectrum_floor(column)


def band_mean(
    axis: Axis, center: float, halfwidth: float, non_negative: bool = True, column: str = "spectrum"
) -> Column:
    """D3: mean over the window, clipped at zero on request."""
    indices = axis.window(center, halfwidth)
    if not indices:
        return F.lit(None).cast("double")
    kept = finite_text(pick_text(column, indices))
    mean = f"try_divide(aggregate({kept}, 0D, (a, x) -> a + x), CAST(size({kept}) AS double))"
    return F.expr(f"if({mean} < 0, 0D, {mean})" if non_negative else mean)


def band_topk_mean_non_negative(
    axis: Axis, center: float, halfwidth: float, k: int = 1, column: str = "spectrum"
) -> Column:
    """D3 variant: values clipped at zero before the top-k mean."""
    indices = _window(axis, center, halfwidth)
    if not indices:
        return F.lit(None).cast("double")
    clipped = f"transform({finite_text(pick_text(column, indices))}, x -> greatest(x, 0D))"
    return F.expr(_topk_text(clipped, min(k, len(indices))))


def band_columns(
    pixels: DataFrame, axis: Axis, keep: Sequence[str], amplitude: bool = True, k: int = 1
) -> DataFrame:
    """One wide row per pixel: the nine library bands, read in a single pass."""
    low = spectrum_floor() if amplitude else F.lit(0.0)
    based = pixels.select(*keep, "spectrum", low.alias("_low"))
    return based.select(
        *keep,
        *[(band_topk_mean(axis, c, hw, k) - F.col("_low")).alias(f"b_{name}") for name, c, hw, _ in BAND_LIBRARY],
    )


def bands_long(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """G3 in long form: (keep..., band, value)."""
    names = [c[2:] for c in wide.columns if c.startswith("b_")]
    entries = ", ".join(f"struct('{n}' AS band, `b_{n}` AS value)" for n in names)
    return wide.select(*keep, F.expr(f"inline(array({entries}))"))


def ratio_catalogue(spark: SparkSession) -> DataFrame:
    """The ratio table, one row per entry of ``ratio_list``."""
    return inline_table(spark, ratio_list(), "ratio string, num_band string, den_band string")


def guarded_ratio(
    num: Column, den: Column, num_thr: Column, den_thr: Column, cap: float | None = RATIO_CAP
) -> Column:
    """D4 for one pixel: NULL unless both guards hold and the capped ratio is positive."""
    value = F.try_divide(num, den + F.lit(EPS))
    if cap is not None:
        value = F.greatest(F.lit(0.0), F.least(value, F.lit(float(cap))))
    ok = is_finite(num) & is_finite(den) & (num > num_thr) & (den > den_thr)
    return F.when(ok & (value > 0), value)


def sample_ratios(
    wide: DataFrame,
    ratios: Sequence[tuple[str, str, str]],
    keep: Sequence[str],
    thresholds: DataFrame | None = None,
    threshold_keys: Sequence[str] = ("sample_id",),
    cap: float | None = RATIO_CAP,
) -> DataFrame:
    """Long pixel-aligned ratios ``(keep..., ratio, value)``.

    Thresholds depend on the band alone, so they are computed for nine bands per
    sample, folded into one map row per sample, and joined once before the pixel
    is fanned out to its ratios.
    """
    keys = list(threshold_keys)
    if thresholds is None:
        thresholds = guard_thresholds(bands_long(wide, keys), [*keys, "band"])
    names = [c[2:] for c in wide.columns if c.startswith("b_")]
    by_band = F.map_from_entries(F.collect_list(F.struct("band", F.struct("num_thr", "den_thr"))))
    folded = thresholds.groupBy(*keys).agg(by_band.alias("_m")).select(
        *keys,
        *[
            F.expr("array(" + ", ".join(f"try_element_at(_m, '{n}').{t}" for n in names) + ")").alias(f"_{t}")
            for t in ("num_thr", "den_thr")
        ],
    )
    # one literal list of (ratio, numerator, denominator) positions keeps the plan small
    entries = ", ".join(
        f"struct('{name}' AS ratio, {names.index(n)} AS _n, {names.index(d)} AS _d)" for name, n, d in ratios
    )
    fanned = wide.join(folded, keys).select(
        *keep, F.array(*[f"b_{n}" for n in names]).alias("_b"), "_num_thr", "_den_thr", F.expr(f"inline(array({entries}))")
    )
    at = lambda column, i: F.get(column, F.col(i))
    value = guarded_ratio(
        at("_b", "_n"), at("_b", "_d"), at("_num_thr", "_n"), at("_den_thr", "_d"), cap
    )
    return fanned.select(*keep, "ratio", value.alias("value")).where(F.col("value").isNotNull())


def overlay_states(ratios: DataFrame, reference_group: str, percentile: float = 0.5) -> DataFrame:
    """Each valid pixel against the reference group's percentile of its ratio."""
    cut = exact_quantiles(
        ratios.where(F.col("grp") == reference_group), ["ratio"], F.col("value"), {"threshold": percentile}
    )
    state = (
        F.when(F.col("value") > F.col("threshold"), "above")
        .when(F.col("value") < F.col("threshold"), "below")
        .otherwise("equal")
    )
    return ratios.join(cut, "ratio").withColumn("state", state)


def overlay_summary(states: DataFrame) -> DataFrame:
    """Counts and shares per (sample, ratio)."""
    n = F.count(F.lit(1))
    above, below = F.count_if(F.col("state") == "above"), F.count_if(F.col("state") == "below")
    return states.groupBy("sample_id", "ratio").agg(
        F.first("threshold").alias("threshold"),
        n.alias("n_valid"),
        above.alias("n_above"),
        below.alias("n_below"),
        (above * 100.0 / n).alias("pct_above"),
        (below * 100.0 / n).alias("pct_below"),
    )


# Three bands and six ratios read together from one pass over the pixels
EXTENDED_BANDS = ["amideI", "amideII", "1734"]
EXTENDED_RATIOS = [
    ("CH2/CH3", "ch2", "ch3"),
    ("AmideI/AmideII", "amideI", "amideII"),
    ("1734/AmideI", "1734", "amideI"),
    ("1734/AmideII", "1734", "amideII"),
    ("CH2/AmideI", "ch2", "amideI"),
    ("CH3/AmideI", "ch3", "amideI"),
]


def extended_metrics(wide: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Nine named metrics in long form (keep..., metric, value)."""
    bands = bands_long(wide, keep).where(F.col("band").isin(EXTENDED_BANDS) & (F.col("value") > 0))
    ratios = sample_ratios(wide, EXTENDED_RATIOS, keep)
    return bands.withColumnRenamed("band", "metric").unionByName(
        ratios.withColumnRenamed("ratio", "metric")
    )


def lifetime_ratio(a1: Column, a2: Column, keep_zero: bool = False) -> Column:
    """a1/a2; NULL where a2 is zero, or 0 in the keeping variant."""
    value = null_if_not_finite(F.try_divide(a1, a2))
    return F.coalesce(value, F.lit(0.0)) if keep_zero else value


def nearest_band(points: DataFrame, known: DataFrame, wn: str = "wn", tolerance: float = 15.0) -> DataFrame:
    """Closest known band within the tolerance, else NULL.

    The catalogue is a fixed handful of rows; folded into one array it becomes a
    column of each point, so the as-of match needs neither shuffle nor window.
    """
    listed = F.array_sort(
        F.collect_list(F.struct("center", "name", "category"))
    ).alias("_known")
    folded = known.agg(listed)
    x = F.col(wn)
    ranked = F.array_min(
        F.transform(
            F.col("_known"),
            lambda b: F.struct(F.abs(x - b["center"]).alias("d"), b["center"].alias("center"),
                               b["name"].alias("name"), b["category"].alias("category")),
        )
    )
    hit = points.crossJoin(F.broadcast(folded)).withColumn("_best", ranked)
    near = F.col("_best.d") <= tolerance
    return hit.select(
        *points.columns,
        F.when(near, F.col("_best.name")).alias("name"),
        F.when(near, F.col("_best.category")).alias("category"),
        F.when(near, F.col("_best.d")).alias("distance"),
    )
