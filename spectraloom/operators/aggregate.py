"""Aggregations over pixels, samples and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.arrays import hash_key, is_finite, null_if_not_finite
from spectraloom.operators.scale import exact_quantiles, joint_quantiles
from spectraloom.operators.spectra import band_long
from spectraloom.session import settle


def mean_spectrum(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F1/F11 in long form: mean per (keys, band), NaN skipped.

    Exploded bands meet a map-side partial average at once, so only
    (groups x bands) rows are shuffled, whatever the pixel count.
    """
    long = band_long(pixels, keys)
    return long.groupBy(*keys, "k").agg(
        F.avg(null_if_not_finite(F.col("v"))).alias("mean"), F.count(F.lit(1)).alias("n_pixels")
    )


def median_spectrum(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F2 in long form: exact median per (keys, band)."""
    return exact_quantiles(band_long(pixels, keys), [*keys, "k"], F.col("v"), {"median": 0.5})


def curve_stats(curves: DataFrame, keys: Sequence[str], value: str, ddof: int = 1) -> DataFrame:
    """mean, SD and SEM per (keys, band) across samples; spread is NULL below two."""
    sd = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    n = F.count(value)
    return curves.groupBy(*keys, "k").agg(
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.when(n >= 2, sd).alias("sd"),
        F.when(n >= 2, sd / F.sqrt(n.cast("double"))).alias("sem"),
    )


def between_sample_variance(curves: DataFrame, value: str = "mean") -> DataFrame:
    """population variance per band across samples of a group, with its mean over bands."""
    per_band = curves.groupBy("grp", "k").agg(F.var_pop(value).alias("var"))
    return per_band.groupBy("grp").agg(F.avg("var").alias("mean_var"), F.count("var").alias("n_bands"))


def summarise(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """median, IQR, mean and population SD of the finite values."""
    q = exact_quantiles(rows, keys, value, {"_q1": 0.25, "med": 0.5, "_q3": 0.75})
    m = rows.where(is_finite(value)).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n")
    )
    return m.join(q, list(keys)).withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")


def animal_medians(values: DataFrame, samples: DataFrame) -> DataFrame:
    """pixel values to sample medians to animal medians; unmapped samples drop out."""
    per_sample = exact_quantiles(values, ["metric", "sample_id"], F.col("value"), {"_m": 0.5})
    mapped = per_sample.join(samples.select("sample_id", "animal_id", "grp"), "sample_id")
    return mapped.groupBy("metric", "animal_id", "grp").agg(
        F.median("_m").alias("value"), F.count(F.lit(1)).alias("n_samples")
    )


def lifetime_summary(pixels: DataFrame, keys: Sequence[str], ratio: str = "ratio", tm: str = "tm") -> DataFrame:
    """F8: median and mean of the ratio and of tm, with the pixel count."""
    keys = list(keys)
    good = pixels.where(is_finite(F.col(ratio)) & is_finite(F.col(tm)))
    med = joint_quantiles(good.select(*keys, F.col(ratio).alias("r"), F.col(tm).alias("t")), keys, ["r", "t"], {"_m": 0.5})
    med = med.withColumnsRenamed({"_m_r": "ratio_median", "_m_t": "tm_median"})
    means = good.groupBy(*keys).agg(
        F.avg(ratio).alias("ratio_mean"), F.avg(tm).alias("tm_mean"), F.count(F.lit(1)).alias("n_pixels")
    )
    return means.join(med, keys)


def roll_up_predictions(preds: DataFrame, keys: Sequence[str], cut: float = 0.5) -> DataFrame:
    """mean finite probability per unit group, row count, label and decision."""
    prob = F.avg(null_if_not_finite(F.col("prob")))
    return preds.groupBy(*keys).agg(
        prob.alias("prob"),
        F.count(F.lit(1)).alias("n"),
        F.min("y").alias("y"),
        F.coalesce((prob >= cut).cast("int"), F.lit(0)).alias("pred"),
    )


def box_table(rows: DataFrame, keys: Sequence[str], value: Column, whisker: float = 1.5) -> DataFrame:
    """quartiles, 1.5 IQR whiskers at the extreme values in range, and mean."""
    keys = list(keys)
    q = exact_quantiles(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * whisker
    base = rows.where(is_finite(value)).select(*keys, value.alias("_v")).join(q, keys)
    in_range = F.when(F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach), F.col("_v"))
    return base.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(in_range).alias("whisker_lo"),
        F.max(in_range).alias("whisker_hi"),
        F.avg("_v").alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )


def axis_limits(
    rows: DataFrame, keys: Sequence[str], value: Column, pad: float = 0.1, floor: float | None = None
) -> DataFrame:
    """P1..P99 padded on both sides; no row when they coincide."""
    q = exact_quantiles(rows, keys, value, {"_lo": 0.01, "_hi": 0.99}).where(F.col("_lo") != F.col("_hi"))
    room = (F.col("_hi") - F.col("_lo")) * pad
    lo = F.col("_lo") - room
    if floor is not None:
        lo = F.greatest(lo, F.lit(float(floor)))
    return q.select(*keys, lo.alias("lo"), (F.col("_hi") + room).alias("hi"))


def trim_to_limits(rows: DataFrame, keys: Sequence[str], value: Column, limits: DataFrame) -> DataFrame:
    """rows inside their group's limits; a group without limits stays whole."""
    joined = rows.where(is_finite(value)).join(limits, list(keys), "left")
    inside = F.coalesce(value.between(F.col("lo"), F.col("hi")), F.lit(True))
    return joined.where(inside).drop("lo", "hi")


def histogram(rows: DataFrame, keys: Sequence[str], value: Column, limits: DataFrame, bins: int) -> DataFrame:
    """counts for a violin outline, on equal bins between the limits."""
    joined = rows.where(is_finite(value)).join(limits, list(keys))
    at = F.least(
        F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)
    ).cast("int")
    return joined.where(value.between(F.col("lo"), F.col("hi"))).groupBy(*keys, at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def scale_image(image: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(v - min) / (max - min) per sample, undefined values to zero.

    The bounds are a plain aggregate joined back, not a window over a whole sample.
    """
    v = null_if_not_finite(F.col(value))
    bounds = settle(image.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")), "bounds")
    scaled = F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return image.join(bounds, list(keys)).withColumn("scaled", F.coalesce(scaled, F.lit(0.0))).drop("_lo", "_hi")


def check_uniform(df: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    """One row with the number of distinct values; fails when there is more than one.

    Two are allowed when one of them is ``blank``.
    """
    c = F.col(column)
    seen = df.agg(
        F.min(c).alias("_lo"),
        F.max(c).alias("_hi"),
        F.min(F.when(c != F.lit(blank), c)).alias("_lo_full") if blank is not None else F.min(c).alias("_lo_full"),
        F.max(F.when(c != F.lit(blank), c)).alias("_hi_full") if blank is not None else F.max(c).alias("_hi_full"),
    )
    same = F.coalesce(F.col("_lo_full") == F.col("_hi_full"), F.lit(True))
    return seen.select(
        F.when(same, F.col("_hi_full"))
        .otherwise(F.raise_error(F.lit(f"non-uniform value in {column}")))
        .alias("value"),
        (F.col("_lo") != F.col("_hi")).alias("has_blank"),
    )


def top_patches(boxes: DataFrame, keys: Sequence[str], n: int, random_salt: str | None = None) -> DataFrame:
    """H1: the ``n`` boxes with most selected pixels (ties by position), or ``n`` at random.

    ``row_number() <= n`` is pushed below the shuffle as a per-task limit.
    """
    order = [F.desc("n_pixels"), F.col("r0"), F.col("c0")]
    if random_salt is not None:
        order = [hash_key(random_salt, *keys, "r0", "c0"), F.col("r0"), F.col("c0")]
    w = Window.partitionBy(*keys).orderBy(*order)
    return boxes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def spaced_top_bands(tested: DataFrame, keys: Sequence[str], k: int, min_sep: int = 1) -> DataFrame:
    """H2: bands by ascending p, skipping those closer than ``min_sep`` to a pick.

    A comparison has one row per band, so its ordered list is bounded by the axis.
    """
    ordered = F.sort_array(F.collect_list(F.struct("p", "k")))

    def step(picked: Column, e: Column) -> Column:
        near = F.exists(picked, lambda j: F.abs(j - e["k"]) < min_sep)
        return F.when((F.size(picked) >= k) | near, picked).otherwise(F.concat(picked, F.array(e["k"])))

    start = F.array().cast("array<int>")
    picks = F.aggregate(ordered, start, step)
    return (
        tested.where(is_finite(F.col("p")))
        .groupBy(*keys)
        .agg(picks.alias("_p"))
        .select(*keys, F.posexplode("_p").alias("rank", "k"))
        .withColumn("rank", F.col("rank") + 1)
    )


def rank_by_magnitude(coefficients: DataFrame, column: str, k: int) -> DataFrame:
    """H3: the ``k`` features with the largest absolute coefficient."""
    return coefficients.withColumn("magnitude", F.abs(column)).orderBy(F.desc("magnitude"), "feature").limit(k)


def order_matrix(
    pairs: DataFrame, samples: DataFrame, groups: Sequence[str], min_share: float = 0.8, clean: bool = True
) -> DataFrame:
    """H4: order samples for a heat table: group blocks, each by mean similarity.

    Works on the long matrix (a, b, cos).  ``clean`` symmetrises it, drops samples
    with too few finite entries, fills holes with the median and clips to [-1, 1].
    """
    m = pairs
    if clean:
        both = m.select("a", "b", "cos").unionByName(m.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
        m = both.groupBy("a", "b").agg(F.avg(null_if_not_finite(F.col("cos"))).alias("cos"))
        n = m.select("a").distinct().agg(F.count(F.lit(1)).alias("_n"))
        share = m.groupBy("a").agg(F.count("cos").alias("_f")).crossJoin(F.broadcast(n))
        kept = share.where(F.col("_f") >= F.col("_n") * min_share).select("a")
        m = m.join(kept, "a").join(kept.withColumnRenamed("a", "b"), "b")
        mid = m.agg(F.median("cos").alias("_mid"))
        filled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("cos", "_mid")))
        m = m.crossJoin(F.broadcast(mid)).select("a", "b", filled.alias("cos"))
    row_mean = m.groupBy(F.col("a").alias("sample_id")).agg(F.avg("cos").alias("mean_cos"))
    block = F.lit(len(groups))
    for i, g in enumerate(groups):
        block = F.when(F.col("grp") == g, F.lit(i)).otherwise(block)
    # one row per sample: the table is as small as the sample list
    w = Window.orderBy("block", F.desc(F.round("mean_cos", 9)), "sample_id")
    return (
        row_mean.join(samples.select("sample_id", "grp"), "sample_id")
        .withColumn("block", block)
        .withColumn("position", F.row_number().over(w))
    )


def union_sides(right: DataFrame, left: DataFrame, ids: Sequence[str], salt: str = "shuffle") -> DataFrame:
    """H5: both sides as one set, with a repeatable shuffle key."""
    return right.unionByName(left).withColumn("shuffle_key", hash_key(salt, *ids))
