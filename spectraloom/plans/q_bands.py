"""Queries over band features and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog import BAND_LIBRARY, KNOWN_BANDS, known_bands_table, ratio_list
from spectraloom.functions.text import format_delta, format_percent, safe_name
from spectraloom.operators import bands as B
from spectraloom.operators.scale import exact_quantiles
from spectraloom.operators.stats import two_group_stats
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, r, rounded, sql
from spectraloom.plans.registry import query
from spectraloom.session import settle

PIX = ["sample_id", "row", "col"]


def wide_bands(spark, sf_dir, keep=("sample_id", "grp", "row", "col")):
    """The band-feature table: nine numbers per pixel instead of a spectrum, written once
    because thresholds, ratios and statistics all read it again."""
    return settle(B.band_columns(X.selected_pixels(spark, sf_dir), AXIS, list(keep)), "bands")


@query(
    "d1_band_topk_mean",
    sql(
        "selected bandlib",
        f"""SELECT sample_id, row, col, band, {r('list_avg(list_slice(list_reverse_sort(list_transform(list_filter(range(64), '
          'lambda i: abs(960.0::DOUBLE + i * (840.0::DOUBLE / 63) - center) <= halfwidth), lambda i: spectrum[i + 1])), 1, 3))', 'value')}
        FROM selected, bandlib""",
    ),
)
def d1(spark, sf_dir):
    wide = B.band_columns(X.selected_pixels(spark, sf_dir), AXIS, PIX, amplitude=False, k=3)
    return B.bands_long(wide, PIX).select(*PIX, "band", *rounded("value"))


@query("d2_band_amplitude", sql("bandpx", f"SELECT sample_id, row, col, band, {r('value', 'value')} FROM bandpx"))
def d2(spark, sf_dir):
    return B.bands_long(wide_bands(spark, sf_dir), PIX).select(*PIX, "band", *rounded("value"))


@query(
    "d3_band_mean",
    sql(
        "selected bandlib",
        f"""SELECT sample_id, row, col, band, {r('greatest(list_avg(w), 0.0)', 'mean_value')},
        {r('list_max(list_transform(w, lambda x: greatest(x, 0.0)))', 'top_value')}
        FROM (SELECT *, list_transform(list_filter(range(64),
          lambda i: abs(960.0::DOUBLE + i * (840.0::DOUBLE / 63) - center) <= halfwidth), lambda i: spectrum[i + 1]) AS w
        FROM selected, bandlib)""",
    ),
)
def d3(spark, sf_dir):
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("band"),
                B.band_mean(AXIS, c, hw).alias("mean_value"),
                B.band_topk_mean_non_negative(AXIS, c, hw).alias("top_value"),
            )
            for n, c, hw, _ in BAND_LIBRARY
        ]
    )
    return (
        X.selected_pixels(spark, sf_dir)
        .select(*PIX, F.inline(entries))
        .select(*PIX, "band", *rounded("mean_value", "top_value"))
    )


@query(
    "d4_guarded_ratios",
    sql("ratiopx", f"SELECT sample_id, row, col, ratio, {r('value', 'value')} FROM ratiopx"),
)
def d4(spark, sf_dir):
    out = B.sample_ratios(wide_bands(spark, sf_dir), ratio_list(), PIX)
    return out.select(*PIX, "ratio", *rounded("value"))


@query(
    "flagship_ratio_effects",
    sql(
        "ratiopx",
        f"""SELECT ratio, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, {r('mean_a', 'mean_a')}, {r('mean_b', 'mean_b')},
        {r('median_a', 'median_a')}, {r('median_b', 'median_b')}, {r('sd_a', 'sd_a')}, {r('sd_b', 'sd_b')},
        {r('2.0 * u / (n_a * n_b) - 1.0', 'delta')}
        FROM (SELECT ratio, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b,
          avg(value) FILTER (grp = 'A') AS mean_a, avg(value) FILTER (grp = 'B') AS mean_b,
          median(value) FILTER (grp = 'A') AS median_a, median(value) FILTER (grp = 'B') AS median_b,
          stddev_samp(value) FILTER (grp = 'A') AS sd_a, stddev_samp(value) FILTER (grp = 'B') AS sd_b FROM ratiopx GROUP BY ratio)
        JOIN (SELECT a.ratio, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END)::DOUBLE AS u
          FROM ratiopx a JOIN ratiopx b ON a.ratio = b.ratio AND a.grp = 'A' AND b.grp = 'B' GROUP BY a.ratio) USING (ratio)""",
    ),
)
def flagship(spark, sf_dir):
    """Cliff's delta per band ratio between the two groups."""
    keep = ["sample_id", "grp"]
    wide = wide_bands(spark, sf_dir, keep)
    ratios = settle(B.sample_ratios(wide, ratio_list(), keep), "ratios")
    out = two_group_stats(ratios, ["ratio"], F.col("value"), F.col("grp") == "A")
    return out.select(
        "ratio", "n_a", "n_b",
        *rounded("mean_a", "mean_b", "median_a", "median_b", "sd_a", "sd_b", "delta"),
    )


@query("d5_ratio_catalogue", sql("ratiopx", "SELECT ratio, num_band, den_band, count(*) AS n FROM ratios JOIN ratiopx USING (ratio) GROUP BY ALL"))
def d5(spark, sf_dir):
    """The ratios that have guarded values, and how many."""
    keep = ["sample_id"]
    found = B.sample_ratios(wide_bands(spark, sf_dir, keep), ratio_list(), keep).where(F.col("value").isNotNull())
    return B.ratio_catalogue(spark).join(found.groupBy("ratio").agg(F.count(F.lit(1)).alias("n")), "ratio")


@query(
    "d6_ratio_overlay",
    sql("ratiopx", f"""SELECT sample_id, ratio, {r('any_value(threshold)', 'threshold')}, count(*) AS n_valid, count(*) FILTER (value > threshold) AS n_above,
        count(*) FILTER (value < threshold) AS n_below, {r('100.0 * count(*) FILTER (value > threshold) / count(*)', 'pct_above')},
        {r('100.0 * count(*) FILTER (value < threshold) / count(*)', 'pct_below')} FROM ratiopx
        JOIN (SELECT ratio, median(value) AS threshold FROM ratiopx WHERE grp = 'A' GROUP BY 1) USING (ratio) GROUP BY 1, 2"""),
)
def d6(spark, sf_dir):
    keep = ["sample_id", "grp", "row", "col"]
    ratios = settle(B.sample_ratios(wide_bands(spark, sf_dir), ratio_list(), keep), "ratios")
    out = B.overlay_summary(B.overlay_states(ratios, "A"))
    return out.select(
        "sample_id", "ratio", *rounded("threshold"), "n_valid", "n_above", "n_below", *rounded("pct_above", "pct_below")
    )


@query(
    "d7_extended_metrics",
    sql("ratiopx", f"""SELECT sample_id, metric, count(*) AS n, {r('median(value)', 'value')} FROM (
        SELECT sample_id, band AS metric, value FROM bandpx WHERE band IN ('1734', 'amideI', 'amideII') AND value > 0
        UNION ALL SELECT sample_id, CASE ratio WHEN 'ch2/AmideI' THEN 'CH2/AmideI' WHEN 'ch3/AmideI' THEN 'CH3/AmideI' ELSE ratio END, value FROM ratiopx
        WHERE ratio IN ('CH2/CH3', 'AmideI/AmideII', '1734/AmideI', '1734/AmideII', 'ch2/AmideI', 'ch3/AmideI')) GROUP BY 1, 2"""),
)
def d7(spark, sf_dir):
    values = settle(B.extended_metrics(wide_bands(spark, sf_dir), ["sample_id"]), "metrics")
    n = values.groupBy("sample_id", "metric").agg(F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(values, ["sample_id", "metric"], F.col("value"), {"value": 0.5})
    return n.join(med, ["sample_id", "metric"]).select("sample_id", "metric", "n", *rounded("value"))


@query(
    "d8_lifetime_ratio",
    sql("flim", f"""SELECT grp, sample_id, count(*) FILTER (a2 <> 25) AS n, {r('sum(a1 / nullif(a2 - 25, 0))', 'dropped', 3)}, count(*) AS n_kept,
        {r('avg(coalesce(a1 / nullif(a2 - 25, 0), 0))', 'kept_mean', 3)} FROM flim GROUP BY 1, 2"""),
)
def d8(spark, sf_dir):
    shifted = X.flim(spark, sf_dir).withColumn("a2", F.col("a2") - 25.0)
    a1, a2 = F.col("a1"), F.col("a2")
    return shifted.groupBy("grp", "sample_id").agg(
        F.count(B.lifetime_ratio(a1, a2)).alias("n"),
        F.sum(B.lifetime_ratio(a1, a2)).alias("dropped"),
        F.count(F.lit(1)).alias("n_kept"),
        F.avg(B.lifetime_ratio(a1, a2, keep_zero=True)).alias("kept_mean"),
    ).select("grp", "sample_id", "n", *rounded("dropped", digits=3), "n_kept", *rounded("kept_mean", digits=3))


_KNOWN = ", ".join(f"('{n}', {c}::DOUBLE, '{k}')" for n, c, k in KNOWN_BANDS)


@query(
    "d9_nearest_band",
    sql("spectra", f"""SELECT sample_id, row, col, CASE WHEN d <= 15 THEN name END AS name, CASE WHEN d <= 15 THEN category END AS category, {r('CASE WHEN d <= 15 THEN d END', 'distance')}
        FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, row, col ORDER BY d, center) AS rn FROM (SELECT sample_id, row, col, name, category, center, abs(center - wn) AS d
        FROM (SELECT *, 960.0::DOUBLE + (list_position(spectrum, list_max(spectrum)) - 1) * (840.0::DOUBLE / 63) AS wn FROM spectra),
        (VALUES {_KNOWN}) k(name, center, category))) WHERE rn = 1"""),
)
def d9(spark, sf_dir):
    peak = F.array_position("spectrum", F.array_max("spectrum")) - 1
    points = X.spectra(spark, sf_dir).select(
        *PIX, (F.lit(AXIS.wn[0]) + peak * ((AXIS.wn[-1] - AXIS.wn[0]) / (len(AXIS) - 1))).alias("wn")
    )
    return B.nearest_band(points, known_bands_table(spark)).select(*PIX, "name", "category", *rounded("distance"))


@query(
    "d4_ratio_labels",
    sql("ratiopx", """SELECT replace(ratio, '/', '_over_') AS name, 'δ=' || printf('%+.2f', median(value) - 1) AS delta, printf('%.1f%%', 100 * avg((value > 1)::INT)) AS share
        FROM ratiopx GROUP BY ratio"""),
)
def d4_labels(spark, sf_dir):
    ratios = settle(B.sample_ratios(wide_bands(spark, sf_dir), ratio_list(), ["sample_id"]), "ratios")
    med = exact_quantiles(ratios, ["ratio"], F.col("value"), {"m": 0.5})
    share = ratios.groupBy("ratio").agg(F.avg((F.col("value") > 1).cast("int")).alias("s"))
    return med.join(share, "ratio").select(
        safe_name(F.col("ratio")).alias("name"), format_delta(F.col("m") - 1).alias("delta"), format_percent(F.col("s")).alias("share")
    )
