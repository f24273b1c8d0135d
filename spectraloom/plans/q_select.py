"""Queries over pixel selection and background choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog import AXIS_MIN, Axis, inline_table
from spectraloom.operators import aggregate as G
from spectraloom.operators import select as S
from spectraloom.operators import spectra as C
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, r, rounded, sql
from spectraloom.plans.registry import query
from spectraloom.schemas import RECTS as RECTS_SCHEMA
from spectraloom.sources.cubes import checked_clusters

PIX = ["sample_id", "row", "col"]
SUM = "list_sum(spectrum)"


def spectrum_sum():
    return F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x).alias("total")


# flat pixel indices, as one of the published label layouts has them
@query(
    "a3_cluster_scan",
    """SELECT 'T' || (vec_id % 14) AS sample_id, CAST(vec_id // 25 AS INT) AS row, CAST(vec_id % 25 AS INT) AS col,
    label AS cluster FROM embeddings""",
)
def a3(spark, sf_dir):
    raw = X.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("T"), (F.col("vec_id") % 14).cast("string")).alias("sample_id"),
        F.col("vec_id").alias("flat"), F.col("label").alias("cluster"),
    )
    return checked_clusters(raw, width=25)


_BG = """bgs AS (SELECT sample_id, 1 AS priority, spectrum FROM (SELECT sample_id,
      list(m ORDER BY k) AS spectrum FROM (SELECT sample_id, k, avg(v) AS m FROM
        (SELECT sample_id, unnest(range(64)) AS k, unnest(spectrum) AS v FROM
          (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY row, col) AS rn FROM spectra) WHERE rn <= 3)
        GROUP BY 1, 2) GROUP BY 1) WHERE sample_id <> 'T3'
    UNION ALL SELECT sample_id, 2, list_transform(spectrum, lambda x: x * 2) FROM spectra WHERE row = 0 AND col < 14)"""
_BGQ = _BG.split(" AS (", 1)[1][:-1]


def backgrounds(spark, sf_dir):
    """First choice: mean of the first three pixels (one sample lacks it); second: a doubled pixel."""
    from spectraloom.operators.sampling import first_rows

    spectra = X.spectra(spark, sf_dir)
    mean = G.mean_spectrum(first_rows(spectra, ["sample_id"], 3), ["sample_id"])
    first = C.gathered(mean, ["sample_id"], "mean").where(F.col("sample_id") != "T3")
    second = spectra.where("row = 0 AND col < 14").select(
        "sample_id", F.lit(2).alias("priority"), F.transform("spectrum", lambda x: x * 2).alias("spectrum")
    )
    return first.select("sample_id", F.lit(1).alias("priority"), "spectrum").unionByName(second)


@query(
    "a4_background_choice",
    sql("spectra", f"""SELECT sample_id, CAST(k AS INT) AS k, {r('v', 'v')} FROM (SELECT sample_id,
        unnest(range(64)) AS k, unnest(spectrum) AS v FROM
        (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY priority) AS rn FROM bgs) WHERE rn = 1)""", bgs=_BGQ),
)
def a4(spark, sf_dir):
    best = C.choose_backgrounds(backgrounds(spark, sf_dir))
    return best.select("sample_id", F.posexplode("bg").alias("k", "v")).select("sample_id", "k", *rounded("v"))


@query(
    "a7_uniform_value",
    "SELECT DISTINCT len(embedding)::VARCHAR AS value, true AS has_blank FROM embeddings",
)
def a7(spark, sf_dir):
    dims = X.table(spark, sf_dir, "embeddings").select(
        F.explode(F.array(F.size("embedding").cast("string"), F.lit(""))).alias("dim")
    )
    return G.check_uniform(dims, "dim", blank="")


@query(
    "b1_cluster_cleaning",
    sql("", """SELECT sample_id, cluster, policy FROM (
        SELECT DISTINCT sample_id, CAST(trunc(x) AS INT) AS cluster, 'truncate' AS policy FROM raw WHERE trunc(x) BETWEEN 0 AND 7
        UNION ALL SELECT DISTINCT sample_id, CAST(x AS INT), 'strict' FROM raw WHERE x = trunc(x) AND x BETWEEN 0 AND 7)""",
        raw="""SELECT 'T' || (vec_id % 14) AS sample_id, label::DOUBLE + CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 0 END
        - CASE WHEN vec_id % 11 = 0 THEN 4 ELSE 0 END AS x FROM embeddings WHERE vec_id % 17 <> 0"""),
)
def b1(spark, sf_dir):
    v = F.col("vec_id")
    x = F.col("label") + F.when(v % 3 == 0, 0.5).otherwise(0.0) - F.when(v % 11 == 0, 4.0).otherwise(0.0)
    raw = X.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("T"), (v % 14).cast("string")).alias("sample_id"),
        F.when(v % 17 == 0, F.lit("n/a")).otherwise(x.cast("string")).alias("raw"),
    )
    parts = [
        S.clean_clusters(raw, strict=strict).withColumn("policy", F.lit(name))
        for name, strict in (("truncate", False), ("strict", True))
    ]
    return parts[0].unionByName(parts[1])


@query("b2_cluster_inclusion", sql("selected", f"SELECT sample_id, row, col, cluster, {r(SUM, 'total')} FROM selected"))
def b2(spark, sf_dir):
    kept = X.selected_pixels(spark, sf_dir)
    return kept.select(*PIX, "cluster", spectrum_sum()).select(*PIX, "cluster", *rounded("total"))


@query(
    "b2_cluster_exclusion",
    sql("spectra clusters selection", f"""SELECT sample_id, row, col, cluster, {r(SUM, 'total')} FROM spectra
        JOIN clusters USING (sample_id, row, col) ANTI JOIN selection USING (sample_id, cluster)"""),
)
def b2x(spark, sf_dir):
    labelled = S.label_pixels(X.spectra(spark, sf_dir), X.clusters(spark, sf_dir))
    dropped = S.drop_clusters(labelled, S.clean_clusters(X.selection_raw(spark)))
    return dropped.select(*PIX, "cluster", spectrum_sum()).select(*PIX, "cluster", *rounded("total"))


def holed(spark, sf_dir):
    """Spectra with deterministic NaN, infinite and missing bands."""
    v = F.col("row") * 25 + F.col("col")
    return X.spectra(spark, sf_dir).withColumn(
        "spectrum",
        F.transform(
            "spectrum",
            lambda x, k: F.when((v * 7 + k) % 211 == 0, F.lit(float("nan")))
            .when((v * 5 + k) % 307 == 0, F.lit(float("inf")))
            .otherwise(x),
        ),
    )


HOLED = """SELECT sample_id, side, row, col, list_transform(range(64), lambda k: CASE
    WHEN ((row * 25 + col) * 7 + k) % 211 = 0 THEN 'nan'::DOUBLE WHEN ((row * 25 + col) * 5 + k) % 307 = 0 THEN 'inf'::DOUBLE
    ELSE spectrum[k + 1] END) AS spectrum FROM spectra"""


@query(
    "b3_finite_spectra",
    sql("spectra", f"""SELECT sample_id, row, col, {r(SUM, 'total')} FROM holed
        WHERE len(list_filter(spectrum, lambda x: NOT isfinite(x))) = 0""", holed=HOLED),
)
def b3(spark, sf_dir):
    return S.finite_spectra(holed(spark, sf_dir)).select(*PIX, spectrum_sum()).select(*PIX, *rounded("total"))


@query(
    "b4_intensity_mask",
    sql("raster", f"""SELECT sample_id, row, col, {r('v', 'v')}, variant FROM (
        SELECT *, 'top' AS variant FROM raster JOIN q USING (sample_id) WHERE v > 0.05 AND v < hi
        UNION ALL SELECT *, 'both' FROM raster JOIN q USING (sample_id) WHERE v > greatest(lo, 0.05) AND v < hi2)""",
        q="""SELECT sample_id, quantile_cont(v, 0.99999) AS hi, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi2
        FROM raster GROUP BY 1"""),
)
def b4(spark, sf_dir):
    raster = X.raster(spark, sf_dir)
    top = S.intensity_mask(raster, F.col("v"), low=0.05)
    both = S.intensity_mask(raster, F.col("v"), low=0.05, low_percentile=0.01, high_percentile=0.995)
    out = top.withColumn("variant", F.lit("top")).unionByName(both.withColumn("variant", F.lit("both")))
    return out.select(*PIX, *rounded("v"), "variant")


POLYGONS = [
    ("triangle", [(2.0, 1.0), (80.5, 30.0), (10.0, 95.0)]),
    ("notched", [(20.0, 20.0), (90.0, 20.0), (55.0, 50.0), (90.0, 90.0), (20.0, 90.0)]),
]


def polygons(spark):
    rows = [(roi, i, x, y) for roi, vs in POLYGONS for i, (x, y) in enumerate(vs)]
    t = inline_table(spark, rows, "roi string, i int, x double, y double")
    listed = F.sort_array(F.collect_list(F.struct("i", "x", "y")))
    return t.groupBy("roi").agg(F.transform(listed, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("verts"))


_EDGES = ", ".join(
    f"('{roi}', {vs[i][0]}::DOUBLE, {vs[i][1]}::DOUBLE, {vs[(i + 1) % len(vs)][0]}::DOUBLE, {vs[(i + 1) % len(vs)][1]}::DOUBLE)"
    for roi, vs in POLYGONS
    for i in range(len(vs))
)


@query(
    "b5_polygon_roi",
    sql("raster", f"""SELECT roi, sample_id, row, col, {r('v', 'v')} FROM raster, edges
        WHERE (y1 > row) <> (y2 > row) AND col < x1 + (row - y1) * (x2 - x1) / (y2 - y1)
        GROUP BY roi, sample_id, row, col, v HAVING count(*) % 2 = 1""",
        edges=f"SELECT * FROM (VALUES {_EDGES}) e(roi, x1, y1, x2, y2)"),
)
def b5(spark, sf_dir):
    return S.inside_polygons(X.raster(spark, sf_dir), polygons(spark)).select("roi", *PIX, *rounded("v"))


RECTS = [(f"region{i % 3}", f"T{i}", i % 4, 400 + i, i % 5, 12 + i % 9) for i in range(14)]


@query(
    "b6_rectangle_roi",
    sql("spectra", f"""SELECT region, CAST(k AS INT) AS k, count(*) AS n, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}
        FROM (SELECT region, unnest(range(64)) AS k, unnest(spectrum) AS v FROM spectra s
          JOIN (VALUES {', '.join(str(x) for x in RECTS)}) q(region, sid, r0, r1, c0, c1)
          ON s.sample_id = sid AND row >= r0 AND row < r1 AND col >= c0 AND col < c1) GROUP BY 1, 2"""),
)
def b6(spark, sf_dir):
    rects = inline_table(spark, RECTS, RECTS_SCHEMA)
    inside = S.inside_rectangles(X.spectra(spark, sf_dir), rects)
    long = C.band_long(inside, ["region"])
    return long.groupBy("region", "k").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")
    ).select("region", "k", "n", *rounded("mean", "sd"))


@query(
    "b7_quality_filter",
    sql("spectra", f"""SELECT sample_id, row, col, len(spectrum) AS bands FROM (SELECT *, sum(good::INT) OVER (PARTITION BY sample_id) AS n_good
        FROM (SELECT *, len(list_filter(spectrum, lambda x: NOT isfinite(x))) = 0
          AND sqrt(list_sum(list_transform(spectrum, lambda x: x * x))) >= 0.95
          AND list_max(list_transform(spectrum, lambda x: abs(x))) <= 0.34 AS good FROM holed)) WHERE good OR n_good < 11""", holed=HOLED),
)
def b7(spark, sf_dir):
    kept = S.quality_filter(holed(spark, sf_dir), min_norm=0.95, max_value=0.34, min_keep=11)
    return kept.select(*PIX, F.size("spectrum").cast("bigint").alias("bands"))


@query(
    "b8_positive_values",
    """SELECT event_type AS sample_id, event_id, round(v, 6) + 0.0 AS v FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN 0.0 WHEN 1 THEN -value
    WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 'inf'::DOUBLE ELSE value END AS v FROM events) WHERE isfinite(v) AND v > 0""",
)
def b8(spark, sf_dir):
    m = F.col("event_id") % 7
    v = (
        F.when(m == 0, 0.0).when(m == 1, -F.col("value")).when(m == 2, float("nan")).when(m == 3, float("inf"))
        .otherwise(F.col("value"))
    )
    e = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("sample_id"), "event_id", v.alias("v"))
    return e.where(S.positive_finite(F.col("v"))).select("sample_id", "event_id", *rounded("v"))


@query(
    "b9_joint_outlier_trim",
    sql("flim", f"""SELECT grp, sample_id, count(*) AS n, {r('sum(a1)', 'a1', 2)}, {r('sum(a2)', 'a2', 2)}, {r('sum(tm)', 'tm', 4)}
        FROM flim JOIN q USING (grp, sample_id) WHERE a1 BETWEEN l1 AND h1 AND a2 BETWEEN l2 AND h2 AND tm BETWEEN l3 AND h3 GROUP BY 1, 2""",
        q="""SELECT grp, sample_id, quantile_cont(a1, 0.025) AS l1, quantile_cont(a1, 0.975) AS h1, quantile_cont(a2, 0.025) AS l2,
        quantile_cont(a2, 0.975) AS h2, quantile_cont(tm, 0.025) AS l3, quantile_cont(tm, 0.975) AS h3 FROM flim GROUP BY 1, 2"""),
)
def b9(spark, sf_dir):
    kept = S.trim_joint(X.flim(spark, sf_dir), ["a1", "a2", "tm"], ["grp", "sample_id"])
    return kept.groupBy("grp", "sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a1").alias("a1"), F.sum("a2").alias("a2"), F.sum("tm").alias("tm")
    ).select("grp", "sample_id", "n", *rounded("a1", "a2", digits=2), *rounded("tm", digits=4))


@query("b10_ratio_guards", sql("thr", f"SELECT sample_id, band, {r('num_thr', 'num_thr')}, {r('den_thr', 'den_thr')} FROM thr"))
def b10(spark, sf_dir):
    from spectraloom.operators.bands import bands_long
    from spectraloom.plans.q_bands import wide_bands

    wide = wide_bands(spark, sf_dir, ["sample_id"])
    thr = S.guard_thresholds(bands_long(wide, ["sample_id"]), ["sample_id", "band"])
    return thr.select("sample_id", "band", *rounded("num_thr", "den_thr"))


_TARGETS = [(1655.0, 30.0), (1640.0, 20.0), (1080.0, 15.0)]
_IDX = {
    "union": S.band_windows(AXIS, _TARGETS),
    "chained": S.band_windows(AXIS, _TARGETS, union=False),
    "range": AXIS.between(1000.0, 1200.0),
}


@query(
    "b11_band_windows",
    sql("spectra axis", f"""SELECT sample_id, row, col, {r("sum(v) FILTER (in_union)", 'union_sum')},
        {r("coalesce(sum(v) FILTER (abs(wn - 1655) <= 30), 0) + coalesce(sum(v) FILTER (abs(wn - 1640) <= 20), 0) + coalesce(sum(v) FILTER (abs(wn - 1080) <= 15), 0)", 'chained_sum')},
        {r("sum(v) FILTER (wn BETWEEN 1000 AND 1200)", 'range_sum')} FROM
        (SELECT *, abs(wn - 1655) <= 30 OR abs(wn - 1640) <= 20 OR abs(wn - 1080) <= 15 AS in_union FROM
        (SELECT sample_id, row, col, unnest(range(64)) AS k, unnest(spectrum) AS v FROM spectra) JOIN axis USING (k)) GROUP BY 1, 2, 3"""),
)
def b11(spark, sf_dir):
    cols = [
        F.aggregate(S.project_bands(F.col("spectrum"), idx), F.lit(0.0), lambda a, x: a + x).alias(f"{name}_sum")
        for name, idx in _IDX.items()
    ]
    return X.spectra(spark, sf_dir).select(*PIX, *cols).select(*PIX, *rounded("union_sum", "chained_sum", "range_sum"))


@query(
    "g1_pixel_labels",
    sql("spectra clusters", """SELECT side, sample_id, cluster, count(*) AS n FROM spectra JOIN clusters USING (sample_id, row, col)
        GROUP BY 1, 2, 3"""),
)
def g1(spark, sf_dir):
    labelled = S.label_pixels(X.spectra(spark, sf_dir), X.clusters(spark, sf_dir))
    return labelled.groupBy("side", "sample_id", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g2_sample_groups",
    sql("spectra samples", """SELECT animal_id, grp, CAST(batch AS INT) AS batch, count(*) AS n FROM spectra JOIN samples USING (sample_id)
        WHERE sample_id <> 'T9' GROUP BY 1, 2, 3"""),
)
def g2(spark, sf_dir):
    known = X.samples(spark).where(F.col("sample_id") != "T9")
    return S.attach_samples(X.spectra(spark, sf_dir), known).groupBy("animal_id", "grp", "batch").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "c5_axis_synthesis",
    sql("spectra", f"""SELECT sample_id, row, col, z, {r('CASE z WHEN 426 THEN 950.0 + 2 * k WHEN 421 THEN 960.0 + 2 * k ELSE k END', 'peak_wn')}
        FROM (SELECT sample_id, row, col, CAST(CASE (row + col) % 3 WHEN 0 THEN 64 WHEN 1 THEN 421 ELSE 426 END AS INT) AS z,
        list_position(spectrum, list_max(spectrum)) - 1 AS k FROM spectra)"""),
)
def c5(spark, sf_dir):
    """Peak wavenumber of spectra of three lengths, each on the axis its own length implies."""
    from spectraloom.catalog import axis_table

    lengths = F.when((F.col("row") + F.col("col")) % 3 == 0, 64).when((F.col("row") + F.col("col")) % 3 == 1, 421).otherwise(426)
    px = X.spectra(spark, sf_dir).withColumn("z", lengths)
    px = px.withColumn("spectrum", F.expr("transform(sequence(0, z - 1), k -> spectrum[k % 64])"))
    peaks = px.select(
        "sample_id", "row", "col", F.size("spectrum").alias("z"),
        (F.array_position("spectrum", F.array_max("spectrum")) - 1).cast("int").alias("k"),
    )
    axis = axis_table(spark, [64, 421, 426]).withColumnRenamed("wn", "peak_wn")
    return peaks.join(axis, ["z", "k"]).select("sample_id", "row", "col", "z", *rounded("peak_wn"))


assert Axis.linspace(AXIS_MIN, 1800.0, 64) == AXIS
