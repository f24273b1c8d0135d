"""Queries over sampling, aggregation, joins and ordering (E, F, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog import inline_table
from spectraloom.functions.arrays import is_finite
from spectraloom.operators import aggregate as G
from spectraloom.operators import bands as B
from spectraloom.operators import patches as P
from spectraloom.operators import sampling as E
from spectraloom.operators import select as S
from spectraloom.operators import similarity as I
from spectraloom.operators import spectra as C
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, r, rounded, sql
from spectraloom.plans.q_bands import wide_bands
from spectraloom.plans.registry import query
from spectraloom.session import settle

PIX = ["sample_id", "row", "col"]
EV = ["event_type", "event_id"]


def events(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value")


# ---- sampling -----------------------------------------------------------------
@query(
    "e1_cap_per_sample",
    """SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type
    ORDER BY md5(concat_ws('|', 'cap', event_id)), event_id) AS rn FROM events) WHERE rn <= 500""",
)
def e1(spark, sf_dir):
    return E.cap_rows(events(spark, sf_dir), ["event_type"], ["event_id"], 500).select(*EV, "value")


@query(
    "e2_cap_per_metric",
    """SELECT event_type, event_id, metric FROM (SELECT *, row_number() OVER (PARTITION BY event_type, metric
    ORDER BY md5(concat_ws('|', 'metric', metric, event_id)), event_id) AS rn FROM (SELECT *, 'm' || (user_id % 3) AS metric FROM events))
    WHERE rn <= CASE metric WHEN 'm0' THEN 40 WHEN 'm1' THEN 90 ELSE 150 END""",
)
def e2(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("metric", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")))
    out = E.cap_by_metric(df, ["event_type"], ["event_id"], "metric", {"m0": 40, "m1": 90}, default=150)
    return out.select(*EV, "metric")


@query(
    "e3_balance_classes",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type
    ORDER BY md5(concat_ws('|', 'balance', event_id)), event_id) AS rn FROM events)
    WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type))""",
)
def e3(spark, sf_dir):
    return E.balance(events(spark, sf_dir), "event_type", ["event_id"], F.col("value")).select(*EV)


@query(
    "e4_fraction_with_minimum",
    """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY md5(concat_ws('|', 'frac', event_id)), event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    WHERE rn <= least(n, greatest(20, round_even(n * 0.3, 0)))""",
)
def e4(spark, sf_dir):
    return E.fraction_rows(events(spark, sf_dir), ["user_id"], ["event_id"], 0.3, 20).select("user_id", "event_id")


@query(
    "e5_two_stage_sample",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type
    ORDER BY md5(concat_ws('|', 'stage2', event_id)), event_id) AS r2, count(*) OVER (PARTITION BY event_type) AS n FROM
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', 'stage1', event_id)), event_id) AS r1
    FROM events) WHERE r1 <= 1500)) WHERE r2 <= greatest(1, floor(n * 0.2))""",
)
def e5(spark, sf_dir):
    return E.two_stage(events(spark, sf_dir), ["event_type"], ["event_id"], 1500, 0.2).select(*EV)


HASH = "('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT"


@query(
    "e6_pair_draws",
    f"""WITH o AS (SELECT event_type, event_id, user_id % 2 AS g, value, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY event_id) - 1 AS at FROM events),
    n AS (SELECT event_type, count(*) FILTER (g = 0) AS nl, count(*) FILTER (g = 1) AS nr FROM o GROUP BY 1),
    d AS (SELECT event_type, nl, nr, unnest(range(1, least(2000, nl * nr) + 1)) AS draw FROM n)
    SELECT d.event_type, CAST(draw AS INT) AS draw, l.event_id AS event_id_l, r.event_id AS event_id_r FROM d
    JOIN o l ON l.event_type = d.event_type AND l.g = 0 AND l.at = {HASH.format(parts="'pairs-l', d.event_type, draw")} % nl
    JOIN o r ON r.event_type = d.event_type AND r.g = 1 AND r.at = {HASH.format(parts="'pairs-r', d.event_type, draw")} % nr""",
)
def e6(spark, sf_dir):
    ev = events(spark, sf_dir)
    left, right = ev.where(F.col("user_id") % 2 == 0), ev.where(F.col("user_id") % 2 == 1)
    return E.draw_pairs(left, right, ["event_type"], ["event_id"], ["event_id"], 2000)


@query(
    "e7_first_rows",
    sql("spectra", f"""SELECT sample_id, CAST(k AS INT) AS k, {r('avg(v)', 'mean')}, count(*) AS n_pixels FROM (SELECT sample_id, unnest(range(64)) AS k, unnest(spectrum) AS v FROM
        (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY row, col) AS rn FROM spectra) WHERE rn <= 20) GROUP BY 1, 2"""),
)
def e7(spark, sf_dir):
    first = E.first_rows(X.spectra(spark, sf_dir), ["sample_id"], 20)
    return G.mean_spectrum(first, ["sample_id"]).select("sample_id", "k", *rounded("mean"), "n_pixels")


@query(
    "e8_fixed_bags",
    f"""WITH o AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS total,
      row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', 'bag', event_id)), event_id) AS pos FROM events),
    b AS (SELECT *, least(total, 60) AS n FROM o WHERE pos <= 60),
    s AS (SELECT DISTINCT user_id, n, unnest(range(1, 61)) AS slot FROM b)
    SELECT s.user_id, CAST(slot AS INT) AS slot, event_id FROM s JOIN b ON b.user_id = s.user_id
    AND b.pos = CASE WHEN s.n >= 60 THEN slot ELSE {HASH.format(parts="'bag-again', s.user_id, slot")} % s.n + 1 END""",
)
def e8(spark, sf_dir):
    return E.fixed_bags(events(spark, sf_dir), ["user_id"], ["event_id"], 60, ["event_id"])


# ---- aggregation --------------------------------------------------------------
@query(
    "f1_mean_spectrum",
    sql("long", f"SELECT sample_id, CAST(k AS INT) AS k, {r('avg(v)', 'mean')}, count(*) AS n_pixels FROM long GROUP BY 1, 2"),
)
def f1(spark, sf_dir):
    m = G.mean_spectrum(X.selected_pixels(spark, sf_dir), ["sample_id"])
    return m.select("sample_id", "k", *rounded("mean"), "n_pixels")


@query(
    "f2_median_spectrum",
    sql("long", f"SELECT sample_id, CAST(k AS INT) AS k, {r('median(v)', 'median')} FROM long GROUP BY 1, 2"),
)
def f2(spark, sf_dir):
    m = G.median_spectrum(X.selected_pixels(spark, sf_dir), ["sample_id"])
    return m.select("sample_id", "k", *rounded("median"))


_CURVES = "SELECT grp, sample_id, k, avg(v) AS m FROM long GROUP BY 1, 2, 3"


@query(
    "f3_group_curves",
    sql("long", f"""SELECT grp, CAST(k AS INT) AS k, count(*) AS n, {r('avg(m)', 'mean')}, {r('stddev_samp(m)', 'sd')}, {r('stddev_samp(m) / sqrt(count(*))', 'sem')}
        FROM c GROUP BY 1, 2""", c=_CURVES),
)
def f3(spark, sf_dir):
    curves = G.mean_spectrum(X.selected_pixels(spark, sf_dir), ["sample_id", "grp"])
    return G.curve_stats(curves, ["grp"], "mean").select("grp", "k", "n", *rounded("mean", "sd", "sem"))


@query(
    "f4_between_sample_variance",
    sql("long", f"SELECT grp, {r('avg(v)', 'mean_var', 9)}, count(*) AS n_bands FROM (SELECT grp, k, var_pop(m) AS v FROM c GROUP BY 1, 2) GROUP BY 1", c=_CURVES),
)
def f4(spark, sf_dir):
    curves = G.mean_spectrum(X.selected_pixels(spark, sf_dir), ["sample_id", "grp"])
    return G.between_sample_variance(curves).select("grp", *rounded("mean_var", digits=9), "n_bands")


@query(
    "f5_distribution_summary",
    sql("flim", f"""SELECT grp, sample_id, count(*) AS n, {r('median(a1)', 'med', 6)}, {r('quantile_cont(a1, 0.75) - quantile_cont(a1, 0.25)', 'iqr', 6)},
        {r('avg(a1)', 'mean', 6)}, {r('stddev_pop(a1)', 'std', 6)} FROM flim GROUP BY 1, 2"""),
)
def f5(spark, sf_dir):
    s = G.summarise(X.flim(spark, sf_dir), ["grp", "sample_id"], F.col("a1"))
    return s.select("grp", "sample_id", "n", *rounded("med", "iqr", "mean", "std"))


@query(
    "f7_animal_medians",
    sql("bandpx", f"""SELECT metric, animal_id, grp, {r('median(m)', 'value')}, count(*) AS n_samples FROM (SELECT band AS metric, sample_id, animal_id, grp, median(value) AS m
        FROM bandpx WHERE sample_id <> 'T2' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""),
)
def f7(spark, sf_dir):
    long = B.bands_long(wide_bands(spark, sf_dir, ["sample_id"]), ["sample_id"]).withColumnRenamed("band", "metric")
    known = X.samples(spark).where(F.col("sample_id") != "T2")
    return G.animal_medians(long, known).select("metric", "animal_id", "grp", *rounded("value"), "n_samples")


@query(
    "f8_lifetime_summary",
    sql("flim", f"""SELECT grp, sample_id, {r('avg(a1 / a2)', 'ratio_mean', 6)}, {r('avg(tm)', 'tm_mean')}, count(*) AS n_pixels,
        {r('median(a1 / a2)', 'ratio_median', 8)}, {r('median(tm)', 'tm_median')} FROM flim WHERE a2 <> 0 GROUP BY 1, 2"""),
)
def f8(spark, sf_dir):
    px = X.flim(spark, sf_dir).withColumn("ratio", B.lifetime_ratio(F.col("a1"), F.col("a2")))
    out = G.lifetime_summary(px, ["grp", "sample_id"])
    return out.select(
        "grp", "sample_id", *rounded("ratio_mean"), *rounded("tm_mean"), "n_pixels",
        *rounded("ratio_median", digits=8), *rounded("tm_median"),
    )


@query(
    "w4_lifetime_workflow",
    sql("flim", f"""SELECT grp, sample_id, {r('avg(a1 / a2)', 'ratio_mean', 6)}, {r('avg(tm)', 'tm_mean')}, count(*) AS n_pixels,
        {r('median(a1 / a2)', 'ratio_median', 8)}, {r('median(tm)', 'tm_median')} FROM flim JOIN q USING (grp, sample_id)
        WHERE a1 BETWEEN l1 AND h1 AND a2 BETWEEN l2 AND h2 AND tm BETWEEN l3 AND h3 AND a2 <> 0 GROUP BY 1, 2""",
        q="""SELECT grp, sample_id, quantile_cont(a1, 0.025) AS l1, quantile_cont(a1, 0.975) AS h1, quantile_cont(a2, 0.025) AS l2,
        quantile_cont(a2, 0.975) AS h2, quantile_cont(tm, 0.025) AS l3, quantile_cont(tm, 0.975) AS h3 FROM flim GROUP BY 1, 2"""),
)
def w4(spark, sf_dir):
    """Lifetime workflow: finite pixels, joint trim, ratio, summary per sample."""
    px = X.flim(spark, sf_dir).where(is_finite(F.col("a1")) & is_finite(F.col("a2")) & is_finite(F.col("tm")))
    kept = S.trim_joint(px, ["a1", "a2", "tm"], ["grp", "sample_id"])
    out = G.lifetime_summary(kept.withColumn("ratio", B.lifetime_ratio(F.col("a1"), F.col("a2"))), ["grp", "sample_id"])
    return out.select(
        "grp", "sample_id", *rounded("ratio_mean", "tm_mean"), "n_pixels", *rounded("ratio_median", digits=8), *rounded("tm_median")
    )


@query(
    "f8_file_ratio",
    sql("flim", f"SELECT grp, sample_id, file_ord, {r('avg(a1 / nullif(a2, 0))', 'ratio_mean', 3)}, count(*) AS n FROM flim GROUP BY 1, 2, 3"),
)
def f8b(spark, sf_dir):
    ratio = B.lifetime_ratio(F.col("a1"), F.col("a2"))
    return X.flim(spark, sf_dir).groupBy("grp", "sample_id", "file_ord").agg(
        F.avg(ratio).alias("ratio_mean"), F.count(F.lit(1)).alias("n")
    ).select("grp", "sample_id", "file_ord", *rounded("ratio_mean", digits=3), "n")


@query(
    "f9_prediction_rollup",
    sql("predictions", f"""SELECT fold, sample_id, {r('avg(prob)', 'prob')}, count(*) AS n, CAST(min(y) AS INT) AS y, CAST(avg(prob) >= 0.5 AS INT) AS pred
        FROM predictions GROUP BY 1, 2"""),
)
def f9(spark, sf_dir):
    out = G.roll_up_predictions(X.predictions(spark, sf_dir), ["fold", "sample_id"])
    return out.select("fold", "sample_id", *rounded("prob"), "n", "y", "pred")


@query(
    "f10_box_table",
    sql("flim", f"""SELECT grp, {r('q1', 'q1', 6)}, {r('med', 'median', 6)}, {r('q3', 'q3', 6)}, {r('min(a1) FILTER (a1 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_lo', 6)},
        {r('max(a1) FILTER (a1 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 'whisker_hi', 6)}, {r('avg(a1)', 'mean', 6)}, count(*) AS n
        FROM flim JOIN (SELECT grp, quantile_cont(a1, 0.25) AS q1, median(a1) AS med, quantile_cont(a1, 0.75) AS q3 FROM flim GROUP BY 1) USING (grp) GROUP BY grp, q1, med, q3"""),
)
def f10(spark, sf_dir):
    out = G.box_table(X.flim(spark, sf_dir), ["grp"], F.col("a1"))
    return out.select("grp", *rounded("q1", "median", "q3", "whisker_lo", "whisker_hi", "mean"), "n")


_LIM = """SELECT grp, greatest(q1 - 0.1 * (q99 - q1), 1e-6) AS lo, q99 + 0.1 * (q99 - q1) AS hi FROM
    (SELECT grp, quantile_cont(a1, 0.01) AS q1, quantile_cont(a1, 0.99) AS q99 FROM flim GROUP BY 1)"""


@query(
    "f10_limits_and_histogram",
    sql("flim", f"""SELECT grp, bin, n, {r('lo', 'lo', 6)}, {r('hi', 'hi', 6)} FROM (SELECT grp, lo, hi, CAST(least(floor((a1 - lo) / (hi - lo) * 40), 39) AS INT) AS bin, count(*) AS n
        FROM flim JOIN lim USING (grp) WHERE a1 BETWEEN lo AND hi GROUP BY 1, 2, 3, 4)""", lim=_LIM),
)
def f10b(spark, sf_dir):
    px = X.flim(spark, sf_dir)
    limits = settle(G.axis_limits(px, ["grp"], F.col("a1"), floor=1e-6), "limits")
    trimmed = G.trim_to_limits(px, ["grp"], F.col("a1"), limits)
    out = G.histogram(trimmed, ["grp"], F.col("a1"), limits, 40).join(limits, "grp")
    return out.select("grp", "bin", "n", *rounded("lo", "hi"))


@query(
    "f11_cluster_spectra",
    sql("long", f"SELECT sample_id, cluster, CAST(k AS INT) AS k, {r('avg(v)', 'mean')}, count(*) AS n_pixels FROM long GROUP BY 1, 2, 3"),
)
def f11(spark, sf_dir):
    m = G.mean_spectrum(X.selected_pixels(spark, sf_dir), ["sample_id", "cluster"])
    return m.select("sample_id", "cluster", "k", *rounded("mean"), "n_pixels")


@query(
    "f12_image_scaling",
    sql("raster", f"""SELECT sample_id, row, col, {r('coalesce((v - lo) / nullif(hi - lo, 0), 0)', 'scaled')} FROM (SELECT sample_id, row, col, CASE WHEN row % 10 = 0 AND col = 5 THEN NULL ELSE v END AS v,
        min(CASE WHEN row % 10 = 0 AND col = 5 THEN NULL ELSE v END) OVER (PARTITION BY sample_id) AS lo, max(CASE WHEN row % 10 = 0 AND col = 5 THEN NULL ELSE v END) OVER (PARTITION BY sample_id) AS hi FROM raster)"""),
)
def f12(spark, sf_dir):
    holes = F.when((F.col("row") % 10 == 0) & (F.col("col") == 5), F.lit(float("nan"))).otherwise(F.col("v"))
    out = G.scale_image(X.raster(spark, sf_dir).withColumn("v", holes), ["sample_id"], "v")
    return out.select(*PIX, *rounded("scaled"))


# ---- joins --------------------------------------------------------------------
@query(
    "g3_pixel_band_windows",
    sql("selected bandlib axis", f"""SELECT sample_id, row, col, band, category, CAST(count(*) AS BIGINT) AS points, {r('sum(v)', 'total')} FROM
        (SELECT sample_id, row, col, unnest(range(64)) AS k, unnest(spectrum) AS v FROM selected) JOIN axis USING (k)
        JOIN bandlib ON abs(wn - center) <= halfwidth GROUP BY 1, 2, 3, 4, 5"""),
)
def g3(spark, sf_dir):
    from spectraloom.catalog import BAND_LIBRARY

    entries = []
    for name, c, hw, kind in BAND_LIBRARY:
        window = S.project_bands(F.col("spectrum"), AXIS.window(c, hw))
        entries.append(
            F.struct(
                F.lit(name).alias("band"), F.lit(kind).alias("category"),
                F.size(window).cast("bigint").alias("points"),
                F.aggregate(window, F.lit(0.0), lambda a, x: a + x).alias("total"),
            )
        )
    out = X.selected_pixels(spark, sf_dir).select(*PIX, F.inline(F.array(*entries)))
    return out.select(*PIX, "band", "category", "points", *rounded("total"))


@query(
    "g4_raster_zip",
    """WITH e AS (SELECT event_type AS sample_id, event_id // 1000 AS file_ord, event_id % 1000 AS pix, value AS a1, user_id::DOUBLE AS a2,
      (json_extract(props, '$.k'))::DOUBLE AS tm FROM events),
    a AS (SELECT sample_id, file_ord, pix, a1 FROM e), b AS (SELECT sample_id, file_ord, pix, a2 FROM e WHERE NOT (file_ord = 2 AND pix % 2 = 0)),
    c AS (SELECT sample_id, file_ord, pix, tm FROM e WHERE file_ord < 8),
    ok AS (SELECT sample_id, file_ord FROM (SELECT sample_id, file_ord, count(*) AS n FROM a GROUP BY 1, 2) x
      JOIN (SELECT sample_id, file_ord, count(*) AS n FROM b GROUP BY 1, 2) y USING (sample_id, file_ord, n)
      JOIN (SELECT sample_id, file_ord, count(*) AS n FROM c GROUP BY 1, 2) z USING (sample_id, file_ord, n))
    SELECT sample_id, CAST(file_ord AS INT) AS file_ord, count(*) AS n, round(sum(a1 * a2), 3) + 0.0 AS a12, round(sum(tm), 3) + 0.0 AS tm
    FROM a JOIN b USING (sample_id, file_ord, pix) JOIN c USING (sample_id, file_ord, pix) JOIN ok USING (sample_id, file_ord) GROUP BY 1, 2""",
)
def g4(spark, sf_dir):
    from spectraloom.sources.rasters import zip_rasters

    e = F.col("event_id")
    base = X.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sample_id"), F.floor(e / 1000).cast("int").alias("file_ord"),
        (e % 1000).cast("int").alias("pix"), F.col("value").alias("a1"), F.col("user_id").cast("double").alias("a2"),
        F.get_json_object("props", "$.k").cast("double").alias("tm"),
    )
    channels = {
        "a1": base.select("sample_id", "file_ord", "pix", F.col("a1").alias("v")),
        "a2": base.where(~((F.col("file_ord") == 2) & (F.col("pix") % 2 == 0))).select(
            "sample_id", "file_ord", "pix", F.col("a2").alias("v")
        ),
        "tm": base.where("file_ord < 8").select("sample_id", "file_ord", "pix", F.col("tm").alias("v")),
    }
    z = zip_rasters(channels, ["sample_id"])
    return z.groupBy("sample_id", "file_ord").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("a1") * F.col("a2")).alias("a12"), F.sum("tm").alias("tm")
    ).select("sample_id", "file_ord", "n", *rounded("a12", "tm", digits=3))


@query(
    "g5_sample_pairs",
    sql("selected", """SELECT a.sample_id AS a, b.sample_id AS b, CASE WHEN a.grp = b.grp THEN a.grp || '-' || b.grp ELSE 'A-B' END AS pair_class, a.n * b.n AS n_cosines
        FROM s a JOIN s b ON a.sample_id < b.sample_id""", s="SELECT sample_id, grp, count(*) AS n FROM selected GROUP BY 1, 2"),
)
def g5(spark, sf_dir):
    sizes = settle(X.selected_pixels(spark, sf_dir).groupBy("sample_id", "grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    pairs = I.sample_pairs(sizes)
    n = lambda s: sizes.select(F.col("sample_id").alias(s), F.col("n").alias(f"n_{s}"))
    return pairs.join(n("a"), "a").join(n("b"), "b").select(
        "a", "b", "pair_class", (F.col("n_a") * F.col("n_b")).alias("n_cosines")
    )


BOXES = [(f"b{i}", 7 * i % 83, 7 * i % 83 + 5 + i % 13, 11 * i % 79, 11 * i % 79 + 4 + i % 17) for i in range(30)]


@query(
    "g6_patch_boxes",
    sql("raster", f"""SELECT sample_id, box, count(*) AS n, {r('sum(v)', 'total', 3)} FROM raster
        JOIN (VALUES {', '.join(str(b) for b in BOXES)}) b(box, r0, r1, c0, c1) ON row >= r0 AND row < r1 AND col >= c0 AND col < c1 GROUP BY 1, 2"""),
)
def g6(spark, sf_dir):
    boxes = inline_table(spark, BOXES, "box string, r0 int, r1 int, c0 int, c1 int")
    return P.join_boxes(X.raster(spark, sf_dir), boxes, [], 20).groupBy("sample_id", "box").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")
    ).select("sample_id", "box", "n", *rounded("total", digits=3))


@query(
    "g7_split_membership",
    """SELECT unit_id, 'train' AS role FROM (SELECT doc_id AS unit_id FROM documents WHERE doc_id % 5 <> 0)
    UNION ALL (SELECT doc_id, 'common' FROM documents INTERSECT SELECT doc_id, 'common' FROM labels)""",
)
def g7(spark, sf_dir):
    from spectraloom.operators.classify import common_units, remaining_units

    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"))
    labels = X.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("unit_id"))
    train = remaining_units(docs, docs.where(F.col("unit_id") % 5 == 0))
    return train.withColumn("role", F.lit("train")).unionByName(
        common_units(docs, labels).withColumn("role", F.lit("common"))
    )


# ---- ordering -----------------------------------------------------------------
@query(
    "h1_top_patches",
    sql("raster", """SELECT sample_id, r0, c0, n_pixels, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n_pixels DESC, r0, c0) AS rank
        FROM (SELECT sample_id, CAST(row // 10 * 10 AS INT) AS r0, CAST(col // 10 * 10 AS INT) AS c0, count(*) AS n_pixels FROM raster GROUP BY 1, 2, 3)) WHERE rank <= 12"""),
)
def h1(spark, sf_dir):
    counts = P.tile_of(X.raster(spark, sf_dir), 10, 10).groupBy("sample_id", "r0", "c0").agg(
        F.count(F.lit(1)).alias("n_pixels")
    )
    return G.top_patches(counts, ["sample_id"], 12).select("sample_id", "r0", "c0", "n_pixels", "rank")


@query(
    "h1_random_patches",
    sql("raster", """SELECT sample_id, r0, c0, n_pixels FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5(concat_ws('|', 'pick', sample_id, r0, c0)), r0, c0) AS rank
        FROM (SELECT sample_id, CAST(row // 10 * 10 AS INT) AS r0, CAST(col // 10 * 10 AS INT) AS c0, count(*) AS n_pixels FROM raster GROUP BY 1, 2, 3)) WHERE rank <= 12"""),
)
def h1b(spark, sf_dir):
    counts = P.tile_of(X.raster(spark, sf_dir), 10, 10).groupBy("sample_id", "r0", "c0").agg(
        F.count(F.lit(1)).alias("n_pixels")
    )
    return G.top_patches(counts, ["sample_id"], 12, random_salt="pick").select("sample_id", "r0", "c0", "n_pixels")


_P = "SELECT cluster, k, round(abs(avg(v) FILTER (grp = 'A') - avg(v) FILTER (grp = 'B')), 9) AS p FROM long GROUP BY 1, 2"


@query(
    "h2_spaced_top_bands",
    sql("long", """SELECT cluster, CAST(rank AS INT) AS rank, CAST(k AS INT) AS k FROM (SELECT cluster, unnest(range(1, len(picks) + 1)) AS rank, unnest(picks) AS k FROM walk
        WHERE step = 64)""",
        p=_P, o="SELECT cluster, k, row_number() OVER (PARTITION BY cluster ORDER BY p, k) AS at FROM p",
        walk="""SELECT cluster, 0 AS step, [k] AS picks FROM o WHERE at < 0""").replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "walk AS (SELECT cluster, 0 AS step, [k] AS picks FROM o WHERE at < 0)",
        """walk AS (SELECT DISTINCT cluster, 0::BIGINT AS step, []::BIGINT[] AS picks FROM o UNION ALL
        SELECT w.cluster, o.at, CASE WHEN len(picks) >= 8 OR len(list_filter(picks, lambda j: abs(j - o.k) < 4)) > 0 THEN picks ELSE list_append(picks, o.k) END
        FROM walk w JOIN o ON o.cluster = w.cluster AND o.at = w.step + 1)"""),
)
def h2(spark, sf_dir):
    long = C.band_long(X.selected_pixels(spark, sf_dir), ["cluster", "grp"])
    mean = lambda g: F.avg(F.when(F.col("grp") == g, F.col("v")))
    tested = long.groupBy("cluster", "k").agg(F.round(F.abs(mean("A") - mean("B")), 9).alias("p"))
    return G.spaced_top_bands(tested, ["cluster"], 8, min_sep=4)


@query(
    "h4_matrix_order",
    sql("long", """SELECT a AS sample_id, grp, CAST(row_number() OVER (ORDER BY grp, round(mc, 9) DESC, a) AS INT) AS position FROM (SELECT a, avg(cos) AS mc FROM twice GROUP BY 1)
        JOIN samples ON sample_id = a""",
        m="SELECT sample_id, k, avg(v) AS m FROM long GROUP BY 1, 2",
        c="SELECT x.sample_id AS a, y.sample_id AS b, sum(x.m * y.m) / sqrt(sum(x.m * x.m) * sum(y.m * y.m)) AS cos FROM m x JOIN m y ON x.k = y.k AND x.sample_id < y.sample_id GROUP BY 1, 2",
        twice="SELECT a, b, greatest(-1, least(1, cos)) AS cos FROM c UNION ALL SELECT b, a, greatest(-1, least(1, cos)) FROM c"),
)
def h4(spark, sf_dir):
    px = X.selected_pixels(spark, sf_dir)
    cos = I.vector_cosines(I.mean_vectors(px, ["sample_id"]), I.sample_pairs(X.samples(spark)))
    out = G.order_matrix(settle(cos, "matrix"), X.samples(spark), ["A", "B"], min_share=0.5)
    return out.select("sample_id", "grp", "position")


@query(
    "h5_union_of_sides",
    sql("spectra", """SELECT side, sample_id, row, col, md5(concat_ws('|', 'shuffle', side, sample_id, row, col)) AS shuffle_key FROM spectra"""),
)
def h5(spark, sf_dir):
    px = X.spectra(spark, sf_dir).select("side", *PIX)
    right, left = px.where(F.col("side") == "RIGHT"), px.where(F.col("side") == "LEFT")
    return G.union_sides(right, left, ["side", *PIX])
