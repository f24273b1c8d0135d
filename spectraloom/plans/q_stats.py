"""Queries over similarity and statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog import STAR_CUTS, ratio_list
from spectraloom.operators import aggregate as G
from spectraloom.operators import bands as B
from spectraloom.operators import sampling as E
from spectraloom.operators import similarity as I
from spectraloom.operators import stats as J
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import r, rounded, sql
from spectraloom.plans.q_aggregate import HASH
from spectraloom.plans.q_bands import wide_bands
from spectraloom.plans.registry import query
from spectraloom.session import settle

#: Draws per sample pair, preference pairs and permutations, as in the workflow.
N_DRAWS, N_PREFERENCES, N_PERMUTATIONS = 20_000, 200_000, 5_000

UNIT = """SELECT sample_id, grp, row, col, list_transform(spectrum, lambda x: x / (sqrt(list_sum(list_transform(spectrum, lambda y: y * y))) + 1e-12)) AS u FROM selected"""
CLASS = "CASE WHEN a.grp = b.grp THEN a.grp || '-' || b.grp ELSE 'A-B' END"


def pairs(spark):
    return I.sample_pairs(X.samples(spark))


# ---- similarity ---------------------------------------------------------------
@query(
    "i1_pooled_cosines",
    sql("selected", f"""SELECT pair_class, {r('avg(cos)', 'mean_cos')}, count(*) AS n_cosines, count(DISTINCT a || b) AS n_pairs FROM
        (SELECT a.sample_id AS a, b.sample_id AS b, {CLASS} AS pair_class, list_dot_product(a.u, b.u) AS cos FROM unit a JOIN unit b ON a.sample_id < b.sample_id) GROUP BY 1""", unit=UNIT),
)
def i1(spark, sf_dir):
    out = I.pooled_means(X.selected_pixels(spark, sf_dir), pairs(spark))
    return out.select("pair_class", *rounded("mean_cos"), "n_cosines", "n_pairs")


@query(
    "i2_mean_spectrum_cosines",
    sql("long", f"""SELECT a, b, pair_class, {r('dp / sqrt(na * nb)', 'cos')} FROM (SELECT a.sample_id AS a, b.sample_id AS b, any_value({CLASS}) AS pair_class, sum(a.m * b.m) AS dp,
        sum(a.m * a.m) AS na, sum(b.m * b.m) AS nb FROM m a JOIN m b ON a.k = b.k AND a.sample_id < b.sample_id GROUP BY 1, 2)""",
        m="SELECT sample_id, grp, k, avg(v) AS m FROM long GROUP BY 1, 2, 3"),
)
def i2(spark, sf_dir):
    v = I.mean_vectors(X.selected_pixels(spark, sf_dir), ["sample_id"])
    return I.vector_cosines(v, pairs(spark)).select("a", "b", "pair_class", *rounded("cos"))


@query(
    "i3_mean_pixel_cosines",
    sql("selected", f"""SELECT a.sample_id AS a, b.sample_id AS b, {CLASS} AS pair_class, {r('avg(list_dot_product(a.u, b.u))', 'cos')}
        FROM unit a JOIN unit b ON a.sample_id < b.sample_id GROUP BY 1, 2, 3""", unit=UNIT),
)
def i3(spark, sf_dir):
    return I.mean_cosines(X.selected_pixels(spark, sf_dir), pairs(spark)).select("a", "b", "pair_class", *rounded("cos"))


_SAMPLED = {
    "unit": UNIT,
    "o": "SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY row, col) AS pos, count(*) OVER (PARTITION BY sample_id) AS n FROM unit",
    "sz": "SELECT sample_id, any_value(grp) AS grp, count(*) AS n FROM unit GROUP BY 1",
    "d": f"""SELECT a, b, pair_class, draw, {HASH.format(parts="'cosine-a', a, b, draw")} % na + 1 AS pa, {HASH.format(parts="'cosine-b', a, b, draw")} % nb + 1 AS pb
        FROM (SELECT a.sample_id AS a, b.sample_id AS b, {CLASS} AS pair_class, a.n AS na, b.n AS nb, unnest(range(1, least(PAIRS, a.n * b.n) + 1)) AS draw
        FROM sz a JOIN sz b ON a.sample_id < b.sample_id)""",
    "cs": "SELECT a, b, pair_class, draw, list_dot_product(x.u, y.u) AS cos FROM d JOIN o x ON x.sample_id = a AND x.pos = pa JOIN o y ON y.sample_id = b AND y.pos = pb",
}


def sampled(body: str, n: int, **extra: str) -> str:
    return sql("selected", body, **_SAMPLED, **extra).replace("PAIRS", str(n))


@query(
    "i1_cosine_distribution",
    sampled("SELECT pair_class, CAST(floor((cos + 1.0) / 2.0 * 50) AS INT) AS bin, count(*) AS n FROM cs GROUP BY 1, 2", N_DRAWS),
)
def i1b(spark, sf_dir):
    """The distribution of all cosines, estimated on I4's draws."""
    cos = I.sampled_cosines(X.selected_pixels(spark, sf_dir), pairs(spark), N_DRAWS)
    spot = F.floor((F.col("cos") + 1.0) / 2.0 * 50).cast("int")
    return cos.groupBy("pair_class", spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("i4_sampled_cosines", sampled(f"SELECT a, b, pair_class, CAST(draw AS INT) AS draw, {r('cos', 'cos')} FROM cs", N_DRAWS))
def i4(spark, sf_dir):
    out = I.sampled_cosines(X.selected_pixels(spark, sf_dir), pairs(spark), N_DRAWS)
    return out.select("a", "b", "pair_class", "draw", *rounded("cos"))


@query(
    "i5_pair_median_matrix",
    sampled(f"""SELECT a, b, {r('cos', 'cos')} FROM (SELECT a, b, cos FROM md UNION ALL SELECT b, a, cos FROM md UNION ALL SELECT sample_id, sample_id, 1.0 FROM samples)""",
            N_DRAWS, md="SELECT a, b, median(cos) AS cos FROM cs GROUP BY 1, 2"),
)
def i5(spark, sf_dir):
    cos = settle(I.sampled_cosines(X.selected_pixels(spark, sf_dir), pairs(spark), N_DRAWS), "cosines")
    return I.median_matrix(cos, X.samples(spark)).select("a", "b", *rounded("cos"))


_MARGIN = {
    "m": "SELECT sample_id, grp, k, REDUCER(v) AS m FROM long GROUP BY 1, 2, 3",
    "c": "SELECT grp, k, avg(m) AS c FROM m GROUP BY 1, 2",
    "cosines": """SELECT sample_id, m.grp, c.grp AS to_grp, greatest(-1, least(1, sum(m * c) / sqrt(sum(m * m) * sum(c * c)))) AS cos FROM m JOIN c USING (k) GROUP BY 1, 2, 3""",
    "mg": """SELECT sample_id, grp, max(cos) FILTER (to_grp = 'A') AS cos_a, max(cos) FILTER (to_grp = 'B') AS cos_b,
        1000 * acos(max(cos) FILTER (to_grp = 'A')) AS angle_a, 1000 * acos(max(cos) FILTER (to_grp = 'B')) AS angle_b FROM cosines GROUP BY 1, 2""",
}


def margin_sql(body: str, reducer: str) -> str:
    return sql("long", body, **_MARGIN).replace("REDUCER", reducer)


@query(
    "i6_centroid_margins",
    margin_sql(f"SELECT sample_id, grp, {r('cos_a', 'cos_a')}, {r('cos_b', 'cos_b')}, {r('angle_a', 'angle_a')}, {r('angle_b', 'angle_b')}, {r('angle_b - angle_a', 'margin')} FROM mg", "avg"),
)
def i6(spark, sf_dir):
    v = I.mean_vectors(X.selected_pixels(spark, sf_dir), ["sample_id"])
    return I.centroid_margins(v, X.samples(spark)).select(
        "sample_id", "grp", *rounded("cos_a", "cos_b", "angle_a", "angle_b", "margin")
    )


@query(
    "i7_group_split",
    margin_sql(f"SELECT sample_id, {r('angle_b - angle_a', 'margin')}, CASE WHEN angle_b - angle_a < 0 THEN 'B-like' ELSE 'A-like' END AS leaning FROM mg WHERE grp = 'B'", "median"),
)
def i7(spark, sf_dir):
    v = I.mean_vectors(X.selected_pixels(spark, sf_dir), ["sample_id"], "median")
    out = I.split_group(I.centroid_margins(v, X.samples(spark)))
    return out.select("sample_id", *rounded("margin"), "leaning")


@query("i8_log_distance", sampled(f"SELECT a, b, CAST(draw AS INT) AS draw, {r('log10(greatest(1 - cos, 2.5e-4))', 'y')} FROM cs", 40))
def i8(spark, sf_dir):
    cos = I.sampled_cosines(X.selected_pixels(spark, sf_dir), pairs(spark), 40)
    return cos.withColumn("y", I.log_distance(F.col("cos"), 2.5e-4)).select("a", "b", "draw", *rounded("y"))


# ---- tests on large value columns ---------------------------------------------
_RANKED = """SELECT file_ord, n_a, n_b, ra - n_a * (n_a + 1) / 2.0::DOUBLE AS u, ties FROM (SELECT file_ord, count(*) FILTER (grp = 'A') AS n_a, count(*) FILTER (grp = 'B') AS n_b,
    sum(rk) FILTER (grp = 'A') AS ra FROM (SELECT file_ord, grp, rank() OVER (PARTITION BY file_ord ORDER BY VALUE) + (count(*) OVER (PARTITION BY file_ord, VALUE) - 1) / 2.0::DOUBLE AS rk FROM flim) GROUP BY 1)
    JOIN (SELECT file_ord, sum(t * t * t - t)::DOUBLE AS ties FROM (SELECT file_ord, VALUE, count(*)::DOUBLE AS t FROM flim GROUP BY 1, 2) GROUP BY 1) USING (file_ord)"""


@query(
    "j1_rank_counts",
    sql("flim", f"SELECT file_ord, n_a, n_b, {r('u', 'u', 1)}, {r('ties', 'ties', 1)} FROM ranked", ranked=_RANKED.replace("VALUE", "a2")),
)
def j1(spark, sf_dir):
    out = J.rank_counts(X.flim(spark, sf_dir), ["file_ord"], F.col("a2"), F.col("grp") == "A")
    return out.select("file_ord", "n_a", "n_b", *rounded("u", "ties", digits=1))


@query(
    "j2_cliffs_delta",
    sql("flim", f"SELECT file_ord, n_a, n_b, {r('2 * u / (n_a * n_b) - 1', 'delta', 9)} FROM ranked", ranked=_RANKED.replace("VALUE", "a1")),
)
def j2(spark, sf_dir):
    out = J.cliffs_delta(X.flim(spark, sf_dir), ["file_ord"], F.col("a1"), F.col("grp") == "A")
    return out.select("file_ord", "n_a", "n_b", *rounded("delta", digits=9))


def _simpson(term: str, steps: int) -> str:
    """Simpson's sum of ``term`` over i = 0..steps, without the step width."""
    return f"list_sum(list_transform(range({steps + 1}), lambda i: ({term}) * CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) / 3"


# two-sided tails as integrals of the densities
_RANK_Z = """(greatest(u, n_a * n_b - u) - n_a * n_b / 2.0::DOUBLE - 0.5::DOUBLE) / sqrt(n_a * n_b / 12.0::DOUBLE
    * ((n_a + n_b + 1) - ties / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1))))"""
_NORMAL_P = "least(1, 2 / sqrt(pi()) * 0.01::DOUBLE * " + _simpson("exp(-(((z / sqrt(2)) + i * 0.01::DOUBLE) ** 2))", 1000) + ")"
_STUDENT_P = (
    "2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * (pi() / 2 - atan(abs(t) / sqrt(df))) / 4000 * "
    + _simpson("cos(atan(abs(t) / sqrt(df)) + i * (pi() / 2 - atan(abs(t) / sqrt(df))) / 4000) ** (df - 1)", 4000)
)
_STARS = "CASE " + " ".join(f"WHEN p < {cut} THEN '{mark}'" for cut, mark in STAR_CUTS) + " ELSE 'ns' END"


@query(
    "j3_mann_whitney",
    sql("flim", f"SELECT file_ord, n_a, n_b, {r('u', 'u', 1)}, {r(_NORMAL_P, 'p')} FROM (SELECT *, {_RANK_Z} AS z FROM ranked)", ranked=_RANKED.replace("VALUE", "a1")),
)
def j3(spark, sf_dir):
    out = J.mann_whitney(X.flim(spark, sf_dir), ["file_ord"], F.col("a1"), F.col("grp") == "A")
    return out.select("file_ord", "n_a", "n_b", *rounded("u", digits=1), *rounded("p"))


@query(
    "f6_two_group_stats",
    sql("flim", f"""SELECT file_ord, r.n_a, r.n_b, {r('2 * u / (r.n_a * r.n_b) - 1', 'delta')}, {r('mean_a', 'mean_a')}, {r('mean_b', 'mean_b')}, {r('sd_a', 'sd_a')}, {r('sd_b', 'sd_b')},
        {r('median_a', 'median_a')}, {r('median_b', 'median_b')} FROM ranked r JOIN (SELECT file_ord, avg(a1) FILTER (grp = 'A') AS mean_a, avg(a1) FILTER (grp = 'B') AS mean_b,
        stddev_samp(a1) FILTER (grp = 'A') AS sd_a, stddev_samp(a1) FILTER (grp = 'B') AS sd_b, median(a1) FILTER (grp = 'A') AS median_a, median(a1) FILTER (grp = 'B') AS median_b
        FROM flim GROUP BY 1) USING (file_ord)""", ranked=_RANKED.replace("VALUE", "a1")),
)
def f6(spark, sf_dir):
    out = J.two_group_stats(X.flim(spark, sf_dir), ["file_ord"], F.col("a1"), F.col("grp") == "A")
    return out.select(
        "file_ord", "n_a", "n_b", *rounded("delta", "mean_a", "mean_b", "sd_a", "sd_b", "median_a", "median_b")
    )


_WELCH = """SELECT file_ord, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS df
    FROM (SELECT file_ord, avg(a1) FILTER (grp = 'A') AS ma, avg(a1) FILTER (grp = 'B') AS mb, var_samp(a1) FILTER (grp = 'A') AS va, var_samp(a1) FILTER (grp = 'B') AS vb,
    count(*) FILTER (grp = 'A') AS na, count(*) FILTER (grp = 'B') AS nb FROM flim GROUP BY 1)"""


@query("j4_welch_t", sql("flim", f"SELECT file_ord, {r('t', 't')}, {r('df', 'df', 3)} FROM w", w=_WELCH))
def j4(spark, sf_dir):
    out = J.welch(X.flim(spark, sf_dir), ["file_ord"], F.col("a1"), F.col("grp") == "A")
    return out.select("file_ord", *rounded("t"), *rounded("df", digits=3))


@query(
    "j4_welch_stars",
    sql("flim", f"SELECT file_ord, {r('t', 't')}, {r('p', 'p')}, {_STARS} AS stars FROM (SELECT *, {_STUDENT_P} AS p FROM w)", w=_WELCH),
)
def j4b(spark, sf_dir):
    out = J.welch(X.flim(spark, sf_dir), ["file_ord"], F.col("a1"), F.col("grp") == "A")
    return out.select("file_ord", *rounded("t", "p"), "stars")


# bootstrap on a band's pixels: rank-based delta per replicate
def _boot(n: int) -> dict[str, str]:
    return {
        "px": "SELECT band, grp = 'A' AS is_a, value, row_number() OVER (PARTITION BY band, grp ORDER BY sample_id, row, col) AS pos, count(*) OVER (PARTITION BY band, grp) AS n FROM bandpx WHERE band IN ('amideI', 'ch2')",
        "asks": f"SELECT band, is_a, rep, {HASH.format(parts=chr(39) + 'boot' + chr(39) + ', band, is_a, rep, pos')} % n + 1 AS pos FROM px, (SELECT unnest(range(1, {n + 1})) AS rep)",
        "draws": "SELECT band, is_a, rep, value FROM asks JOIN px USING (band, is_a, pos)",
        "reps": """SELECT band, rep, 2 * (sum(rk) FILTER (is_a) - count(*) FILTER (is_a) * (count(*) FILTER (is_a) + 1) / 2.0::DOUBLE) / (count(*) FILTER (is_a) * count(*) FILTER (NOT is_a)) - 1 AS delta,
            median(value) FILTER (is_a) - median(value) FILTER (NOT is_a) AS gap FROM
            (SELECT band, rep, is_a, value, rank() OVER (PARTITION BY band, rep ORDER BY value) + (count(*) OVER (PARTITION BY band, rep, value) - 1) / 2.0::DOUBLE AS rk FROM draws) GROUP BY 1, 2""",
    }


def boot_draws(spark, sf_dir, n):
    long = B.bands_long(wide_bands(spark, sf_dir), ["sample_id", "grp", "row", "col"]).where(F.col("band").isin("amideI", "ch2"))
    return J.bootstrap_draws(long, ["band"], F.col("value"), F.col("grp") == "A", ["sample_id", "row", "col"], n)


@query(
    "j5_bootstrap_delta",
    sql("bandpx", f"SELECT band, count(*) AS n_rep, {r('quantile_cont(delta, 0.025)', 'lo')}, {r('quantile_cont(delta, 0.975)', 'hi')} FROM reps GROUP BY 1", **_boot(100)),
)
def j5(spark, sf_dir):
    out = J.bootstrap_interval(boot_draws(spark, sf_dir, 100), ["band"], J.delta_statistic)
    return out.select("band", "n_rep", *rounded("lo", "hi"))


@query(
    "j5_bootstrap_median_gap",
    sql("bandpx", f"SELECT band, count(*) AS n_rep, {r('quantile_cont(gap, 0.025)', 'lo')}, {r('quantile_cont(gap, 0.975)', 'hi')} FROM reps GROUP BY 1", **_boot(60)),
)
def j5b(spark, sf_dir):
    draws = settle(boot_draws(spark, sf_dir, 60), "draws")
    return J.bootstrap_interval(draws, ["band"], J.median_gap_statistic).select("band", "n_rep", *rounded("lo", "hi"))


@query(
    "j6_exact_preference",
    sql("flim", f"""SELECT file_ord, {r('(u - t / 2) / (n_a * n_b)', 'p_a', 9)}, {r('(n_a * n_b - u - t / 2) / (n_a * n_b)', 'p_b', 9)}, {r('t / (n_a * n_b)', 'p_tie', 9)} FROM ranked
        JOIN (SELECT file_ord, sum(x * y)::DOUBLE AS t FROM (SELECT file_ord, a2, count(*) FILTER (grp = 'A') AS x, count(*) FILTER (grp = 'B') AS y FROM flim GROUP BY 1, 2) GROUP BY 1) USING (file_ord)""",
        ranked=_RANKED.replace("VALUE", "a2")),
)
def j6(spark, sf_dir):
    out = J.preference_exact(X.flim(spark, sf_dir), ["file_ord"], F.col("a2"), F.col("grp") == "A")
    return out.select("file_ord", *rounded("p_a", "p_b", "p_tie", digits=9))


@query(
    "j6_sampled_preference",
    f"""WITH o AS (SELECT event_type, user_id % 2 AS g, value, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY event_id) - 1 AS pos FROM events),
    n AS (SELECT event_type, count(*) FILTER (g = 0) AS nl, count(*) FILTER (g = 1) AS nr FROM o GROUP BY 1),
    d AS (SELECT event_type, nl, nr, unnest(range(1, least({N_PREFERENCES}, nl * nr) + 1)) AS draw FROM n)
    SELECT d.event_type, round(avg((l.value > r.value)::INT), 9) + 0.0 AS p_a, round(avg((l.value < r.value)::INT), 9) + 0.0 AS p_b, round(avg((l.value = r.value)::INT), 9) + 0.0 AS p_tie FROM d
    JOIN o l ON l.event_type = d.event_type AND l.g = 0 AND l.pos = {HASH.format(parts="'pairs-l', d.event_type, draw")} % nl
    JOIN o r ON r.event_type = d.event_type AND r.g = 1 AND r.pos = {HASH.format(parts="'pairs-r', d.event_type, draw")} % nr GROUP BY 1""",
)
def j6b(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value")
    left, right = ev.where(F.col("user_id") % 2 == 0), ev.where(F.col("user_id") % 2 == 1)
    drawn = E.draw_pairs(left, right, ["event_type"], ["event_id"], ["value"], N_PREFERENCES)
    out = J.preference(drawn, ["event_type"], "value_l", "value_r")
    return out.select("event_type", *rounded("p_a", "p_b", "p_tie", digits=9))


_BIN = """CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END
    || ' (' || CASE WHEN delta > 0 THEN 'A>B' WHEN delta < 0 THEN 'A<B' ELSE 'A=B' END || ')'"""


@query(
    "j7_effect_bins",
    sql("ratiopx", f"""SELECT ratio, {r('delta', 'delta')}, {_BIN} AS effect FROM (SELECT ratio, 2 * (sum(rk) FILTER (grp = 'A') - count(*) FILTER (grp = 'A') * (count(*) FILTER (grp = 'A') + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (grp = 'A') * count(*) FILTER (grp = 'B')) - 1 AS delta FROM (SELECT *, rank() OVER (PARTITION BY ratio ORDER BY value) + (count(*) OVER (PARTITION BY ratio, value) - 1) / 2.0::DOUBLE AS rk FROM ratiopx) GROUP BY 1)"""),
)
def j7(spark, sf_dir):
    keep = ["sample_id", "grp"]
    ratios = B.sample_ratios(wide_bands(spark, sf_dir, keep), ratio_list(), keep)
    d = J.cliffs_delta(ratios, ["ratio"], F.col("value"), F.col("grp") == "A")
    return d.select("ratio", *rounded("delta"), J.effect_bin(F.col("delta")).alias("effect"))


def _max_t(n: int, stat: str) -> dict[str, str]:
    gap = "avg(m) FILTER (in_a) - avg(m) FILTER (NOT in_a)"
    if stat == "welch":
        gap = f"({gap}) / sqrt(var_samp(m) FILTER (in_a) / count(*) FILTER (in_a) + var_samp(m) FILTER (NOT in_a) / count(*) FILTER (NOT in_a))"
    return {
        "m": "SELECT sample_id, grp = 'A' AS grp_a, batch, k, avg(v) AS m FROM (SELECT sample_id, grp, batch, unnest(range(64)) AS k, unnest(spectrum) AS v FROM selected) GROUP BY 1, 2, 3, 4",
        "u": "SELECT DISTINCT sample_id, grp_a, batch FROM m",
        "dealt": f"""SELECT sample_id, rep, row_number() OVER (PARTITION BY rep, batch ORDER BY md5(concat_ws('|', 'perm', rep, sample_id)), sample_id) <= need AS in_a
            FROM u JOIN (SELECT batch, count(*) FILTER (grp_a) AS need FROM u GROUP BY 1) USING (batch), (SELECT unnest(range(1, {n + 1})) AS rep)""",
        "st": f"""SELECT rep, k, {gap} AS s FROM (SELECT 0 AS rep, k, m, grp_a AS in_a FROM m UNION ALL SELECT rep, k, m, in_a FROM dealt JOIN m USING (sample_id)) GROUP BY 1, 2""",
        "mx": "SELECT rep, max(abs(s)) AS t FROM st WHERE rep > 0 GROUP BY 1",
        "res": f"SELECT k, s AS obs, ((SELECT count(*) FROM mx WHERE t >= abs(s) * (1 - 1e-12::DOUBLE)) + 1) / {n + 1}.0::DOUBLE AS p FROM st WHERE rep = 0",
    }


def curves(spark, sf_dir):
    m = G.mean_spectrum(X.selected_pixels(spark, sf_dir), ["sample_id", "grp", "batch"])
    return m.select(
        F.col("sample_id").alias("unit"), (F.col("grp") == "A").alias("grp_a"), F.col("batch").alias("stratum"),
        F.col("k").alias("band"), F.col("mean").alias("value"),
    )


@query("j8_max_t_difference", sql("selected", f"SELECT CAST(k AS INT) AS band, {r('obs', 'obs')}, {r('p', 'p')} FROM res", **_max_t(N_PERMUTATIONS, "diff")))
def j8(spark, sf_dir):
    out = J.max_t(settle(curves(spark, sf_dir), "curves"), N_PERMUTATIONS)
    return out.select("band", *rounded("obs", "p"))


@query("j8_max_t_welch", sql("selected", f"SELECT CAST(k AS INT) AS band, {r('obs', 'obs')}, {r('p', 'p')} FROM res", **_max_t(N_PERMUTATIONS, "welch")))
def j8b(spark, sf_dir):
    out = J.max_t(settle(curves(spark, sf_dir), "curves"), N_PERMUTATIONS, "welch")
    return out.select("band", *rounded("obs", "p"))


@query("j9_significant_bands", sql("selected", "SELECT count(*) FILTER (p < 0.9) AS n_sig, count(*) AS n_bands FROM res", **_max_t(N_PERMUTATIONS, "diff")))
def j9(spark, sf_dir):
    return J.significance(J.max_t(settle(curves(spark, sf_dir), "curves"), N_PERMUTATIONS), [], alpha=0.9)


_CLASSES = [("A-A", "B-B"), ("A-A", "A-B"), ("B-B", "A-B")]
_THREE = {
    "bal": """SELECT pair_class, y, a, b, draw FROM (SELECT *, log10(greatest(1 - cos, 1e-6)) AS y, row_number() OVER (PARTITION BY pair_class ORDER BY md5(concat_ws('|', 'balance', a, b, draw)), a, b, draw) AS rn FROM cs)
        WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM cs GROUP BY pair_class))""",
    "cmp": " UNION ALL ".join(
        f"SELECT '{x} vs {y}' AS comparison, pair_class = '{x}' AS is_a, y FROM bal WHERE pair_class IN ('{x}', '{y}')" for x, y in _CLASSES
    ),
    "dl": """SELECT comparison, count(*) FILTER (is_a) AS n_a, count(*) FILTER (NOT is_a) AS n_b, 2 * (sum(rk) FILTER (is_a) - count(*) FILTER (is_a) * (count(*) FILTER (is_a) + 1) / 2.0::DOUBLE)
        / (count(*) FILTER (is_a) * count(*) FILTER (NOT is_a)) - 1 AS delta FROM (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY y) + (count(*) OVER (PARTITION BY comparison, y) - 1) / 2.0::DOUBLE AS rk FROM cmp) GROUP BY 1""",
}


def three(spark, sf_dir, n):
    cos = settle(I.sampled_cosines(X.selected_pixels(spark, sf_dir), pairs(spark), n), "cosines")
    kept = E.balance(cos, "pair_class", ["a", "b", "draw"], F.col("cos"))
    return J.three_way(kept, I.log_distance(F.col("cos")), _CLASSES, keep=["a", "b", "draw"])


@query(
    "j10_three_way_delta",
    sampled(f"SELECT comparison, n_a, n_b, {r('delta', 'delta', 4)}, {_BIN} AS effect FROM dl", 100, **_THREE),
)
def j10(spark, sf_dir):
    rows = settle(three(spark, sf_dir, 100), "comparisons")
    d = J.cliffs_delta(rows, ["comparison"], F.col("value"), F.col("is_a"))
    return d.select("comparison", "n_a", "n_b", *rounded("delta", digits=4), J.effect_bin(F.col("delta")).alias("effect"))


_INTERVAL = {
    "cmpx": " UNION ALL ".join(
        f"SELECT '{x} vs {y}' AS comparison, pair_class = '{x}' AS is_a, y AS value, a, b, draw FROM bal WHERE pair_class IN ('{x}', '{y}')" for x, y in _CLASSES
    ),
    "tested": """SELECT comparison, n_a, n_b, ra - n_a * (n_a + 1) / 2.0::DOUBLE AS u, ties FROM (SELECT comparison, count(*) FILTER (is_a) AS n_a, count(*) FILTER (NOT is_a) AS n_b,
        sum(rk) FILTER (is_a) AS ra FROM (SELECT *, rank() OVER (PARTITION BY comparison ORDER BY value) + (count(*) OVER (PARTITION BY comparison, value) - 1) / 2.0::DOUBLE AS rk FROM cmpx) GROUP BY 1)
        JOIN (SELECT comparison, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT comparison, value, count(*)::DOUBLE AS c FROM cmpx GROUP BY 1, 2) GROUP BY 1) USING (comparison)""",
    "px": "SELECT comparison, is_a, value, row_number() OVER (PARTITION BY comparison, is_a ORDER BY a, b, draw) AS pos, count(*) OVER (PARTITION BY comparison, is_a) AS n FROM cmpx",
    "asks": f"SELECT comparison, is_a, rep, {HASH.format(parts=chr(39) + 'boot' + chr(39) + ', comparison, is_a, rep, pos')} % n + 1 AS pos FROM px, (SELECT unnest(range(1, 51)) AS rep)",
    "draws": "SELECT comparison, is_a, rep, value FROM asks JOIN px USING (comparison, is_a, pos)",
    "reps": """SELECT comparison, rep, 2 * (sum(rk) FILTER (is_a) - count(*) FILTER (is_a) * (count(*) FILTER (is_a) + 1) / 2.0::DOUBLE) / (count(*) FILTER (is_a) * count(*) FILTER (NOT is_a)) - 1 AS delta FROM
        (SELECT *, rank() OVER (PARTITION BY comparison, rep ORDER BY value) + (count(*) OVER (PARTITION BY comparison, rep, value) - 1) / 2.0::DOUBLE AS rk FROM draws) GROUP BY 1, 2""",
}


@query(
    "j10_three_way_interval",
    sampled(f"""SELECT comparison, n_a, n_b, {r('2 * u / (n_a * n_b) - 1', 'delta', 4)}, {r(_NORMAL_P, 'p', 4)}, {r('lo', 'lo', 4)}, {r('hi', 'hi', 4)}, '' AS note
        FROM (SELECT *, {_RANK_Z} AS z FROM tested) JOIN (SELECT comparison, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM reps GROUP BY 1) USING (comparison)""",
        25, **_THREE, **_INTERVAL),
)
def j10b(spark, sf_dir):
    rows = settle(three(spark, sf_dir, 25), "comparisons")
    d = J.mann_whitney(rows, ["comparison"], F.col("value"), F.col("is_a"), exact=False)
    draws = J.bootstrap_draws(rows, ["comparison"], F.col("value"), F.col("is_a"), ["a", "b", "draw"], 50)
    ci = J.bootstrap_interval(draws, ["comparison"], J.delta_statistic)
    few = (F.col("n_a") < 2) | (F.col("n_b") < 2)  # such comparisons are skipped, with a note
    found = d.join(ci, "comparison").withColumn("delta", J.delta_of(F.col("u"), F.col("n_a"), F.col("n_b")))
    return found.select(
        "comparison", "n_a", "n_b",
        *[F.when(~few, F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("delta", "p", "lo", "hi")],
        F.when(few, "too few values").otherwise("").alias("note"),
    )


