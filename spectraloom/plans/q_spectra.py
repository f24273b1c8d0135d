"""Queries over whole-spectrum transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spectraloom.functions import kernels
from spectraloom.operators import aggregate as G
from spectraloom.operators import spectra as C
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, N_BANDS, r, rounded, sql
from spectraloom.plans.q_select import _BGQ, HOLED, backgrounds, holed
from spectraloom.plans.registry import query

PIX = ["sample_id", "row", "col"]
S = "spectrum"


def probes(df, extra=()):
    """A few facts per spectrum that together pin every band: both ends, and a weighted sum."""
    weighted = F.aggregate(
        F.transform("spectrum", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return df.select(
        *PIX, F.size("spectrum").cast("bigint").alias("bands"), F.get("spectrum", F.lit(0)).alias("first"),
        F.element_at("spectrum", -1).alias("last"), weighted.alias("weighted"), *extra
    ).select(*PIX, "bands", *rounded("first", "last", "weighted"), *extra)


def probed(expr: str, source: str, extra: str = "") -> str:
    return f"""SELECT sample_id, row, col, len(s) AS bands, {r('s[1]', 'first')}, {r('s[-1]', 'last')},
        {r('list_sum(list_transform(range(len(s)), lambda k: s[k + 1] * (k + 1)))', 'weighted')} {extra}
        FROM (SELECT *, {expr} AS s FROM {source})"""


def uneven(df):
    """Spectra of unequal length: one pixel in three is longer, one is shorter."""
    n = F.pmod(F.col("row") * 25 + F.col("col"), F.lit(3))
    return df.withColumn(
        "spectrum", F.when(n == 0, F.concat(S, F.slice(S, 1, 9))).when(n == 1, F.slice(S, 1, 59)).otherwise(F.col(S))
    )


UNEVEN = """SELECT sample_id, side, row, col, CASE (row * 25 + col) % 3 WHEN 0 THEN list_concat(spectrum, list_slice(spectrum, 1, 9))
    WHEN 1 THEN list_slice(spectrum, 1, 59) ELSE spectrum END AS spectrum FROM spectra"""


@query(
    "c1_band_alignment",
    sql("spectra", probed("""CASE WHEN len(spectrum) < 64 THEN list_concat(list_transform(range(64 - len(spectrum)), lambda i: spectrum[1]), spectrum)
        WHEN len(spectrum) > 64 THEN list_slice(spectrum, len(spectrum) - 63, len(spectrum)) ELSE spectrum END""", "uneven"), uneven=UNEVEN),
)
def c1(spark, sf_dir):
    df = uneven(X.spectra(spark, sf_dir))
    return probes(df.withColumn("spectrum", C.align_bands(F.col(S), N_BANDS)))


@query(
    "c2_background_alignment",
    sql("spectra", probed("""list_transform(range(z), lambda i: CASE WHEN n = 426 AND z = 421 THEN spectrum[(i + 5) % 64 + 1]
        WHEN i < n THEN spectrum[i % 64 + 1] ELSE spectrum[(n - 1) % 64 + 1] END)""",
        "(SELECT *, CASE (row * 25 + col) % 3 WHEN 0 THEN 426 WHEN 1 THEN 400 ELSE 421 END AS n, 421 AS z FROM spectra)")),
)
def c2(spark, sf_dir):
    m = F.pmod(F.col("row") * 25 + F.col("col"), F.lit(3))
    size = F.when(m == 0, 426).when(m == 1, 400).otherwise(421)
    long = F.slice(F.flatten(F.array_repeat("spectrum", 7)), F.lit(1), size)
    df = X.spectra(spark, sf_dir).withColumn("spectrum", C.align_background(long, F.lit(421)))
    return probes(df)


@query(
    "c3_background_subtraction",
    sql("spectra", probed("""CASE WHEN bg IS NULL THEN spectrum ELSE list_transform(range(len(spectrum)),
        lambda i: spectrum[i + 1] - bg[least(i + 1, len(bg))]) END""",
        """(SELECT u.*, b.spectrum AS bg FROM uneven u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY priority) AS rn
        FROM bgs WHERE sample_id <> 'T5') WHERE rn = 1) b USING (sample_id))"""), uneven=UNEVEN, bgs=_BGQ),
)
def c3(spark, sf_dir):
    bg = backgrounds(spark, sf_dir).where(F.col("sample_id") != "T5")
    return probes(C.subtract_background(uneven(X.spectra(spark, sf_dir)), bg))


@query(
    "c4_resampling",
    sql("spectra", probed("""list_transform(range(64), lambda k: spectrum[floor(least(k * (len(spectrum) - 1) / 63.0::DOUBLE, len(spectrum) - 1))::INT + 1]
        + (spectrum[least(floor(least(k * (len(spectrum) - 1) / 63.0::DOUBLE, len(spectrum) - 1))::INT + 2, len(spectrum))]
        - spectrum[floor(least(k * (len(spectrum) - 1) / 63.0::DOUBLE, len(spectrum) - 1))::INT + 1])
        * (least(k * (len(spectrum) - 1) / 63.0::DOUBLE, len(spectrum) - 1) - floor(least(k * (len(spectrum) - 1) / 63.0::DOUBLE, len(spectrum) - 1))))""",
        "uneven"), uneven=UNEVEN),
)
def c4(spark, sf_dir):
    return probes(uneven(X.spectra(spark, sf_dir)).withColumn("spectrum", C.resample(F.col(S), N_BANDS)))


@query(
    "c6_min_floor_shift",
    sql("spectra", probed("list_transform(spectrum, lambda x: x + greatest(0.0, 0.2 - list_min(spectrum)))", "spectra")),
)
def c6(spark, sf_dir):
    return probes(C.shift_floor(X.spectra(spark, sf_dir), 0.2))


@query(
    "c7_vector_normalisation",
    sql("spectra", " UNION ALL ".join(
        f"({probed(f'list_transform(spectrum, lambda x: x / ({d}))', 'spectra', f', {chr(39)}{m}{chr(39)} AS mode')})"
        for m, d in (
            ("l2", "sqrt(list_sum(list_transform(spectrum, lambda y: y * y))) + 1e-12"),
            ("l1", "list_sum(list_transform(spectrum, lambda y: abs(y))) + 1e-12"),
            ("max", "list_max(list_transform(spectrum, lambda y: abs(y)))"),
            ("reference", "greatest(spectrum[53], 1e-2)"),
        )
    )),
)
def c7(spark, sf_dir):
    out = None
    for mode in ("l2", "l1", "max", "reference"):
        eps = 1e-2 if mode == "reference" else 1e-12
        part = C.normalise(X.spectra(spark, sf_dir), mode, reference=52, eps=eps)
        part = probes(part, [F.lit(mode).alias("mode")])
        out = part if out is None else out.unionByName(part)
    return out


def _trapezoid(center: float, hw: float) -> str:
    idx = AXIS.window(center, hw)
    return f"list_sum(list_transform(range({idx[0]}, {idx[-1]}), lambda i: (spectrum[i + 1] + spectrum[i + 2]) / 2 * (840.0::DOUBLE / 63)))"


@query(
    "c8_area_normalisation",
    sql("spectra", f"""({probed('list_transform(spectrum, lambda x: x / (CASE WHEN a1 > 1e-12 THEN a1 ELSE 1.0 END + 1e-12))',
        f"(SELECT *, {_trapezoid(1655.0, 30.0)} AS a1 FROM spectra)", ", 'amide1' AS mode")})
        UNION ALL ({probed('list_transform(spectrum, lambda x: x / (greatest(a1, 1e-12) + greatest(a2, 1e-12) + 1e-12))',
        f"(SELECT * REPLACE (list_transform(spectrum, lambda x: x + 1) AS spectrum), {_trapezoid(1655.0, 30.0)} + {len(AXIS.window(1655.0, 30.0)) - 1} * (840.0::DOUBLE / 63) AS a1, {_trapezoid(1545.0, 30.0)} + {len(AXIS.window(1545.0, 30.0)) - 1} * (840.0::DOUBLE / 63) AS a2 FROM spectra)", ", 'both' AS mode")})"""),
)
def c8(spark, sf_dir):
    base = X.spectra(spark, sf_dir)
    one = C.normalise_area(base, AXIS, [(1655.0, 30.0)])
    lifted = base.withColumn("spectrum", F.transform("spectrum", lambda x: x + 1))
    two = C.normalise_area(lifted, AXIS, [(1655.0, 30.0), (1545.0, 30.0)], clip=True)
    return probes(one, [F.lit("amide1").alias("mode")]).unionByName(probes(two, [F.lit("both").alias("mode")]))


def _basis_rows(degree: int) -> str:
    x = np.array(AXIS.wn)
    q, _ = np.linalg.qr(np.vander((x - x.mean()) / x.std(), degree + 1, increasing=True))
    return ", ".join(f"({j}, {k}, {float(q[k, j])!r}::DOUBLE)" for j in range(degree + 1) for k in range(N_BANDS))


def _pivot_probe(source: str, extra: str = "") -> str:
    """Probe columns from long rows (sample_id, row, col, k, v)."""
    return f"""SELECT sample_id, row, col, count(*) AS bands, {r('max(v) FILTER (k = 0)', 'first')}, {r('max(v) FILTER (k = 63)', 'last')},
        {r('sum(v * (k + 1))', 'weighted')} {extra} FROM {source} GROUP BY sample_id, row, col"""


_LONG = "SELECT sample_id, row, col, unnest(range(64)) AS k, unnest(spectrum) AS v FROM spectra"


@query(
    "c9_polynomial_detrend",
    sql("spectra", _pivot_probe("""(SELECT l.sample_id, l.row, l.col, l.k, any_value(l.v) - sum(c * b) AS v FROM l JOIN
        (SELECT sample_id, row, col, j, sum(v * b) AS c FROM l JOIN basis USING (k) GROUP BY 1, 2, 3, 4) f USING (sample_id, row, col)
        JOIN basis ON basis.j = f.j AND basis.k = l.k GROUP BY 1, 2, 3, 4)"""),
        l=_LONG, basis=f"SELECT * FROM (VALUES {_basis_rows(2)}) b(j, k, b)"),
)
def c9(spark, sf_dir):
    return probes(C.detrend(X.spectra(spark, sf_dir), AXIS, 2))


@query("c10_asymmetric_baseline")
def c10(spark, sf_dir):
    return probes(C.als_correct(X.spectra(spark, sf_dir)))


@query("c11_emsc")
def c11(spark, sf_dir):
    base = X.spectra(spark, sf_dir)
    curve = G.mean_spectrum(base, []).orderBy("k").collect()  # one number per band
    return probes(C.emsc(base, [x.mean for x in curve], degree=4, iterations=5))


def _matrix_rows(m) -> str:
    return ", ".join(f"({i}, {j}, {float(m[i, j])!r}::DOUBLE)" for i in range(len(m)) for j in range(len(m)) if m[i, j] != 0)


def _matrix_oracle(m, source: str = "l") -> str:
    return _pivot_probe(f"""(SELECT sample_id, row, col, i AS k, sum(v * w) AS v FROM {source}
        JOIN (VALUES {_matrix_rows(m)}) m(i, j, w) ON k = j GROUP BY 1, 2, 3, 4)""")


_SG_SQUARES = float(sum((j * j - 56.0 / 3) ** 2 for j in range(-7, 8)))


# coefficients in closed form (quadratic second derivative over 2h+1 points), constant within the end windows
@query(
    "c12_savgol_derivative",
    sql("spectra", f"""SELECT sample_id, row, col, CAST(k AS INT) AS k, {r(f'''list_sum(list_transform(range(-7, 8),
        lambda j: s[c + j + 1] * (j * j - 56.0::DOUBLE / 3) * 2 / {_SG_SQUARES!r}::DOUBLE))''', 'd2')}
        FROM (SELECT *, greatest(7, least(56, k)) AS c FROM (SELECT sample_id, row, col, unnest(range(64)) AS k, spectrum AS s FROM spectra))"""),
)
def c12(spark, sf_dir):
    d = C.savgol(X.spectra(spark, sf_dir), N_BANDS, 15, 2, 2)
    long = d.select(*PIX, F.posexplode("spectrum").alias("k", "d2"))
    return long.select(*PIX, "k", *rounded("d2"))


@query("c12_savgol_smoothing", sql("spectra", _matrix_oracle(kernels.savgol_matrix(N_BANDS, 11, 3, 0)), l=_LONG))
def c12b(spark, sf_dir):
    return probes(C.savgol(X.spectra(spark, sf_dir), N_BANDS, 11, 3, 0))


_GRAD = "CASE WHEN k = 0 THEN ({n} - {v}) / h WHEN k = 63 THEN ({v} - {p}) / h ELSE ({n} - {p}) / (2 * h) END"


def _grad_cte(src: str, cols: dict[str, str]) -> str:
    lead = ", ".join(
        _GRAD.format(n=f"lead({c}) OVER w", p=f"lag({c}) OVER w", v=c) + f" AS {out}" for c, out in cols.items()
    )
    return f"SELECT *, {lead} FROM {src} WINDOW w AS (PARTITION BY grp ORDER BY k)"


@query(
    "c13_curve_derivatives",
    sql("selected", f"""SELECT grp, CAST(k AS INT) AS k, {r('d1', 'd1', 9)}, {r('d1_err', 'd1_err', 9)}, {r('d2', 'd2', 9)}, {r('d2_err', 'd2_err', 9)} FROM g2""",
        stats="""SELECT grp, k, avg(m) AS mean, stddev_samp(m) AS sd, 840.0::DOUBLE / 63 AS h FROM (SELECT grp, sample_id, k, avg(v) AS m FROM
        (SELECT grp, sample_id, unnest(range(64)) AS k, unnest(spectrum) AS v FROM selected) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        g1=_grad_cte("stats", {"mean": "d1", "sd": "d1_err"}), g2=_grad_cte("g1", {"d1": "d2", "d1_err": "d2_err"})),
)
def c13(spark, sf_dir):
    means = G.mean_spectrum(X.selected_pixels(spark, sf_dir), ["sample_id", "grp"])
    stats = G.curve_stats(means, ["grp"], "mean")
    d = C.curve_derivatives(C.curve_table(stats, ["grp"], ["mean", "sd"]), AXIS)
    zipped = F.arrays_zip("d1", "d1_err", "d2", "d2_err")
    out = d.select("grp", F.posexplode(zipped).alias("k", "e")).select("grp", "k", "e.*")
    return out.select("grp", "k", *rounded("d1", "d1_err", "d2", "d2_err", digits=9))


@query(
    "c14_smoothed_second_derivative",
    sql("spectra", f"""SELECT sample_id, row, col, CAST(k AS INT) AS k, {r('-d2', 'd2', 9)} FROM g2""",
        l="SELECT sample_id || '/' || row || '/' || col AS grp, sample_id, row, col, unnest(range(64)) AS k, spectrum AS s FROM spectra",
        sm="""SELECT grp, sample_id, row, col, k, 840.0::DOUBLE / 63 AS h, list_sum(list_transform(range(k - 3, k + 4), lambda i: s[(CASE WHEN i < 0 THEN -i WHEN i > 63 THEN 126 - i ELSE i END)::INT + 1])) / 7 AS v FROM l""",
        g1=_grad_cte("sm", {"v": "d1"}), g2=_grad_cte("g1", {"d1": "d2"})),
)
def c14(spark, sf_dir):
    d = C.smooth_second_derivative(X.spectra(spark, sf_dir), AXIS, 7)
    return d.select(*PIX, F.posexplode("spectrum").alias("k", "d2")).select(*PIX, "k", *rounded("d2", digits=9))


@query(
    "c15_sign_orientation",
    sql("spectra", _pivot_probe("(SELECT l.sample_id, l.row, l.col, k, CASE WHEN d < 0 THEN -v ELSE v END AS v FROM l JOIN dots USING (sample_id, row, col))"),
        l=_LONG, ref="SELECT k, median(v) AS m FROM l GROUP BY 1",
        dots="SELECT sample_id, row, col, sum(v * m) AS d FROM l JOIN ref USING (k) GROUP BY 1, 2, 3"),
)
def c15(spark, sf_dir):
    base = X.spectra(spark, sf_dir)
    return probes(C.orient(base, C.sign_reference(base)))


_FILLED = """(SELECT sample_id, row, col, k, CASE WHEN isfinite(v) THEN v ELSE coalesce(pv + (nv - pv) * (k - pk) / (nk - pk), pv, nv) END AS v FROM
        (SELECT *, last_value(g IGNORE NULLS) OVER p AS pk, first_value(g IGNORE NULLS) OVER n AS nk,
          last_value(gv IGNORE NULLS) OVER p AS pv, first_value(gv IGNORE NULLS) OVER n AS nv
        FROM (SELECT sample_id, row, col, k, v, CASE WHEN isfinite(v) THEN k END AS g, CASE WHEN isfinite(v) THEN v END AS gv FROM
          (SELECT sample_id, row, col, unnest(range(64)) AS k, unnest(spectrum) AS v FROM holed))
        WINDOW p AS (PARTITION BY sample_id, row, col ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               n AS (PARTITION BY sample_id, row, col ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


@query(
    "c16_gap_interpolation",
    sql("spectra", _pivot_probe(_FILLED), holed=HOLED),
)
def c16(spark, sf_dir):
    return probes(C.fill_gaps(holed(spark, sf_dir)))


@query(
    "c12_gap_filled_derivative",
    sql("spectra", _matrix_oracle(kernels.savgol_matrix(N_BANDS, 15, 2, 2), "filled"), holed=HOLED, filled="SELECT * FROM " + _FILLED),
)
def c12c(spark, sf_dir):
    return probes(C.second_derivative(holed(spark, sf_dir), N_BANDS, 15, 2))


@query(
    "c17_offset_anchoring",
    sql("spectra", f"""({probed('list_transform(spectrum, lambda x: x - spectrum[1])', 'spectra', ", 'first' AS mode")})
        UNION ALL ({probed('list_transform(spectrum, lambda x: x - low)', '(SELECT *, min(list_min(spectrum)) OVER () AS low FROM spectra)', ", 'global' AS mode")})
        UNION ALL ({probed('list_transform(spectrum, lambda x: x - low)', '(SELECT *, min(list_min(spectrum)) OVER (PARTITION BY sample_id) AS low FROM spectra)', ", 'subset' AS mode")})"""),
)
def c17(spark, sf_dir):
    base = X.spectra(spark, sf_dir)
    parts = [
        ("first", base.withColumn("spectrum", C.anchor_first(F.col(S)))),
        ("global", C.anchor_min(base)),
        ("subset", C.anchor_min(base, ["sample_id"])),
    ]
    out = None
    for mode, part in parts:
        part = probes(part, [F.lit(mode).alias("mode")])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "c17_group_anchor",
    sql("selected", f"""SELECT grp, CAST(k AS INT) AS k, {r('mean - first_value(mean) OVER (PARTITION BY grp ORDER BY k) + (SELECT mean FROM stats WHERE grp = $$A$$ AND k = 0)', 'mean')} FROM stats""",
        stats="""SELECT grp, k, avg(v) AS mean FROM (SELECT grp, unnest(range(64)) AS k, unnest(spectrum) AS v FROM selected) GROUP BY 1, 2"""),
)
def c17b(spark, sf_dir):
    means = C.gathered(G.mean_spectrum(X.selected_pixels(spark, sf_dir), ["grp"]), ["grp"], "mean", "mean")
    out = C.anchor_groups(means, "A").select("grp", F.posexplode("mean").alias("k", "mean"))
    return out.select("grp", "k", *rounded("mean"))


_W = C.gaussian_weights(3.0)


@query(
    "c18_gaussian_band_map",
    sql("spectra", f"""SELECT row, col, {r('v', 'v')} FROM p2""",
        img=f"""SELECT row, col, list_sum(list_transform(list_filter(range(64), lambda i: abs(960.0::DOUBLE + i * (840.0::DOUBLE / 63) - 1655) <= 20), lambda i: spectrum[i + 1])) AS v FROM spectra""",
        s="SELECT row, col, v / (SELECT max(abs(v)) FROM img) AS v, (SELECT max(row) + 1 FROM img) AS h, (SELECT max(col) + 1 FROM img) AS wd FROM img",
        tap="SELECT * FROM (VALUES " + ", ".join(f"({i - 12}, {w!r}::DOUBLE)" for i, w in enumerate(_W)) + ") t(d, w)",
        p1="""SELECT t.row, t.col, t.wd, sum(s.v * w) AS v FROM s t, tap JOIN s ON s.col = t.col AND s.row = CASE
          WHEN (t.row + d) % (2 * t.h) >= 0 AND (t.row + d) % (2 * t.h) < t.h THEN (t.row + d) % (2 * t.h)
          WHEN (t.row + d) < 0 THEN -1 - (t.row + d) ELSE 2 * t.h - 1 - (t.row + d) END GROUP BY 1, 2, 3""",
        p2="""SELECT t.row, t.col, sum(s.v * w) AS v FROM p1 t, tap JOIN p1 s ON s.row = t.row AND s.col = CASE
          WHEN t.col + d >= 0 AND t.col + d < t.wd THEN t.col + d WHEN t.col + d < 0 THEN -1 - (t.col + d) ELSE 2 * t.wd - 1 - (t.col + d) END
          GROUP BY 1, 2"""),
)
def c18(spark, sf_dir):
    image = X.spectra(spark, sf_dir).select("row", "col", C.window_sum(F.col(S), AXIS, 1655.0, 20.0).alias("v"))
    return C.gaussian_map(image, [], 3.0).select("row", "col", *rounded("v"))
