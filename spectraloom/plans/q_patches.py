"""Queries over patches (L1-L6) and mosaics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog import BAND_LIBRARY, ratio_list
from spectraloom.operators import bands as B
from spectraloom.operators import mosaic as N
from spectraloom.operators import patches as P
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, r, rounded, sql
from spectraloom.plans.q_aggregate import HASH
from spectraloom.plans.registry import query
from spectraloom.session import settle


@query(
    "l1_grid_tiles",
    sql("raster", """SELECT sample_id, r0, c0, n_pixels, row_number() OVER (PARTITION BY sample_id ORDER BY r0, c0) AS patch_no FROM
        (SELECT sample_id, CAST(row // 7 * 7 AS INT) AS r0, CAST(col // 9 * 9 AS INT) AS c0, count(*) AS n_pixels FROM raster GROUP BY 1, 2, 3) WHERE n_pixels >= 12"""),
)
def l1(spark, sf_dir):
    out = P.grid_boxes(X.raster(spark, sf_dir), ["sample_id"], 7, 9, 12)
    return out.select("sample_id", "r0", "c0", "n_pixels", "patch_no")


@query(
    "l1_patch_ids",
    sql("raster", """SELECT printf('%s_p%03d_r%03d-%03d_c%03d-%03d', sample_id, patch_no, r0, r0 + 7, c0, c0 + 9) AS patch_id, n_pixels FROM
        (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY r0, c0) AS patch_no FROM
        (SELECT sample_id, row // 7 * 7 AS r0, col // 9 * 9 AS c0, count(*) AS n_pixels FROM raster GROUP BY 1, 2, 3) WHERE n_pixels >= 12)"""),
)
def l1b(spark, sf_dir):
    out = P.grid_boxes(X.raster(spark, sf_dir), ["sample_id"], 7, 9, 12)
    pid = P.patch_id(F.col("r0"), F.col("r0") + 7, F.col("c0"), F.col("c0") + 9, F.col("sample_id"), F.col("patch_no"))
    return out.select(pid.alias("patch_id"), "n_pixels")


def shape_of(df):
    """Image size, two numbers."""
    top = df.agg(F.max("row") + 1, F.max("col") + 1).first()
    return int(top[0]), int(top[1])


_COVER = """SELECT sample_id, CAST(cr * 4 AS INT) AS r0, CAST(cc * 4 AS INT) AS c0, count(*) AS n_pixels FROM
    (SELECT sample_id, row, col, unnest(range(greatest(0, ceil((row - 9) / 4.0)::BIGINT), least(row // 4, (h - 10) // 4) + 1)) AS cr,
     w FROM (SELECT * FROM kept, (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM raster))) JOIN (SELECT col AS col2, unnest(range(greatest(0, ceil((col - 9) / 4.0)::BIGINT), least(col // 4, (w2 - 10) // 4) + 1)) AS cc
     FROM (SELECT DISTINCT col FROM raster), (SELECT max(col) + 1 AS w2 FROM raster)) ON col = col2 GROUP BY 1, 2, 3"""


@query(
    "l2_covered_tiles",
    sql("raster", f"""SELECT sample_id, r0, c0, n_pixels, {r('n_pixels / 100.0', 'cover')} FROM (SELECT *, row_number() OVER (PARTITION BY sample_id
        ORDER BY md5(concat_ws('|', 'tiles', sample_id, r0, c0)), sample_id, r0, c0) AS rn FROM t WHERE n_pixels >= 80) WHERE rn <= 60""",
        kept="SELECT CASE WHEN sample_id IN ('click', 'view') THEN 'x' ELSE 'y' END AS sample_id, row, col FROM raster WHERE (row * 3 + col) % 11 <> 0 AND sample_id <> 'zzz'".replace(
            "CASE WHEN sample_id IN ('click', 'view') THEN 'x' ELSE 'y' END", "'all'"), t=_COVER),
)
def l2(spark, sf_dir):
    px = X.raster(spark, sf_dir).select(F.lit("all").alias("sample_id"), "row", "col")
    kept = px.where((F.col("row") * 3 + F.col("col")) % 11 != 0)
    out = P.covered_tiles(kept, ["sample_id"], 10, 4, shape_of(px), 0.8, per_group=60)
    return out.select("sample_id", "r0", "c0", "n_pixels", *rounded("cover"))


_H = lambda tag, room: f"CAST({HASH.format(parts=chr(39) + 'patch-' + tag + chr(39) + ', sample_id, try_no')} % ({room} + 1) AS INT)"


@query(
    "l3_random_patches",
    sql("raster", f"""SELECT sample_id, CAST(try_no AS INT) AS try_no, r0, c0, n_pixels, CAST(patch_no AS INT) AS patch_no FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY try_no) AS patch_no FROM
        (SELECT b.sample_id, try_no, r0, c0, count(*) AS n_pixels FROM b JOIN raster p ON p.sample_id = b.sample_id AND row >= r0 AND row < r0 + 8 AND col >= c0 AND col < c0 + 8
        GROUP BY 1, 2, 3, 4) WHERE n_pixels >= 14) WHERE patch_no <= 25""",
        b=f"SELECT sample_id, try_no, {_H('r', 'h - 8')} AS r0, {_H('c', 'w - 8')} AS c0 FROM (SELECT DISTINCT sample_id FROM raster), (SELECT unnest(range(1, 301)) AS try_no), (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM raster)"),
)
def l3(spark, sf_dir):
    px = X.raster(spark, sf_dir)
    groups = px.select("sample_id").distinct()
    out = P.random_patches(px, groups, ["sample_id"], shape_of(px), (8, 8), 25, 300, 14)
    return out.select("sample_id", "try_no", "r0", "c0", "n_pixels", "patch_no")


@query(
    "l4_whole_patches",
    sql("spectra", f"""SELECT r0, c0, len(f) AS length, {r('list_sum(list_transform(range(len(f)), lambda i: f[i + 1] * ((i % 97) + 1)))', 'weighted')} FROM
        (SELECT r0, c0, flatten(list(spectrum ORDER BY row, col)) AS f FROM (SELECT row, col, spectrum, unnest(range(greatest(0, row - 2), least(row, h - 3) + 1)) AS r0, w FROM spectra, hw WHERE (row * 25 + col) % 29 <> 0)
        JOIN (SELECT DISTINCT col AS col2, unnest(range(greatest(0, col - 2), least(col, w - 3) + 1)) AS c0 FROM spectra, hw) ON col = col2 GROUP BY 1, 2 HAVING count(*) = 9)
        QUALIFY row_number() OVER (ORDER BY md5(concat_ws('|', 'whole', r0, c0)), r0, c0) <= 200""",
        hw="SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM spectra"),
)
def l4(spark, sf_dir):
    px = X.spectra(spark, sf_dir)
    holed = px.withColumn(
        "spectrum",
        F.when((F.col("row") * 25 + F.col("col")) % 29 == 0, F.transform("spectrum", lambda x: F.lit(float("nan")))).otherwise(F.col("spectrum")),
    )
    out = P.whole_patches(holed, [], 3, 1, shape_of(px), 200)
    weighted = F.aggregate(F.transform("features", lambda x, i: x * ((i % 97) + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select(
        F.col("r0").cast("bigint").alias("r0"), F.col("c0").cast("bigint").alias("c0"),
        F.size("features").cast("bigint").alias("length"), weighted.alias("weighted"),
    ).select("r0", "c0", "length", *rounded("weighted"))


BANDS = [band for band, *_ in BAND_LIBRARY]
RATIOS = ratio_list()
_SHOWN = ", ".join(r(f'"{b}"', f'"{b}"') for b in BANDS)


def band_pixels(spark, sf_dir):
    return B.band_columns(X.selected_pixels(spark, sf_dir), AXIS, ["side", "sample_id", "grp", "row", "col"])


@query(
    "l5_patch_features",
    sql("bandpx", f"""SELECT sample_id, r0, c0, {_SHOWN}, {', '.join(r(f'least("{n}" / "{d}", 1.05)', f'"{name}"') for name, n, d in RATIOS)} FROM (SELECT sample_id, CAST(row // 5 * 5 AS INT) AS r0, CAST(col // 5 * 5 AS INT) AS c0,
        {', '.join(f"avg(value) FILTER (band = '{b}' AND value - 0.35 > 0) AS \"{b}\"" for b in BANDS)} FROM bandpx GROUP BY 1, 2, 3) WHERE {' AND '.join(f'"{b}" IS NOT NULL' for b in BANDS)}""").replace(
        "avg(value) FILTER", "avg(value - 0.35) FILTER"),
)
def l5(spark, sf_dir):
    wide = band_pixels(spark, sf_dir)
    lowered = wide.select("sample_id", "row", "col", *[(F.col(f"b_{b}") - 0.35).alias(f"b_{b}") for b in BANDS])
    tiled = P.tile_of(lowered, 5, 5)
    out = P.patch_features(tiled, ["sample_id", "r0", "c0"], BANDS, RATIOS, 1.05)
    return out.select("sample_id", "r0", "c0", *rounded(*BANDS, *[name for name, _, _ in RATIOS]))


@query(
    "l6_patch_dataset",
    sql("bandpx", f"""SELECT printf('%s_%s_p%02d', side, sample_id, patch_no) AS patch_id, label, row, col, {_SHOWN} FROM (
        SELECT *, row_number() OVER (PARTITION BY side, sample_id, patch_no ORDER BY md5(concat_ws('|', 'patch-pixels', side, sample_id, row, col)), side, sample_id, row, col) AS rn FROM
        (SELECT x.*, patch_no FROM (SELECT side, sample_id, row, col, {', '.join(f"max(value) FILTER (band = '{b}') AS \"{b}\"" for b in BANDS)}, CAST(grp = 'B' AS INT) AS label, row // 6 * 6 AS r0, col // 12 * 12 AS c0 FROM bandpx GROUP BY side, sample_id, row, col, grp) x JOIN
          (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side, sample_id ORDER BY n DESC, r0, c0) AS rank, row_number() OVER (PARTITION BY side, sample_id ORDER BY r0, c0) AS patch_no
            FROM (SELECT side, sample_id, row // 6 * 6 AS r0, col // 12 * 12 AS c0, count(*) AS n FROM bandpx WHERE band = 'amideI' GROUP BY ALL) WHERE n >= 2) WHERE rank <= 3) USING (side, sample_id, r0, c0))) WHERE rn <= 4"""),
)
def l6(spark, sf_dir):
    wide = settle(band_pixels(spark, sf_dir), "bands")
    out = P.patch_dataset(wide, 6, 12, 2, 3, 4)
    named = out.select("patch_id", "label", "row", "col", *[F.col(f"b_{b}").alias(b) for b in BANDS])
    return named.select("patch_id", "label", "row", "col", *rounded(*BANDS))


# ---- mosaics --------------------------------------------------------------------
def positions(spark, sf_dir):
    """Suppliers as stage positions: a grid row, a place along it, a label."""
    s = F.col("s_suppkey")
    return X.table(spark, sf_dir, "supplier").select(
        (s - 1).cast("int").alias("idx"), ((s * 37 % 101) * 12.5).alias("x"), ((s % 10) * 250.0).alias("y"),
        F.col("s_acctbal").alias("z"), (s % 10).cast("int").alias("grid_row"), F.floor(s / 10).cast("int").alias("grid_col"),
        F.col("s_name").alias("label"),
    )


_POS = """SELECT CAST(s_suppkey - 1 AS INT) AS idx, (s_suppkey * 37 % 101) * 12.5::DOUBLE AS x, (s_suppkey % 10) * 250.0::DOUBLE AS y, s_acctbal AS z,
    CAST(s_suppkey % 10 AS INT) AS grid_row, s_name AS label FROM supplier"""


@query(
    "n1_mosaic_stitch",
    f"""WITH pos AS ({_POS}), placed AS (SELECT idx, CAST((row_number() OVER (PARTITION BY grid_row ORDER BY -round_even(x / 0.931, 0), idx) - 1) * 5 AS INT) AS x0, grid_row * 4 AS y0 FROM pos),
    tiles AS (SELECT CAST(event_id // 20 AS INT) AS idx, CAST(event_id % 20 // 5 AS INT) AS row, CAST(event_id % 5 AS INT) AS col, value FROM events WHERE event_id // 20 % 7 <> 3 OR event_id % 20 < 15),
    whole AS (SELECT idx FROM tiles GROUP BY 1 HAVING count(*) = 20)
    SELECT y0 + row AS row, x0 + col AS col, {r('value', 'value')} FROM tiles JOIN whole USING (idx) JOIN placed USING (idx)""",
)
def n1(spark, sf_dir):
    e = F.col("event_id")
    tiles = X.table(spark, sf_dir, "events").select(
        F.floor(e / 20).cast("int").alias("idx"), F.floor(e % 20 / 5).cast("int").alias("row"), (e % 5).cast("int").alias("col"),
        "value", e,
    ).where((F.col("idx") % 7 != 3) | (e % 20 < 15))
    placed = N.place_tiles(positions(spark, sf_dir), 0.931, 4, 5)
    return N.stitch(tiles, placed, 4, 5).select("row", "col", *rounded("value"))


_PH = """ph AS (SELECT event_type AS file, CAST(user_id % 12 AS INT) AS row, CAST(event_id % 12 AS INT) AS col, CAST(second(ts) AS INT) AS t, CAST(floor(value) AS INT) AS n FROM events),
    c AS (SELECT file, row, col, max(n)::DOUBLE AS m, sum(n)::DOUBLE AS s FROM ph GROUP BY 1, 2, 3),
    b AS (SELECT *, m - min(m) OVER (PARTITION BY file) AS mv, max(m) OVER (PARTITION BY file) - min(m) OVER (PARTITION BY file) AS mr,
      s - min(s) OVER (PARTITION BY file) AS sv, max(s) OVER (PARTITION BY file) - min(s) OVER (PARTITION BY file) AS sr FROM c)"""


@query(
    "n2_photon_projection",
    f"WITH {_PH} SELECT file, row, col, CAST(floor(coalesce(mv / nullif(mr, 0) * 65535.0::DOUBLE, 0)) AS INT) % 65536 AS max_linear, CAST(floor(pow(sv, 0.75) * 2500.0) AS BIGINT) % 65536 AS sum_gamma FROM b",
)
def n2(spark, sf_dir):
    photons = X.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("file"), (F.col("user_id") % 12).cast("int").alias("row"), (F.col("event_id") % 12).cast("int").alias("col"),
        F.second("ts").alias("t"), F.floor("value").cast("int").alias("n"),
    )
    a = N.project_photons(photons, "max", "linear").withColumnRenamed("value", "max_linear")
    b = N.project_photons(photons, "sum", "gamma").select("file", "row", "col", F.col("value").cast("bigint").alias("sum_gamma"))
    return a.join(b, ["file", "row", "col"])


@query(
    "n3_serpentine_numbering",
    sql("raster", """SELECT sample_id, row, col, CAST(row AS BIGINT) * 100 + CASE WHEN row % 2 = 0 THEN 99 - col ELSE col END + 1 AS full_number,
        row_number() OVER (PARTITION BY sample_id ORDER BY row, CASE WHEN row % 2 = 0 THEN -col ELSE col END) AS sparse_number FROM raster"""),
)
def n3(spark, sf_dir):
    cells = X.raster(spark, sf_dir).select("sample_id", "row", "col")
    out = N.serpentine_sparse(cells, "sparse_number", ["sample_id"])
    return out.withColumn("full_number", N.serpentine_number(F.col("row"), F.col("col"), 100))


@query(
    "a8_tile_configuration",
    f"""WITH pos AS ({_POS}), f AS (SELECT 'tile_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.tif' AS name FROM orders)
    SELECT k, name || '; ; (' || x::VARCHAR || ',' || y::VARCHAR || ')' AS line FROM (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT name FROM f))
    JOIN (SELECT x, y, row_number() OVER (ORDER BY idx) AS k FROM pos) USING (k)""",
)
def a8(spark, sf_dir):
    files = X.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("tile_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".tif")).alias("name")
    ).distinct()
    return N.tile_lines(files, positions(spark, sf_dir))


