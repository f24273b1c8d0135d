"""Queries over file scans and sinks.

Each derives its files from the driver tables with a Spark job, in pieces of
bounded size, and then scans them back.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spectraloom.catalog import ratio_list
from spectraloom.operators import bands as B
from spectraloom.operators import aggregate as G
from spectraloom.operators.select import guard_thresholds
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import r, rounded, sql
from spectraloom.plans.q_bands import wide_bands
from spectraloom.plans.registry import query
from spectraloom.session import new_path, settle
from spectraloom.sources import cubes, rasters, sinks

BLOCK_ROWS = 20


def save_bytes(path: str, data: bytes) -> None:
    fs, inner = cubes.filesystem_of(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(data)


def write_cube_files(pixels, folder: str, raw: bool) -> int:
    """One cube file per (sample, block of image rows): at most BLOCK_ROWS x 25 pixels each."""

    def save(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sample, block = key
        cube = np.full((BLOCK_ROWS, 25, len(pdf.spectrum.iloc[0])), np.nan)
        cube[pdf.row % BLOCK_ROWS, pdf.col] = np.stack(pdf.spectrum.to_numpy())
        buf = io.BytesIO()
        if raw:
            np.save(buf, cube)
        else:
            np.savez_compressed(buf, data=cube)
        name = f"{sample}-b{block}.npy" if raw else f"masked_cube_{sample}-b{block}.npz"
        save_bytes(f"{folder}/{name}", buf.getvalue())
        return pd.DataFrame({"n": [len(pdf)]})

    blocks = pixels.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS).cast("int"))
    return blocks.groupBy("sample_id", "block").applyInPandas(save, "n long").agg(F.sum("n")).first()[0]


_BLOCKED = f"""SELECT sample_id || '-b' || (row // {BLOCK_ROWS}) AS sample_id, row % {BLOCK_ROWS} AS row, col, {r('list_sum(spectrum)', 'total')} FROM spectra"""


def cube_query(spark, sf_dir, raw):
    folder = new_path(spark, "cubes")
    write_cube_files(X.spectra(spark, sf_dir), folder, raw)
    px = cubes.scan_raw_cubes(spark, folder, rows_per_task=8) if raw else cubes.scan_cubes(spark, folder)
    total = F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)
    return px.select("sample_id", "row", "col", total.alias("total")).select("sample_id", "row", "col", *rounded("total"))


@query("a1_cube_scan", sql("spectra", _BLOCKED))
def a1(spark, sf_dir):
    return cube_query(spark, sf_dir, raw=False)


@query("a2_raw_cube_scan", sql("spectra", _BLOCKED))
def a2(spark, sf_dir):
    return cube_query(spark, sf_dir, raw=True)


@query(
    "a2_reference_spectrum",
    sql("spectra", f"""SELECT CAST(k AS INT) AS k, {r('CASE WHEN k % 9 = 4 THEN NULL ELSE m END', 'value')} FROM
        (SELECT k, avg(v) AS m FROM (SELECT unnest(range(64)) AS k, unnest(spectrum) AS v FROM spectra) GROUP BY 1)"""),
)
def a2b(spark, sf_dir):
    mean = G.mean_spectrum(X.spectra(spark, sf_dir), [])
    cell = F.when(F.col("k") % 9 == 4, "").otherwise(F.col("mean").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("k", F.concat(cell, F.lit("\tx")).alias("line"))))
    text = mean.agg(F.array_join(F.transform(listed, lambda e: e["line"]), "\n").alias("value"))
    path = new_path(spark, "reference")
    text.write.text(path)
    return cubes.scan_reference(spark, path).select("k", *rounded("value"))


def write_raster_files(px, folder: str) -> int:
    """One text matrix per (sample, file, channel): at most 1000 pixels each."""

    def save(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sample, file_ord = key
        pdf = pdf.sort_values("event_id")
        for channel, suffix in rasters.SUFFIXES.items():
            rows = [" ".join(repr(float(v)) for v in pdf[channel].iloc[i : i + 25]) for i in range(0, len(pdf), 25)]
            text = "\n".join([f"header {i}" for i in range(rasters.HEADER_LINES)] + rows) + "\n"
            save_bytes(f"{folder}/{sample}/S_{file_ord}/img{suffix}", text.encode())
        return pd.DataFrame({"n": [len(pdf)]})

    return px.groupBy("sample_id", "file_ord").applyInPandas(save, "n long").agg(F.sum("n")).first()[0]


@query(
    "a5_lifetime_scan",
    """SELECT event_type AS sample_id, CAST(event_id // 1000 AS INT) AS file_ord, CAST(row_number() OVER (PARTITION BY event_type, event_id // 1000 ORDER BY event_id) - 1 AS INT) AS pix,
    round(value, 6) + 0.0 AS a1, round(user_id::DOUBLE, 6) + 0.0 AS a2, round(json_extract(props, '$.k')::DOUBLE, 6) + 0.0 AS tm FROM events""",
)
def a5(spark, sf_dir):
    px = X.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("sample_id"), F.floor(F.col("event_id") / 1000).cast("int").alias("file_ord"), "event_id",
        F.col("value").alias("a1"), F.col("user_id").cast("double").alias("a2"),
        F.get_json_object("props", "$.k").cast("double").alias("tm"),
    )
    folder = new_path(spark, "rasters")
    write_raster_files(px, folder)
    files = cubes.list_files(spark, folder, "*.asc")
    channels = {c: settle(rasters.scan_rasters(spark, folder, s, files=files), "channel") for c, s in rasters.SUFFIXES.items()}
    out = rasters.zip_rasters(channels, ["sample_id"])
    return out.select("sample_id", "file_ord", "pix", *rounded("a1", "a2", "tm"))


@query(
    "a6_stage_positions",
    """SELECT CAST(row_number() OVER (PARTITION BY s_suppkey // 25 ORDER BY s_suppkey) - 1 AS INT) AS idx, s_suppkey * 1.5::DOUBLE AS x, s_suppkey * 0.25::DOUBLE AS y,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE round(s_acctbal, 2) + 0.0 END AS z, CAST(s_suppkey % 10 AS INT) AS grid_row, CAST(s_suppkey // 10 AS INT) AS grid_col, s_name AS label FROM supplier""",
)
def a6(spark, sf_dir):
    s = F.col("s_suppkey")
    device = lambda name, *v: F.struct(
        F.struct(F.lit(name).alias("scalar")).alias("Device"), F.struct(F.array(*v).alias("array")).alias("Position_um")
    )
    xy = device("XYStage", s * 1.5, s * 0.25)
    devices = F.when(s % 6 == 0, F.array(xy)).otherwise(F.array(device("ZStage", F.col("s_acctbal")), xy))
    scalar = lambda c: F.struct(c.alias("scalar"))
    entry = F.struct(
        scalar(F.lit("XYStage")).alias("DefaultXYStage"), scalar(F.lit("ZStage")).alias("DefaultZStage"),
        F.struct(devices.alias("array")).alias("DevicePositions"),
        scalar(F.floor(s / 10)).alias("GridCol"), scalar(s % 10).alias("GridRow"), scalar(F.col("s_name")).alias("Label"),
    )
    # a document holds at most 25 positions
    docs = X.table(spark, sf_dir, "supplier").groupBy(F.floor(s / 25).alias("doc")).agg(
        F.sort_array(F.collect_list(F.struct(s.alias("s"), entry.alias("e")))).alias("l")
    )
    listed = F.struct(F.transform("l", lambda x: x["e"]).alias("array"))
    body = F.to_json(F.struct(F.struct(listed.alias("StagePositions")).alias("map")))
    path = new_path(spark, "positions")
    docs.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    out = rasters.scan_positions(spark, path)
    return out.select("idx", "x", "y", *rounded("z", digits=2), "grid_row", "grid_col", "label")


@query(
    "a9_table_sink",
    sql("flim", f"SELECT grp, sample_id, count(*) AS n, {r('avg(a1)', 'mean_a1')}, {r('avg(CASE WHEN a2 > 49 THEN a2 END)', 'mean_top')} FROM flim GROUP BY 1, 2"),
)
def a9(spark, sf_dir):
    stats = X.flim(spark, sf_dir).groupBy("grp", "sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a1").alias("mean_a1"), F.avg(F.when(F.col("a2") > 49, F.col("a2"))).alias("mean_top")
    ).select("grp", "sample_id", "n", *rounded("mean_a1", "mean_top"))
    path = new_path(spark, "table")
    sinks.write_table(stats, path)
    return sinks.read_table(spark, path, stats.schema)


@query(
    "a10_overlay_sink",
    sql("ratiopx", f"""SELECT sample_id, ratio, row, col, CASE WHEN value > t THEN 'above' WHEN value < t THEN 'below' ELSE 'equal' END AS state, {r('num_thr', 'num_thr')}, {r('t', 'threshold')}
        FROM ratiopx JOIN (SELECT ratio, median(value) AS t FROM ratiopx WHERE grp = 'A' GROUP BY 1) USING (ratio) JOIN ratios USING (ratio)
        JOIN thr ON thr.sample_id = ratiopx.sample_id AND thr.band = num_band""").replace("SELECT sample_id, ratio, row, col, CASE", "SELECT ratiopx.sample_id AS sample_id, ratio, row, col, CASE"),
)
def a10(spark, sf_dir):
    wide = wide_bands(spark, sf_dir)
    thr = settle(guard_thresholds(B.bands_long(wide, ["sample_id"]), ["sample_id", "band"]), "thr")
    ratios = settle(B.sample_ratios(wide, ratio_list(), ["sample_id", "grp", "row", "col"], thresholds=thr), "ratios")

    catalogue = B.ratio_catalogue(spark)
    num = thr.select("sample_id", F.col("band").alias("num_band"), "num_thr")
    den = thr.select("sample_id", F.col("band").alias("den_band"), "den_thr")
    states = (
        B.overlay_states(ratios, "A").join(catalogue, "ratio").join(num, ["sample_id", "num_band"]).join(den, ["sample_id", "den_band"])
    )
    path = new_path(spark, "overlay")
    sinks.write_overlay(states, path)
    return sinks.read_overlay(spark, path).select("sample_id", "ratio", "row", "col", "state", *rounded("num_thr", "threshold"))
