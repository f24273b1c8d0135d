"""Pixel selection: clusters, validity, regions, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.catalog import DEN_FLOOR, DEN_PERCENTILE, N_CLUSTERS, NUM_FLOOR, NUM_PERCENTILE, Axis
from spectraloom.functions.arrays import all_finite, is_finite, l2_norm, max_abs, pick
from spectraloom.operators.scale import exact_quantiles, joint_quantiles
from spectraloom.session import settle

PIXEL = ["sample_id", "row", "col"]


def clean_clusters(raw: DataFrame, n_clusters: int = N_CLUSTERS, strict: bool = False) -> DataFrame:
    """B1: raw cluster entries to distinct ids in 0..n-1.

    The default truncates towards zero (4.5 becomes 4); ``strict`` drops
    fractional entries instead.  Text that is no number is dropped.
    """
    number = F.col("raw").try_cast("double")
    whole = F.when(is_finite(number), number).try_cast("int")
    cleaned = raw.select("sample_id", number.alias("_x"), whole.alias("cluster"))
    if strict:
        cleaned = cleaned.where(F.col("_x") == F.col("cluster"))
    return cleaned.where(F.col("cluster").between(0, n_clusters - 1)).select(
        "sample_id", "cluster"
    ).distinct()


def label_pixels(pixels: DataFrame, clusters: DataFrame) -> DataFrame:
    """G1: attach the cluster label; pixels without one drop out."""
    return pixels.join(clusters, PIXEL, "inner")


def keep_clusters(labelled: DataFrame, selection: DataFrame) -> DataFrame:
    """B2: pixels whose cluster is on their sample's list."""
    return labelled.join(selection, ["sample_id", "cluster"], "left_semi")


def drop_clusters(labelled: DataFrame, selection: DataFrame) -> DataFrame:
    """B2 complement: pixels whose cluster is not on their sample's list."""
    return labelled.join(selection, ["sample_id", "cluster"], "left_anti")


def finite_spectra(pixels: DataFrame) -> DataFrame:
    """Rows with every band finite."""
    return pixels.where(all_finite(F.col("spectrum")))


def intensity_mask(
    pixels: DataFrame,
    value: Column,
    keys: Sequence[str] = ("sample_id",),
    low: float = 0.0,
    low_percentile: float | None = None,
    high_percentile: float = 0.99999,
) -> DataFrame:
    """Keep ``low < value < percentile``; the lower bound may be lifted to a percentile."""
    probs = {"_hi": high_percentile}
    if low_percentile is not None:
        probs["_lo"] = low_percentile
    bounds = exact_quantiles(pixels, keys, value, probs)
    lower = F.lit(float(low))
    if low_percentile is not None:
        lower = F.greatest(F.col("_lo"), lower)
    return (
        pixels.join(bounds, list(keys))
        .where((value > lower) & (value < F.col("_hi")))
        .drop("_hi", "_lo")
    )


def _crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Whether the ray from (x, y) to the right crosses edge a-b."""
    straddles = (a["y"] > y) != (b["y"] > y)
    at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
    return F.coalesce(straddles & (x < at), F.lit(False))


def inside_polygons(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pixels whose (col, row) lies inside a polygon, one row per (pixel, roi).

    ``polygons`` is ``(roi, verts array<struct<x,y>>)``: regions drawn by hand, so
    few.  They are folded into one row; a pixel first drops those whose bounding box
    it misses, then counts edge crossings for the rest.
    """
    verts = F.col("verts")
    n = F.size(verts)
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.get(verts, i).alias("a"), F.get(verts, F.pmod(i + 1, n)).alias("b")),
    )
    box = [
        fold(F.col(f"verts.{axis}")).alias(f"{axis}{tag}")
        for axis in ("x", "y")
        for tag, fold in (("0", F.array_min), ("1", F.array_max))
    ]
    listed = polygons.select("roi", edges.alias("edges"), *box).agg(
        F.collect_list(F.struct("roi", "edges", "x0", "x1", "y0", "y1")).alias("_rois")
    )
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    near = F.filter("_rois", lambda p: x.between(p["x0"], p["x1"]) & y.between(p["y0"], p["y1"]))
    crossings = F.size(F.filter(F.col("_roi.edges"), lambda e: _crosses(x, y, e["a"], e["b"])))
    return (
        pixels.crossJoin(F.broadcast(listed))
        .withColumn("_roi", F.explode(near))
        .where(crossings % 2 == 1)
        .withColumn("roi", F.col("_roi.roi"))
        .drop("_rois", "_roi")
    )


def inside_rectangles(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """Half-open row/col boxes per sample; a pixel may fall in several regions."""
    box = (
        (F.col("row") >= F.col("r0"))
        & (F.col("row") < F.col("r1"))
        & (F.col("col") >= F.col("c0"))
        & (F.col("col") < F.col("c1"))
    )
    renamed = rects.withColumnRenamed("sample_id", "_sid")
    return pixels.join(renamed, (F.col("sample_id") == F.col("_sid")) & box).drop(
        "_sid", "r0", "r1", "c0", "c1"
    )


def quality_filter(
    pixels: DataFrame,
    min_norm: float = 1e-3,
    max_value: float = 1e3,
    min_keep: int = 100,
    keys: Sequence[str] = ("sample_id",),
) -> DataFrame:
    """Drop degenerate spectra, unless fewer than ``min_keep`` of a group would survive.

    The survivor count is a plain aggregate, so the guard holds one row per group.
    """
    good = all_finite(F.col("spectrum")) & (l2_norm(F.col("spectrum")) >= min_norm) & (
        max_abs(F.col("spectrum")) <= max_value
    )
    judged = pixels.withColumn("_good", good)
    counts = judged.groupBy(*keys).agg(F.count_if("_good").alias("_n_good"))
    counts = settle(counts, "counts")  # small, so the spectra stay where they are
    return (
        judged.join(counts, list(keys))
        .where(F.col("_good") | (F.col("_n_good") < min_keep))
        .drop("_good", "_n_good")
    )


def positive_finite(value: Column) -> Column:
    """B8 predicate."""
    return is_finite(value) & (value > 0)


def trim_joint(
    rows: DataFrame, columns: Sequence[str], keys: Sequence[str], lower: float = 0.025, upper: float = 0.975
) -> DataFrame:
    """Rows whose every column lies in its own closed percentile interval."""
    wide = joint_quantiles(rows, keys, columns, {"_lo": lower, "_hi": upper})
    kept = rows.join(wide, list(keys))
    for c in columns:
        kept = kept.where(F.col(c).between(F.col(f"_lo_{c}"), F.col(f"_hi_{c}")))
    return kept.select(*rows.columns)


def guard_thresholds(
    band_values: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    num: tuple[float, float] = (NUM_PERCENTILE, NUM_FLOOR),
    den: tuple[float, float] = (DEN_PERCENTILE, DEN_FLOOR),
) -> DataFrame:
    """Numerator and denominator thresholds per group: max(percentile, floor)."""
    q = exact_quantiles(band_values, keys, F.col(value), {"_pn": num[0], "_pd": den[0]})
    return q.select(
        *keys,
        F.greatest(F.col("_pn"), F.lit(num[1])).alias("num_thr"),
        F.greatest(F.col("_pd"), F.lit(den[1])).alias("den_thr"),
    )


def band_windows(axis: Axis, targets: Sequence[tuple[float, float]], union: bool = True) -> list[int]:
    """B11 indices: the union of windows, or the windows one after another."""
    parts = [axis.window(c, hw) for c, hw in targets]
    if union:
        return sorted({i for part in parts for i in part})
    return [i for part in parts for i in part]


def project_bands(spectrum: Column, indices: Sequence[int]) -> Column:
    """The chosen bands of a spectrum."""
    return pick(spectrum, indices)


def attach_samples(df: DataFrame, samples: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Group, animal and batch of each sample; unknown samples drop out by default."""
    return df.join(samples, "sample_id", "left" if keep_unknown else "inner")
