"""Lifetime rasters, stage positions and tile lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.functions.arrays import null_if_not_finite
from spectraloom.sources.cubes import list_files, open_path, spread

# fixed values: layout of the exported text matrices
HEADER_LINES = 6
UNPARSABLE = 9999
FILES_AT_ONCE = 16
SUFFIXES = {"a1": "_740_a1.asc", "a2": "_740_a2.asc", "tm": "_740_color coded value.asc"}


def folder_number(path: Column) -> Column:
    """Number of the ``S_<n>`` folder a file lies in; 9999 when it cannot be read."""
    return F.coalesce(F.regexp_extract(path, r"/S_([^/_]*)[^/]*/[^/]+$", 1).try_cast("int"), F.lit(UNPARSABLE))


def scan_rasters(
    spark: SparkSession, folder: str, suffix: str, header: int = HEADER_LINES, files: DataFrame | None = None
) -> DataFrame:
    """A5: text matrices under ``{sample}/S_<n>/*{suffix}`` as (sample_id, file_ord, pix, v).

    ``file_ord`` counts a sample's files from 0 by folder number, folders without one last,
    then by path.  Pixels are numbered row by row, NaN becomes NULL.  One file is one field
    of view, so a file is read as one record to keep its line order.  ``files`` is the
    folder's list where several suffixes share it.
    """
    files = list_files(spark, folder, f"*{suffix}") if files is None else files.where(F.endswith("path", F.lit(suffix)))
    listed = files.select(
        "path", F.regexp_extract("path", r"([^/]+)/S_[^/]*/[^/]+$", 1).alias("sample_id")
    ).where(F.col("path").rlike(r"/S_[^/]*/[^/]+$"))
    place = Window.partitionBy("sample_id").orderBy(folder_number(F.col("path")), "path")
    listed = listed.withColumn("file_ord", F.row_number().over(place) - 1)

    def read(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(lo, FILES_AT_ONCE)
                texts = []
                for path in part.column("path").to_pylist():
                    with open_path(path) as stream:
                        texts.append(stream.read().decode("utf-8", "replace"))
                columns = [part.column("sample_id"), part.column("file_ord"), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["sample_id", "file_ord", "value"])

    raw = spread(listed).mapInArrow(read, "sample_id string, file_ord int, value string")
    lines = F.slice(F.split(F.rtrim("value"), r"\r?\n"), F.lit(header + 1), F.greatest(F.size(F.split(F.rtrim("value"), r"\r?\n")) - header, F.lit(0)))
    numbers = F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), r"\s+")))
    pixels = raw.select(
        "sample_id",
        "file_ord",
        F.posexplode(F.filter(numbers, lambda x: x != "")).alias("pix", "_t"),
    )
    return pixels.select("sample_id", "file_ord", "pix", null_if_not_finite(F.col("_t").try_cast("double")).alias("v"))


def zip_rasters(channels: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Pixel i of every channel side by side, k-th file of each channel with k-th.

    Files beyond the shortest list are left out.

    A file set whose channels differ in pixel count is dropped whole, as is one
    that lacks a channel.
    """
    file_keys = [*keys, "file_ord"]
    names = list(channels)
    sizes = None
    for name in names:
        n = channels[name].groupBy(*file_keys).agg(F.count(F.lit(1)).alias(f"_n_{name}"))
        sizes = n if sizes is None else sizes.join(n, file_keys)
    first = F.col(f"_n_{names[0]}")
    for name in names[1:]:
        sizes = sizes.where(F.col(f"_n_{name}") == first)
    complete = sizes.select(*file_keys)
    out = None
    for name in names:
        side = channels[name].select(*file_keys, "pix", F.col("v").alias(name))
        out = side if out is None else out.join(side, [*file_keys, "pix"])
    return out.join(complete, file_keys, "left_semi")


def _device(devices: Column, name: str) -> Column:
    """First position array of the named device."""
    return F.get(F.filter(devices, lambda d: d["Device"]["scalar"] == name), F.lit(0))["Position_um"]["array"]


POSITION_JSON = (
    "map struct<StagePositions: struct<array: array<struct<"
    "DefaultXYStage: struct<scalar: string>, DefaultZStage: struct<scalar: string>, "
    "DevicePositions: struct<array: array<struct<Device: struct<scalar: string>, Position_um: struct<array: array<double>>>>>, "
    "GridCol: struct<scalar: int>, GridRow: struct<scalar: int>, Label: struct<scalar: string>>>>>"
)


def scan_positions(
    spark: SparkSession, path: str, xy_stage: str = "XYStage", z_stage: str = "ZStage", strict: bool = False,
    keep_file: bool = False,
) -> DataFrame:
    """Stage positions of nested JSON files, one row per position.

    A missing Z gives NULL, or drops the position when ``strict``.
    """
    raw = spark.read.schema(POSITION_JSON).option("multiLine", "true").json(path)
    kept = ["file"] if keep_file else []
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    listed = raw.select(*kept, F.posexplode("map.StagePositions.array").alias("idx", "p"))
    xy = _device(F.col("p.DevicePositions.array"), xy_stage)
    z = _device(F.col("p.DevicePositions.array"), z_stage)
    out = listed.select(
        *kept,
        "idx",
        F.get(xy, F.lit(0)).alias("x"),
        F.get(xy, F.lit(1)).alias("y"),
        F.get(z, F.lit(0)).alias("z"),
        F.col("p.GridRow.scalar").alias("grid_row"),
        F.col("p.GridCol.scalar").alias("grid_col"),
        F.col("p.Label.scalar").alias("label"),
    )
    return out.where("x IS NOT NULL AND z IS NOT NULL") if strict else out
