"""Patches of the pixel grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.arrays import all_finite, hash_key, hex_to_long, null_if_not_finite
from spectraloom.operators.aggregate import top_patches
from spectraloom.operators.scale import row_ordinals, take_hashed


def tile_of(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Non-overlapping grid tile of each pixel, by division."""
    return pixels.withColumn("r0", (F.floor(F.col("row") / height) * height).cast("int")).withColumn(
        "c0", (F.floor(F.col("col") / width) * width).cast("int")
    )


def join_boxes(pixels: DataFrame, boxes: DataFrame, keys: Sequence[str], cell: int) -> DataFrame:
    """G6 for free boxes: half-open containment, by an equi-join on grid cells.

    A box is listed under every cell it touches, a pixel under its own, so no
    pixel meets a box of another part of the image.
    """
    keys = list(keys)
    spread = boxes.withColumn(
        "_cr", F.explode(F.sequence(F.floor(F.col("r0") / cell), F.floor((F.col("r1") - 1) / cell)))
    ).withColumn("_cc", F.explode(F.sequence(F.floor(F.col("c0") / cell), F.floor((F.col("c1") - 1) / cell))))
    placed = pixels.withColumn("_cr", F.floor(F.col("row") / cell)).withColumn("_cc", F.floor(F.col("col") / cell))
    inside = (
        (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r1"))
        & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c1"))
    )
    return placed.join(spread, [*keys, "_cr", "_cc"]).where(inside).drop("_cr", "_cc")


def patch_id(r0: Column, r1: Column, c0: Column, c1: Column, prefix: Column, number: Column) -> Column:
    return F.format_string("%s_p%03d_r%03d-%03d_c%03d-%03d", prefix, number, r0, r1, c0, c1)


def grid_boxes(pixels: DataFrame, keys: Sequence[str], height: int, width: int, min_pixels: int) -> DataFrame:
    """L1: tiles with at least ``min_pixels`` selected pixels, numbered in reading order."""
    keys = list(keys)
    counts = (
        tile_of(pixels, height, width)
        .groupBy(*keys, "r0", "c0")
        .agg(F.count(F.lit(1)).alias("n_pixels"))
        .where(F.col("n_pixels") >= min_pixels)
    )
    return row_ordinals(counts, keys, ["r0", "c0"], "patch_no")


def covering_tiles(
    pixels: DataFrame, keys: Sequence[str], size: int, stride: int, height: Column, width: Column
) -> DataFrame:
    """One row per (pixel, full tile over it) for tiles on a stride grid."""

    def corners(x: Column, extent: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((x - size + 1) / stride))
        last = F.least(F.floor(x / stride), F.floor((extent - size) / stride))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: (i * stride).cast("int")))

    return pixels.withColumn("r0", F.explode(corners(F.col("row"), height))).withColumn(
        "c0", F.explode(corners(F.col("col"), width))
    )


def covered_tiles(
    pixels: DataFrame, keys: Sequence[str], size: int, stride: int, shape: tuple[int, int],
    min_cover: float = 0.8, per_group: int | None = None, salt: str = "tiles",
) -> DataFrame:
    """L2: full tiles with enough selected pixels, at most ``per_group`` each."""
    keys = list(keys)
    tiles = (
        covering_tiles(pixels, keys, size, stride, F.lit(shape[0]), F.lit(shape[1]))
        .groupBy(*keys, "r0", "c0")
        .agg(F.count(F.lit(1)).alias("n_pixels"))
        .withColumn("cover", F.col("n_pixels") / float(size * size))
        .where(F.col("cover") >= min_cover)
    )
    if per_group is not None:
        ids = [*keys, "r0", "c0"]
        tiles = take_hashed(tiles, keys, hash_key(salt, *ids), ids, per_group)
    return tiles


def random_patches(
    pixels: DataFrame, groups: DataFrame, keys: Sequence[str], shape: tuple[int, int], size: tuple[int, int],
    wanted: int, tries: int, min_pixels: int, salt: str = "patch",
) -> DataFrame:
    """L3: boxes from hashed corners, the first ``wanted`` accepted tries of each group.

    ``groups`` is one row per group; tries multiply only that small table.
    """
    keys = list(keys)
    corner = lambda tag, room: F.pmod(
        hex_to_long(hash_key(f"{salt}-{tag}", *keys, "try_no")), F.lit(max(room, 0) + 1)
    ).cast("int")
    boxes = (
        groups.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("try_no"))
        .withColumn("r0", corner("r", shape[0] - size[0]))
        .withColumn("c0", corner("c", shape[1] - size[1]))
        .withColumn("r1", F.col("r0") + size[0])
        .withColumn("c1", F.col("c0") + size[1])
    )
    hits = join_boxes(pixels.select(*keys, "row", "col"), boxes, keys, max(size))
    accepted = (
        hits.groupBy(*keys, "try_no", "r0", "c0", "r1", "c1")
        .agg(F.count(F.lit(1)).alias("n_pixels"))
        .where(F.col("n_pixels") >= min_pixels)
    )
    # at most ``tries`` rows per group, a parameter


    w = Window.partitionBy(*keys).orderBy("try_no")
    return accepted.withColumn("patch_no", F.row_number().over(w)).where(F.col("patch_no") <= wanted)


def whole_patches(
    pixels: DataFrame, keys: Sequence[str], size: int, stride: int, shape: tuple[int, int], most: int,
    salt: str = "whole",
) -> DataFrame:
    """L4: windows without a missing pixel, as one flattened vector; at most ``most`` per group.

    A patch gathers exactly size x size pixels.
    """
    keys = list(keys)
    good = pixels.where(all_finite(F.col("spectrum"))).select(*keys, "row", "col", "spectrum")
    spread = covering_tiles(good, keys, size, stride, F.lit(shape[0]), F.lit(shape[1]))
    ids = [*keys, "r0", "c0"]
    full = (
        spread.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size * size).drop("_n")
    )
    chosen = take_hashed(full, keys, hash_key(salt, *ids), ids, most)
    listed = F.sort_array(F.collect_list(F.struct("row", "col", "spectrum")))
    return spread.join(chosen, ids).groupBy(*ids).agg(
        F.flatten(F.transform(listed, lambda e: e["spectrum"])).alias("features")
    )


def patch_features(
    tiled: DataFrame, ids: Sequence[str], bands: Sequence[str], ratios: Sequence[tuple[str, str, str]], cap: float
) -> DataFrame:
    """Mean of the positive values per band, capped ratios of means; incomplete rows drop."""
    positive = lambda b: F.when(F.col(f"b_{b}") > 0, null_if_not_finite(F.col(f"b_{b}")))
    means = tiled.groupBy(*ids).agg(*[F.avg(positive(b)).alias(b) for b in bands])
    wide = means.select(
        *ids, *bands,
        *[F.least(F.try_divide(F.col(n), F.col(d)), F.lit(float(cap))).alias(name) for name, n, d in ratios],
    )
    return wide.dropna(subset=[*bands, *[name for name, _, _ in ratios]])


def patch_dataset(
    wide: DataFrame, height: int, width: int, min_pixels: int, max_patches: int, max_pixels: int, positive: str = "B"
) -> DataFrame:
    """Band values of the pixels of each kept patch, for both sides at once.

    ``wide`` holds (side, sample_id, grp, row, col, b_*).  Result adds the box, the
    patch id, and the label; pixels beyond ``max_pixels`` of a patch are sampled out.
    """

    keys = ["side", "sample_id"]
    boxes = top_patches(grid_boxes(wide, keys, height, width, min_pixels), keys, max_patches)
    tiled = tile_of(wide, height, width).join(boxes.drop("n_pixels", "rank"), [*keys, "r0", "c0"])
    ids = [*keys, "row", "col"]
    capped = take_hashed(tiled, [*keys, "patch_no"], hash_key("patch-pixels", *ids), ids, max_pixels)
    return capped.withColumn(
        "patch_id", F.format_string("%s_%s_p%02d", "side", "sample_id", "patch_no")
    ).withColumn("label", (F.col("grp") == positive).cast("int"))
