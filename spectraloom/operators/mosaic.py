"""Tile mosaics and photon images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.scale import row_ordinals
from spectraloom.session import settle


def place_tiles(
    positions: DataFrame, pixel_um: float, tile_h: int, tile_w: int, serpentine: bool = False
) -> DataFrame:
    """Mosaic offset of each tile: grid rows downwards, tiles by descending x.

    ``serpentine`` reverses only even rows, as a stage that snakes would need.
    """
    x = F.bround(F.col("x") / pixel_um)
    across = -x
    if serpentine:
        across = F.when(F.col("grid_row") % 2 == 0, -x).otherwise(x)
    keyed = positions.withColumn("_across", across)
    placed = row_ordinals(keyed, ["grid_row"], ["_across", "idx"], "_at")
    return placed.select(
        "idx", "grid_row",
        ((F.col("_at") - 1) * tile_w).cast("int").alias("x0"),
        (F.col("grid_row") * tile_h).cast("int").alias("y0"),
    )


def stitch(tiles: DataFrame, placed: DataFrame, tile_h: int, tile_w: int) -> DataFrame:
    """Tile pixels in mosaic coordinates; missing and wrong-sized tiles stay blank (absent)."""
    whole = (
        tiles.groupBy("idx")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("row").alias("_r"), F.max("col").alias("_c"))
        .where((F.col("_n") == tile_h * tile_w) & (F.col("_r") == tile_h - 1) & (F.col("_c") == tile_w - 1))
        .select("idx")
    )
    return tiles.join(whole, "idx", "left_semi").join(placed, "idx").select(
        (F.col("y0") + F.col("row")).alias("row"), (F.col("x0") + F.col("col")).alias("col"), "value"
    )


def project_photons(photons: DataFrame, how: str = "max", scale: str = "linear") -> DataFrame:
    """Collapse the time bins of each pixel, remove the file's minimum, stretch to 16 bits.

    ``linear`` scales the brightest pixel to 65535, ``gamma`` applies x^0.75 * 2500.
    The result wraps to 16 unsigned bits as an integer cast does.
    """
    collapsed = photons.groupBy("file", "row", "col").agg(
        (F.max("n") if how == "max" else F.sum("n")).cast("double").alias("_v")
    )
    collapsed = settle(collapsed, "collapsed")  # one value per pixel, read for the bounds and for the stretch
    bounds = settle(collapsed.groupBy("file").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "bounds")
    v = F.col("_v") - F.col("_lo")
    span = F.col("_hi") - F.col("_lo")
    stretched = F.pow(v, F.lit(0.75)) * 2500.0 if scale == "gamma" else F.coalesce(F.try_divide(v, span) * 65535.0, F.lit(0.0))
    return collapsed.join(bounds, "file").select(
        "file", "row", "col", F.pmod(F.floor(stretched), F.lit(65536)).cast("int").alias("value")
    )


def serpentine_number(row: Column, col: Column, n_cols: int) -> Column:
    """Running number on a full grid whose even rows run right to left.

    A closed form, so no ordering of the grid is needed.
    """
    across = F.when(row % 2 == 0, n_cols - 1 - col).otherwise(col)
    return row.cast("bigint") * n_cols + across + 1


def serpentine_sparse(cells: DataFrame, name: str = "number", keys: Sequence[str] = ()) -> DataFrame:
    """N3 on a grid with holes: positions among the cells that exist, per grid named by ``keys``."""
    keyed = cells.withColumn("_across", F.when(F.col("row") % 2 == 0, -F.col("col")).otherwise(F.col("col")))
    return row_ordinals(keyed, list(keys), ["row", "_across"], name).drop("_across")


def tile_lines(files: DataFrame, positions: DataFrame) -> DataFrame:
    """The k-th tile file (by name) with the k-th XY position, as configuration lines."""
    named = row_ordinals(files.select("name"), [], ["name"], "k")
    placed = row_ordinals(positions.select("idx", "x", "y"), [], ["idx"], "k")
    return named.join(placed, "k").select(
        "k", F.format_string("%s; ; (%s,%s)", "name", F.col("x").cast("string"), F.col("y").cast("string")).alias("line")
    )
