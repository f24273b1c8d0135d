"""Spectral similarity between samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.arrays import dot, hash_key, hex_to_long, l2_norm
from spectraloom.operators.aggregate import mean_spectrum, median_spectrum
from spectraloom.operators.scale import exact_quantiles, row_ordinals
from spectraloom.operators.select import PIXEL
from spectraloom.operators.spectra import gathered, normalise
from spectraloom.session import settle


def pair_class(ga: Column, gb: Column, first: str = "A", second: str = "B") -> Column:
    """Within-group classes keep their label, mixed pairs get one class."""
    return F.when(ga == gb, F.concat_ws("-", ga, gb)).otherwise(f"{first}-{second}")


def sample_pairs(samples: DataFrame, ordered: bool = False, with_self: bool = False) -> DataFrame:
    """Sample pairs, i<j by default.

    The sample list is one row; each sample picks its partners from it, so the pairs
    exist before any pixel is touched and no table is crossed with another.
    """
    listed = samples.agg(F.collect_set(F.struct("sample_id", "grp")).alias("_all"))
    a = F.col("a")

    def partner(e: Column) -> Column:
        b = e["sample_id"]
        wanted = (b != a) if ordered else (b > a)
        return (wanted | (b == a)) if with_self else wanted

    return (
        samples.select(F.col("sample_id").alias("a"), F.col("grp").alias("grp_a"))
        .crossJoin(F.broadcast(listed))
        .select("a", "grp_a", F.explode(F.filter("_all", partner)).alias("_p"))
        .select("a", "grp_a", F.col("_p.sample_id").alias("b"), F.col("_p.grp").alias("grp_b"))
        .withColumn("pair_class", pair_class(F.col("grp_a"), F.col("grp_b")))
    )


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), l2_norm(x) * l2_norm(y))


def pooled_means(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean over all pixel-by-pixel cosines, per pair and pooled per class.

    The mean of all cosines of two samples is the dot product of their mean unit
    vectors, so no pixel pair is ever formed; pooling weighs pairs by their counts.
    """
    counts = pixels.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    weighed = (
        mean_cosines(pixels, pairs)
        .join(counts.select(F.col("sample_id").alias("a"), F.col("n").alias("n_a")), "a")
        .join(counts.select(F.col("sample_id").alias("b"), F.col("n").alias("n_b")), "b")
        .withColumn("_w", F.col("n_a").cast("double") * F.col("n_b"))
    )
    return weighed.groupBy("pair_class").agg(
        (F.sum(F.col("cos") * F.col("_w")) / F.sum("_w")).alias("mean_cos"),
        F.sum("_w").cast("bigint").alias("n_cosines"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def cosine_histogram(
    pixels: DataFrame, pairs: DataFrame, bins: int, absolute: bool = False, block: int = 512
) -> DataFrame:
    """Distribution of all pixel-by-pixel cosines per pair class, as bin counts.

    Its input is the capped pixel set (E1).  Pixels travel in blocks; each block
    pair is one small matrix product that leaves only its bin counts behind.
    """
    unit = normalise(pixels, "l2").select("sample_id", "spectrum", hash_key("block", "sample_id", "row", "col").alias("_h"))
    sizes = unit.groupBy("sample_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    cut = unit.join(sizes, "sample_id").withColumn("_block", F.pmod(hex_to_long(F.col("_h")), F.col("_blocks")))
    # a block holds about ``block`` spectra, whatever its sample holds
    blocks = cut.groupBy("sample_id", "_block").agg(
        F.flatten(F.collect_list("spectrum")).alias("_m"), F.count(F.lit(1)).alias("_n")
    )
    left = blocks.select(F.col("sample_id").alias("a"), F.col("_m").alias("x"), F.col("_n").alias("nx"))
    right = blocks.select(F.col("sample_id").alias("b"), F.col("_m").alias("y"), F.col("_n").alias("ny"))
    met = pairs.select("a", "b", "pair_class").join(left, "a").join(right, "b")

    def count(batches):
        for pdf in batches:
            for c, x, nx, y, ny in zip(pdf.pair_class, pdf.x, pdf.nx, pdf.y, pdf.ny):
                cos = np.asarray(x).reshape(nx, -1) @ np.asarray(y).reshape(ny, -1).T
                cos = np.abs(cos) if absolute else cos
                at = np.clip(np.floor((cos + 1.0) / 2.0 * bins), 0, bins - 1).astype(int)
                n = np.bincount(at.ravel(), minlength=bins)
                yield pd.DataFrame({"pair_class": c, "bin": np.arange(bins, dtype=np.int32), "n": n.astype(np.int64)})

    counted = met.select("pair_class", "x", "nx", "y", "ny").mapInPandas(count, "pair_class string, bin int, n bigint")
    return counted.groupBy("pair_class", "bin").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def mean_vectors(pixels: DataFrame, keys: Sequence[str], reducer: str = "mean") -> DataFrame:
    """One representative spectrum per group, mean or median."""
    if reducer == "median":
        return gathered(median_spectrum(pixels, keys), keys, "median")
    return gathered(mean_spectrum(pixels, keys), keys, "mean")


def vector_cosines(vectors: DataFrame, pairs: DataFrame, unit: bool = False) -> DataFrame:
    """Cosine of representative spectra; plain dot product with ``unit``."""
    left = vectors.select(F.col("sample_id").alias("a"), F.col("spectrum").alias("_x"))
    right = vectors.select(F.col("sample_id").alias("b"), F.col("spectrum").alias("_y"))
    c = dot(F.col("_x"), F.col("_y")) if unit else cosine(F.col("_x"), F.col("_y"))
    return pairs.join(left, "a").join(right, "b").withColumn("cos", c).drop("_x", "_y")


def mean_cosines(pixels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean of all pixel cosines as the dot product of mean unit vectors: O(n), exact."""
    return vector_cosines(mean_vectors(normalise(pixels, "l2"), ["sample_id"]), pairs, unit=True)


def sampled_cosines(pixels: DataFrame, pairs: DataFrame, max_pairs: int, salt: str = "cosine") -> DataFrame:
    """I4: cosines of randomly drawn pixel pairs per sample pair.

    Draws are made on pixel ordinals, which carry keys only; spectra are fetched
    just for the pixels some draw asked for.
    """
    placed = settle(row_ordinals(pixels.select(*PIXEL), ["sample_id"], ["row", "col"], "at"), "ordinals")
    sizes = settle(placed.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counted = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    wanted = F.least(F.lit(max_pairs).cast("double"), F.col("n_a").cast("double") * F.col("n_b"))
    draws = counted.select(
        "a", "b", "pair_class", "n_a", "n_b", F.explode(F.sequence(F.lit(1), wanted.cast("int"))).alias("draw")
    )
    pick = lambda side, n: F.pmod(hex_to_long(hash_key(f"{salt}-{side}", "a", "b", "draw")), F.col(n)) + 1
    draws = settle(draws.withColumn("at_a", pick("a", "n_a")).withColumn("at_b", pick("b", "n_b")).drop("n_a", "n_b"), "draws")
    asked = draws.select(F.col("a").alias("sample_id"), F.col("at_a").alias("at")).unionByName(
        draws.select(F.col("b").alias("sample_id"), F.col("at_b").alias("at"))
    ).distinct()
    keys = settle(placed.join(asked, ["sample_id", "at"]), "asked")
    unit = normalise(pixels.select(*PIXEL, "spectrum").join(keys, PIXEL), "l2")
    side = lambda s, v: unit.select(
        F.col("sample_id").alias(s), F.col("at").alias(f"at_{s}"), F.col("spectrum").alias(v)
    )
    met = draws.join(side("a", "_x"), ["a", "at_a"]).join(side("b", "_y"), ["b", "at_b"])
    return met.select("a", "b", "pair_class", "draw", dot(F.col("_x"), F.col("_y")).alias("cos"))


def median_matrix(cosines: DataFrame, samples: DataFrame) -> DataFrame:
    """Median cosine per pair, mirrored, with ones on the diagonal."""
    half = exact_quantiles(cosines, ["a", "b"], F.col("cos"), {"cos": 0.5}).where(F.col("a") != F.col("b"))
    mirror = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")
    diagonal = samples.select(F.col("sample_id").alias("a"), F.col("sample_id").alias("b"), F.lit(1.0).alias("cos"))
    return half.unionByName(mirror).unionByName(diagonal)


def centroid_margins(vectors: DataFrame, samples: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Angle of each sample to the two group centroids, and their difference in mrad.

    Every sample weighs the same in its group's centroid.  Positive leans to ``a``.
    """
    known = vectors.join(samples.select("sample_id", "grp"), "sample_id")
    centroids = gathered(mean_spectrum(known, ["grp"]), ["grp"], "mean", "_c")
    both = centroids.groupBy().pivot("grp", [a, b]).agg(F.first("_c"))
    angle = lambda c: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * 1000.0
    return (
        known.crossJoin(F.broadcast(both))
        .withColumn("cos_a", cosine(F.col("spectrum"), F.col(a)))
        .withColumn("cos_b", cosine(F.col("spectrum"), F.col(b)))
        .withColumn("angle_a", angle(F.col("cos_a")))
        .withColumn("angle_b", angle(F.col("cos_b")))
        .withColumn("margin", F.col("angle_b") - F.col("angle_a"))
        .select("sample_id", "grp", "cos_a", "cos_b", "angle_a", "angle_b", "margin")
    )


def split_group(margins: DataFrame, group: str = "B", a: str = "A") -> DataFrame:
    """Members of a group that lean to their own centroid, and those that do not."""
    return margins.where((F.col("grp") == group) & F.col("margin").isNotNull()).withColumn(
        "leaning", F.when(F.col("margin") < 0, f"{group}-like").otherwise(f"{a}-like")
    )


def log_distance(cos: Column, eps: float = 1e-6) -> Column:
    """I8: log10 of the cosine distance, floored at eps."""
    return F.log10(F.greatest(F.lit(1.0) - cos, F.lit(eps)))
