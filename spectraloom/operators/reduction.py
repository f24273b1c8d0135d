"""Dimension reduction and clustering (K1-K5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.arrays import all_finite, l2_norm, pick
from spectraloom.operators.spectra import normalise, savgol


def assemble(
    pixels: DataFrame, z: int, derivative: bool = False, bands: Sequence[int] | None = None,
    unit: bool = False, window: int = 15, order: int = 2,
) -> DataFrame:
    """K3: finite (and, for unit spectra, non-zero) pixels with their feature array."""
    out = pixels.where(all_finite(F.col("spectrum")))
    if unit:
        out = normalise(out.where(l2_norm(F.col("spectrum")) > 0), "l2")
    if derivative:
        out = savgol(out, z, window, order, 2)
    feature = F.col("spectrum") if bands is None else pick(F.col("spectrum"), bands)
    return out.withColumn("features", feature)


def principal_components(features: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """K1: centred projections as array ``pc``, and the explained variance ratios."""
    vectors = features.withColumn("_x", array_to_vector("features"))
    scaler = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(vectors)
    centred = scaler.transform(vectors)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    out = model.transform(centred).withColumn("pc", vector_to_array("_p")).drop("_x", "_c", "_p")
    return out, [float(v) for v in model.explainedVariance.toArray()]


def cluster(reduced: DataFrame, k: int, seed: int = 42, column: str = "pc") -> DataFrame:
    """K2: k-means labels in ``cluster``."""
    vectors = reduced.withColumn("_x", array_to_vector(column))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("_x")


def cluster_map(labels: DataFrame, grid: DataFrame, filler: int = 9) -> DataFrame:
    """K4: labels on the full pixel grid, ``filler`` where a pixel has none."""
    keys = ["sample_id", "row", "col"]
    return grid.join(labels.select(*keys, "cluster"), keys, "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(filler))
    )


def cluster_masks(mapped: DataFrame, clusters: Sequence[int]) -> DataFrame:
    """K4: pixel counts of one mask per cluster."""
    return mapped.groupBy("sample_id").agg(
        *[F.count_if(F.col("cluster") == c).alias(f"mask_{c}") for c in clusters], F.count(F.lit(1)).alias("n_pixels")
    )


def publish(labelled: DataFrame, path: str) -> None:
    """K5: labels, reduced coordinates and spectra, partitioned by sample for later scans."""
    columns = [c for c in ("sample_id", "row", "col", "cluster", "pc", "spectrum") if c in labelled.columns]
    labelled.select(*columns).write.partitionBy("sample_id").parquet(path)
