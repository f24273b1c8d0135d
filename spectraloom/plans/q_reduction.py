"""Queries over dimension reduction and clustering (K1-K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.functions import kernels
from spectraloom.operators import reduction as K
from spectraloom.operators.select import band_windows
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, N_BANDS, r, rounded, sql
from spectraloom.plans.q_select import HOLED, holed
from spectraloom.plans.q_spectra import _matrix_rows
from spectraloom.plans.registry import query
from spectraloom.session import new_path, settle
from spectraloom.sources.cubes import checked_clusters

PIX = ["sample_id", "row", "col"]


def reduced(spark, sf_dir, k=6):
    features = settle(K.assemble(X.selected_pixels(spark, sf_dir), N_BANDS, unit=True), "features")
    return K.principal_components(features, k)


@query("k1_principal_components")
def k1(spark, sf_dir):
    out, ratios = reduced(spark, sf_dir)
    explained = F.array(*[F.lit(v) for v in ratios])
    return out.select(*PIX, F.posexplode("pc").alias("component", "score")).withColumn("explained", explained[F.col("component")])


@query("k2_kmeans_labels")
def k2(spark, sf_dir):
    out, _ = reduced(spark, sf_dir)
    return K.cluster(settle(out.select(*PIX, "pc"), "pc"), 8).select(*PIX, "cluster")


_WINDOWS = band_windows(AXIS, [(1655.0, 30.0), (1080.0, 15.0)])


@query(
    "k3_feature_assembly",
    sql("spectra", f"""SELECT sample_id, row, col, count(*) AS n_features, {r('sum(v * (k + 1))', 'weighted', 5)} FROM (SELECT sample_id, row, col, i AS k, sum(x * w) AS v FROM
        (SELECT sample_id, row, col, unnest(range(64)) AS k, unnest(list_transform(spectrum, lambda x: x / (sqrt(list_sum(list_transform(spectrum, lambda y: y * y))) + 1e-12))) AS x FROM holed
          WHERE len(list_filter(spectrum, lambda z: NOT isfinite(z))) = 0)
        JOIN (VALUES {_matrix_rows(kernels.savgol_matrix(N_BANDS, 15, 2, 2))}) m(i, j, w) ON k = j WHERE i IN ({', '.join(map(str, _WINDOWS))}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", holed=HOLED),
)
def k3(spark, sf_dir):
    out = K.assemble(holed(spark, sf_dir), N_BANDS, derivative=True, bands=_WINDOWS, unit=True)
    long = out.select(*PIX, F.posexplode("features").alias("i", "v"))
    place = F.array(*[F.lit(i) for i in _WINDOWS])
    return long.groupBy(*PIX).agg(
        F.count(F.lit(1)).alias("n_features"), F.sum(F.col("v") * (place[F.col("i")] + 1)).alias("weighted")
    ).select(*PIX, "n_features", *rounded("weighted", digits=5))


@query(
    "k4_cluster_map",
    sql("spectra clusters", f"""SELECT sample_id, {', '.join(f"count(*) FILTER (c = {c}) AS mask_{c}" for c in (0, 1, 2, 9))}, count(*) AS n_pixels FROM
        (SELECT s.sample_id, coalesce(cluster, 9) AS c FROM spectra s LEFT JOIN (SELECT * FROM clusters WHERE cluster < 8) k USING (sample_id, row, col)) GROUP BY 1"""),
)
def k4(spark, sf_dir):
    labels = X.clusters(spark, sf_dir).where("cluster < 8")
    mapped = K.cluster_map(labels, X.spectra(spark, sf_dir).select(*PIX))
    return K.cluster_masks(mapped, [0, 1, 2, 9])


@query("k5_published_clusters")
def k5(spark, sf_dir):
    out, _ = reduced(spark, sf_dir, 3)
    labelled = K.cluster(settle(out.select(*PIX, "pc", "spectrum"), "pc"), 6)
    path = new_path(spark, "clusters")
    K.publish(labelled, path)
    back = spark.read.parquet(path)
    flat = back.select("sample_id", (F.col("row") * 25 + F.col("col")).alias("flat"), "cluster")
    return checked_clusters(flat, 25)
