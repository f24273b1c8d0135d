"""The hold-out workflow: patches, features, all splits and side pairs fitted together, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.operators import bands as B
from spectraloom.operators import classify as M
from spectraloom.operators import holdout as H
from spectraloom.operators import patches as P
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, r, rounded, sql
from spectraloom.plans.q_classify import _SPLITS, BANDS, FEATURES, SCORES, animals
from spectraloom.plans.registry import query
from spectraloom.session import settle

#: Grid of the patches on the small stand-in, pixels a patch needs, patches a sample, pixels a patch.
HEIGHT, WIDTH, LEAST, MOST_PATCHES, MOST_PIXELS = 6, 12, 2, 100, 1500
SIDES = ("RIGHT", "LEFT")
PAIRS = [(a, b) for a in SIDES for b in SIDES]


def patch_table(spark, sf_dir):
    """One row per patch: side, animal, label and band features."""
    wide = B.band_columns(X.selected_pixels(spark, sf_dir), AXIS, ["side", "sample_id", "grp", "row", "col"])
    pixels = P.patch_dataset(settle(wide, "bands"), HEIGHT, WIDTH, LEAST, MOST_PATCHES, MOST_PIXELS)
    ids = ["side", "sample_id", "patch_id", "label"]
    table = M.feature_table(B.bands_long(pixels, ids), ids, "band", BANDS)
    return settle(table.withColumnRenamed("sample_id", "unit_id"), "patches")


def fitted(spark, sf_dir):
    table = patch_table(spark, sf_dir)
    tests = settle(M.holdout_tests(M.holdout_splits(animals(spark, sf_dir))), "tests")
    return H.fit_all(H.plan_fits(table, tests, PAIRS, FEATURES), table), table


_PATCHES = f"""SELECT side, sample_id, grp, least(count(*), {MOST_PATCHES}) AS n FROM (SELECT side, sample_id, grp, row // {HEIGHT} AS r, col // {WIDTH} AS c
    FROM selected GROUP BY ALL HAVING count(*) >= {LEAST}) GROUP BY ALL"""


@query(
    "w3_holdout_fits",
    sql("selected spectra samples", f"""SELECT a.side AS train_side, b.side AS test_side, split_id, CAST(a.n AS BIGINT) AS n_train, CAST(b.n AS BIGINT) AS n_test, 37 AS n_coef, {r('0', 'residual')} FROM
        (SELECT side, split_id, sum(n) AS n FROM p, splits WHERE sample_id NOT IN (a1, a2, b1, b2) GROUP BY ALL HAVING count(DISTINCT grp) = 2) a JOIN
        (SELECT side, split_id, sum(n) AS n FROM p, splits WHERE sample_id IN (a1, a2, b1, b2) GROUP BY ALL) b USING (split_id)""", p=_PATCHES, **_SPLITS),
)
def w3_fits(spark, sf_dir):
    fits, _ = fitted(spark, sf_dir)
    out = H.fit_table(spark, fits).withColumn("n_coef", F.size("coef"))
    return out.select("train_side", "test_side", "split_id", "n_train", "n_test", "n_coef", *rounded("residual"))


@query("w3_holdout_predictions")
def w3_predictions(spark, sf_dir):
    return H.predict_units(*fitted(spark, sf_dir))


@query("w3_holdout_scores")
def w3_scores(spark, sf_dir):
    """Animal-level scores of each side pair over all splits."""
    preds = settle(H.predict_units(*fitted(spark, sf_dir)), "predictions")
    return M.binary_scores(preds, ["train_side", "test_side"], F.col("pred")).select("train_side", "test_side", *SCORES)
