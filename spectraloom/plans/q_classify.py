"""Queries over folds, features, models and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spectraloom.catalog import BAND_LIBRARY
from spectraloom.operators import aggregate as G
from spectraloom.operators import bands as B
from spectraloom.operators import classify as M
from spectraloom.plans import fixtures as X
from spectraloom.plans.fixtures import AXIS, r, rounded, sql
from spectraloom.plans.q_bands import wide_bands
from spectraloom.plans.registry import query
from spectraloom.session import settle

#: All bands and, as in the workflow, five folds.
BANDS = [band for band, *_ in BAND_LIBRARY]
N_FOLDS = 5


def units(spark, sf_dir):
    """Labelled documents as units: 0/1 label, a sample they belong to."""
    return X.predictions(spark, sf_dir).select("unit_id", "sample_id", F.col("y").alias("label"))


def animals(spark, sf_dir):
    """Samples present in the pixel table, with label 1 for group B."""
    seen = X.spectra(spark, sf_dir).select("sample_id").distinct()
    return seen.join(X.samples(spark), "sample_id").select(
        F.col("sample_id").alias("unit_id"), (F.col("grp") == "B").cast("int").alias("label")
    )


def band_values(spark, sf_dir):
    long = B.bands_long(wide_bands(spark, sf_dir, ["sample_id"]), ["sample_id"])
    return long.select(F.col("sample_id").alias("unit_id"), "band", "value")


_SPLITS = {
    "u": "SELECT DISTINCT sample_id AS unit_id, grp FROM spectra JOIN samples USING (sample_id)",
    "splits": """SELECT row_number() OVER (ORDER BY a1, a2, b1, b2) AS split_id, * FROM
        (SELECT a.unit_id AS a1, b.unit_id AS a2 FROM u a JOIN u b ON a.grp = 'A' AND b.grp = 'A' AND a.unit_id < b.unit_id),
        (SELECT a.unit_id AS b1, b.unit_id AS b2 FROM u a JOIN u b ON a.grp = 'B' AND b.grp = 'B' AND a.unit_id < b.unit_id)""",
}


@query(
    "m1_training_thresholds",
    sql("bandpx spectra samples", f"""SELECT split_id, band, {r('greatest(quantile_cont(value, 0.15), 1e-4)', 'num_thr')}, {r('greatest(quantile_cont(value, 0.03), 1e-2)', 'den_thr')}
        FROM splits JOIN bandpx ON sample_id NOT IN (a1, a2, b1, b2) GROUP BY 1, 2""", **_SPLITS),
)
def m1(spark, sf_dir):
    tests = M.holdout_tests(M.holdout_splits(animals(spark, sf_dir)))
    out = M.training_thresholds(band_values(spark, sf_dir), settle(tests, "tests"))
    return out.select("split_id", "band", *rounded("num_thr", "den_thr"))


_FEATS = ", ".join(
    r(f"{e} FILTER (band = '{b}')" if "quantile" not in e else e.replace("F_", f"FILTER (band = '{b}')"), f'"{b}_{t}"')
    for b in BANDS
    for t, e in (("med", "median(value)"), ("iqr", "quantile_cont(value, 0.75) F_ - quantile_cont(value, 0.25) F_"), ("mean", "avg(value)"), ("std", "stddev_pop(value)"))
)


@query("m2_feature_table", sql("bandpx", f"SELECT sample_id AS unit_id, {_FEATS} FROM bandpx GROUP BY 1"))
def m2(spark, sf_dir):
    out = M.feature_table(band_values(spark, sf_dir), ["unit_id"], "band", BANDS)
    return out.select("unit_id", *rounded(*[c for c in out.columns if c != "unit_id"]))


def unit_table(spark, sf_dir):
    """One row per sample: label and band features."""
    f = M.feature_table(band_values(spark, sf_dir), ["unit_id"], "band", BANDS)
    return f.join(animals(spark, sf_dir), "unit_id")


FEATURES = [f"{b}_{t}" for b in BANDS for t in ("med", "iqr", "mean", "std")]


def document_table(spark, sf_dir):
    """One row per labelled document with simple numeric features, for the model queries."""
    d = X.table(spark, sf_dir, "documents")
    y = X.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    words = F.size(F.split("text", r"\s+")).cast("double")
    digits = F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double")
    return d.join(y, "doc_id").select(
        F.col("doc_id").cast("string").alias("unit_id"), (F.col("doc_id") % 14).alias("sample_no"), "label",
        F.log1p(F.col("n_chars").cast("double")).alias("f_len"),
        F.try_divide(digits, F.col("n_chars").cast("double")).alias("f_digits"),
        F.try_divide(F.col("n_chars").cast("double"), words).alias("f_word"),
        F.when(words > 3, words).alias("f_words"),
    )


DOC_FEATURES = ["f_len", "f_digits", "f_word", "f_words"]


def fold_tests(spark, sf_dir, k=N_FOLDS):
    return M.stratified_folds(units(spark, sf_dir), k).select(F.col("fold").alias("split_id"), "unit_id")


@query("m3_logistic_predictions")
def m3(spark, sf_dir):
    return M.fit_predict(document_table(spark, sf_dir), fold_tests(spark, sf_dir), DOC_FEATURES, "logistic")


@query("m4_linear_svm_predictions")
def m4(spark, sf_dir):
    return M.fit_predict(document_table(spark, sf_dir), fold_tests(spark, sf_dir), DOC_FEATURES, "svm")


@query("m5_forest_predictions")
def m5(spark, sf_dir):
    split = M.three_way_split(units(spark, sf_dir), test=0.2, val=0.0).where("role = 'test'")
    tests = split.select(F.lit(0).alias("split_id"), "unit_id")
    return M.fit_predict(document_table(spark, sf_dir), tests, DOC_FEATURES, "forest")


@query(
    "m6_positive_probability",
    sql("predictions", f"SELECT unit_id, {r('1 / (1 + exp(-(prob * 8 - 4)))', 'prob')} FROM predictions"),
)
def m6(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    score = F.col("prob") * 8 - 4
    raw = X.predictions(spark, sf_dir).select("unit_id", array_to_vector(F.array(-score, score)).alias("rawPrediction"))
    return M.positive_probability(raw).select("unit_id", *rounded("prob"))


@query(
    "m7_leave_one_out",
    sql("spectra", """SELECT s.sample_id AS split_id, u.sample_id AS unit_id, CASE WHEN s.sample_id = u.sample_id THEN 'test' ELSE 'train' END AS role
        FROM (SELECT DISTINCT sample_id FROM spectra) s, (SELECT DISTINCT sample_id FROM spectra) u"""),
)
def m7(spark, sf_dir):
    u = settle(animals(spark, sf_dir), "units")
    return M.split_roles(u, M.leave_one_out(u))


@query(
    "m8_stratified_folds",
    sql("predictions", """SELECT unit_id, y AS label, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', 'kfold', unit_id)), unit_id) - 1)
        % greatest(2, least(5, (SELECT min(n) FROM (SELECT count(*) AS n FROM predictions GROUP BY y)))) AS INT) AS fold FROM predictions"""),
)
def m8(spark, sf_dir):
    return M.stratified_folds(units(spark, sf_dir), 5).select("unit_id", "label", "fold")


@query(
    "m9_grouped_folds",
    sql("spectra samples", """SELECT sample_id, row, col, CAST((at_no - 1) % 5 AS INT) AS fold FROM spectra JOIN (SELECT sample_id, row_number() OVER (PARTITION BY grp
        ORDER BY md5(concat_ws('|', 'group', sample_id)), sample_id) AS at_no FROM (SELECT DISTINCT sample_id, grp FROM spectra JOIN samples USING (sample_id))) USING (sample_id)"""),
)
def m9(spark, sf_dir):
    px = X.spectra(spark, sf_dir).join(X.samples(spark), "sample_id").select(
        "sample_id", "row", "col", (F.col("grp") == "B").cast("int").alias("label")
    )
    return M.grouped_folds(px, 5).select("sample_id", "row", "col", "fold")


@query("m10_holdout_splits", sql("spectra samples", "SELECT * FROM splits", **_SPLITS))
def m10(spark, sf_dir):
    return M.holdout_splits(animals(spark, sf_dir))


@query(
    "m11_three_way_split",
    sql("predictions", """SELECT unit_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'test' WHEN rn <= ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * 0.2) THEN 'val' ELSE 'train' END AS role
        FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', 'three', unit_id)), unit_id) AS rn, (count(*) OVER (PARTITION BY y))::DOUBLE AS n FROM predictions)""").replace("0.1)", "0.1::DOUBLE)").replace("0.2)", "0.2::DOUBLE)"),
)
def m11(spark, sf_dir):
    return M.three_way_split(units(spark, sf_dir)).select("unit_id", "role")


@query("m12_cross_domain")
def m12(spark, sf_dir):
    keep = ["side", "sample_id"]
    wide = B.band_columns(X.selected_pixels(spark, sf_dir), AXIS, keep)
    table = M.feature_table(B.bands_long(wide, keep), keep, "band", BANDS)
    labelled = settle(table.join(animals(spark, sf_dir).withColumnRenamed("unit_id", "sample_id"), "sample_id"), "sides")
    return M.cross_domain(labelled, "RIGHT", "LEFT", FEATURES)


PRED = "CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END"
_COUNTS = f"""SELECT fold, count(*) FILTER (y = 1 AND {PRED} = 1) AS tp, count(*) FILTER (y = 0 AND {PRED} = 1) AS fp, count(*) FILTER (y = 0 AND {PRED} = 0) AS tn,
    count(*) FILTER (y = 1 AND {PRED} = 0) AS fn FROM predictions GROUP BY 1"""
_SCORES = f"""{r('(tp + tn) / (tp + fp + tn + fn)', 'accuracy')}, {r('tp / nullif(tp + fp, 0)', 'precision')}, {r('tp / nullif(tp + fn, 0)', 'recall')}, {r('tn / nullif(tn + fp, 0)', 'specificity')},
    {r('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')}, {r('2 * tp / nullif(2.0 * tp + fp + fn, 0)', 'f1')}, {r('tp / (tp + fn) + tn / (tn + fp) - 1', 'youden')}"""
SCORES = ["accuracy", "precision", "recall", "specificity", "balanced_accuracy", "f1", "youden"]


def predicted():
    return (F.col("prob") >= 0.5).cast("int")


@query("m13_binary_scores", sql("predictions", f"SELECT fold, tp, fp, tn, fn, {_SCORES} FROM c", c=_COUNTS))
def m13(spark, sf_dir):
    out = M.binary_scores(X.predictions(spark, sf_dir), ["fold"], predicted())
    return out.select("fold", "tp", "fp", "tn", "fn", *rounded(*SCORES))


@query(
    "m13_confusion_matrix",
    sql("predictions", f"""SELECT fold, y, pred, n, {r('n / sum(n) OVER (PARTITION BY fold, y)', 'share')} FROM
        (SELECT fold, y, CAST({PRED} AS INT) AS pred, count(*) AS n FROM predictions GROUP BY ALL)"""),
)
def m13b(spark, sf_dir):
    out = M.confusion_matrix(X.predictions(spark, sf_dir), ["fold"], predicted())
    return out.select("fold", "y", "pred", "n", *rounded("share"))


_STEPS = {
    "st": "SELECT fold, prob AS score, sum(y)::BIGINT AS p, sum(1 - y)::BIGINT AS n FROM predictions GROUP BY 1, 2",
    "run": """SELECT *, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp, sum(p) OVER (PARTITION BY fold) AS pos, sum(n) OVER (PARTITION BY fold) AS neg FROM st
        WINDOW w AS (PARTITION BY fold ORDER BY score DESC)""",
}


@query(
    "m14_auc_and_precision",
    sql("predictions", f"""SELECT fold, CAST(any_value(pos) + any_value(neg) AS BIGINT) AS n, {r('sum(n / neg * (tp - p / 2.0)) / any_value(pos)', 'auc')},
        {r('sum(p / pos * tp / (tp + fp))', 'ap')} FROM run GROUP BY 1""", **_STEPS),
)
def m14(spark, sf_dir):
    preds = X.predictions(spark, sf_dir)
    steps = settle(M.score_steps(preds, ["fold"]), "steps")
    out = M.roc_auc(preds, ["fold"]).join(M.average_precision(steps, ["fold"]), "fold")
    return out.select("fold", "n", *rounded("auc", "ap"))


@query(
    "m15_curve_points",
    sql("predictions", f"SELECT fold, {r('score', 'score')}, {r('fp / neg', 'fpr')}, {r('tp / pos', 'tpr')}, {r('tp / (tp + fp)', 'precision')} FROM run", **_STEPS),
)
def m15(spark, sf_dir):
    out = M.curve_points(M.score_steps(X.predictions(spark, sf_dir), ["fold"]), ["fold"])
    return out.select("fold", *rounded("score", "fpr", "tpr", "precision"))


@query(
    "m15_pr_area",
    sql("predictions", f"""SELECT fold, {r('sum((rec - prec_rec) * (pr + prec_pr) / 2)', 'pr_area')} FROM (SELECT *, coalesce(lag(rec) OVER w, 0) AS prec_rec, coalesce(lag(pr) OVER w, 1) AS prec_pr
        FROM (SELECT fold, score, tp / pos AS rec, tp / (tp + fp) AS pr FROM run) WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) GROUP BY 1""", **_STEPS),
)
def m15b(spark, sf_dir):
    steps = M.score_steps(X.predictions(spark, sf_dir), ["fold"])
    return M.pr_area(steps, ["fold"]).select("fold", *rounded("pr_area"))


@query(
    "m16_mean_roc",
    sql("predictions", f"""SELECT {r('g / 200.0::DOUBLE', 'fpr')}, {r('CASE WHEN g = 200 THEN 1 ELSE avg(tpr) END', 'mean_tpr')}, {r('stddev_samp(tpr)', 'sd_tpr')}, count(*) AS n_folds FROM
        (SELECT fold, g, CASE WHEN g = 0 THEN 0 ELSE coalesce(t0 + (t1 - t0) * (x - f0) / nullif(f1 - f0, 0), t0) END AS tpr FROM
          (SELECT fold, g, x, max(fpr) FILTER (fpr <= x + 1e-9) AS f0, max(tpr) FILTER (fpr <= x + 1e-9) AS t0, min(fpr) FILTER (fpr > x + 1e-9) AS f1, min(tpr) FILTER (fpr > x + 1e-9) AS t1
          FROM pts, (SELECT g, g / 200.0::DOUBLE AS x FROM range(201) t(g)) GROUP BY 1, 2, 3)) GROUP BY g""",
        **_STEPS, pts="SELECT fold, fp / neg AS fpr, tp / pos AS tpr FROM run UNION ALL SELECT DISTINCT fold, 0.0, 0.0 FROM run"),
)
def m16(spark, sf_dir):
    out = M.mean_roc(X.predictions(spark, sf_dir))
    return out.select(*rounded("fpr", "mean_tpr", "sd_tpr"), "n_folds")


@query(
    "m16_mean_auc",
    sql("predictions", f"""SELECT {r('avg(auc)', 'mean_auc')}, {r('stddev_samp(auc)', 'sd_auc')}, count(*) AS n_folds FROM
        (SELECT fold, sum(n / neg * (tp - p / 2.0)) / any_value(pos) AS auc FROM run GROUP BY 1)""", **_STEPS),
)
def m16b(spark, sf_dir):
    out = M.mean_auc(X.predictions(spark, sf_dir))
    return out.select(*rounded("mean_auc", "sd_auc"), "n_folds")


_THR = {
    "c": """SELECT thr AS threshold, count(*) FILTER (y = 1 AND prob >= thr) AS tp, count(*) FILTER (y = 0 AND prob >= thr) AS fp, count(*) FILTER (y = 0 AND prob < thr) AS tn,
        count(*) FILTER (y = 1 AND prob < thr) AS fn FROM predictions, (SELECT CASE WHEN i = 180 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180) END AS thr FROM range(181) t(i)) GROUP BY 1""",
}


@query("m17_threshold_search", sql("predictions", f"SELECT {r('threshold', 'threshold')}, tp, fp, tn, fn, {_SCORES} FROM c", **_THR))
def m17(spark, sf_dir):
    out = M.threshold_table(X.predictions(spark, sf_dir))
    return out.select(*rounded("threshold"), "tp", "fp", "tn", "fn", *rounded(*SCORES))


@query(
    "m17_best_threshold",
    sql("predictions", f"""SELECT {r('threshold', 'threshold')}, {r('s', 'score')} FROM (SELECT threshold, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS s FROM c) ORDER BY round(s, 12) DESC, threshold LIMIT 1""", **_THR).replace(
        "SELECT round", "SELECT * FROM (SELECT round", 1) + ")",
)
def m17b(spark, sf_dir):
    out = M.tuned_threshold(X.predictions(spark, sf_dir), min_auc=0.0)
    return out.select(*rounded("threshold", "score"))


@query(
    "m18_heat_table",
    sql("bandpx", f"""SELECT unit_id, feature, {r('(v - mu) / (sd + 1e-12)', 'z', 5)} FROM (SELECT *, avg(v) OVER (PARTITION BY feature) AS mu, stddev_pop(v) OVER (PARTITION BY feature) AS sd FROM
        (SELECT unit_id, feature, coalesce(v, median(v) OVER (PARTITION BY feature)) AS v FROM (SELECT sample_id AS unit_id, band AS feature, CASE WHEN sample_id = 'T4' AND band = 'ch2' THEN NULL ELSE median(value) END AS v FROM bandpx GROUP BY 1, 2)))"""),
)
def m18(spark, sf_dir):
    from spectraloom.operators.scale import exact_quantiles

    med = exact_quantiles(band_values(spark, sf_dir), ["unit_id", "band"], F.col("value"), {"v": 0.5})
    gap = (F.col("unit_id") == "T4") & (F.col("band") == "ch2")
    long = med.select("unit_id", F.col("band").alias("feature"), F.when(~gap, F.col("v")).alias("value"))
    return M.heat_table(settle(long, "features"), 40).select("unit_id", "feature", *rounded("z", digits=5))


@query(
    "m19_train_normaliser",
    sql("spectra", f"""SELECT sample_id, row, col, {r('sum((v - mu) / sd)', 'total', 5)}, {r('max((v - mu) / sd)', 'top', 5)} FROM l JOIN (SELECT k, avg(v) AS mu, stddev_pop(v) AS sd FROM l WHERE side = 'RIGHT' GROUP BY 1) USING (k)
        WHERE side = 'LEFT' GROUP BY 1, 2, 3""", l="SELECT sample_id, side, row, col, unnest(range(64)) AS k, unnest(spectrum) AS v FROM spectra"),
)
def m19(spark, sf_dir):
    px = X.spectra(spark, sf_dir)
    norm = M.train_normaliser(px.where("side = 'RIGHT'"))
    out = M.apply_normaliser(px.where("side = 'LEFT'"), settle(norm, "norm"))
    total = F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", "row", "col", total.alias("total"), F.array_max("spectrum").alias("top")).select(
        "sample_id", "row", "col", *rounded("total", "top", digits=5)
    )


@query(
    "m19_class_weights",
    sql("predictions", f"SELECT label, n, {r('t / (2.0 * n)', 'weight')} FROM (SELECT y AS label, count(*) AS n FROM predictions GROUP BY 1), (SELECT count(*) AS t FROM predictions)"),
)
def m19b(spark, sf_dir):
    out = M.balanced_weights(units(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
    return out.select("label", "n", *rounded("weight"))


@query("h3_coefficient_ranking")
def h3(spark, sf_dir):
    table = M.balanced_weights(settle(unit_table(spark, sf_dir), "units"))
    model = M.classifier("logistic", 14).fit(M.standardiser(table, FEATURES)(table))
    # one number per feature
    rows = [(f, float(c)) for f, c in zip(FEATURES, model.coefficients)]
    return G.rank_by_magnitude(spark.createDataFrame(rows, "feature string, coefficient double"), "coefficient", 12)
