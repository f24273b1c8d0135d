"""Folds, features, models and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.catalog import DEN_FLOOR, DEN_PERCENTILE, NUM_FLOOR, NUM_PERCENTILE
from spectraloom.functions.arrays import hash_key, is_finite, null_if_not_finite
from spectraloom.functions.text import safe_label
from spectraloom.operators.aggregate import summarise
from spectraloom.operators.scale import exact_quantiles, row_ordinals, running_totals
from spectraloom.operators.spectra import gathered
from spectraloom.operators.stats import delta_of, rank_counts
from spectraloom.session import settle


# ---- thresholds and features ------------------------------------------------
#: Rows (values per unit) up to which a cell is read by every split that asks for it.
OPEN_ROWS = 64
#: Parts into which a larger cell is cut.
PARTS = 16


def training_thresholds(bands: DataFrame, tests: DataFrame, cells: int = 64, open_rows: int = OPEN_ROWS) -> DataFrame:
    """M1: guard thresholds per (split, band) from the units a split does not test.

    ``bands`` is (unit_id, band, value), ``tests`` is (split_id, unit_id).  Hundreds
    of splits share nearly all their pixels, so the pixels are not copied per split:
    every band is cut at fixed values into cells, a split's cell counts are the sums
    of its units' counts, and only the cells that hold a wanted rank are opened.  Cells
    of more than ``open_rows`` rows are cut again, so what a split reads does not grow
    with the pixels.
    """
    values = bands.where(is_finite(F.col("value"))).select("unit_id", "band", F.col("value").alias("_v"))
    placed = _placed(values.withColumns({"_in": F.lit(0).cast("bigint"), "_c": F.lit(1).cast("bigint")}), cells)
    counts = settle(_cell_counts(placed), "cells")
    roles = settle(split_roles(counts.select("unit_id").distinct(), tests).where("role = 'train'").drop("role"), "train")
    held = counts.join(roles, "unit_id")
    sizes = held.groupBy("split_id", "band").agg(F.sum("_c").alias("_n"))
    asks = F.array(
        *[
            F.struct(F.lit(name).alias("_name"), (F.lit(p) * (F.col("_n") - 1)).alias("at"))
            for name, p in (("num", NUM_PERCENTILE), ("den", DEN_PERCENTILE))
        ]
    )
    asked = sizes.select("split_id", "band", F.inline(asks)).select(
        "split_id", "band", F.lit(0).cast("bigint").alias("_cell"), "_name", (F.col("at") - F.floor("at")).alias("_frac"),
        F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("_rank"), F.lit(0).cast("bigint").alias("_before"),
    )
    wanted = settle(_ranks_in_cells(asked, held), "ranks")
    while True:
        # values of an opened cell as counts per unit, so a split reads each value once
        needed = settle(wanted.select("split_id", "band", "_cell").distinct(), "needed")
        opened = settle(
            placed.join(needed.select("band", "_cell").distinct(), ["band", "_cell"], "left_semi")
            .groupBy("band", "_cell", "unit_id", "_v")
            .agg(F.sum("_c").alias("_c")),
            "opened",
        )
        sized = opened.groupBy("band", "_cell").agg(F.count(F.lit(1)).alias("rows"), (F.min("_v") < F.max("_v")).alias("several"))
        if not sized.where(F.col("several") & (F.col("rows") > open_rows)).take(1):
            break
        placed = _placed(opened.withColumnRenamed("_cell", "_in"), PARTS)
        held = (
            settle(_cell_counts(placed), "cells")
            .join(needed.withColumnRenamed("_cell", "_in"), ["band", "_in"])
            .join(roles, ["split_id", "unit_id"], "left_semi")
        )
        wanted = settle(_ranks_in_cells(wanted, held), "ranks")
    inside = (
        opened.join(needed, ["band", "_cell"])
        .join(roles, ["split_id", "unit_id"], "left_semi")
        .groupBy("split_id", "band", "_cell", "_v")
        .agg(F.sum("_c").alias("_c"))
    )
    run = Window.partitionBy("split_id", "band", "_cell").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    hits = inside.withColumn("_run", F.sum("_c").over(run)).join(wanted, ["split_id", "band", "_cell"]).where(
        (F.col("_rank") >= F.col("_before") + F.col("_run") - F.col("_c")) & (F.col("_rank") < F.col("_before") + F.col("_run"))
    )
    lo, hi = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    blended = hits.groupBy("split_id", "band", "_name").agg((lo + (hi - lo) * F.first("_frac")).alias("_q"))
    of = lambda name: F.max(F.when(F.col("_name") == name, F.col("_q")))
    return blended.groupBy("split_id", "band").agg(
        F.greatest(of("num"), F.lit(NUM_FLOOR)).alias("num_thr"), F.greatest(of("den"), F.lit(DEN_FLOOR)).alias("den_thr")
    )


def _placed(values: DataFrame, cells: int) -> DataFrame:
    """``values`` (band, _in, unit_id, _v, _c) with the ``_cell`` of each inside its cell ``_in``.

    The lowest value is a cut of its own: a cell of several values always falls apart.
    """
    marks = [i / cells for i in range(1, cells)]
    edges = settle(
        values.groupBy("band", "_in").agg(
            F.min("_v").alias("_low"), F.percentile_approx("_v", marks, 10 * cells).alias("_marks")
        ).select("band", "_in", F.array_prepend("_marks", F.col("_low")).alias("_edge")),
        "edges",
    )
    at = F.size(F.filter("_edge", lambda e: e < F.col("_v")))
    cell = F.col("_in") * (cells + 1) + at
    return values.join(edges, ["band", "_in"]).select("band", "_in", cell.alias("_cell"), "unit_id", "_v", "_c")


def _cell_counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("band", "_in", "unit_id", "_cell").agg(F.sum("_c").alias("_c"))


def _ranks_in_cells(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """``wanted`` ranks (split, band, _cell, ..., _before), each moved to the cell inside its cell that holds it.

    ``held`` has the counts of each split's training units.
    """
    outer = wanted.withColumnRenamed("_cell", "_in")
    order = Window.partitionBy("split_id", "band", "_in").orderBy("_cell")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        held.groupBy("split_id", "band", "_in", "_cell")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_upto", F.sum("_c").over(upto))
    )
    rank, before = F.col("_rank"), F.col("_before") + F.col("_upto") - F.col("_c")
    return (
        outer.join(summed, ["split_id", "band", "_in"])
        .where((rank >= before) & (rank < F.col("_before") + F.col("_upto")))
        .select("split_id", "band", "_cell", "_name", "_frac", "_rank", before.alias("_before"))
    )


def feature_table(
    values: DataFrame, ids: Sequence[str], item: str, items: Sequence[str], value: str = "value"
) -> DataFrame:
    """M2: four summary features per (unit, item), one column each, sorted by name.

    A unit without values for an item keeps NULL there.
    """
    s = summarise(values, [*ids, item], F.col(value))
    cols = []
    for name in items:
        at = F.col(item) == name
        stem = safe_label(name)
        cols += [
            F.max(F.when(at, F.col(src))).alias(f"{stem}_{tag}")
            for src, tag in (("med", "med"), ("iqr", "iqr"), ("mean", "mean"), ("std", "std"))
        ]
    wide = s.groupBy(*ids).agg(*cols)
    return wide.select(*ids, *sorted(c for c in wide.columns if c not in ids))


# ---- models -----------------------------------------------------------------
def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (2 * n_class) per row."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    w = n.crossJoin(F.broadcast(total)).select(label, (F.col("_n") / (2.0 * F.col("_c"))).alias("weight"))
    return df.join(w, label)


def standardiser(train: DataFrame, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """M3: the training rows' median fills gaps, then each feature is centred and divided by
    its population deviation (one where it is zero).  Three numbers per feature are kept.
    """
    med = exact_quantiles(
        train.select(F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features
        ])).alias("e")).select("e.f", "e.v"),
        ["f"], F.col("v"), {"med": 0.5},
    )
    median = {r.f: r.med for r in med.collect()}

    def filled(df: DataFrame, f: str) -> Column:
        return F.coalesce(null_if_not_finite(F.col(f).cast("double")), F.lit(median.get(f, 0.0)))

    moments = train.agg(
        *[F.avg(filled(train, f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(filled(train, f)).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    n = len(features)

    def apply(df: DataFrame) -> DataFrame:
        scaled = [
            ((filled(df, f) - F.lit(moments[i])) / F.lit(moments[n + i] or 1.0)).alias(f"{f}__scaled")
            for i, f in enumerate(features)
        ]
        columns = df.select("*", *scaled)
        return VectorAssembler(inputCols=[f"{f}__scaled" for f in features], outputCol="features").transform(columns)

    return apply


def classifier(model: str = "logistic", n_train: int = 100, seed: int = 123, max_iter: int = 5000, tol: float = 1e-4):
    """M3-M5: the estimator, with the iteration limit and tolerance of the workflow."""
    reg = 1.0 / max(n_train, 1)
    common = {"regParam": reg, "weightCol": "weight", "standardization": False, "maxIter": max_iter, "tol": tol}
    return {
        "logistic": lambda: LogisticRegression(**common),
        "svm": lambda: LinearSVC(**common),
        "forest": lambda: RandomForestClassifier(numTrees=100, seed=seed),
    }[model]()


def positive_probability(scored: DataFrame) -> DataFrame:
    """M6: class-1 probability, else the logistic of the decision score, else NULL."""
    if "probability" in scored.columns:
        prob = vector_to_array("probability")[1]
    elif "rawPrediction" in scored.columns:
        prob = squash(vector_to_array("rawPrediction")[1])
    else:
        prob = F.lit(None).cast("double")
    return scored.withColumn("prob", prob)


def squash(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def fit_predict(
    table: DataFrame, tests: DataFrame, features: Sequence[str], model: str = "logistic"
) -> DataFrame:
    """M3-M7: one fit per split on the units it does not test, predictions for those it does.

    The unit table (one row per unit) is settled once; each fit is a Spark ML job
    over it, so this loop runs over the split list only.
    """
    base = settle(table, "features")
    tests = settle(tests, "tests")
    splits = [x.split_id for x in tests.select("split_id").distinct().orderBy("split_id").collect()]
    out = None
    for split in splits:
        held = tests.where(F.col("split_id") == split).select("unit_id")
        train = settle(balanced_weights(remaining_units(base, held)), "train")
        prepared = standardiser(train, features)
        fitted = classifier(model, train.count()).fit(prepared(train))
        test = base.join(held, "unit_id", "left_semi").withColumn("weight", F.lit(1.0))
        scored = positive_probability(fitted.transform(prepared(test)))
        part = scored.select(
            F.lit(split).alias("split_id"), "unit_id", F.col("label").alias("y"), "prob",
            F.col("prediction").cast("int").alias("pred"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def cross_domain(
    table: DataFrame, train_side: str, test_side: str, features: Sequence[str], model: str = "logistic"
) -> DataFrame:
    """Fit on one side, predict the other, on the units both sides have."""
    common = common_units(
        table.where(F.col("side") == train_side).select("sample_id"),
        table.where(F.col("side") == test_side).select("sample_id"),
    )
    kept = table.join(common, "sample_id", "left_semi")
    train = balanced_weights(kept.where(F.col("side") == train_side))
    prepared = standardiser(train, features)
    fitted = classifier(model, train.count()).fit(prepared(train))
    test = kept.where(F.col("side") == test_side).withColumn("weight", F.lit(1.0))
    return positive_probability(fitted.transform(prepared(test))).select(
        "sample_id", F.col("label").alias("y"), "prob", F.col("prediction").cast("int").alias("pred")
    )


# ---- folds ------------------------------------------------------------------
def common_units(a: DataFrame, b: DataFrame) -> DataFrame:
    """Units present in both sets."""
    return a.intersect(b)


def remaining_units(units: DataFrame, test: DataFrame, key: str = "unit_id") -> DataFrame:
    """Units not in the test set."""
    return units.join(test, key, "left_anti")


def leave_one_out(units: DataFrame) -> DataFrame:
    """M7: test rows of one split per unit; what is not tested trains."""
    return units.select(F.col("unit_id").alias("split_id"), "unit_id")


def split_roles(units: DataFrame, tests: DataFrame) -> DataFrame:
    """Every split's test and training units as (split_id, unit_id, role).

    The unit list (samples, animals or patches, never pixels) is folded into one
    row, and each split takes what its test set leaves over.
    """
    everyone = units.agg(F.collect_set("unit_id").alias("_all"))
    left_out = tests.groupBy("split_id").agg(F.collect_set("unit_id").alias("_test"))
    train = left_out.crossJoin(F.broadcast(everyone)).select(
        "split_id", F.explode(F.array_except("_all", "_test")).alias("unit_id"), F.lit("train").alias("role")
    )
    return tests.select("split_id", "unit_id", F.lit("test").alias("role")).unionByName(train)


def _dealt(units: DataFrame, salt: str) -> DataFrame:
    hashed = units.withColumn("_h", hash_key(salt, "unit_id"))
    return row_ordinals(hashed, ["label"], ["_h", "unit_id"], "_at").drop("_h")


def stratified_folds(units: DataFrame, k: int, clip: bool = True, salt: str = "kfold") -> DataFrame:
    """M8: fold number per unit, classes dealt in turn; k shrinks to the smallest class.

    A class of one unit cannot be split and is an error.
    """
    if clip:
        smallest = units.groupBy("label").count().agg(F.min("count")).first()[0]
        if smallest is None or smallest < 2:
            raise ValueError(f"a class has {smallest or 0} units: folds need two at least")
        k = min(k, int(smallest))
    return _dealt(units, salt).withColumn("fold", F.pmod(F.col("_at") - 1, F.lit(k)).cast("int")).drop("_at")


def grouped_folds(units: DataFrame, k: int, group: str = "sample_id", salt: str = "group") -> DataFrame:
    """M9: whole samples go to one fold, classes balanced over samples."""
    groups = units.select(F.col(group).alias("unit_id"), "label").distinct()
    folds = stratified_folds(groups, k, salt=salt).select(F.col("unit_id").alias(group), "fold")
    return units.join(folds, group)


def holdout_splits(
    units: DataFrame, n_test: int = 2, n_splits: int | None = None, salt: str = "split", n_train: int = 0
) -> DataFrame:
    """All choices of ``n_test`` animals per class as test sets, numbered; optionally a subset.

    A test set grows by the later animals of its class, from a list of the class's animals.
    Each class must leave ``n_train`` animals for training.
    """
    sizes = {r.label: r.n for r in units.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label in (0, 1):
        if sizes.get(label, 0) < n_test + n_train:
            raise ValueError(f"class {label} has {sizes.get(label, 0)} units; {n_test} + {n_train} are needed")

    def choices(label: int, tag: str) -> DataFrame:
        u = units.where(F.col("label") == label).select(F.col("unit_id").alias("_u"))
        listed = u.agg(F.collect_set("_u").alias("_all"))
        sets = u.crossJoin(F.broadcast(listed)).select("_all", F.array("_u").alias("_set"))
        for _ in range(n_test - 1):
            last = F.element_at("_set", -1)
            sets = sets.select("_all", "_set", F.explode(F.filter("_all", lambda x: x > last)).alias("_u")).select(
                "_all", F.concat("_set", F.array("_u")).alias("_set")
            )
        return sets.select(*[F.col("_set")[i].alias(f"{tag}{i + 1}") for i in range(n_test)])

    names = [f"{tag}{i + 1}" for tag in "ab" for i in range(n_test)]
    second = choices(1, "b").agg(F.collect_list(F.struct(*names[n_test:])).alias("_b"))
    both = choices(0, "a").crossJoin(F.broadcast(second)).select(*names[:n_test], F.inline("_b"))
    if n_splits is not None:
        both = both.orderBy(hash_key(salt, *names)).limit(n_splits)
    return row_ordinals(both, [], names, "split_id")


def holdout_tests(splits: DataFrame) -> DataFrame:
    """The test rows (split_id, unit_id) of numbered splits."""
    names = [c for c in splits.columns if c != "split_id"]
    return splits.select("split_id", F.explode(F.array(*names)).alias("unit_id"))


def three_way_split(units: DataFrame, test: float = 0.1, val: float = 0.2, salt: str = "three") -> DataFrame:
    """Stratified test share, then a validation share of the rest."""
    placed = _dealt(units, salt)
    n = units.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.ceil(F.col("_n") * F.lit(test))
    n_val = F.ceil((F.col("_n") - n_test) * F.lit(val))
    role = F.when(F.col("_at") <= n_test, "test").when(F.col("_at") <= n_test + n_val, "val").otherwise("train")
    return placed.join(n, "label").withColumn("role", role).drop("_at", "_n")


# ---- scores -----------------------------------------------------------------
def binary_scores(preds: DataFrame, keys: Sequence[str], pred: Column) -> DataFrame:
    """Confusion counts and the scores that follow from them."""
    y = F.col("y")
    counts = preds.groupBy(*keys).agg(
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
    )
    return add_scores(counts)


def add_scores(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    scored = (
        counts.withColumn("accuracy", F.try_divide(tp + tn, tp + fp + tn + fn))
        .withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("specificity", F.try_divide(tn, tn + fp))
    )
    p, rec, spec = F.col("precision"), F.col("recall"), F.col("specificity")
    known = F.coalesce(rec, spec), F.coalesce(spec, rec)
    return (
        scored.withColumn("balanced_accuracy", (known[0] + known[1]) / 2)
        .withColumn("f1", F.try_divide(p * rec * 2.0, p + rec))
        .withColumn("youden", rec + spec - 1.0)
    )


def confusion_matrix(preds: DataFrame, keys: Sequence[str], pred: Column) -> DataFrame:
    """Counts and row-normalised shares of (y, pred)."""
    keys = list(keys)
    cells = preds.groupBy(*keys, "y", pred.cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    rows = preds.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("_n"))
    return cells.join(rows, [*keys, "y"]).withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def usable(preds: DataFrame) -> DataFrame:
    return preds.where(is_finite(F.col("prob")))


def roc_auc(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank-based AUC with ties; NULL below three scores or with one class."""
    c = rank_counts(usable(preds), keys, F.col("prob"), F.col("y") == 1)
    auc = (delta_of(F.col("u"), F.col("n_a"), F.col("n_b")) + 1.0) / 2.0
    n = F.col("n_a") + F.col("n_b")
    return c.select(*keys, n.alias("n"), F.when(n >= 3, auc).alias("auc"))


def score_steps(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M15 base: one row per distinct score, with positives and negatives at or above it."""
    keys = list(keys)
    y = F.col("y").cast("bigint")
    steps = usable(preds).groupBy(*keys, F.col("prob").alias("score")).agg(
        F.sum(y).alias("_p"), F.sum(1 - y).alias("_n")
    )
    falling = steps.withColumn("_down", -F.col("score"))
    run = running_totals(falling, keys, ["_down"], {"tp": F.col("_p"), "fp": F.col("_n")})
    totals = steps.groupBy(*keys).agg(F.sum("_p").alias("pos"), F.sum("_n").alias("neg"))
    return (run.join(totals, keys) if keys else run.crossJoin(F.broadcast(totals))).drop("_down")


def average_precision(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision averaged over recall steps."""
    gain = F.try_divide(F.col("_p"), F.col("pos")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    return steps.groupBy(*keys).agg(F.sum(gain).alias("ap"))


def curve_points(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC and PR points per distinct score."""
    return steps.select(
        *keys, "score",
        F.try_divide("fp", "neg").alias("fpr"),
        F.try_divide("tp", "pos").alias("tpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def pr_area(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid area under the PR points, starting at (recall 0, precision 1).

    The point before a step follows from its own counts, except its precision, which
    needs the cumulative counts just above: tp - p and fp - n.
    """
    tp0, fp0 = F.col("tp") - F.col("_p"), F.col("fp") - F.col("_n")
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    width = F.try_divide(F.col("_p"), F.col("pos"))
    return steps.groupBy(*keys).agg(F.sum(width * (prec + before) / 2.0).alias("pr_area"))


def mean_roc(preds: DataFrame, fold: str = "fold", grid: int = 201, min_folds: int = 2) -> DataFrame:
    """Mean and SD of the fold ROC curves on a fixed grid of false positive rates.

    Each segment between two ROC points covers a run of grid points, so a segment
    emits exactly those: the as-of join becomes an explode of the segment.
    """
    steps = settle(score_steps(preds, [fold]), "steps")
    steps = steps.where((F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("pos") + F.col("neg") >= 3))
    last = grid - 1
    f1, t1 = F.col("fp") / F.col("neg"), F.col("tp") / F.col("pos")
    f0 = (F.col("fp") - F.col("_n")) / F.col("neg")
    t0 = (F.col("tp") - F.col("_p")) / F.col("pos")
    segments = steps.select(fold, f0.alias("f0"), f1.alias("f1"), t0.alias("t0"), t1.alias("t1"))
    # grid points in (f0, f1]; a vertical step has none and its top is the next start
    first = F.floor(F.col("f0") * last + 1e-9) + 1
    final = F.floor(F.col("f1") * last + 1e-9)
    g = F.col("g")
    rise = segments.where(F.col("f1") > F.col("f0")).where(first <= final).select(
        fold, "f0", "f1", "t0", "t1", F.explode(F.sequence(first, final)).alias("g")
    ).select(
        fold, "g",
        (F.col("t0") + (F.col("t1") - F.col("t0")) * (g / float(last) - F.col("f0")) / (F.col("f1") - F.col("f0"))).alias("tpr"),
    )
    # curves that climb vertically at a grid point take the highest value reached there
    vertical = segments.where(F.col("f1") == F.col("f0")).select(
        fold, F.round(F.col("f1") * last, 9).alias("_x"), F.col("t1").alias("tpr")
    ).where(F.col("_x") == F.floor("_x")).select(fold, F.col("_x").cast("bigint").alias("g"), "tpr")
    start = steps.select(fold).distinct().select(fold, F.lit(0).cast("bigint").alias("g"), F.lit(0.0).alias("tpr"))
    per_fold = (
        rise.unionByName(vertical).where(F.col("g") > 0).groupBy(fold, "g").agg(F.max("tpr").alias("tpr")).unionByName(start)
    )
    return (
        per_fold.groupBy("g")
        .agg(F.avg("tpr").alias("_m"), F.stddev_samp("tpr").alias("sd_tpr"), F.count(F.lit(1)).alias("n_folds"))
        .where(F.col("n_folds") >= min_folds)
        .select(
            (g / float(last)).alias("fpr"),
            F.when(g == last, 1.0).otherwise(F.col("_m")).alias("mean_tpr"),
            "sd_tpr", "n_folds",
        )
    )


def mean_auc(preds: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and SD of the fold AUCs."""
    return roc_auc(preds, [fold]).agg(
        F.avg("auc").alias("mean_auc"), F.coalesce(F.stddev_samp("auc"), F.lit(0.0)).alias("sd_auc"),
        F.count("auc").alias("n_folds"),
    )


def threshold_table(preds: DataFrame, n: int = 181, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """All scores at each threshold.

    A prediction falls between two thresholds; counting those cells and summing
    upwards scores the whole grid without crossing predictions with thresholds.
    """
    step = (hi - lo) / (n - 1)
    spot = F.floor((F.col("prob") - lo) / step)
    # correct the floor where division and grid round differently
    grid = lambda i: F.when(i == n - 1, F.lit(hi)).otherwise(F.lit(lo) + i * F.lit(step))
    spot = F.when(F.col("prob") >= grid(spot + 1), spot + 1).when(F.col("prob") < grid(spot), spot - 1).otherwise(spot)
    inside = F.greatest(F.lit(-1), F.least(spot, F.lit(n - 1))).cast("int")
    cell = F.when(is_finite(F.col("prob")), inside).otherwise(-1)  # no score is a negative decision
    y = F.col("y").cast("bigint")
    counted = preds.groupBy(cell.alias("i")).agg(
        F.sum(y).alias("_p"), F.sum(1 - y).alias("_n")
    )
    every = preds.sparkSession.range(-1, n).select(F.col("id").cast("int").alias("i")).join(counted, "i", "left").fillna(0)
    # one row per threshold: bounded by the grid
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy()
    summed = every.select(
        "i",
        F.sum("_p").over(above).alias("tp"), F.sum("_n").over(above).alias("fp"),
        F.sum("_p").over(all_rows).alias("_tp"), F.sum("_n").over(all_rows).alias("_tn"),
    ).where(F.col("i") >= 0)
    counts = summed.select(
        grid(F.col("i")).alias("threshold"), "tp", "fp",
        (F.col("_tn") - F.col("fp")).alias("tn"), (F.col("_tp") - F.col("tp")).alias("fn"),
    )
    return add_scores(counts)


def best_threshold(table: DataFrame, metric: str = "balanced_accuracy", default: float = 0.5) -> DataFrame:
    """The smallest threshold with the best score; ``default`` where no score is defined."""
    known = F.when(is_finite(F.col(metric)), F.struct(F.round(metric, 12), -F.col("threshold")))
    best = F.coalesce(F.max_by(F.when(known.isNotNull(), F.col("threshold")), known), F.lit(default))
    return table.agg(best.alias("threshold"), F.max(metric).alias("score"))


def tuned_threshold(val: DataFrame, metric: str = "balanced_accuracy", min_auc: float = 0.5, fallback: float = 0.5) -> DataFrame:
    """The best threshold, or the fallback when validation ranks no better than chance."""
    best = best_threshold(threshold_table(val), metric, fallback)
    auc = roc_auc(val, [])
    return best.crossJoin(auc.select("auc")).select(
        F.when(F.col("auc") >= min_auc, F.col("threshold")).otherwise(fallback).alias("threshold"), "score", "auc"
    )


def heat_table(long: DataFrame, top: int = 40, ranking: DataFrame | None = None) -> DataFrame:
    """Median-filled z-scores of (unit, feature, value), for the leading features.

    ``ranking`` holds (feature, coefficient): the largest by size lead, ties by name.
    Without it the most variable features do.  Population moments are joined back per feature.
    """
    med = exact_quantiles(long, ["feature"], F.col("value"), {"_med": 0.5})
    filled = long.join(med, "feature").withColumn("_v", F.coalesce(null_if_not_finite(F.col("value")), "_med"))
    m = filled.groupBy("feature").agg(F.avg("_v").alias("_mu"), F.stddev_pop("_v").alias("_sd"))
    if ranking is None:
        m = m.withColumn("_lead", F.round(F.col("_sd") * F.col("_sd"), 15))
    else:
        m = m.join(ranking.select("feature", F.abs("coefficient").alias("_lead")), "feature")
    chosen = m.orderBy(F.desc("_lead"), "feature").limit(top)
    return filled.join(chosen, "feature").select(
        "unit_id", "feature", ((F.col("_v") - F.col("_mu")) / (F.col("_sd") + 1e-12)).alias("z")
    )


def train_normaliser(pixels: DataFrame, tiny: float = 1e-8) -> DataFrame:
    """One row of per-band mean and SD over the training pixels, tiny SDs set to one."""
    per_band = pixels.select(F.posexplode("spectrum").alias("k", "v")).groupBy("k").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("_sd")
    ).withColumn("sd", F.when(F.col("_sd") < tiny, 1.0).otherwise(F.col("_sd")))
    return gathered(per_band, [], "mean", "mu").crossJoin(F.broadcast(gathered(per_band, [], "sd", "sd")))


def apply_normaliser(pixels: DataFrame, norm: DataFrame) -> DataFrame:
    centred = F.zip_with("spectrum", "mu", lambda x, m: x - m)
    return pixels.crossJoin(F.broadcast(norm)).withColumn(
        "spectrum", F.zip_with(centred, "sd", lambda x, s: x / s)
    ).drop("mu", "sd")
