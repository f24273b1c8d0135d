"""All hold-out fits of a workflow at once (M3, M4's role masks, M10, F9).

Hundreds of splits train on nearly the same rows, so rows are neither copied nor scanned per
split.  A fit is a row of a mask (which animals it tests) and a vector of coefficients.  One pass
over the table gives the loss, gradient and Hessian of every fit as sums over batches of rows; the
Newton steps are solved in tasks that each hold a block of fits, and only the coefficients come to
the driver.  Gaps and scaling differ by fit as well: with z the scaled row, with zeros for gaps,
and g its gap marks, the row of fit f is T_f (1, z, g), so that all sums are taken once over (1, z, g).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions.arrays import null_if_not_finite
from spectraloom.operators.scale import exact_quantiles

FIT_BLOCK = 64
ROWS_AT_ONCE = 512


@dataclass
class Fits:
    """Splits times side pairs, with what every fit needs; a few hundred numbers each."""

    features: list[str]
    units: list[str]
    train_side: np.ndarray
    test_side: np.ndarray
    split: np.ndarray
    tests: np.ndarray  # fits x units
    trains: np.ndarray
    base: np.ndarray  # 2 x features: mean and deviation of all rows
    gaps: list[int] = field(default_factory=list)  # features with gaps
    mean: np.ndarray | None = None  # fits x features, in units of base
    scale: np.ndarray | None = None
    fill: np.ndarray | None = None
    weight: np.ndarray | None = None  # fits x 2: of a row by its label
    rows: np.ndarray | None = None  # fits x 2: training and test rows
    coef: np.ndarray | None = None  # fits x (1 + features)
    residual: np.ndarray | None = None  # largest absolute entry of the gradient

    def design(self, of: slice) -> np.ndarray:
        """T_f of some fits: (1 + features) x (1 + features + gaps)."""
        d, g = len(self.features), len(self.gaps)
        t = np.zeros((len(self.split[of]), 1 + d, 1 + d + g))
        t[:, 0, 0] = 1
        j = np.arange(d)
        t[:, 1 + j, 1 + j] = 1 / self.scale[of]
        t[:, 1 + j, 0] = -self.mean[of] / self.scale[of]
        for k, i in enumerate(self.gaps):
            t[:, 1 + i, 1 + d + k] = self.fill[of, i] / self.scale[of, i]
        return t

    def raw(self, coef: np.ndarray) -> np.ndarray:
        """Coefficients of (1, z, g): fits x columns."""
        out = np.zeros((len(coef), 1 + len(self.features) + len(self.gaps)))
        for s in range(0, len(coef), FIT_BLOCK):
            of = slice(s, s + FIT_BLOCK)
            out[of] = np.einsum("fda,fd->fa", self.design(of), coef[of])
        return out


def plan_fits(table: DataFrame, tests: DataFrame, pairs: Sequence[tuple[str, str]], features: Sequence[str]) -> Fits:
    """Fits for every split (split_id, unit_id of its test animals) and (training, test) side pair.

    ``table`` has side, unit_id, label (0/1) and the feature columns.  A pair uses the animals that
    both sides have; splits that test another one, and fits whose training rows lack a class or
    whose test rows are empty, are left out, as in the workflow.
    """
    features = list(features)
    value = [null_if_not_finite(F.col(f).cast("double")) for f in features]
    moments = table.groupBy("side", "unit_id", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.count(v) for v in value]).alias("k"),
        F.array(*[F.avg(v) for v in value]).alias("m"),
        F.array(*[F.var_pop(v) for v in value]).alias("v"),
    )
    rows = moments.toArrow().to_pylist()  # one row per side, animal and label
    listed: dict[int, set[str]] = {}
    for r in tests.select("split_id", "unit_id").toArrow().to_pylist():
        listed.setdefault(int(r["split_id"]), set()).add(r["unit_id"])
    units = sorted({r["unit_id"] for r in rows})
    place = {u: i for i, u in enumerate(units)}
    numbers = lambda key: np.array([[np.nan if x is None else x for x in r[key]] for r in rows], float).reshape(-1, len(features))
    n, label = np.array([r["n"] for r in rows], float), np.array([r["label"] for r in rows], int)
    side, unit = np.array([r["side"] for r in rows], object), np.array([place[r["unit_id"]] for r in rows], int)
    k, m, v = numbers("k"), np.nan_to_num(numbers("m")), np.nan_to_num(numbers("v"))

    def pooled(w: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = np.maximum(w.sum(axis=0), 1)
        centre = (w * mean).sum(axis=0) / total
        return centre, np.sqrt((w * (var + (mean - centre) ** 2)).sum(axis=0) / total)

    centre, spread = pooled(k, m, v)
    spread = np.where(spread > 0, spread, 1.0)
    m, v = (m - centre) / spread, v / spread**2
    has = {s: {units[u] for u in unit[side == s]} for s in set(side.tolist())}
    keep: list[tuple[str, str, int, np.ndarray, np.ndarray]] = []
    for train, test in pairs:
        common = has.get(train, set()) & has.get(test, set())
        for split in sorted(listed):
            held = np.array([u in listed[split] for u in units])
            inside = np.array([u in common for u in units])
            if not listed[split] <= common:
                continue
            training = (side == train) & (inside & ~held)[unit]
            if len(set(label[training])) == 2 and ((side == test) & held[unit]).any():
                keep.append((train, test, split, held, inside & ~held))
    fits = Fits(
        features, units,
        np.array([x[0] for x in keep], object), np.array([x[1] for x in keep], object), np.array([x[2] for x in keep], np.int64),
        *[np.array([x[i] for x in keep], bool).reshape(len(keep), len(units)) for i in (3, 4)], np.stack([centre, spread]),
        [int(i) for i in np.flatnonzero((k < n[:, None]).any(axis=0))],
    )
    d = len(features)
    fits.mean, fits.scale, fits.fill = np.zeros((len(keep), d)), np.ones((len(keep), d)), np.zeros((len(keep), d))
    fits.weight, fits.rows = np.zeros((len(keep), 2)), np.zeros((len(keep), 2), np.int64)
    if fits.gaps:
        _fill_gaps(fits, table)
    for f, (train, test, _, held, trains) in enumerate(keep):
        own = (side == train) & trains[unit]
        total = n[own].sum()
        fits.weight[f] = [total / (2 * n[own & (label == c)].sum()) for c in (0, 1)]
        fits.rows[f] = total, n[(side == test) & held[unit]].sum()
        w = np.concatenate([k[own], (n[own, None] - k[own]).sum(axis=0, keepdims=True)])  # gaps hold the fill value
        fits.mean[f], scale = pooled(
            w, np.concatenate([m[own], fits.fill[f][None]]), np.concatenate([v[own], np.zeros((1, d))])
        )
        fits.scale[f] = np.where(scale > 0, scale, 1.0)
    return fits


def _fill_gaps(fits: Fits, table: DataFrame) -> None:
    """Training medians of the features that have gaps, by fit; only their values meet the splits."""
    spark = table.sparkSession
    masks = [
        (f, str(s), u)
        for f, (s, own) in enumerate(zip(fits.train_side, fits.trains))
        for u, trained in zip(fits.units, own)
        if trained
    ]
    names = [fits.features[i] for i in fits.gaps]
    long = table.select("side", "unit_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in zip(fits.gaps, names)])).alias("e"))
    trains = spark.createDataFrame(masks, "fit int, side string, unit_id string")
    found = exact_quantiles(long.join(trains, ["side", "unit_id"]).select("fit", "e.i", "e.v"), ["fit", "i"], F.col("v"), {"med": 0.5})
    for r in found.toArrow().to_pylist():
        fits.fill[r["fit"], r["i"]] = (r["med"] - fits.base[0, r["i"]]) / fits.base[1, r["i"]]


def _columns(fits: Fits, batch: pa.RecordBatch) -> np.ndarray:
    """(1, z, g) of every row."""
    x = np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in fits.features], axis=1)
    gap = ~np.isfinite(x)
    z = np.where(gap, 0.0, (x - fits.base[0]) / fits.base[1])
    return np.concatenate([np.ones((len(x), 1)), z, gap[:, fits.gaps].astype(float)], axis=1)


def _batches(batches: Iterator[pa.RecordBatch], fits: Fits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    place = {u: i for i, u in enumerate(fits.units)}
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            unit = np.array([place[u] for u in part.column("unit_id").to_pylist()])
            yield _columns(fits, part), unit, np.array(part.column("side").to_pylist(), object), part.column("label").to_numpy().astype(int)


def _rows(fits: Fits, table: DataFrame) -> DataFrame:
    known = table.where(F.col("unit_id").isin(fits.units)) if fits.units else table.limit(0)
    return known.select("side", "unit_id", F.col("label").cast("int").alias("label"), *[F.col(f).cast("double").alias(f) for f in fits.features])


def _newton(fits: Fits, table: DataFrame, coef: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Newton step of every fit at ``coef``: one pass over the table."""
    spark = table.sparkSession
    ship = spark.sparkContext.broadcast((fits, coef, fits.raw(coef)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, _, raw = ship.value
        count, a = raw.shape
        upper = np.triu_indices(a)
        loss, grad, hess = np.zeros(count), np.zeros((count, a)), np.zeros((count, len(upper[0])))
        for x, unit, side, label in _batches(batches, fits):
            score = x @ raw.T
            weight = np.where(label[:, None] == 1, fits.weight[:, 1], fits.weight[:, 0])
            weight = weight * fits.trains.T[unit] * (side[:, None] == fits.train_side)
            signed = np.where(label[:, None] == 1, score, -score)
            prob = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
            loss += (weight * np.logaddexp(0, -signed)).sum(axis=0)
            grad += (weight * (prob - label[:, None])).T @ x
            hess += (weight * prob * (1 - prob)).T @ (x[:, upper[0]] * x[:, upper[1]])
        whole = np.concatenate([loss[:, None], grad, hess], axis=1)
        blocks = range(0, count, FIT_BLOCK)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b // FIT_BLOCK for b in blocks], pa.int32()),
                pa.array([whole[b : b + FIT_BLOCK].tobytes() for b in blocks], pa.binary()),
            ],
            names=["block", "sums"],
        )

    def solve(rows: pa.Table) -> pa.Table:
        fits, coef, raw = ship.value
        block = rows.column("block")[0].as_py()
        of = slice(block * FIT_BLOCK, (block + 1) * FIT_BLOCK)
        count, a = raw[of].shape
        whole = sum(np.frombuffer(s.as_py()).reshape(count, -1) for s in rows.column("sums"))
        t, upper = fits.design(of), np.triu_indices(a)
        full = np.zeros((count, a, a))
        full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = whole[:, 1 + a :]
        grad = np.einsum("fda,fa->fd", t, whole[:, 1 : 1 + a]) + penalty * coef[of]
        hess = t @ full @ t.transpose(0, 2, 1) + penalty * np.eye(coef.shape[1])
        loss = whole[:, 0] + penalty / 2 * (coef[of] ** 2).sum(axis=1)
        step = np.linalg.solve(hess, grad[:, :, None])[:, :, 0]
        return pa.table(
            {
                "fit": pa.array(np.arange(count) + of.start, pa.int32()),
                "found": pa.array(np.concatenate([loss[:, None], grad, step], axis=1).tolist(), pa.list_(pa.float64())),
            }
        )

    partial = _rows(fits, table).mapInArrow(sums, "block int, sums binary")
    solved = partial.groupBy("block").applyInArrow(solve, "fit int, found array<double>").toArrow()
    found = np.empty((len(coef), 1 + 2 * coef.shape[1]))
    found[solved.column("fit").to_numpy()] = np.stack(solved.column("found").to_numpy(zero_copy_only=False))
    ship.unpersist()
    return found[:, 0], found[:, 1 : 1 + coef.shape[1]], found[:, 1 + coef.shape[1] :]


def fit_all(fits: Fits, table: DataFrame, penalty: float = 1.0, tol: float = 1e-8, steps: int = 100) -> Fits:
    """Class-balanced logistic regressions of all fits; the intercept is penalised like the rest.

    A step that does not lower a fit's loss is halved for that fit alone.
    """
    coef = np.zeros((len(fits.split), 1 + len(fits.features)))
    if not len(coef):
        fits.coef, fits.residual = coef, np.zeros(0)
        return fits
    loss, grad, step = _newton(fits, table, coef, penalty)
    for _ in range(steps):
        if np.abs(grad).max() <= tol:
            break
        trial = coef - step
        new_loss, new_grad, new_step = _newton(fits, table, trial, penalty)
        better = new_loss <= loss + 1e-9 * np.abs(loss)
        coef = np.where(better[:, None], trial, coef)
        step = np.where(better[:, None], new_step, step / 2)
        loss, grad = np.where(better, new_loss, loss), np.where(better[:, None], new_grad, grad)
    fits.coef, fits.residual = coef, np.abs(grad).max(axis=1)
    return fits


def predict_units(fits: Fits, table: DataFrame) -> DataFrame:
    """F9 for every fit: (train_side, test_side, split_id, unit_id, y, n, prob, pred) per tested animal.

    A task adds up its rows' probabilities per (fit, animal), so no row is written per split.
    """
    spark: SparkSession = table.sparkSession
    ship = spark.sparkContext.broadcast((fits, fits.raw(fits.coef)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, raw = ship.value
        shape = (len(fits.split), len(fits.units))
        total, count, label_of = np.zeros(shape), np.zeros(shape, np.int64), np.full(shape[1], -1)
        for x, unit, side, label in _batches(batches, fits):
            prob = 1 / (1 + np.exp(-np.clip(x @ raw.T, -500, 500)))
            used = fits.tests.T[unit] * (side[:, None] == fits.test_side)
            for u in np.unique(unit):
                own = unit == u
                total[:, u] += (prob[own] * used[own]).sum(axis=0)
                count[:, u] += used[own].sum(axis=0)
                label_of[u] = label[own][0]
        f, u = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(fits.train_side[f], pa.string()), pa.array(fits.test_side[f], pa.string()), pa.array(fits.split[f]),
                pa.array([fits.units[i] for i in u], pa.string()), pa.array(label_of[u], pa.int32()), pa.array(total[f, u]), pa.array(count[f, u]),
            ],
            names=["train_side", "test_side", "split_id", "unit_id", "y", "total", "n"],
        )

    parts = _rows(fits, table).mapInArrow(
        run, "train_side string, test_side string, split_id bigint, unit_id string, y int, total double, n bigint"
    )
    keys = ["train_side", "test_side", "split_id", "unit_id"]
    summed = parts.groupBy(*keys).agg(F.min("y").alias("y"), F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("prob"))
    return summed.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


def fit_table(spark: SparkSession, fits: Fits) -> DataFrame:
    """One row per fit: its rows, coefficients and what is left of the gradient."""
    rows = [
        (str(a), str(b), int(s), int(n[0]), int(n[1]), float(r), [float(c) for c in w])
        for a, b, s, n, r, w in zip(fits.train_side, fits.test_side, fits.split, fits.rows, fits.residual, fits.coef)
    ]
    return spark.createDataFrame(
        rows, "train_side string, test_side string, split_id bigint, n_train bigint, n_test bigint, residual double, coef array<double>"
    )
