"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed words of a text.
The pairwise part learns what additive weights cannot, such as an insult next to a group's name.
Fitting runs on a bounded sample of labelled rows (``SAMPLE_ROWS``) in one task.  Only terms
whose share of label 1 is far from chance enter, so that the many terms of a long text do not
drown the few that matter, and the model is a short table.
Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import remainder, slices

SAMPLE_ROWS = 20_000
LEAST_DOCS = 4
DEVIATIONS = 5.0  # how far from chance a term's share of label 1 must be to enter the machine
FACTORS = 4
STEPS = 300
RATE = 0.05
DECAY = 0.1
TERMS_KEPT = 300_000
_TERM = re.compile(r"[^\W_]+")


class _Terms(dict):
    """32-bit hash of a word, remembered; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= TERMS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


def terms(text: str | None, known: dict) -> np.ndarray:
    """Distinct term hashes of a whole text, sorted."""
    words = set(_TERM.findall(text.lower())) if text else ()
    return np.unique(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))


@dataclass
class Model:
    bias: float
    term: np.ndarray  # sorted hashes of the terms with weights
    weight: np.ndarray
    factor: np.ndarray

    def score(self, hashes: np.ndarray) -> float:
        at = np.minimum(np.searchsorted(self.term, hashes), max(0, len(self.term) - 1))
        hit = at[self.term[at] == hashes] if len(self.term) else at[:0]
        v = self.factor[hit]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()) if len(hit) else 0.0
        z = self.bias + float(self.weight[hit].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Adam on log loss over all rows, weights and factors decayed.

    Terms in fewer than LEAST_DOCS texts, or with a share of label 1 that chance may give, are
    left out.  With one class or no rows at all the model is the smoothed share of label 1.
    """
    y = np.array(labels, np.float64)
    positive = float(y.sum())
    prior = (positive + 1) / (len(y) + 3)
    nothing = np.zeros(0, np.int64)
    empty = Model(float(np.log(prior / (1 - prior))), nothing, np.zeros(0), np.zeros((0, FACTORS)))
    if positive in (0.0, float(len(y))):
        return empty
    known = _Terms()
    found = [terms(t, known) for t in texts]
    every, back = np.unique(np.concatenate(found), return_inverse=True)
    label_of = np.repeat(y, [len(f) for f in found])
    count, toxic = np.bincount(back), np.bincount(back, label_of)
    share = positive / len(y)
    apart = np.abs(toxic - count * share) / np.sqrt(count * share * (1 - share))
    vocabulary = every[(count >= LEAST_DOCS) & (apart >= DEVIATIONS)]
    if not len(vocabulary):
        return empty
    cols, size = [], []
    for hashes in found:
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        cols.append(at[vocabulary[at] == hashes])
        size.append(len(cols[-1]))
    flat = np.concatenate(cols).astype(np.int64)
    owner = np.repeat(np.arange(len(y)), size)
    rng = np.random.default_rng(seed)
    n, m = len(y), len(vocabulary)
    # bias, weights, factors in one vector; factors start small and are decayed more
    x = np.concatenate([[empty.bias], np.zeros(m), rng.normal(0, 0.05, m * FACTORS)])
    decay = np.concatenate([[0.0], np.full(m, DECAY), np.full(m * FACTORS, 5 * DECAY)])
    first, second = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        bias, w, v = x[0], x[1 : m + 1], x[m + 1 :].reshape(m, FACTORS)
        vf = v[flat]
        total = np.stack([np.bincount(owner, vf[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(owner, (vf**2).sum(axis=1), n)
        z = bias + np.bincount(owner, w[flat], n) + 0.5 * ((total**2).sum(axis=1) - squares)
        error = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        pull = error[owner][:, None] * (total[owner] - vf)
        grad_v = np.stack([np.bincount(flat, pull[:, f], m) for f in range(FACTORS)], axis=1)
        grad = np.concatenate([[error.sum()], np.bincount(flat, error[owner], m), grad_v.ravel()]) + decay * x
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        pace = RATE * min(1.0, 3 * (1 - step / (STEPS + 1)))
        x = x - pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(float(x[0]), vocabulary, x[1 : m + 1], x[m + 1 :].reshape(m, FACTORS))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Model from at most ``rows`` labelled documents, those with the smallest id hashes.

    Only rows whose crc32(doc_id) mod 5 is not 0 are read; null labels and ids are left out,
    and of repeated labels of an id the highest counts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(remainder(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        model = fit(table.column("text").to_pylist(), table.column("toxic").to_pylist())
        return pa.table(
            {
                "term": pa.array([-1, *model.term.tolist()], pa.int64()),
                "weight": pa.array([model.bias, *model.weight.tolist()], pa.float64()),
                "factor": pa.array([[0.0] * FACTORS, *model.factor.tolist()], pa.list_(pa.float64())),
            }
        )

    fitted = sorted(
        sample.withColumn("one", F.lit(1))
        .groupBy("one")
        .applyInArrow(run, "term bigint, weight double, factor array<double>")
        .collect()  # at most the terms of the bounded sample
    )
    if not fitted:
        return fit([], [])
    return Model(
        fitted[0][1],
        np.array([r[0] for r in fitted[1:]], np.int64),
        np.array([r[1] for r in fitted[1:]], np.float64),
        np.array([r[2] for r in fitted[1:]], np.float64).reshape(-1, FACTORS),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row; null and empty texts get the score of no terms."""
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fitted = _Terms(), ship.value
        for batch in slices(batches):
            scores = [fitted.score(terms(t, known)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Labels, lang, source and doc_id are never inputs of a score.  Rows with equal texts get
    equal scores; repeated rows stay; no labels give one prior score; an empty table is empty.
    """
    return score(docs, learn(docs, labels)).select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
