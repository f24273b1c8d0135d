"""Induced sorting against plain sorting; removal of repeats against plain windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from brute import AWKWARD, awkward, nothing
from spectraloom.llm import induce, repeats


def _plain(text):
    order = sorted(range(len(text) - 1), key=lambda i: text[i:], reverse=True)
    shared = [0] * len(order)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        while text[a + shared[k]] == text[b + shared[k]]:
            shared[k] += 1
    return order, shared


@pytest.mark.parametrize("memory", [0, 64, 1 << 20])
def test_suffixes_at_any_memory(monkeypatch, memory):
    """Small batches, slices and memory: merged runs and strings lie on disk."""
    rng = random.Random(memory)
    for _ in range(80):
        text = [rng.randrange(1, rng.choice([2, 3, 6, 300])) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.3:
            text = (text * 4)[:90]
        text.append(0)
        monkeypatch.setattr(induce, "BATCH", rng.choice([1, 2, 7, 1000]))
        monkeypatch.setattr(induce, "SLICE", rng.choice([3, 8, 1000]))
        with induce.Scratch(memory) as scratch:
            place, shared = induce.suffixes(np.array(text, np.int32), scratch)
            assert (place.tolist(), shared.tolist()) == _plain(text)
            assert memory or scratch.files


def test_shard_far_larger_than_memory():
    rng = np.random.default_rng(1)
    base = rng.integers(2, 60, 12_000)
    text = np.concatenate([base, base[100:9000], np.full(900, 7), base[500:9000], [0]]).astype(np.int32)
    results = []
    for memory in (1 << 30, 1 << 13):
        with induce.Scratch(memory) as scratch:
            place, shared = induce.suffixes(text, scratch)
            results.append((np.array(place), np.array(shared)))
            assert (scratch.files > 0) == (memory < 1 << 20)
    assert all((a == b).all() for a, b in zip(*results))


def _removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, np.int8)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + length + 1] = 1
        kept = bytes(b for b, g in zip(d, gone[1:]) if not g)
        spans = int((np.diff(gone) == 1).sum())
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _check(spark, texts, length, **limits):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = repeats.summary(repeats.without_repeats(docs, length, **limits)).orderBy("doc_id").collect()
    want = _removed(texts, length)
    assert [tuple(r)[1:] for r in got] == want
    return want


@pytest.mark.parametrize("limits", [{}, {"hot_bytes": 300, "shard_bytes": 2000}, {"memory": 256, "shard_bytes": 10_000}])
def test_planted_passages(spark, limits):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 20, 60)]
    texts = [None, "", "x" * 39, "y" * 40, "y" * 40, "z" * 5000, "ab" * 300, "q" * 300]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 30)))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 9)
            parts += [p[cut:], " ".join(word() for _ in range(rng.randrange(0, 20)))]
        texts.append(" ".join(parts))
    texts += texts[20:24] + [texts[30][3:], texts[31] + texts[31]]
    want = _check(spark, texts, 40, **limits)
    assert 20 < sum(w[1] > 0 for w in want) < len(want) - 10


def test_overlaps_in_one_text(spark):
    _check(spark, ["".join("abc"[i % 3] for i in range(90)) + "x", "abcab" * 3, "n" * 41], 40)


def test_awkward_rows(spark):
    got = repeats.summary(repeats.without_repeats(awkward(spark), 400)).collect()
    want = _removed([r[1] for r in AWKWARD], 400)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *w) for r, w in zip(AWKWARD, want)), key=key)
    assert repeats.without_repeats(nothing(spark)).count() == 0
