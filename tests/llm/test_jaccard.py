import random

import pytest

from brute import AWKWARD, awkward, components, nothing, shingles
from spectraloom.llm import graph, jaccard


def _check(spark, texts, k, percent):
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs, k, percent).collect()}
    want = components(texts, k, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t, k)) for i, t in texts.items()}
    return want


def _copies(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        what = rng.randrange(3)
        if what == 0:
            out[at] = f"e{rng.random()}"
        elif what == 1:
            del out[at]
        else:
            out.insert(at, f"i{rng.random()}")
    return " ".join(out)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_copies_at_every_distance(spark, k, percent):
    rng = random.Random(percent)
    texts, doc = {}, 0
    passage = [f"p{i}" for i in range(60)]
    for group in range(40):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 40, 150, 600]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            text = _copies(rng, base, rng.randrange(0, max(2, len(base) // 20)))
            if rng.random() < 0.5:
                text += " " + " ".join(passage)
            texts[doc] = text
            doc += 1
    want = _check(spark, texts, k, percent)
    assert len(set(want.values())) < len(want)


def test_chain_of_copies_and_hot_groups(spark):
    """A chain whose ends are far apart is one class; so are hundreds of copies of a text."""
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(30):  # neighbours differ by a few words, the ends by most
        texts[i] = " ".join(words[3 * i : 3 * i + 200])
    for i in range(100, 300):
        texts[i] = " ".join(["hot"] + words[:100])
    rng = random.Random(3)
    for i in range(300, 500):
        texts[i] = _copies(rng, [f"n{j}" for j in range(120)], 2)
    _check(spark, texts, 3, 90)


def test_unresolved_clusters_are_compared_whole(spark, monkeypatch):
    """Small blocks force lists and clusters to be cut into block pairs."""
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 7)
    monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", 5)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(80)]
    texts = {i: _copies(rng, base, rng.randrange(0, 6)) for i in range(150)}
    _check(spark, texts, 3, 90)
    _check(spark, texts, 5, 80)


def test_awkward_rows(spark):
    got = jaccard.jaccard_join(awkward(spark), 3, 90).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert [by[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 5, 5, 7, 8]
    assert by[1].n_shingles == by[2].n_shingles == by[8].n_shingles == 0 and by[4].n_shingles == 1
    assert by[None].component_id is None
    assert jaccard.jaccard_join(nothing(spark)).collect() == []


def test_sketch_never_exceeds_the_difference():
    rng = random.Random(5)
    import numpy as np

    for _ in range(200):
        x = np.array(sorted(rng.sample(range(-(10**6), 10**6), rng.randrange(1, 900))))
        y = np.array(sorted({*rng.sample(x.tolist(), len(x) // 2), *rng.sample(range(10**7), rng.randrange(1, 900))}))
        p, q = jaccard.parity_sketch(x), jaccard.parity_sketch(y)
        size = min(len(p), len(q))
        p, q = jaccard._folded(p, size), jaccard._folded(q, size)
        apart = (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count()
        assert apart <= len(set(x.tolist()) ^ set(y.tolist()))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)] + [(120, 121), (7, 7)]
    links = spark.createDataFrame(path + star + path, "a bigint, b bigint")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("turn", [1, -1])
def test_one_id_with_several_texts(spark, turn):
    """Whatever the order of rows, an id ties its texts, and each of them keeps its links."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (0, b + " other"), (5, ""), (5, c), (4, c), (6, ""), (6, "x y")]
    docs = spark.createDataFrame(rows[::turn], "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_join(docs, 3, 90).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (5, 4), (6, 6), (6, 6)]
