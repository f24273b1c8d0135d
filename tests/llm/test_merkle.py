"""The manifest against trees built in plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from brute import AWKWARD, DOCS, awkward, nothing
from spectraloom.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    doc, text, lang, source, n = row
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)]
    return _h(*fields)


def _tree(nodes):
    """Root, and each node's path of (sibling on the left, sibling on the right)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            left = nodes[at - 1] if at % 2 else ""
            right = nodes[at + 1] if at % 2 == 0 and at + 1 < len(nodes) else ""
            paths[i].append((left, right))
            where[i] = at // 2
        nodes = [_h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0], paths


def _plain(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    for members in langs.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {lang: _tree([_leaf(r) for r in langs[lang]]) for lang in order}
    root, tops = _tree([trees[lang][0] for lang in order])
    out = []
    for lang, above in zip(order, tops):
        for row, path in zip(langs[lang], trees[lang][1]):
            doc, text, _, source, n = row
            hit = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            node = _leaf((doc, text, lang, source, n + 1 if hit else n))
            for left, right in path + above:
                node = _h(left, node, right)
            proof = _h(*(s for pair in path + above for s in pair))
            out.append((doc, _leaf(row), trees[lang][0], root, proof, node, node == root))
    return out


def _key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def _check(spark, rows, clash=False, **levels):
    docs = awkward(spark, clash) if rows is AWKWARD else spark.createDataFrame(rows, DOCS).repartition(5)
    got = merkle.manifest(docs, merkle.tampered(docs), **levels).collect()
    assert sorted(map(tuple, got), key=_key) == sorted(_plain(rows), key=_key)
    return got


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_trees_of_all_sizes(spark, levels):
    rows, doc = [], 0
    for i, n in enumerate([1, 2, 3, 4, 5, 8, 9, 17, 33]):
        for _ in range(n):
            rows.append((doc * 7919 % 100_003, f"text {doc} é", f"l{i}" if i else None, "s", doc))
            doc += 1
    got = _check(spark, rows, levels=levels)
    assert {r.verified for r in got} == {True, False}


def test_awkward_rows(spark):
    _check(spark, AWKWARD, clash=True)
    assert merkle.manifest(nothing(spark), merkle.tampered(nothing(spark))).count() == 0
    _check(spark, [(5, "only", "en", None, 2**63 - 1)])


def test_one_hot_language(spark):
    rows = [(i, "same", "en", "s", 4) for i in range(2500)] + [(3000, "x", "zz", "s", 1)]
    _check(spark, rows)
