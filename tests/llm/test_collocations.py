"""Count transducers against dictionaries, and the mined phrases against plain counting."""

import bisect
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from brute import awkward, lower, nothing
from spectraloom.llm import collocations
from spectraloom.llm.collocations import Machine, build, compose, unite


def _machine(counts):
    grams = sorted(counts)
    words = sorted({w for g in grams for w in g})
    columns = [np.array([words.index(g[j]) for g in grams]) for j in range(len(grams[0]))]
    return build(words, columns, np.array([counts[g] for g in grams], np.int64))


def _counts(rng, n, size):
    return {tuple(rng.choice([b"a", b"b", b"cc", b"d"]) for _ in range(n)): rng.randrange(1, 2**40) for _ in range(size)}


def test_transducers():
    rng = random.Random(1)
    for n in (2, 3, 4):
        parts = [_counts(rng, n, rng.randrange(1, 40)) for _ in range(5)]
        machines = [_machine(p) for p in parts]
        for p, m in zip(parts, machines):
            assert list(Machine.unpacked(m.packed()).paths()) == sorted(p.items())
        total = Counter()
        for p in parts:
            total.update(p)
        whole, weight = unite(machines)
        assert list(whole.paths()) == sorted(total.items()) and weight == sum(total.values())
        least = sorted(total.values())[len(total) // 2]
        assert list(unite(machines, least)[0].paths()) == sorted((g, c) for g, c in total.items() if c >= least)
        assert dict(compose(machines[0], whole)) == {g: total[g] for g in parts[0]}
        assert list(unite(machines, 1 << 60)[0].paths()) == []


def test_equal_states_are_one():
    machine = _machine({(x, y): 7 for x in (b"a", b"b", b"c") for y in (b"x", b"y")})
    assert len(machine.first) - 1 == 2 and len(machine.label) == 5


def _plain(rows, least, percent, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        drop = set()
        for g, a in found.items():
            for m in range(2, len(g)):
                drop |= {g[i : i + m] for i in range(len(g) - m + 1) if 100 * a >= percent * found[g[i : i + m]]}
        rows = []
        for g in found.keys() - drop:
            score, _, left, right = min(
                (2_000_000 * found[g] // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))
            )
            rows.append((-score, -found[g], " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def _check(spark, rows, least=3, percent=80, top=2000):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.collocations(docs, least, percent, top).collect()
    want = _plain(rows, least, percent, top)
    assert sorted(map(tuple, got)) == want
    return want


@pytest.mark.parametrize("top", [2000, 5])
def test_phrases(spark, top):
    rng = random.Random(2)
    names = [f"w{i}" for i in range(60)] + ["the", "THE", "of", "été", "Été", "x\x1cy", "a\x00b"]
    phrases = ["the quick brown fox", "of the", "new york city", "été of"]
    rows = [(None, None), ("en", ""), ("", "a b a b a b a b"), ("und", "p q p q p q"), (None, "p q\tp q"), ("zz", "once only")]
    for i in range(120):
        parts = [rng.choice(names + phrases * 3) for _ in range(rng.randrange(1, 120))]
        rows.append((rng.choice(["en", "en", "en", "fr", None]), "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for p in parts)))
    want = _check(spark, rows, top=top)
    assert len(want) > 10 and {r[0] for r in want} >= {"en", "fr", "und", ""}


def test_small_limits_and_many_ranges(spark, monkeypatch):
    """The workers take the limits from the closure's module, the driver cuts many ranges."""
    monkeypatch.setattr(collocations, "RANGE_TOKENS", 50)
    monkeypatch.setattr(collocations, "REQUESTS", 10)
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdefgh") for _ in range(200))) for _ in range(60)]
    _check(spark, rows, least=30)


def test_a_shard_that_is_full_several_times():
    shard = collocations._Shard((2,), np.full(collocations.SIEVE_BITS // 64, -1, np.int64), [(b"en", b"m"), (b"en", b"p", b"c")])
    rng, total, parts = random.Random(4), Counter(), []
    for _ in range(6):
        words = [rng.choice("abmpqz") for _ in range(50)]
        shard.add(b"en", [" ".join(words).encode()])
        total.update((b"en", a.encode(), b.encode()) for a, b in zip(words, words[1:]))
        if rng.random() < 0.5:
            parts += list(shard.machines())
    parts += list(shard.machines())
    for r in range(3):
        whole = dict(unite([m for _, q, m in parts if q == r])[0].paths())
        low, high = [(), (b"en", b"m"), (b"en", b"p", b"c")][r], [(b"en", b"m"), (b"en", b"p", b"c"), (b"fr",)][r]
        assert whole == {g: c for g, c in total.items() if low <= g < high}


def test_awkward_rows(spark):
    rows = [(r.lang, r.text) for r in awkward(spark, False).collect()]
    got = collocations.collocations(awkward(spark), 30).collect()
    assert sorted(map(tuple, got)) == _plain(rows, 30, 80, 2000) and got
    assert collocations.collocations(nothing(spark)).count() == 0


def _calls(work) -> int:
    """Calls that Python makes, of its own functions and of others."""
    n = 0

    def seen(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        work()
    finally:
        sys.setprofile(None)
    return n


def test_many_ranges_and_ngrams_take_few_calls():
    """Arrays are worked on as a whole: neither an n-gram nor a range's share of them has its own loop."""
    rng = random.Random(5)
    names = [f"w{i}".encode() for i in range(400)]
    bounds = [(b"en", w) for w in sorted(names)[1:]]
    shard = collocations._Shard((2,), np.full(collocations.SIEVE_BITS // 64, -1, np.int64), bounds)
    text = b" ".join(rng.choices(names, k=60_000))
    shard.add(b"en", [text])
    out = []
    assert _calls(lambda: out.extend((n, r, m.packed()) for n, r, m in shard.machines())) < 60 * len(names)
    assert [r for _, r, _ in out] == list(range(len(names)))
    words = text.split()
    want = Counter((b"en", *pair) for pair in zip(words, words[1:]))
    assert [p for _, _, m in out for p in Machine.unpacked(m).paths()] == sorted(want.items())
    machines = [_machine({(rng.choice(names), rng.choice(names), b"x"): 1 + i % 9 for i in range(5000)}) for _ in range(4)]
    assert _calls(lambda: out.append(unite(machines))) < 1000
    total = Counter()
    for m in machines:
        total.update(dict(m.paths()))
    assert list(out[-1][0].paths()) == sorted(total.items())


def test_only_hot_ranges_are_copied(spark, monkeypatch):
    monkeypatch.setattr(collocations, "REQUESTS", 10)
    asked = spark.createDataFrame(
        [([b"en", b"x"], i, 0, 1, int(i >= 45), [b"en"]) for i in range(50)], collocations._ASKED
    )
    machines = spark.createDataFrame([(1, r, b"") for r in range(20)], "n int, range int, machine binary")
    salted, copies = (x.collect() for x in collocations._dealt(asked, machines))
    assert len(salted) == 50 and len(copies) == 20 + 4
    keys = {(r.n, r.range, r.salt) for r in copies}
    assert len(keys) == len(copies) and {(r.n, r.range, r.salt) for r in salted} <= keys


def test_a_large_range_is_not_united_again_for_every_shard(monkeypatch):
    monkeypatch.setattr(collocations, "ARCS_AT_ONCE", 50)
    taken = []
    monkeypatch.setattr(collocations, "unite", lambda machines, least=1: taken.append(len(machines)) or unite(machines, least))
    parts = [{(b"en", b"a%d" % i, b"b%d" % j): i + j + 1 for j in range(5)} for i in range(400)]
    rows = [(2, 7, _machine(p).packed()) for p in parts]
    ((n, at, whole),) = collocations._unite_all([collocations._machine_batch(rows)], 1)
    assert (n, at) == (2, 7) and list(whole.paths()) == sorted((g, c) for p in parts for g, c in p.items())
    assert len(taken) < 20


def test_ranges_are_balanced(spark):
    """Words that are just not hot weigh as much as they occur."""
    words = [(b"en", b"w%05d" % i, 5000 if 2000 <= i < 2400 else 30 + i % 20) for i in range(40_000)]
    frame = spark.createDataFrame(words, "lang binary, word binary, f bigint")
    bounds = collocations._bounds(frame, 21_000_000)
    share = Counter()
    for lang, word, f in words:
        share[bisect.bisect_right(bounds, (lang, word))] += f
    assert len(bounds) >= 20 and max(share.values()) < 2 * sum(f for _, _, f in words) / len(bounds)
