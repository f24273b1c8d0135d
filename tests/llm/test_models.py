import math
import zlib
from collections import Counter

import numpy as np
import pytest

from brute import AWKWARD, WORD, awkward, lower, nothing
from spectraloom import session
from spectraloom.llm import lm, toxicity
from spectraloom.llm.common import words_of
from spectraloom.llm.queries import op4_toxicity, op5_lm_scores

SF = "/root/testdata/sf0.01"


def test_pairs_are_learned_that_weights_cannot_tell():
    """Insult or group alone is harmless, both together are toxic: no additive model parts them."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{i}" for i in rng.integers(0, 40, 6)]
        words += ["insult"] * insult + ["group"] * group
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    model = toxicity.fit(texts, labels)
    at = {w: int(np.searchsorted(model.term, toxicity._Terms()[w])) for w in ("insult", "group")}
    assert float(model.factor[at["insult"]] @ model.factor[at["group"]]) > 0.5
    found = [model.score(toxicity.terms(t, toxicity._Terms())) >= 0.5 for t in texts]
    assert np.mean(np.array(found) == np.array(labels)) > 0.97


def test_toxicity_on_held_out_rows(spark):
    got = op4_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert held[held.toxic == 1].predicted.mean() > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert len(got) == 10_000 and got.score.between(0, 1).all()


def test_toxicity_awkward_rows(spark):
    labels = spark.createDataFrame(
        [(1, 0), (3, 1), (3, 0), (4, None), (None, 1), (7, 1), (7, 1)], "doc_id bigint, toxic int"
    ).selectExpr("*", "'x' AS text", "0 AS quality")
    got = toxicity.toxicity(awkward(spark), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    prior = toxicity.toxicity(awkward(spark), none).collect()
    assert {round(r.score, 9) for r in prior} == {round(1 / 3, 9)} and not any(r.predicted for r in prior)
    assert toxicity.toxicity(nothing(spark), none).collect() == []


def _base(rows):
    """(N, base score, tokens, known) by plain counting."""
    tokens = [WORD.findall(lower(t or "")) + ["\n"] for _, t, *_ in rows]
    train = [zlib.crc32(str("" if i is None else i).encode()) % 7 != 2 for i, *_ in rows]
    count = Counter(w for ws, x in zip(tokens, train) if x for w in ws)
    n, v = sum(count.values()), len(count)
    return n, [
        (sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), len(ws), sum(count[w] > 0 for w in ws))
        for ws in tokens
    ]


def test_lm_base_is_exact_and_the_mixture_better(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, want = _base(rows)
    got = {r.doc_id: r for r in op5_lm_scores(spark, SF).collect()}
    for (doc_id, _), (base, tokens, known) in zip(rows, want):
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert abs(r.base_score - base) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.05


def test_lm_probabilities_sum_to_one(spark):
    """Over all known words, the end and one unknown, P(w | h) sums to at most 1."""
    texts = [(i, "a b c a b d e longerword anotherword a b c") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model, counts = lm.learn(docs)
    known = lm._Classes()
    words = {bytes(r.word): r.c for r in counts.collect()}
    total = model.tokens + model.words + 1
    assert model.tokens == sum(words.values()) and model.words == len(words)
    for before in (lm.START, known[b"a"], known[b"longerword"]):
        mass = 0.0
        for word, c in [*words.items(), (b"unknownword", 0)]:
            cls = lm.END if word == lm.END_WORD else known[word]
            key = np.array([(before << lm.CLASS_BITS) | cls])
            gain = lm._looked_up(key, model.pairs, model.pair_log)[0]
            if np.isnan(gain):
                rest = lm._looked_up(np.array([before]), model.contexts, model.context_log)[0]
                gain = 0.0 if np.isnan(rest) else rest
            mass += (c + 1) / total * 10**gain
        assert 0.5 < mass <= 1 + 1e-9


def test_lm_pairs_below_the_sent_frequency_count(spark, monkeypatch):
    """Scores do not depend on which pairs and contexts are sent and which are joined."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    want = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "RELATIVE", 100)
    got = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    assert want.keys() == got.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_lm_tells_words_of_one_class_apart_by_their_neighbours(spark):
    train = [(i, "xx aaaaaing yy" if i % 2 else "zz bbbbbing qq") for i in range(200)]
    texts = ["xx aaaaaing yy", "xx bbbbbing yy", "zz aaaaaing qq", "zz bbbbbing qq"]
    free = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = dict(zip(free, texts))
    docs = spark.createDataFrame([*train, *asked.items()], "doc_id bigint, text string")
    got = {asked[r.doc_id]: r.score - r.base_score for r in lm.lm_scores(docs).collect() if r.doc_id in asked}
    assert got[texts[0]] > got[texts[1]] + 1 and got[texts[3]] > got[texts[2]] + 1


def test_lm_texts_sum_to_at_most_one(spark):
    """Over all texts of up to three words, one of them unknown, the scores are probabilities."""
    train = [(i, ("a b longerword", "a b", "b a", "longerword", "a")[i % 5]) for i in range(300)]
    words, texts = ["a", "b", "longerword", "never"], [""]
    for _ in range(3):
        texts += [f"{t} {w}".strip() for t in texts for w in words]
    held = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = dict(zip(held, sorted(set(texts))))
    assert len(asked) == 1 + 4 + 16 + 64
    docs = spark.createDataFrame([*train, *asked.items()], "doc_id bigint, text string")
    mass = sum(10**r.score for r in lm.lm_scores(docs).collect() if r.doc_id in asked)
    assert 0.9 < mass <= 1 + 1e-9


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    true, rows = 0.7, []
    ratio = np.array([0.0, 0.5, 2.0, 8.0])
    p1 = np.array([0.5, 0.3, 0.15, 0.05])
    p2 = ratio * p1 / (ratio * p1).sum()
    n = rng.multinomial(200_000, true * p2 + (1 - true) * p1)
    rows = [(3, None if r == 0 else float(x / y), int(c)) for r, x, y, c in zip(ratio, p2, p1, n)]
    assert lm.weights(rows)[3] == pytest.approx(true, abs=0.02)


def test_lm_awkward_rows(spark):
    n, want = _base(AWKWARD)
    got = lm.lm_scores(awkward(spark)).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(
        (t, k, round(b, 6)) for b, t, k in want
    )
    assert {r.train_tokens for r in got} == {n}
    assert lm.lm_scores(nothing(spark)).collect() == []


def test_lm_tables_stay_below_the_input(spark, tmp_path, monkeypatch):
    """Counting and scoring leave no table of n-grams behind."""
    monkeypatch.setattr(session, "new_path", lambda _, label: str(tmp_path / f"{label}-{len(list(tmp_path.iterdir()))}"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert lm.lm_scores(docs).count() == 1000
    text = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert 0 < sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1.5 * text


def test_lm_scores_do_not_depend_on_blocks(spark, monkeypatch):
    """Small blocks, many ranges of hashes: the same counts, so the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    want = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 5000)
    monkeypatch.setattr(lm, "KEYS_AT_ONCE", 20_000)
    got = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.lm_scores(docs).collect()}
    assert want.keys() == got.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-6) for k in want)


def test_lm_splits_words_as_other_operators():
    texts = [None, "", " ", "A  b\tC\n", "\x0bx\x0cy\r ", "\x1cz \x85 \xa0É ÀB", "Ünï  CODE\x00q", "word"]
    words, size = lm._words_and_sizes(lm.pa.array([None if t is None else t.encode() for t in texts], lm.pa.binary()))
    want = [words_of(None if t is None else t.encode()) for t in texts]
    assert size.tolist() == list(map(len, want)) and words.to_pylist() == sum(want, [])


def test_lm_order_of_keys_that_agree_in_their_high_bits():
    rng = np.random.default_rng(2)
    keys = np.concatenate([rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2), np.arange(300, dtype=np.uint64)[::-1]])
    keys = np.concatenate([keys, keys[::3]])
    order, ordered = lm._order(keys)
    assert (np.sort(keys) == ordered).all() and (keys[order] == ordered).all() and len(set(order.tolist())) == len(keys)
