import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brute import AWKWARD, awkward, nothing
from spectraloom.llm import bpe, chat, topk
from spectraloom.llm.queries import op2_exact_top_k

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id bigint, turn bigint, role string, text string"
HARD = [
    "</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST] [", "<", "[INS", "T]", "[+]", "[ROLE]x[TEXT]y[/ROLE]",
    "", "a\nb", "\\", "[OUT]</s><s>", "é 😀", "$1 \\$2",
]


def _read(spark, rows):
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS starts", "'y' AS blocks")
    return {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}


def test_chat_round_trip_of_control_strings(spark):
    rows, n = [], 0
    for role in ("system", "user", "assistant", "tool [INST]", ""):
        for text in HARD:
            rows.append((1, n, role, text))
            n += 1
    got = _read(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t in rows]
    assert got.loss_text == "".join(HARD)


def test_chat_merges_neighbours_and_takes_them_apart(spark):
    got = _read(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "d")])
    assert got[1].formatted == "<s>[INST]a[+]b[/INST][OUT]c[+]d</s>"
    assert [t.text for t in got[1].turns] == list("abcd") and got[1].loss_text == "cd"
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["c", "d"]


def test_chat_of_very_many_turns(spark):
    """Time follows the turns: with sums or cuts from the start this takes many minutes."""
    turns = spark.range(200_000).selectExpr(
        "1 AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('[OUT] turn ', id) AS text"
    )
    started = time.monotonic()
    got = chat.read_chats(chat.format_chats(turns)).selectExpr(
        "size(turns) AS n", "sha2(loss_text, 256) AS loss", "size(loss_spans) AS spans"
    ).collect()[0]
    assert time.monotonic() - started < 60
    learned = "".join(f"[OUT] turn {i}" for i in range(200_000) if i % 3)
    assert got.n == 200_000 and got.spans == 133_333
    assert got.loss == hashlib.sha256(learned.encode()).hexdigest()


@pytest.mark.parametrize("turns", [63, 64, 65, 4095, 4096, 4097, 8193])
def test_chat_spans_at_the_ends_of_runs(spark, turns):
    rows = [(1, i, "assistant" if i % 5 else "user", f"é{i}") for i in range(turns)]
    got = _read(spark, rows)[1]
    assert [got.formatted[s.start : s.end] for s in got.loss_spans] == [t for _, _, r, t in rows if r == "assistant"]
    assert got.loss_text == "".join(t for _, _, r, t in rows if r == "assistant")


def test_chat_awkward_rows(spark):
    rows = [(1, 1, "user", None), (1, None, None, "first"), (1, 1, "user", None), (None, 0, "user", "lost")]
    got = _read(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("", "first"), ("user", ""), ("user", "")]
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "lost")]
    assert _read(spark, []) == {}
    long = [(5, i, ("user", "assistant")[i % 2], "x" * 1000) for i in range(2000)]
    assert len(_read(spark, long)[5].loss_text) == 1000 * 1000


def _brute_top(ids, rows, queries, k):
    out = []
    for q in queries:
        score = rows @ rows[q]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), int(score[i])) for r, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("low,high", [(-600, 600), (0, 3), (-1, 1), (-100_000, 100_000)])
def test_slices_find_the_exact_top(low, high):
    rng = np.random.default_rng(low + high)
    ids, rows = rng.permutation(3000)[:2000], rng.integers(low, high, (2000, 24), endpoint=True)
    index = topk.SliceIndex(ids, rows)
    for q in range(0, 2000, 137):
        got, score = index.top(int(ids[q]), rows[q], 10)
        want = _brute_top(ids, rows, [q], 10)
        assert [(i, s) for _, _, i, s in sorted(want)] == list(zip(got.tolist(), score.tolist()))


def test_top_k_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    rows = np.floor(1024 * np.stack(table.embedding).astype(np.float64)).astype(np.int64)
    ids = table.vec_id.to_numpy()
    want = _brute_top(ids, rows, np.flatnonzero(ids % 100 == 0), 10)
    got = op2_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == want


def test_top_k_awkward_rows(spark):
    schema = "vec_id bigint, embedding array<float>, v string, rank int"
    rows = [
        (0, [1.0, 0.0], "x", 1), (0, [1.0, 0.0], "x", 1), (1, [0.5, 0.5], None, None), (2, [0.5, -0.5], "", 2),
        (2, [0.5, -0.5], "", 2), (3, None, "x", 1), (4, [float("nan"), 1.0], "x", 1), (5, [1.0, None], "x", 1),
        (6, [1.0], "x", 1), (None, [1.0, 1.0], "x", 1), (7, [], "x", 1), (8, [float("inf"), 0.0], "x", 1),
    ]
    vectors = topk.quantised(spark.createDataFrame(rows, schema))
    got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10).collect()
    half = 1024 * 512
    assert sorted(map(tuple, got)) == [(0, 1, 1, half), (0, 2, 2, half), (0, 3, 2, half)]
    none = topk.quantised(spark.createDataFrame([], schema))
    assert topk.top_k(none, none).collect() == []


ENCODER = bpe.Encoder(open(TOKENIZER, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(TOKENIZER)
PIECES = [" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　", "᠎", "  ", "\n\n", "the", "à", "É",
          "'s", "12", "中", "😀", "<|endoftext|>", "!", "x" * 50]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=12))
def test_fragments_encode_as_the_whole(parts):
    text = "".join(parts)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER.encode([text.encode()])[0], "<u4").tolist() == want
    table = bpe.decoder_table(open(TOKENIZER, encoding="utf-8").read())
    data = b"".join(table[i] for i in want).decode("utf-8", "replace")
    assert data == LIBRARY.decode(want, skip_special_tokens=False)


def test_forced_boundaries_lie_in_no_token():
    import json

    with open(TOKENIZER, encoding="utf-8") as file:
        inside = bpe.inner_pairs(json.load(file))
    assert all(bytes([a]) in ENCODER.unsure for a, b in inside if b == 32 and a > 32)
    assert (ord("e"), 32) not in inside and (ord("t"), ord("h")) in inside


def test_bpe_awkward_rows(spark):
    docs = awkward(spark)
    done = bpe.digests(bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER)).collect()
    want = []
    for doc_id, text, *_ in AWKWARD:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        want.append(
            (doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        )
    assert sorted(map(str, map(tuple, done))) == sorted(map(str, want))
    assert bpe.decode(bpe.encode(nothing(spark), TOKENIZER), TOKENIZER).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"\xff\xff\xff\x7f"))], "doc_id bigint, ids binary")
    assert [r.decoded for r in bpe.decode(odd, TOKENIZER).orderBy("doc_id").collect()] == ["", ""]
