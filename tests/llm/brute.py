"""Plain Python counterparts of the operators, and awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
#: Nulls in every column, empty and very long texts, ties, repeated rows.
AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, "one", None, "a", 3),
    (4, "one two", "en", "a", 7),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG, "de", "b", len(LONG)),
    (7, "the same words again and again " * 30, "en", "c", 1),
    (7, "the same words again and again " * 30, "en", "c", 1),
    (None, "the same words again and again " * 30, None, None, None),
    (8, " \n\t ", "fr", "c", 4),
    (9, "à la carte   x y é\n\nfin <|endoftext|>", "fr", "c", 9),
]


def awkward(spark, clash: bool = True):
    """The rows above, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(AWKWARD, DOCS)
    if clash:
        for name in ("n", "key", "h", "rest", "words", "tokens", "row", "cell", "given", "_id", "shard", "c"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(texts: dict[int, str], k: int, percent: int) -> dict[int, int]:
    sets = {i: shingles(t, k) for i, t in texts.items()}
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    common = Counter((a, b) for ids in lists.values() for i, a in enumerate(ids) for b in ids[i + 1 :])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def repeated_words(words: list[str]) -> int:
    found = defaultdict(list)
    for i in range(len(words) - 7):
        found[tuple(words[i : i + 8])].append(i)
    return len({i + j for at in found.values() if len(at) > 1 for i in at for j in range(8)})
