"""Phrases whose words belong together, mined with weighted acyclic automata.

A count transducer is an acyclic automaton over words: a path (language, word, ..., word) spells an
n-gram and the weight of its last arc is the count.  States with equal arcs are one state.

1. Words are counted; a bounded sample of the frequent ones cuts the space of all n-grams into
   prefix ranges, hot first words by their second word.
2. Every shard counts its word pairs, then its triples and quadruples, sorts them and builds a
   transducer per prefix range, those of many ranges at once and depth by depth.  An n-gram is only
   counted where all its words (pairs) may be frequent; two Bloom filters of bounded size tell that
   without a miss.
3. The transducers of one range meet in one task, which unites them state by state, depth by depth,
   and adds up the weights.  What is too rare is cut off; the rest are the candidates.
4. To look up the two parts of every cut of every candidate, the parts are dealt to their prefix
   ranges, form an acceptor there, and are composed with the range's transducer.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import slices
from spectraloom.session import settle

NGRAMS_KEPT = 250_000
WORDS_KEPT = 300_000
ARCS_AT_ONCE = 400_000
ROWS_AT_ONCE = 50_000
SIEVE_BITS, MOST_SIEVE_BITS = 1 << 24, 1 << 27
MOST_RANGES = 4096
RANGE_TOKENS = 1_000_000
SAMPLED_WORDS = 16_384
BOUND_BYTES = 64
REQUESTS = 100_000
BATCH_BYTES, BATCH_ROWS = 1 << 20, 1000
#: Ends a piece; UTF-8 text has no such byte.
BREAK = b"\xff"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + BREAK * len(_BREAKS)
)
_MACHINE = "machine binary"


def words_in(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, A-Z lower-cased, and the number of the piece that each is in."""
    data = BREAK.join(t for t in texts if t).translate(_TABLE)
    codes = np.frombuffer(data, np.uint8)
    breaks = codes == BREAK[0]
    inside = np.zeros(len(codes) + 2, bool)
    np.logical_not(breaks | (codes == 32), out=inside[1:-1])
    starts, ends = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    spelt = data.translate(None, b" " + BREAK)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(spelt)])
    return words, np.cumsum(breaks, dtype=np.int32)[starts]


def _coded(known: pa.Array, more: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """``known`` different words with the new ones after them, and the places of ``more`` in that."""
    coded = pa.concat_arrays([known, *more]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()[len(known) :]


class Machine:
    """A weighted acyclic automaton; the last state is the root, target -1 ends a path."""

    def __init__(self, words, first, label, weight, target):
        self.words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        self.first, self.label, self.weight, self.target = first, label, weight, target

    @classmethod
    def empty(cls) -> Machine:
        none = np.empty(0, np.int64)
        return cls([], np.zeros(1, np.int64), none, none, none)

    def packed(self) -> bytes:
        ends, spelt = np.zeros(1, np.int32), b""
        if len(self.words):
            _, offsets, data = self.words.buffers()
            ends = np.frombuffer(offsets, np.int32, len(self.words) + 1, 4 * self.words.offset)
            spelt = memoryview(data)[int(ends[0]) : int(ends[-1])]
        head = np.array([len(self.words), len(self.first), len(self.label)], np.int64)
        ints = (ends[1:] - ends[:-1], self.first[1:] - self.first[:-1], self.label, self.target)
        parts = [head.tobytes(), self.weight.astype(np.int64).tobytes(), *(x.astype(np.int32).tobytes() for x in ints), spelt]
        return _compressor().compress(b"".join(parts))

    @classmethod
    def unpacked(cls, data: bytes) -> Machine:
        data = _decompressor().decompress(data)
        n_words, n_first, n_arcs = np.frombuffer(data, np.int64, 3).tolist()
        weight, at = np.frombuffer(data, np.int64, n_arcs, 24), 24 + 8 * n_arcs
        parts = []
        for n in (n_words, n_first - 1, n_arcs, n_arcs):
            parts.append(np.frombuffer(data, np.int32, n, at))
            at += 4 * n
        sizes, states, label, target = parts
        ends, first = np.zeros(n_words + 1, np.int32), np.zeros(n_first, np.int64)
        np.cumsum(sizes, out=ends[1:])
        np.cumsum(states, out=first[1:])
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(data).slice(at)]
        return cls(pa.Array.from_buffers(pa.binary(), n_words, buffers), first, label, weight, target)

    def paths(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """Every n-gram with its weight, in order."""
        first, label, weight, target = (x.tolist() for x in (self.first, self.label, self.weight, self.target))
        words = self.words.to_pylist()

        def walk(state: int, before: tuple) -> Iterator:
            for k in range(first[state], first[state + 1]):
                path = (*before, words[label[k]])
                if target[k] < 0:
                    yield path, weight[k]
                else:
                    yield from walk(target[k], path)

        if len(first) > 1:
            yield from walk(len(first) - 2, ())


@lru_cache(maxsize=1)  # a worker makes very many small machines
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every stretch, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _register(start: np.ndarray, size: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every state the first one of its owner that has equal arcs.

    A state's arcs are rows ``start`` to ``start + size`` of ``a`` and ``b``.  Hashes bring equal
    states together, then all arcs are compared: states that only share a hash stay apart.
    """
    key = np.add.reduceat(_mixed(a.astype(np.uint64), b.astype(np.uint64)), start)
    key = _mixed(key, owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
    by = np.argsort(key, kind="stable")
    new = np.append(True, key[by[1:]] != key[by[:-1]])
    found = np.empty(len(by), np.int64)
    found[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    others = np.flatnonzero(found != np.arange(len(found)))
    like = found[others]
    unequal = (size[others] != size[like]) | (owner[others] != owner[like])
    found[others[unequal]] = others[unequal]
    others, like = others[~unequal], like[~unequal]
    x, y = _stretches(start[others], size[others]), _stretches(start[like], size[others])
    unequal = np.unique(np.repeat(others, size[others])[(a[x] != a[y]) | (b[x] != b[y])])
    found[unequal] = unequal
    return found


def _transducers(words: pa.Array, columns: list[np.ndarray], weight: np.ndarray, edges: np.ndarray) -> list[Machine]:
    """The transducers of stretches of sorted different n-grams, all built at once.

    Stretch i, not an empty one, goes from row ``edges[i]`` to ``edges[i + 1]``.  The states of one
    depth are the different prefixes of that length.  From the deepest up, those with equal arcs
    become one; their numbers are the targets one word higher.
    """
    n, ranges = len(weight), len(edges) - 1
    owner = np.repeat(np.arange(ranges), np.diff(edges))
    new = np.zeros(n, bool)
    new[edges[:-1]] = True
    starts = [edges[:-1]]
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
        starts.append(np.flatnonzero(new))
    label, value, target = columns[-1].astype(np.int64), weight.astype(np.int64), np.full(n, -1)
    start, bound = starts[-1], n
    levels, below = [], np.zeros(ranges, np.int64)  # states of each range in the deeper levels
    for d in range(len(columns) - 1, -1, -1):
        size, own = np.diff(np.append(start, bound)), owner[starts[d]]
        found = _register(start, size, own, label, value if d == len(columns) - 1 else target)
        states = np.unique(found)
        arcs = _stretches(start[states], size[states])
        levels.append((own[states], size[states], label[arcs], value[arcs], target[arcs]))
        if d:
            number = np.searchsorted(states, found)
            number += below[own] - np.searchsorted(own[states], np.arange(ranges))[own]
            below = below + np.bincount(own[states], minlength=ranges)
            label, value, target = columns[d - 1][starts[d]].astype(np.int64), np.zeros(len(starts[d]), np.int64), number
            start, bound = np.searchsorted(starts[d], starts[d - 1]), len(starts[d])
    own, size, label, value, target = (np.concatenate(x) for x in zip(*levels))
    by = np.argsort(own, kind="stable")  # within a range the deepest states first
    at = _stretches((np.cumsum(size) - size)[by], size[by])
    label, value, target, arc_owner = label[at], value[at], target[at], np.repeat(own[by], size[by])
    first = np.append(0, np.cumsum(size[by]))
    used, label = np.unique(arc_owner * len(words) + label, return_inverse=True)
    spelt = words.take(pa.array(used % len(words)))
    w = np.searchsorted(used, np.arange(ranges + 1) * len(words))
    s = np.searchsorted(own[by], np.arange(ranges + 1))
    label -= w[arc_owner]
    label, target = label.astype(np.int32), target.astype(np.int32)
    out = []
    for (w0, w1), (s0, s1) in zip(pairwise(w.tolist()), pairwise(s.tolist())):
        own_first = first[s0 : s1 + 1]
        lo, hi = int(own_first[0]), int(own_first[-1])
        out.append(Machine(spelt.slice(w0, w1 - w0), own_first - lo, label[lo:hi], value[lo:hi], target[lo:hi]))
    return out


def build(words: list[bytes] | pa.Array, columns: list[np.ndarray], weight: np.ndarray) -> Machine:
    """The transducer of sorted different n-grams of one length; ``columns`` index the sorted ``words``."""
    if not len(weight):
        return Machine.empty()
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
    return _transducers(words, columns, weight, np.array([0, len(weight)]))[0]


def unite(machines: list[Machine], least: int = 1) -> tuple[Machine, int]:
    """One transducer with the sums of the weights, without those below ``least``; and their total.

    All machines are walked together, word by word: the states that spell one prefix follow each
    other up to the last ones, whose arcs are summed up.
    """
    machines = [m for m in machines if len(m.first) > 1]
    if not machines:
        return Machine.empty(), 0
    words, place = _ranked(pa.concat_arrays([m.words for m in machines]))
    ends = np.cumsum([[0, 0, 0], *([len(m.words), len(m.first) - 1, len(m.label)] for m in machines)], 0)
    base, arcs_of = ends[:-1], np.diff(ends[:, 2])
    label = place[np.concatenate([m.label for m in machines]) + np.repeat(base[:, 0], arcs_of)]
    weight, target = (np.concatenate(x) for x in zip(*((m.weight, m.target) for m in machines)))
    inner = target >= 0
    target = target + np.where(inner, np.repeat(base[:, 1], arcs_of), 0)
    start = np.concatenate([m.first[:-1] + b for m, b in zip(machines, base[:, 2].tolist())])
    size = np.concatenate([m.first[1:] - m.first[:-1] for m in machines])
    state = ends[1:, 1] - 1
    prefix, columns = np.zeros(len(state), np.int64), []
    while True:
        arcs = _stretches(start[state], size[state])
        if not len(arcs):
            return Machine.empty(), 0
        prefix, follow = np.repeat(prefix, size[state]), label[arcs]
        if not inner[arcs[0]]:  # all paths have one length
            break
        (before, last), prefix = _numbered([prefix, follow])
        columns, state = [*(c[before] for c in columns), last], target[arcs]
    (prefix, last), sums = _unique_rows([prefix, follow], weight[arcs])
    total, enough = int(sums.sum()), sums >= least
    prefix, last = prefix[enough], last[enough]
    return build(words, [*(c[prefix] for c in columns), last], sums[enough]), total


def compose(asked: Machine, counts: Machine) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """Paths that both have, with the weights of ``counts``: both are walked together."""
    arcs_of = []
    for m in (asked, counts):
        first, label, weight, target = (x.tolist() for x in (m.first, m.label, m.weight, m.target))
        words = m.words.to_pylist()
        arcs_of.append((first, [words[x] for x in label], weight, target))
    (first_a, word_a, _, to_a), (first_c, word_c, weight_c, to_c) = arcs_of

    def walk(a: int, c: int, before: tuple) -> Iterator:
        own = {word_c[k]: k for k in range(first_c[c], first_c[c + 1])}
        for k in range(first_a[a], first_a[a + 1]):
            j = own.get(word_a[k])
            if j is not None:
                path = (*before, word_a[k])
                if to_a[k] < 0:
                    yield path, weight_c[j]
                else:
                    yield from walk(to_a[k], to_c[j], path)

    if len(first_a) > 1 and len(first_c) > 1:
        yield from walk(len(first_a) - 2, len(first_c) - 2, ())


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order (uint64)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    last = np.uint64(bits - 1)
    return (hashes & last).astype(np.int64), (hashes >> np.uint64(37) & last).astype(np.int64)


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for p in _places(hashes, 64 * len(bits)):
        out &= (bits[p >> 6] >> (p & 63)) & 1 == 1
    return out


def _sieve(counts: DataFrame, order: int):
    """Bloom filter of the n-grams (lang and words) of one order; at least ``SIEVE_BITS``.

    It is made with ``MOST_SIEVE_BITS`` and folded to the size at which an eighth of the bits is set
    at most, so that what it lets through by chance does not grow with the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [g for g in batch.column("gram").to_pylist() if len(g) == order + 1]
            hashes = np.array([[_hash(w) for w in g] for g in grams], np.uint64).reshape(-1, order + 1)
            key = hashes[:, 0]
            for j in range(order):
                key = _mixed(key, hashes[:, j + 1])
            places = np.concatenate(_places(key, MOST_SIEVE_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64())], names=["p"])

    bits = (
        counts.select("gram").mapInArrow(run, "p bigint")
        .groupBy(F.expr("p div 64").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        .toArrow()  # at most MOST_SIEVE_BITS / 64 rows
    )
    bitmap = np.zeros(MOST_SIEVE_BITS // 64, np.int64)
    bitmap[bits.column("w").to_numpy()] = bits.column("bits").to_numpy()
    size, found = SIEVE_BITS, int(np.bitwise_count(bitmap.view(np.uint64)).sum())
    while size < min(8 * found, MOST_SIEVE_BITS):
        size *= 2
    return counts.sparkSession.sparkContext.broadcast(np.bitwise_or.reduce(bitmap.reshape(-1, size // 64)))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes | None]]]:
    found: dict[bytes, list] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        found.setdefault(lang, []).append(text)
    yield from found.items()


def _word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, tuple[pa.Array, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (words, f) in counts.items():
                for lo in range(0, len(words), 50_000):
                    part = words.slice(lo, 50_000)
                    columns = [pa.array([lang] * len(part), pa.binary()), part, pa.array(f[lo : lo + 50_000])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "f"])
            counts.clear()

        for batch in slices(batches):
            for lang, texts in _by_lang(batch):
                words, before = counts.get(lang, (pa.array([], pa.binary()), np.empty(0, np.int64)))
                words, numbers = _coded(words, [words_in(texts)[0]])
                f = np.bincount(numbers, minlength=len(words))
                f[: len(before)] += before
                counts[lang] = words, f
            if sum(len(f) for _, f in counts.values()) > WORDS_KEPT:
                yield from flush()
        yield from flush()

    found = docs.mapInArrow(run, "lang binary, word binary, f bigint")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _evenly(points: list[tuple], parts: int) -> list:
    """Keys that cut sorted (key, weight) pairs into so many parts of about one weight."""
    bounds, weight, step = [], 0.0, max(1.0, sum(w for _, w in points)) / parts
    for key, w in points:
        weight += w
        if weight >= step:
            bounds.append(key)
            weight -= step * (weight // step)
    return sorted(set(bounds))


def _bounds(words: DataFrame, total: int) -> list[tuple[bytes, ...]]:
    """Where the prefix ranges begin; a bounded sample only balances them."""
    ranges = min(MOST_RANGES, max(8, total // RANGE_TOKENS))
    cut = [F.substring("lang", 1, BOUND_BYTES).alias("lang"), F.substring("word", 1, BOUND_BYTES).alias("word"), "f"]
    heavy = words.where(F.col("f") * MOST_RANGES >= total).select(*cut).toArrow().to_pylist()  # at most MOST_RANGES rows
    light = words.where(F.col("f") * MOST_RANGES < total)
    chance = (F.shiftrightunsigned(F.xxhash64("lang", "word"), 11) + 0.5) / float(1 << 53)
    light = light.select(*cut, (F.col("f") / chance).alias("priority")).orderBy(F.desc("priority")).limit(SAMPLED_WORDS)
    light = light.toArrow().to_pylist()
    # a word that is drawn stands for as many tokens as the last one drawn, at least
    rest = light[-1]["priority"] if len(light) == SAMPLED_WORDS else 0
    light = [r | {"f": max(r["f"], rest)} for r in light]
    points = [((r["lang"], r["word"]), r["f"]) for r in light]
    known: dict[bytes, list[tuple[bytes, float]]] = {}
    for r in heavy + light:
        known.setdefault(r["lang"], []).append((r["word"], r["f"]))
    seconds = {lang: _evenly(sorted(known[lang]), 64) for lang in {r["lang"] for r in heavy}}
    for r in heavy:
        second = seconds[r["lang"]]
        points.append(((r["lang"], r["word"]), r["f"] / (len(second) + 1)))
        points += [((r["lang"], r["word"], u), r["f"] / (len(second) + 1)) for u in second]
    points.sort()
    return _evenly(points, ranges)


def _row_keys(columns: list[np.ndarray]) -> np.ndarray:
    """One integer a row, in the order of the rows and equal for equal ones.

    Columns share the integer as long as their spans fit; else what is packed so far is numbered.
    """
    key, span = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        low = int(c.min()) if len(c) else 0
        wide = int(c.max(initial=0)) - low + 1
        if span * wide >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            span = int(key.max(initial=0)) + 1
        key *= wide
        key += c
        key -= low
        span *= wide
    return key


def _unique_rows(columns: list[np.ndarray], weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows in order and the sums of their weights (each 1 where none are given)."""
    key = _row_keys(columns)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if weight is None:
        sums = np.diff(np.append(starts, len(key)))
    else:
        sums = np.add.reduceat(weight[order], starts) if len(starts) else weight
    return [c[order[starts]] for c in columns], sums.astype(np.int64)


def _numbered(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows in order, and every row's number among them."""
    key = _row_keys(columns)
    order = np.argsort(key)
    new = np.append(True, np.diff(key[order]) != 0)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in columns], number


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different words in bytewise order, and every word's place among them."""
    coded = words.dictionary_encode()
    by = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(by), np.int64)
    rank[by.to_numpy()] = np.arange(len(by))
    return coded.dictionary.take(by), rank[coded.indices.to_numpy()]


def _cuts(words: list[bytes], columns: list[np.ndarray], bounds: list[tuple[bytes, ...]]) -> np.ndarray:
    """The first of the sorted rows that is not below each bound, compared by the words it has."""
    lead = columns[0].astype(np.int64) * (len(words) + 1) + columns[1]
    out = np.empty(len(bounds), np.int64)
    for i, bound in enumerate(bounds):
        at = [bisect.bisect_left(words, w) for w in bound]
        met = [a < len(words) and words[a] == w for a, w in zip(at, bound)]
        low = at[0] * (len(words) + 1) + (at[1] if met[0] else 0)
        out[i] = np.searchsorted(lead, low)
        if len(bound) > 2 and met[0] and met[1]:
            stop = np.searchsorted(lead, low + 1)
            out[i] = stop if len(columns) < 3 else out[i] + np.searchsorted(columns[2][out[i] : stop], at[2])
    return out


def _by_range(
    words: pa.Array, columns: list[np.ndarray], weight: np.ndarray, bounds: list[tuple[bytes, ...]]
) -> Iterator[tuple[int, Machine]]:
    """(prefix range, transducer) of sorted n-grams, range by range."""
    edges = np.concatenate([[0], _cuts(words.to_pylist(), columns, bounds), [len(weight)]])
    ranges = np.flatnonzero(edges[1:] > edges[:-1])
    edges = np.append(edges[ranges], len(weight))
    lo = 0
    while lo < len(ranges):  # a bounded number of rows at once, one range at least
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + ROWS_AT_ONCE, "right")) - 1)
        rows = slice(edges[lo], edges[hi])
        part = [c[rows] for c in columns]
        yield from zip(ranges[lo:hi].tolist(), _transducers(words, part, weight[rows], edges[lo : hi + 1] - edges[lo]))
        lo = hi


class _Shard:
    """Counts of one shard's n-grams of some orders."""

    def __init__(self, orders: tuple[int, ...], bits: np.ndarray, bounds: list[tuple[bytes, ...]]):
        self.orders, self.bits, self.bounds = orders, bits, bounds
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.binary())  # every word has its place as number
        self.hashes = np.empty(0, np.uint64)
        self.single: dict[int, np.ndarray] = {}  # by lang: hash of every word with it,
        self.often: dict[int, np.ndarray] = {}  # and whether the sieve has it
        self.found: dict[int, list[tuple[list[np.ndarray], np.ndarray]]] = {n: [] for n in self.orders}

    def _with_lang(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        single = self.single.get(code, self.hashes[:0])
        often = self.often.get(code, np.empty(0, bool))
        if len(single) < len(self.hashes):
            more = self.hashes[len(single) :]
            more = _mixed(np.full(len(more), self.hashes[code], np.uint64), more)
            single = self.single[code] = np.concatenate([single, more])
            if self.orders == (2,):
                often = self.often[code] = np.concatenate([often, _hit(self.bits, more)])
        return single, often

    def add(self, lang: bytes, texts: list[bytes | None]) -> None:
        self.add_all([(lang, texts)])

    def add_all(self, groups: Iterable[tuple[bytes, list[bytes | None]]]) -> None:
        """Counts the texts of each lang."""
        langs, texts = zip(*groups)
        met = [words_in(t) for t in texts]
        self.words, numbers = _coded(self.words, [pa.array(langs, pa.binary()), *(words for words, _ in met)])
        more = [_hash(w) for w in self.words.slice(len(self.hashes)).to_pylist()]
        self.hashes = np.concatenate([self.hashes, np.array(more, np.uint64)])
        at = len(langs)
        for code, (words, piece) in zip(numbers[:at].tolist(), met):
            self._count(code, numbers[at : at + len(words)], piece)
            at += len(words)

    def _count(self, code: int, own: np.ndarray, piece: np.ndarray) -> None:
        single, often = self._with_lang(code)
        together = piece[1:] == piece[:-1]
        if self.orders == (2,):
            often = often[own]
            together &= often[1:] & often[:-1]
        else:
            at = np.flatnonzero(together)
            together[at] = _hit(self.bits, _mixed(single[own[at]], self.hashes[own[at + 1]]))
        for n in self.orders:
            fits = together[: max(0, len(own) - n + 1)].copy()
            for j in range(1, n - 1):
                fits &= together[j : j + len(fits)]
            at = np.flatnonzero(fits)
            if len(at):
                columns = [np.full(len(at), code, np.int32)] + [own[at + j] for j in range(n)]
                self.found[n].append(_unique_rows(columns))

    def full(self) -> bool:
        for n, parts in self.found.items():
            if len(parts) > 1 and sum(len(p[1]) for p in parts) > 2 * NGRAMS_KEPT:
                self.found[n] = [self._joined(n)]
        return len(self.words) > WORDS_KEPT or sum(len(p[0][1]) for p in self.found.values() if p) > NGRAMS_KEPT

    def _joined(self, n: int) -> tuple[list[np.ndarray], np.ndarray]:
        parts = self.found[n]
        columns = [np.concatenate([p[0][j] for p in parts]) for j in range(n + 1)]
        return _unique_rows(columns, np.concatenate([p[1] for p in parts]))

    def machines(self) -> Iterator[tuple[int, int, Machine]]:
        """(order, prefix range, transducer) of what was counted; then the shard is empty."""
        for n in self.orders:
            if not self.found[n]:
                continue
            columns, weight = self._joined(n)
            self.found[n] = []
            rank = np.zeros(len(self.words), np.int32)
            for c in columns:
                rank[c] = 1
            met = np.flatnonzero(rank)  # few of the shard's words
            words, place = _ranked(self.words.take(pa.array(met)))
            rank[met] = place
            columns = [rank[c] for c in columns]
            by = np.argsort(_row_keys(columns))
            columns, weight = [c[by] for c in columns], weight[by]
            for r, machine in _by_range(words, columns, weight, self.bounds):
                yield n, r, machine
        if len(self.words) > WORDS_KEPT // 2:
            self.clear()


def _machine_batches(machines: Iterable[tuple[int, int, Machine]]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(n, range, machine)``, many small machines in a batch."""
    rows, size = [], 0
    for n, at, machine in machines:
        rows.append((n, at, machine.packed()))
        size += len(rows[-1][2])
        if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
            yield _machine_batch(rows)
            rows, size = [], 0
    if rows:
        yield _machine_batch(rows)


def _machine_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["n", "range", "machine"])


def _ngram_machines(docs: DataFrame, orders: tuple[int, ...], bits, bounds) -> DataFrame:
    """Transducers of every shard, by order and prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(orders, bits.value, bounds.value)
        for batch in slices(batches, 500):
            shard.add_all(_by_lang(batch))
            if shard.full():
                yield from _machine_batches(shard.machines())
        yield from _machine_batches(shard.machines())

    return docs.mapInArrow(run, f"n int, range int, {_MACHINE}")


def _word_machines(words: DataFrame, bounds) -> DataFrame:
    """Transducers of single words, by prefix range: each batch of rows is a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "f"))))
            if rows:
                known = sorted({w for row in rows for w in row[:2]})
                place = {w: i for i, w in enumerate(known)}
                columns = [np.array([place[row[j]] for row in rows]) for j in (0, 1)]
                weight = np.array([row[2] for row in rows], np.int64)
                yield from _machine_batches((1, r, m) for r, m in _by_range(pa.array(known, pa.binary()), columns, weight, bounds.value))

    return words.mapInArrow(run, f"n int, range int, {_MACHINE}")


def _unite_all(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[tuple[int, int, Machine]]:
    """(order, prefix range, transducer) of rows that are sorted by order and range."""
    held: list[Machine] = []
    arcs, most, now = 0, ARCS_AT_ONCE, None
    for batch in batches:
        for n, at, packed in zip(batch.column("n").to_pylist(), batch.column("range").to_pylist(), batch.column("machine")):
            if (n, at) != now:
                if held:
                    yield *now, unite(held, least)[0]
                held, arcs, most, now = [], 0, ARCS_AT_ONCE, (n, at)
            held.append(Machine.unpacked(packed.as_py()))
            arcs += len(held[-1].label)
            if arcs > most and len(held) > 1:
                held, arcs = [unite(held)[0]], 0
                most = max(ARCS_AT_ONCE, len(held[0].label))  # until as much has come again
    if held:
        yield *now, unite(held, least)[0]


def _united(machines: DataFrame, least: int) -> DataFrame:
    """One transducer for each order and prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _machine_batches(_unite_all(batches, least))

    dealt = machines.repartition("n", "range").sortWithinPartitions("n", "range")
    return dealt.mapInArrow(run, f"n int, range int, {_MACHINE}")


def _grams(machines: DataFrame) -> DataFrame:
    """``(gram, f)``: every path (lang, word, ...) of the transducers with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("machine"):
                paths = list(Machine.unpacked(packed.as_py()).paths())
                for lo in range(0, len(paths), 10_000):
                    part = paths[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([list(p) for p, _ in part], pa.list_(pa.binary())), pa.array([f for _, f in part], pa.int64())],
                        names=["gram", "f"],
                    )

    return machines.mapInArrow(run, "gram array<binary>, f bigint")


_ASKED = "gram array<binary>, k int, side int, n int, range int, part array<binary>"


def _parts(candidates: DataFrame, bounds) -> DataFrame:
    """Both parts (side 0 and 1) of every cut after k words, with the prefix range they fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 10_000):
            rows = []
            for gram in batch.column("gram").to_pylist():
                for k in range(1, len(gram) - 1):
                    for side, part in enumerate((gram[: k + 1], [gram[0], *gram[k + 1 :]])):
                        at = bisect.bisect_right(bounds.value, tuple(part[:3]))
                        rows.append((gram, k, side, len(part) - 1, at, part))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["gram", "k", "side", "n", "range", "part"]
            )

    return candidates.select("gram").mapInArrow(run, _ASKED)


def _dealt(asked: DataFrame, machines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with a ``salt``: ranges in which very many parts are asked for, and only they, go to several tasks."""
    number = asked.groupBy("n", "range").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= REQUESTS)
    hot = F.broadcast(number.select("n", "range", F.expr(f"c div {REQUESTS}").alias("last")))  # few rows
    asked, machines = (x.join(hot, ["n", "range"], "left").withColumn("last", F.coalesce("last", F.lit(0))) for x in (asked, machines))
    return (
        asked.withColumn("salt", F.pmod(F.xxhash64("gram", "k"), F.col("last") + 1)).drop("last"),
        machines.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).drop("last"),
    )


def _looked_up(asked: DataFrame, machines: DataFrame) -> DataFrame:
    """``(gram, k, side, f)``: the parts' counts, by composition within their prefix range."""
    salted, copies = _dealt(asked, machines)

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [tuple(p) for p in rows.column("part").to_pylist()]
        found: dict[tuple, int] = {}
        if parts and counts.num_rows:
            asked_for = sorted(set(parts))
            words = sorted({w for p in asked_for for w in p})
            place = {w: i for i, w in enumerate(words)}
            columns = [np.array([place[p[j]] for p in asked_for]) for j in range(len(asked_for[0]))]
            acceptor = build(words, columns, np.ones(len(asked_for), np.int64))
            found = dict(compose(acceptor, Machine.unpacked(counts.column("machine")[0].as_py())))
        return rows.select(["gram", "k", "side"]).append_column("f", pa.array([found.get(p) for p in parts], pa.int64()))

    keys = ["n", "range", "salt"]
    return (
        salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(run, "gram array<binary>, k int, side int, f bigint")
    )


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts (null: empty) are lower-cased in A-Z, cut at ``.,;:!?`` and line ends, and split at
    spaces and tabs; lang null counts as ``und``.  Candidates are phrases of two to four words that
    occur at least ``least`` times; l and r are the counts of the two parts at the cut with the
    lowest score floor(2000000 a / (l + r)), the first such cut.  Phrases inside a longer one that
    occurs at least ``percent`` percent as often are dropped.  Ties go to the higher count, then to
    the bytewise smaller phrase.  Repeated rows count each time; doc_id and other columns are not
    looked at.  An empty table gives an empty table.
    """
    texts = docs.select(
        F.coalesce(F.col("lang"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text")
    )
    spark = docs.sparkSession
    every = settle(_word_counts(texts), "words")
    totals = settle(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    total = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    often = every.where(F.col("f") >= least)
    bounds = spark.sparkContext.broadcast(_bounds(often, total))
    one = settle(_united(_word_machines(often, bounds), least), "one")
    bits = _sieve(_grams(one), 1)
    two = settle(_united(_ngram_machines(texts, (2,), bits, bounds), least), "two")
    bits = _sieve(_grams(two), 2)
    more = settle(_united(_ngram_machines(texts, (3, 4), bits, bounds), least), "more")
    machines = one.unionByName(two).unionByName(more)
    candidates = settle(_grams(two.unionByName(more)), "candidates")
    asked = settle(_parts(candidates, bounds), "asked")
    counts = _looked_up(asked, machines)
    cut = counts.groupBy("gram", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    exact = "cast(a as decimal(28,0)) * 2000000 div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))"
    best = (
        cut.join(candidates.select("gram", F.col("f").alias("a")), "gram")
        .withColumn("score", F.expr(exact))
        .groupBy("gram")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    )
    inside = (
        candidates.where(F.size("gram") > 3)
        .select("f", F.col("gram")[0].alias("lang"), F.expr("slice(gram, 2, 4)").alias("w"))
        .select(
            "f",
            F.explode(
                F.expr(
                    "flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1),"
                    " i -> concat(array(lang), slice(w, i, m)))))"
                )
            ).alias("gram"),
        )
        .groupBy("gram")
        .agg(F.max("f").alias("longer"))
    )
    kept = best.join(inside, "gram", "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(28,0)") * 100 < F.col("a").cast("decimal(28,0)") * percent)
    )
    shown = kept.join(totals, kept["gram"][0] == totals["lang"]).select(
        F.col("lang").cast("string").alias("lang"),
        F.expr("array_join(transform(slice(gram, 2, 4), w -> cast(w as string)), ' ')").alias("phrase"),
        "a",
        F.col("best.l").alias("l"),
        F.col("best.r").alias("r"),
        "n",
        F.col("best.score").cast("bigint").alias("score"),
    )
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = shown.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
