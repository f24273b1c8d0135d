"""Language-model scores by deleted interpolation.

Words, pairs of word classes (a word of up to four bytes is its own class, longer ones share a
class by ending and length) and word bigrams and trigrams (as 64-bit hashes) are counted, apart
for a deleted part of the training documents.  Each order's maximum-likelihood estimate is mixed
with the next lower one; the mixture weight depends on how often the context was seen, one
weight per power of two, learned by expectation-maximisation on the deleted part's tokens:

    PC(w | h)   = P1(w) * (lambda * C(class w | class h) / P1(class w) + 1 - lambda)
    P2(w | h)   = lambda2 * c(h w) / c(h) + (1 - lambda2) * PC(w | h)
    P3(w | g h) = lambda3 * c(g h w) / c(g h) + (1 - lambda3) * P2(w | h)

P1 is the additive unigram over all known words and one unknown, so P sums to at most 1.  All
counts are in the model.

Texts are cut into blocks of about BLOCK_TOKENS tokens, each of one part.  A block sends each distinct word, then
each distinct key, once, to the task of the word's or key's range of hashes, whatever its
frequency; that task adds up and answers with the totals alone, in the order in which they were
asked.  So no table of n-grams is written, nothing is looked up row by row, and every later
step (weights, scores) finds the counts of its tokens beside them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import remainder, slices
from spectraloom.session import intermediates, settle, settle_outside, shuffles_deleted

RELATIVE = 1_000_000
HELD_MODULUS = 11
CLASS_BITS = 31
START, END = 0, 1
END_WORD = b"\n"  # no word holds white space
WORDS_KEPT = 300_000
BLOCK_TOKENS = 500_000
KEYS_AT_ONCE = 3_000_000
TURNS = 4  # all keys are counted, a quarter of the hashes after the other; a power of two
STEPS = 200
BUCKETS = 41
_MASK = (1 << CLASS_BITS) - 1
_START_HASH, _END_HASH, _TRIGRAM, _PAIR, _CLASS, _CLASS_WORDS = range(1, 7)
_MAIN, _DELETED, _HELD_OUT = range(3)


class _Classes(dict):
    """Class of a word, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        shape = word if len(word) <= 4 else b"\x00%d %b" % (min(len(word), 15), word[-2:])
        value = self[word] = max(2, zlib.crc32(shape) & _MASK)
        return value


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order (uint64)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _pack(values: np.ndarray) -> bytes:
    """Bytes of the numbers, compressed place by place."""
    places = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(places.T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    places = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(places.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _joined(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b" ".join(words))


def _parted(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _words_and_sizes(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and the number of words of each; see ``words_of``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.view(pa.string()), "")))
    words, of = lists.flatten().view(pa.binary()), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    return words.filter(full), np.bincount(of.filter(full).to_numpy(), minlength=len(texts))


def blocks_of(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text, kind), each of one kind and with its words numbered.

    A block holds whole texts; every text ends with END_WORD, number 0.
    """
    most = BLOCK_TOKENS

    def row(block: int, kind: int, parts: list[tuple[pa.Array, pa.Array, np.ndarray]], known: _Classes) -> pa.RecordBatch:
        size = np.concatenate([p[2] for p in parts])
        numbered = pa.concat_arrays([p[1] for p in parts]).dictionary_encode()
        words = [END_WORD, *numbered.dictionary.to_pylist()]
        ids = np.zeros(int(size.sum()) + len(size), np.int32)
        ends = np.cumsum(size + 1) - 1
        is_word = np.ones(len(ids), bool)
        is_word[ends] = False
        ids[is_word] = numbered.indices.to_numpy() + 1
        cls = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        cls[0] = END
        lists = (pa.concat_arrays([p[0] for p in parts]), pa.array(size + 1))
        cells = [_pack(ids), _joined(words), _pack(cls)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([kind], pa.int32()),
                *(pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), x) for x in lists),
                *(pa.array([x], pa.binary()) for x in cells),
                *(pa.array([x], pa.int64()) for x in (len(ids), len(words))),
            ],
            names=["block", "kind", "doc_id", "size", "ids", "words", "cls", "tokens", "distinct"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        known = _Classes()
        waiting: dict[int, list] = {}
        for batch in slices(batches, 200):
            for kind in pc.unique(batch.column("kind")).to_pylist():
                part = batch.filter(pc.equal(batch.column("kind"), kind))
                waiting.setdefault(kind, []).append((part.column("doc_id"), *_words_and_sizes(part.column("text"))))
                if sum(len(p[1]) + len(p[2]) for p in waiting[kind]) >= most:
                    yield row(block, kind, waiting.pop(kind), known)
                    block += 1
        for kind, parts in waiting.items():
            yield row(block, kind, parts, known)
            block += 1

    return docs.select("doc_id", "kind", F.col("text").cast("binary").alias("text")).mapInArrow(
        run,
        "block bigint, kind int, doc_id array<bigint>, size array<bigint>, ids binary, words binary, cls binary, tokens bigint, distinct bigint",
    )


class _Block:
    """A block's tokens, decoded from its row."""

    def __init__(self, row: dict):
        self.doc_id, self.kind = row["doc_id"], row["kind"]
        self.size = np.array(row["size"], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = _parted(row["words"])
        self.ids, self.cls = _unpack(row["ids"], np.int32), _unpack(row["cls"], np.int32).astype(np.int64)
        self.first = np.zeros(len(self.ids), bool)
        self.first[self.start] = True
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        self.hashes[0] = _END_HASH
        self.order = np.argsort(self.hashes, kind="stable")  # in which words are asked
        self.count = np.bincount(self.ids, minlength=len(self.words))

    def back(self, answers: list[dict], names: tuple[str, ...]) -> list[np.ndarray]:
        """The answers, by ascending hash."""
        kinds = {"main": np.int64, "held": np.int64, "owner": np.uint8}
        return [np.concatenate([_unpack(a[n], kinds[n]) for a in answers]) for n in names]

    def word_totals(self, answers: list[dict]) -> list[np.ndarray]:
        """Main and deleted counts of each word, and whether this block stands for it."""
        out = []
        for values in self.back(answers, ("main", "held", "owner")):
            out.append(np.empty_like(values))
            out[-1][self.order] = values
        return out

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The values one token earlier, ``start`` at the beginning of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def class_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending keys of the classes and of their numbers of words, their order before
        sorting, and the number of each word's class (last: START's)."""
        found, of = np.unique(np.append(self.cls, START), return_inverse=True)
        keys = np.concatenate([_mixed(found.view(np.uint64), np.uint64(x)) for x in (_CLASS, _CLASS_WORDS)])
        order = np.argsort(keys)
        return keys[order], order, of

    def pairs(self) -> np.ndarray:
        now = self.cls[self.ids]
        return (self.before(now, START) << CLASS_BITS) | now

    def keys(self) -> np.ndarray:
        """Keys of the class pairs, then the bigrams, then the trigrams (none of a first token)."""
        word = self.hashes[self.ids]
        two = _mixed(self.before(word, _START_HASH), word)
        three = _mixed(two[:-1] + np.uint64(_TRIGRAM), word[1:])[~self.first[1:]]
        return np.concatenate([_mixed(self.pairs().view(np.uint64), np.uint64(_PAIR)), two, three])


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])


def _within(keys: np.ndarray, first: np.uint64, last: np.uint64) -> np.ndarray:
    return keys[(keys >= first) & (keys <= last)]


def _order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and the sorted keys.

    Sorted with their positions in the low bits, which is several times faster than argsort.
    """
    bits = np.uint64(len(keys).bit_length())
    packed = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():  # keys that differ in the low bits only
        again = np.argsort(ordered, kind="stable")
        order, ordered = order[again], ordered[again]
    return order, ordered


def _spread(values: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value of each key from those of the distinct keys, which begin at ``at`` in ``order``."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(at, len(order))))
    return out


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


_ASKED = "bucket int, block bigint, kind int, asked binary, n binary"
_ANSWER = "block bigint, bucket int, main binary, held binary, owner binary, tokens bigint, words bigint"


def _bits(entries: int) -> int:
    """Bits of a hash that number its range, so that a range gets about KEYS_AT_ONCE entries.

    No range lies in two turns.
    """
    return max(TURNS.bit_length() - 1, 1, int(np.ceil(np.log2(max(1, entries) / KEYS_AT_ONCE))))


def _asked(row: dict, bits: int, hashes: np.ndarray, asked: Callable[[int, int], bytes], n: np.ndarray) -> pa.RecordBatch:
    """A row for each range of the ascending hashes."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int32)
    starts = _starts(bucket)
    cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[starts], pa.int32()),
            pa.array([row["block"]] * len(cuts), pa.int64()),
            pa.array([row["kind"]] * len(cuts), pa.int32()),
            pa.array([asked(a, b) for a, b in cuts], pa.binary()),
            pa.array([_pack(n[a:b].astype(np.int32)) for a, b in cuts], pa.binary()),
        ],
        names=["bucket", "block", "kind", "asked", "n"],
    )


def _ask_words(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            b = _Block(row)
            words = [b.words[i] for i in b.order.tolist()]
            yield _asked(row, bits, b.hashes[b.order], lambda x, y: _joined(words[x:y]), b.count[b.order])

    return blocks.mapInArrow(run, _ASKED)


def _ask_keys(blocks: DataFrame, bits: int, turn: int) -> DataFrame:
    """The keys of one of TURNS parts of the ranges."""
    first, last = (np.uint64((x << 64) // TURNS - (x > turn)) for x in (turn, turn + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            b = _Block(row)
            keys = _within(b.keys(), first, last)
            keys.sort()
            at = _starts(keys)
            n, keys = np.diff(np.append(at, len(keys))), keys[at]
            more, order, of = b.class_keys()
            owner = np.append(b.word_totals(row["answers"])[2], 0)
            counts = [np.bincount(of, x) for x in (np.append(b.count, len(b.size)), owner)]
            inside = (more >= first) & (more <= last)
            more, counted = more[inside], np.concatenate(counts)[order][inside]
            where = np.searchsorted(keys, more)
            keys, n = np.insert(keys, where, more), np.insert(n, where, counted)
            if len(keys):
                yield _asked(row, bits, keys, lambda x, y, keys=keys: _pack(np.diff(keys[x:y], prepend=np.uint64(0))), n)

    return blocks.mapInArrow(run, _ASKED)


def _answered(asked: DataFrame, words: bool) -> DataFrame:
    """Totals of what the blocks ask for, in the order of each; of every trained word one block is the owner."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        parts = [_parted(d) if words else np.cumsum(_unpack(d, np.uint64)) for d in table.column("asked").to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        if words:
            code = pa.array(chain.from_iterable(parts), pa.binary()).dictionary_encode().indices.to_numpy()
            order = np.argsort(code, kind="stable")
            at = _starts(code[order])
        else:
            order, ordered = _order(np.concatenate(parts))
            at = _starts(ordered)
        counts = [_unpack(d, np.int32).astype(np.int64) for d in table.column("n").to_pylist()]
        totals = []
        for kind in (_MAIN, _DELETED):
            n = np.concatenate([c if k == kind else np.zeros_like(c) for c, k in zip(counts, kinds)])
            totals.append(_spread(np.add.reduceat(n[order], at), order, at))
        owner = np.zeros(len(order), np.uint8)
        if words:
            trained = np.flatnonzero(np.repeat(np.array(kinds) != _HELD_OUT, [len(p) for p in parts]))
            owner[trained[np.unique(code[trained], return_index=True)[1]]] = 1
        split = [np.split(x, ends[:-1]) for x in (*totals, owner)]
        return pa.table(
            {
                "block": table.column("block"),
                "bucket": table.column("bucket"),
                **{name: pa.array([_pack(x) for x in s], pa.binary()) for name, s in zip(("main", "held", "owner"), split)},
                "tokens": pa.array([int((m + h)[o > 0].sum()) for m, h, o in zip(*split)], pa.int64()),
                "words": pa.array([int(o.sum()) for o in split[2]], pa.int64()),
            }
        )

    return asked.groupBy("bucket").applyInArrow(run, _ANSWER)


def _beside(blocks: DataFrame, answers: DataFrame, name: str, *fields: str) -> DataFrame:
    """The blocks with their answers as a list, by ascending range."""
    lists = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", *fields))).alias(name))
    return blocks.join(lists, "block")


def weights(histogram: list[tuple[int, float | None, int]]) -> dict[int, float]:
    """Mixture weight of each bucket from (bucket, ratio or None, count) by EM."""
    found = {}
    for bucket in {b for b, _, _ in histogram}:
        rows = [(0.0 if r is None else r, n) for b, r, n in histogram if b == bucket]
        ratio, n = np.array([r for r, _ in rows]), np.array([n for _, n in rows], float)
        share = 0.5
        for _ in range(STEPS):
            mixed = share * ratio
            share = float((n * mixed / (mixed + 1 - share)).sum() / n.sum())
            share = min(max(share, 1e-6), 1 - 1e-6)
        found[bucket] = share
    return found


def _bucket(count) -> Column:
    return F.least(F.lit(BUCKETS - 1), F.floor(F.log2(count + 1))).cast("int")


def _by_bucket(values: list[float], count) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), _bucket(count) + 1)


def _steps(table: DataFrame, context: Column, ratio: Column) -> list[float]:
    """Mixture weight of every bucket of ``context`` from the deleted part's tokens."""
    histogram = (
        table.groupBy(_bucket(context).alias("bucket"), F.round(F.log(ratio) * 20).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # buckets x steps of a logarithm: bounded
    )
    found = weights([(r[0], None if r[1] is None else float(np.exp(r[1] / 20)), r[2]) for r in histogram])
    share = [found.get(0, 0.0)]
    for b in range(1, BUCKETS):  # a context seen more often than any of the main part: as the next lower
        share.append(found.get(b, share[-1]))
    return share


class _Counted(_Block):
    """A block with the counts of all its tokens; ``_main`` without the deleted part, for its blocks only."""

    def __init__(self, row: dict, tokens: int, words: int):
        super().__init__(row)
        total = tokens + words + 1
        order, keys = _order(self.keys())
        at = _starts(keys)
        more, class_order, of = self.class_keys()
        where = np.searchsorted(keys[at], more) + np.arange(len(more))
        word_main, word_held, self.owner = self.word_totals(row["answers"])
        main, held = self.back(row["totals"], ("main", "held"))

        def parts(values: np.ndarray) -> list[np.ndarray]:
            """Of classes and their numbers of words, of each token's pair, bigram and trigram."""
            classes = np.empty(len(more), np.int64)
            classes[class_order] = values[where]
            found = _spread(np.delete(values, where), order, at)
            three = np.zeros(len(self.ids), np.int64)
            three[~self.first] = found[2 * len(self.ids) :]
            return [*(x[of] for x in np.split(classes, 2)), *np.split(found[: 2 * len(self.ids)], 2), three]

        self.word_all = word_main + word_held
        self.c = self.word_all[self.ids]
        self.p1 = (self.c + 1) / total
        cls, cls_words, self.pair_all, self.two_all, self.three_all = parts(main + held)
        self.q = ((cls + cls_words + 1) / total)[self.ids]  # of the token's class
        self.h_all = self.before(cls[self.ids], cls[-1])  # of the class before
        self.l_all = self.before(self.c, cls[-1])  # of the word before
        self.g_all = self.before(self.two_all, 0)  # of the two before
        if self.kind == _DELETED:
            cls, _, self.pair_main, self.two_main, self.three_main = parts(main)
            self.h_main = self.before(cls[self.ids], cls[-1])
            self.l_main = self.before(word_main[self.ids], cls[-1])
            self.g_main = self.before(self.two_main, 0)


def _deleted(blocks: DataFrame, answers: DataFrame, n: int, v: int) -> DataFrame:
    """The main part's counts of every token of the deleted part."""
    columns = ("h_all", "h_main", "pair_main", "l_main", "two_main", "g_main", "three_main", "p1", "q", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            b = _Counted(row, n, v)
            for start in range(0, len(b.ids), 50_000):
                stop = start + 50_000
                yield pa.RecordBatch.from_arrays([pa.array(getattr(b, c)[start:stop]) for c in columns], names=list(columns))

    kinds = ["bigint"] * 7 + ["double"] * 2 + ["boolean"]
    chosen = blocks.where(F.col("kind") == _DELETED)
    counted = _beside(chosen, answers.join(chosen.select("block"), "block", "left_semi"), "totals", "main", "held")
    return counted.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))


def _learned(deleted: DataFrame) -> tuple[list[float], list[float], list[float]]:
    """Weights lambda, lambda2 and lambda3 of every bucket."""

    def seen(count: str, of: str) -> Column:
        return F.when(F.col(count) > 0, F.col(count) / F.col(of))

    one = _steps(deleted, F.col("h_all"), seen("pair_main", "h_main") / F.col("q"))
    share = _by_bucket(one, F.col("h_all"))
    pc = F.col("p1") * (share * F.coalesce(seen("pair_main", "h_main") / F.col("q"), F.lit(0.0)) + 1 - share)
    two = _steps(deleted, F.col("l_main"), seen("two_main", "l_main") / pc)
    share = _by_bucket(two, F.col("l_main"))
    p2 = share * F.coalesce(seen("two_main", "l_main"), F.lit(0.0)) + (1 - share) * pc
    three = _steps(deleted.where("NOT first"), F.col("g_main"), seen("three_main", "g_main") / p2)
    return one, two, three


@dataclass
class Model:
    tokens: int  # N
    words: int  # V
    shares: tuple[list[float], list[float], list[float]]  # of class pairs, bigrams, trigrams
    #: Classes seen as context and class pairs of at least one in RELATIVE tokens; filled by ``learn``
    contexts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    context_log: np.ndarray = field(default_factory=lambda: np.empty(0))  # log10(1 - lambda)
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    pair_log: np.ndarray = field(default_factory=lambda: np.empty(0))  # log10 of the factor on P1

    def share(self, order: int, context: np.ndarray) -> np.ndarray:
        bucket = np.minimum(BUCKETS - 1, np.frexp((context + 1).astype(np.float64))[1] - 1)
        return np.where(context > 0, np.array(self.shares[order])[bucket], 0.0)

    def factor(self, b: _Counted) -> np.ndarray:
        """PC over P1 of every token."""
        share = self.share(0, b.h_all)
        return share * b.pair_all / np.maximum(b.h_all, 1) / b.q + 1 - share

    def logs(self, b: _Counted) -> np.ndarray:
        """log10 P3 of every token."""
        share = self.share(1, b.l_all)
        p = share * b.two_all / np.maximum(b.l_all, 1) + (1 - share) * b.p1 * self.factor(b)
        share = self.share(2, b.g_all)
        return np.log10(share * b.three_all / np.maximum(b.g_all, 1) + (1 - share) * p)


def _counts(docs: DataFrame) -> tuple[DataFrame, Model]:
    """The blocks of ``docs`` (doc_id, text, held_out) with all counts, and the model."""
    spark = docs.sparkSession
    kind = F.when(F.col("held_out"), _HELD_OUT).when(remainder(F.col("doc_id"), HELD_MODULUS) == 0, _DELETED)
    parted = docs.select("doc_id", "text", kind.otherwise(_MAIN).cast("int").alias("kind"))
    with shuffles_deleted(spark):
        with intermediates(spark):
            blocks = settle(blocks_of(parted), "blocks")
            tokens, distinct = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct")]).first()
            answers = settle(_answered(_ask_words(blocks, _bits(distinct)), True), "words")
            n, v = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words")]).first()
            worded = settle_outside(_beside(blocks, answers, "answers", "main", "held", "owner"), "worded")
        bits = _bits(2 * tokens)
        turns = [settle(_answered(_ask_keys(worded, bits, turn), False), "keys") for turn in range(TURNS)]
        answers = reduce(DataFrame.union, turns)
        with intermediates(spark):
            shares = _learned(settle(_deleted(worded, answers, n, v), "deleted"))
    return _beside(worded, answers, "totals", "main", "held"), Model(int(n), int(v), shares)


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Model and the table ``(word, c)`` of all word counts, from all given documents.

    The model holds the frequent contexts and class pairs; at most RELATIVE of each can exist.
    """
    counted, model = _counts(docs.select("doc_id", "text", F.lit(False).alias("held_out")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            b = _Counted(row, model.tokens, model.words)
            at = np.flatnonzero(b.owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.words[i] for i in at.tolist()], pa.binary()), pa.array(b.word_all[at], pa.int64())],
                names=["word", "c"],
            )

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            b = _Counted(row, model.tokens, model.words)
            pairs = b.pairs()
            rest, factor = np.log10(1 - model.share(0, b.h_all)), np.log10(model.factor(b))
            for pair, key, value, count in ((False, pairs >> CLASS_BITS, rest, b.h_all), (True, pairs, factor, b.pair_all)):
                key, at = np.unique(key, return_index=True)
                often = count[at] * RELATIVE >= model.tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(often.sum()), pair)), pa.array(key[often]), pa.array(value[at][often])],
                    names=["pair", "key", "value"],
                )

    sent = counted.mapInArrow(logs, "pair boolean, key bigint, value double").dropDuplicates(["pair", "key"])
    tables = []
    for pair in (False, True):
        table = sent.where(F.col("pair") == pair).sort("key").select("key", "value").toArrow()
        tables += [table.column("key").to_numpy(), table.column("value").to_numpy()]
    found = Model(model.tokens, model.words, model.shares, *tables)
    return found, counted.mapInArrow(words, "word binary, c bigint")


def _looked_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Value of each key, NaN where the table lacks it."""
    if not len(table):
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], np.nan)


def score(counted: DataFrame, model: Model) -> DataFrame:
    """Scores of every text in the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows_of(batches):
            b = _Counted(row, model.tokens, model.words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.doc_id, pa.int64()),
                    pa.array(np.full(len(b.size), b.kind == _HELD_OUT)),
                    pa.array(b.size),
                    pa.array(np.add.reduceat((b.c > 0).astype(np.int64), b.start)),
                    pa.array(np.full(len(b.size), model.tokens)),
                    pa.array(np.add.reduceat(np.log10(b.p1), b.start)),
                    pa.array(np.add.reduceat(model.logs(b), b.start)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return counted.mapInArrow(
        run,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` by a model of those whose crc32(doc_id) mod 7 is not 2.

    Null texts count as empty: one end token.  A null id counts as empty text in the hash.
    Repeated rows are counted and scored as often as they occur.  Without training rows every
    base score is 0; an empty table gives an empty table.
    """
    return score(*_counts(docs.select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))))
