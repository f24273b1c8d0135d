"""Removal of long repeated byte strings by suffix arrays over shards of the corpus.

Two equal strings of ``length`` bytes have the same anchor: the least hash of their grams of half
that length.  Neighbouring windows of one anchor form a stretch, so the stretches of one anchor
hold every copy of their windows, and an anchor belongs to one shard.  Stretches that occur more
than once are repeats as they are and travel once; an anchor with a single, once occurring stretch
that does not repeat itself needs no look.  The texts of all others are read into the shards,
where a suffix array with common-prefix values (``induce``) finds the repeated windows.

An anchor whose different stretches exceed ``HOT_BYTES`` would fill a shard of its own; its windows
are counted by 128-bit digests instead, which groups of any size survive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.llm.common import slices
from spectraloom.llm.induce import Scratch, suffixes
from spectraloom.session import settle

SHARD_BYTES = 2 << 20
HOT_BYTES = 1 << 20
STRETCH_WINDOWS = 4096
SIEVE_BITS = 1 << 25
MEMORY = 128 << 20
SEEN = 200_000
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR, _SHIFT = 1, 2  # symbols of a shard's text: 0 ends it, 1 ends a stretch, then the bytes


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a text needs them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 17)
            parts = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                power = np.full(size, np.uint64(base))
                power[0] = 1
                parts.append(np.multiply.accumulate(power))
            self.up, self.down = parts
        return self.up[:n], self.down[:n]


def gram_hashes(data: np.ndarray, gram: int, powers: _Powers) -> np.ndarray:
    """Hash of every ``gram`` neighbouring bytes, the same wherever they stand."""
    n = len(data)
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    least, span = h, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    count = len(h) - width + 1
    return np.minimum(least[:count], least[width - span : width - span + count])


def stretches(text: bytes, length: int, powers: _Powers) -> tuple[np.ndarray, ...]:
    """Anchor, first window, windows, and whether the anchor occurs again, of all stretches of a text."""
    if len(text) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),)
    gram = max(1, length // 2)
    width = length - gram + 1
    h = gram_hashes(np.frombuffer(text, np.uint8), gram, powers)
    least = _least_of(h, width)
    start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    anchor = least[start]
    enters = np.append(False, h[width:] == least[:-1])  # the window's last gram equals the anchor before
    enters[start] = False
    again = np.add.reduceat(enters, start, dtype=np.int64) > 0
    for lo in range(0, len(start), 4096):
        part = slice(lo, lo + 4096)
        first = np.lib.stride_tricks.sliding_window_view(h, width)[start[part]]
        again[part] |= (first == anchor[part, None]).sum(axis=1) > 1
    windows = np.diff(np.append(start, len(least)))
    if (windows > STRETCH_WINDOWS).any():  # long stretches are cut; their parts may repeat one another
        pieces = -(-windows // STRETCH_WINDOWS)
        again = np.repeat(again | (pieces > 1), pieces)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(windows, pieces) - nth * STRETCH_WINDOWS
        anchor, start = np.repeat(anchor, pieces), np.repeat(start, pieces) + nth * STRETCH_WINDOWS
        windows = np.minimum(left, STRETCH_WINDOWS)
    return anchor.view(np.int64), start, windows, again


def _digests(text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    view = memoryview(text)
    found = [xxhash.xxh3_64_intdigest(view[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]
    return np.array(found, np.uint64).view(np.int64)


class _Sieve:
    """Bloom filter of 64-bit hashes, of fixed size; full, it lets everything pass and a join decides."""

    def __init__(self, df: DataFrame, name: str):
        low, high = F.col(name).bitwiseAND(SIEVE_BITS - 1), F.shiftrightunsigned(name, 32).bitwiseAND(SIEVE_BITS - 1)
        bits = (
            df.select(F.explode(F.array(low, high)).alias("_p"))
            .groupBy(F.expr("_p div 64").alias("_w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits"))
            .toArrow()  # at most SIEVE_BITS / 64 rows
        )
        bitmap = np.zeros(SIEVE_BITS // 64, np.int64)
        bitmap[bits.column("_w").to_numpy()] = bits.column("_bits").to_numpy()
        self.ship = df.sparkSession.sparkContext.broadcast(bitmap)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        bits, out = self.ship.value, np.ones(len(hashes), bool)
        for p in (hashes & (SIEVE_BITS - 1), (hashes.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (SIEVE_BITS - 1)):
            out &= (bits[p >> 6] >> (p & 63)) & 1 == 1
        return out


_FOUND = pa.struct(
    [("anchor", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("again", pa.bool_())]
)


def _stretch_table(texts: DataFrame, length: int) -> DataFrame:
    """``(text_key, found)``: digest of each text with its stretches (anchor, digest, start, size, again)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in slices(batches, 200):
            key, parts = [], []
            for text in batch.column("text").to_pylist():
                anchor, start, windows, again = stretches(text, length, powers)
                size = windows + length - 1
                key.append(xxhash.xxh3_128_digest(text))
                parts.append((anchor, _digests(text, start, size), start, size, again))
            ends = np.cumsum([0] + [len(p[0]) for p in parts])
            columns = [np.concatenate([p[c] for p in parts]) if parts else np.empty(0, np.int64) for c in range(5)]
            fields = [pa.array(c, f.type) for c, f in zip(columns, _FOUND)]
            found = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_FOUND))
            )
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), found], names=["text_key", "found"])

    return texts.mapInArrow(
        run,
        "text_key binary, found array<struct<anchor:bigint,digest:bigint,start:bigint,size:int,again:boolean>>",
    )


def _shared(each: DataFrame, sieve: _Sieve) -> DataFrame:
    """Stretches whose anchor the filter lets through."""
    columns, schema = each.columns, each.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.passes(batch.column("anchor").to_numpy()))).select(columns)

    return each.mapInArrow(run, schema)


def _fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(anchor, digest, content)`` of what may be wanted, read from the texts again."""
    anchors, digests = _Sieve(wanted, "anchor"), _Sieve(wanted, "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, 200):
            rows: list[tuple[int, int, bytes]] = []
            for text in batch.column("text").to_pylist():
                anchor, start, windows, _ = stretches(text, length, powers)
                some = np.flatnonzero(anchors.passes(anchor))
                anchor, start, size = anchor[some], start[some], windows[some] + length - 1
                digest = _digests(text, start, size)
                some = digests.passes(digest)
                for a, d, at, n in zip(*(x[some].tolist() for x in (anchor, digest, start, size))):
                    if (a, d) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add((a, d))
                        rows.append((a, d, text[at : at + n]))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                names=["anchor", "digest", "content"],
            )

    return texts.mapInArrow(run, "anchor bigint, digest bigint, content binary")


def repeated_windows(contents: list[bytes], length: int, memory: int = MEMORY) -> list[list[tuple[int, int]]]:
    """Of each content the byte ranges covered by strings of ``length`` that start anywhere else in them."""
    starts = np.cumsum([0] + [len(c) + 1 for c in contents])
    with Scratch(memory) as scratch:
        text = scratch.empty(int(starts[-1]) + 1, np.int32)
        for at, content in zip(starts.tolist(), contents):
            text[at : at + len(content)] = np.frombuffer(content, np.uint8)
            text[at : at + len(content)] += _SHIFT
            text[at + len(content)] = _SEPARATOR
        text[-1] = 0
        place, shared = suffixes(text, scratch)
        marked = np.zeros(int(starts[-1]), bool)
        step = 1 << 20
        for lo in range(0, len(place), step):
            part = shared[lo : lo + step + 1] >= length  # with one more: shared with the next
            own = part[:step].copy()
            own[: len(part) - 1] |= part[1:]
            marked[place[lo : lo + step][own]] = True
        for stop in (starts[1:] - 1).tolist():  # strings that run over a content's end
            marked[max(0, stop - length + 1) : stop + 1] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))).reshape(-1, 2)
    owner = np.searchsorted(starts, edges[:, 0], "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in contents]
    for c, (lo, hi) in zip(owner.tolist(), edges.tolist()):
        out[c].append((lo - int(starts[c]), hi - int(starts[c]) + length - 1))
    return out


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _sorted_shards(rows: DataFrame, length: int, memory: int) -> DataFrame:
    """``(anchor, digest, spans)`` of the contents that come sorted by shard, anchor and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        contents: list[bytes] = []

        def flush() -> pa.RecordBatch:
            found = repeated_windows(contents, length, memory)
            some = [i for i, f in enumerate(found) if f]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i][0] for i in some], pa.int64()),
                    pa.array([keys[i][1] for i in some], pa.int64()),
                    pa.array([[{"lo": a, "hi": b} for a, b in found[i]] for i in some], _SPANS),
                ],
                names=["anchor", "digest", "spans"],
            )
            keys.clear()
            contents.clear()
            return batch

        now = None
        for batch in batches:
            for shard, anchor, digest, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != now:
                    if keys:
                        yield flush()
                    now = shard
                if not keys or keys[-1] != (anchor, digest):  # each task may send a content once
                    keys.append((anchor, digest))
                    contents.append(content)
        if keys:
            yield flush()

    return rows.select("shard", "anchor", "digest", "content").mapInArrow(
        run, "anchor bigint, digest bigint, spans array<struct<lo:bigint,hi:bigint>>"
    )


def _hot_spans(rows: DataFrame, length: int) -> DataFrame:
    """``(anchor, digest, spans)`` of contents of anchors too large for a shard, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            anchor, digest, at, window = [], [], [], []
            for a, d, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "content"))):
                n = len(content) - length + 1
                anchor += [a] * n
                digest += [d] * n
                at += range(n)
                window += [xxhash.xxh3_128_digest(content[i : i + length]) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor, pa.int64()), pa.array(digest, pa.int64()), pa.array(at, pa.int32()), pa.array(window, pa.binary())],
                names=["anchor", "digest", "at", "window"],
            )

    once = rows.dropDuplicates(["anchor", "digest"])
    windows = settle(once.mapInArrow(run, "anchor bigint, digest bigint, at int, window binary"), "windows")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("window")
    marked = windows.join(often, "window", "left_semi").groupBy("anchor", "digest")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for found in batch.column("at").to_pylist():
                at = np.sort(np.array(found, np.int64))
                ends = np.flatnonzero(np.diff(at) > length)
                lo, hi = at[np.append(0, ends + 1)], at[np.append(ends, len(at) - 1)] + length
                spans.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("anchor"), batch.column("digest"), pa.array(spans, _SPANS)], names=["anchor", "digest", "spans"]
            )

    return marked.agg(F.collect_list("at").alias("at")).mapInArrow(
        ranges, "anchor bigint, digest bigint, spans array<struct<lo:bigint,hi:bigint>>"
    )


def repeated_spans(
    docs: DataFrame, length: int = 400, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES, memory: int = MEMORY
) -> DataFrame:
    """``(text_key, spans)``: byte ranges of each distinct text that repeated strings cover.

    ``text_key`` is the 128-bit digest of the text's bytes; the ranges may overlap.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(F.length("text") >= length)
    table = settle(_stretch_table(texts, length), "stretches")
    each = table.select("text_key", F.explode("found").alias("f")).select("text_key", "f.*")
    shared = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("again").alias("again"))
    sieve = _Sieve(shared.where("times > 1 OR again"), "anchor")
    rows = settle(
        _shared(each, sieve)
        .groupBy("text_key", "start", "size", "anchor", "digest", "again")
        .agg(F.count(F.lit(1)).alias("copies")),
        "repeated",
    )
    contents = rows.groupBy("anchor", "digest", "size", "again").agg(F.sum("copies").alias("copies"))
    contents = settle(contents, "contents")
    anchors = contents.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("bytes"), F.max("again").alias("again")
    )
    anchors = settle(anchors.where("kinds > 1 OR again").select("anchor", "bytes"), "anchors")
    total = anchors.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))
    wanted = contents.select("anchor", "digest").join(
        anchors.select(
            "anchor",
            F.when(F.col("bytes") <= hot_bytes, F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"),
        ),
        "anchor",
    )
    wanted = settle(wanted, "wanted")
    fetched = settle(_fetched(texts, wanted, length).join(wanted, ["anchor", "digest"]), "fetched")
    cold = fetched.where("shard IS NOT NULL").select("shard", "anchor", "digest", "content")
    cold = cold.repartition(shards, "shard").sortWithinPartitions("shard", "anchor", "digest")
    found = _sorted_shards(cold, length, memory).unionByName(_hot_spans(fetched.where("shard IS NULL"), length))
    single = rows.join(contents.where("copies = 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    by_sort = single.join(settle(found, "found"), ["anchor", "digest"]).select("text_key", "start", F.explode("spans").alias("s"))
    by_copy = rows.join(contents.where("copies > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
    every = by_sort.select(
        "text_key", (F.col("start") + F.col("s.lo")).alias("lo"), (F.col("start") + F.col("s.hi")).alias("hi")
    ).unionByName(by_copy.select("text_key", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi")))
    return every.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def without_repeats(docs: DataFrame, length: int = 400, **limits) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row of ``docs`` (doc_id, text, ...).

    ``spans`` are the maximal byte ranges [lo, hi) covered by strings of ``length`` bytes that also
    start elsewhere in any row, this one included; ``kept`` is the other bytes, concatenated (they
    need not be valid UTF-8).  Null texts count as empty; texts shorter than ``length`` stay whole.
    Repeated rows repeat one another, so both go.  A null doc_id is returned as such.  Other columns
    are ignored.  An empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spans = settle(repeated_spans(docs, length, **limits), "spans")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            key = [xxhash.xxh3_128_digest(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.binary())], names=["doc_id", "text", "text_key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            removed, kept = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for s in found or ():
                    if merged and s["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["hi"])
                    else:
                        merged.append([s["lo"], s["hi"]])
                ends = [0, *(x for m in merged for x in m), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                removed.append([{"lo": a, "hi": b} for a, b in merged])
            size = pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(removed, _SPANS), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = rows.mapInArrow(keyed, "doc_id bigint, text binary, text_key binary").join(spans, "text_key", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, spans array<struct<lo:bigint,hi:bigint>>, kept binary"
    )


def summary(cut: DataFrame) -> DataFrame:
    """Lengths, number of runs and digest of what is kept."""
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
