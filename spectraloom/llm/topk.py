"""Exact top-k inner products on a bit-sliced index.

The components of a block of vectors are kept as bitmaps, one per attribute and bit, cut to
their highest eight bits.  A query's weights are written in signed binary digits; each digit
contributes shifted bitmaps (inverted ones for negative digits), and a carry-save adder over
bitmaps yields the slices of every row's sum at once.  The k-th highest sum is found from the
most significant slice downward.  What the cut bits may add is bounded, so the rows within that
bound of the k-th sum are the boundary, whose inner products are then computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
QUERY_BLOCK = 20_000
KEPT_BITS = 8


def _digits(weight: int) -> Iterator[tuple[int, int]]:
    """Signed binary digits without neighbours: (power, +1 or -1)."""
    negative, weight, power = weight < 0, abs(weight), 0
    while weight:
        if weight & 1:
            digit = 2 - (weight & 3)
            yield power, -digit if negative else digit
            weight -= digit
        weight >>= 1
        power += 1


class SliceIndex:
    """Bitmaps of one block of integer vectors of equal length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        m, d = rows.shape
        self.low = self.rows.min(axis=0) if d else np.zeros(0, np.int64)
        above = self.rows - self.low
        bits = max(1, int(above.max()).bit_length()) if d else 1
        self.cut = max(0, bits - KEPT_BITS)
        self.bits = bits - self.cut
        self.words = -(-m // 64)
        kept = above >> self.cut
        pad = np.zeros((2, d, self.bits, self.words * 8), np.uint8)
        for b in range(self.bits):
            packed = np.packbits(((kept >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            pad[0, :, b, : packed.shape[1]] = packed
        pad[1] = ~pad[0]
        self.slices = pad.reshape(2 * d * self.bits, self.words * 8).view(np.uint64)
        full = np.zeros(self.words * 64, np.uint8)
        full[:m] = 1
        self.all = np.packbits(full, bitorder="little").view(np.uint64)

    def _sum(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the (shifted) sum, least significant first."""
        d, bits = len(query), self.bits
        columns: list[list[int]] = []
        for i, weight in enumerate(query.tolist()):
            for power, digit in _digits(weight):
                base = ((digit < 0) * d + i) * bits
                while len(columns) < power + bits:
                    columns.append([])
                for b in range(bits):
                    columns[power + b].append(base + b)
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        at = 0
        while at < len(columns) or carried:
            parts = carried + ([self.slices[columns[at]]] if at < len(columns) and columns[at] else [])
            carried = []
            stack = np.concatenate(parts) if parts else np.zeros((1, self.words), np.uint64)
            while len(stack) > 2:
                t = len(stack) // 3
                a, b, c = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * t :]])
            if len(stack) == 2:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0])
            at += 1
        return out

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of other ids, best first, ties by smaller id."""
        lo, hi = np.searchsorted(self.ids, [own, own + 1])
        valid = self.all
        if hi > lo:
            mask = np.zeros(self.words * 64, np.uint8)
            mask[lo:hi] = 1
            valid = valid & ~np.packbits(mask, bitorder="little").view(np.uint64)
        if len(self.ids) - (hi - lo) <= k:
            chosen = np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little"))
        else:
            slices = self._sum(query)
            rest, need, kth = valid, k, 0
            for power in range(len(slices) - 1, -1, -1):
                ones = rest & slices[power]
                count = int(np.bitwise_count(ones).sum())
                if count >= need:
                    rest, kth = ones, kth | 1 << power
                else:
                    need -= count
                    rest = rest & ~slices[power]
            # cut bits add between -lost and +gained to a row's sum
            spread = int(np.abs(query).sum()) * ((1 << self.cut) - 1)
            floor = max(0, kth - (spread >> self.cut) - 1)
            above, equal = np.zeros_like(valid), valid
            for power in range(len(slices) - 1, -1, -1):
                if floor >> power & 1:
                    equal = equal & slices[power]
                else:
                    above = above | (equal & slices[power])
                    equal = equal & ~slices[power]
            chosen = np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little"))
        score = self.rows[chosen] @ query
        best = np.lexsort((self.ids[chosen], -score))[:k]
        return self.ids[chosen][best], score[best]


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x); rows with unusable vectors or ids are left out."""
    usable = "embedding IS NOT NULL AND vec_id IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    return vectors.where(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.expr(f"transform(embedding, x -> floor({scale}D * CAST(x AS DOUBLE)))").alias("v"),
    )


def _search(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """Best k of each block of rows for each query; one pass, no shuffle."""
    ship = rows.sparkSession.sparkContext.broadcast(queries)  # at most QUERY_BLOCK vectors

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[SliceIndex]:
        held: dict[int, list] = {}

        def built(d: int) -> SliceIndex:
            ids, parts = zip(*held.pop(d))
            return SliceIndex(np.concatenate(ids), np.concatenate(parts))

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                part = flat[(starts[at][:, None] + np.arange(d)[None, :])] if d else np.zeros((len(at), 0), np.int64)
                held.setdefault(int(d), []).append((ids[at], part))
                if sum(len(i) for i, _ in held[int(d)]) >= BLOCK_ROWS:
                    yield built(int(d))
        for d in list(held):
            yield built(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index in blocks(batches):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for own, query in ship.value:
                if len(query) == index.rows.shape[1]:
                    ids, score = index.top(own, query, k)
                    out.append((np.full(len(ids), own, np.int64), ids, score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"]
                )

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each query.

    Both tables come from ``quantised``.  A query's own id is no candidate; vectors of another
    length are none either; equal scores go to the smaller vec_id, and a candidate row that is
    repeated is listed as often.  A query id that is repeated counts once, with its smallest
    vector.  Fewer than k candidates give fewer rows, empty tables none.  Queries go out in
    blocks of at most QUERY_BLOCK vectors, one pass over the candidates each.
    """
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        part = once.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        sent = [(r[0], np.array(r[1], np.int64)) for r in part.collect()]
        hits = _search(vectors, sent, k)
        found = hits if found is None else found.unionByName(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
