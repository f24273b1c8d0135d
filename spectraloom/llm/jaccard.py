"""N-gram Jaccard self-join by set relations: skipped stretches of lists and shared answers.

Order of work:

1. Every document becomes the sorted array of its distinct shingle hashes (64 bits).  Equal
   sets form one class; only its smallest document goes on.
2. Two sets of similarity t share at least l of their first n - ceil(t n) + l hashes, l being
   set by the smaller.  Sets of whose first hashes fewer than that occur in any other set are
   dropped: one that merely holds a common passage is gone before any pair is formed.
3. Index lists of what remains are sorted by size.  Inside a list, stretches of entries are
   skipped by size and by position (what can still follow is too short), and pairs by a parity
   sketch whose differing bits are a lower bound of the sets' difference.  A set that meets a
   similar one takes over its answers: pairs already tied together are not looked at again, so
   a list yields a spanning forest, never all its pairs.  Lists over a block size are cut into
   block pairs and dealt to many tasks.
4. The forest's links are verified on the whole sets.  Where a candidate cluster stays in one
   piece, it is done.  Elsewhere all pairs across its pieces are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import slices, words_of
from spectraloom.llm.graph import components
from spectraloom.session import intermediates, settle, settle_outside, shuffles_deleted

WORDS_KEPT = 300_000
SKETCH_BITS = 2048
LIST_BLOCK = 4096
CLUSTER_BLOCK = 1024
SIEVE_BITS = 1 << 24


class _WordHashes(dict):
    """Hash of a word, remembered; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(words: list[bytes], k: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words count as one shingle."""
    if not words:
        return np.empty(0, np.int64)
    k = min(k, len(words))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    m = len(words) - k + 1
    mixed = np.full(m, 0x9E3779B97F4A7C15 ^ k, np.uint64)
    for j in range(k):
        mixed ^= h[j : j + m]
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def parity_sketch(tokens: np.ndarray, percent: int = 80) -> bytes:
    """Parity of the tokens in each of a power of two of cells.

    One cell per token at 80 percent, fewer the fewer differences a link may have.
    """
    bits = 64
    while 20 * bits < len(tokens) * (100 - percent) and bits < SKETCH_BITS:
        bits *= 2
    cells = (tokens & (bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(sketch: bytes, size: int) -> bytes:
    while len(sketch) > size:
        half = len(sketch) // 2
        sketch = (
            int.from_bytes(sketch[:half], "big") ^ int.from_bytes(sketch[half:], "big")
        ).to_bytes(half, "big")
    return sketch


def least_overlap(n: int, m: int, percent: int) -> int:
    """Smallest common size with 100 * common >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _lead(n: int, percent: int) -> int:
    """How many of a set's first tokens are looked at to prove that it shares enough."""
    need = -(-percent * n // 100)
    return min(n, n - need + max(1, (n - need) // 2))


def _shingled(df: DataFrame, k: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches):
            n, key, lead, sketch = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_hashes(words_of(text), k, known)
                n.append(len(tokens))
                key.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                lead.append(tokens[: _lead(len(tokens), percent)])
                sketch.append(parity_sketch(tokens, percent))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(key, pa.binary()),
                    pa.array(lead, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                ],
                names=["doc_id", "n", "key", "lead", "sketch"],
            )

    return df.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, key binary, lead array<bigint>, sketch binary"
    )


def _sieve(ids: DataFrame, name: str) -> tuple[list[Column], np.ndarray]:
    """Bloom filter of a column: where to look for a row, and a bitmap of fixed size.

    A full bitmap lets everything pass; it only spares work, a join decides.
    """
    places = [F.pmod(F.xxhash64(name, F.lit(i)), F.lit(SIEVE_BITS)) for i in range(3)]
    set_bits = (
        ids.select(F.explode(F.array(*places)).alias("p"))
        .groupBy(F.expr("p div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        .toArrow()  # at most SIEVE_BITS / 64 rows
    )
    bitmap = np.zeros(SIEVE_BITS // 64, np.int64)
    bitmap[set_bits.column("word").to_numpy()] = set_bits.column("bits").to_numpy()
    return places, np.unpackbits(bitmap.view(np.uint8), bitorder="little").view(bool)


def _passed(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``sets`` whose rep may be among ``chosen``; wide rows stay where they are."""
    places, bitmap = _sieve(chosen, "rep")
    ship, tries = sets.sparkSession.sparkContext.broadcast(np.packbits(bitmap)), len(places)

    columns, schema = sets.columns, sets.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(ship.value).view(bool)
        for batch in batches:
            hit = np.logical_and.reduce([bits[batch.column(f"p{i}").to_numpy()] for i in range(tries)])
            yield batch.filter(pa.array(hit)).select(columns)

    return sets.select("*", *[p.alias(f"p{i}") for i, p in enumerate(places)]).mapInArrow(run, schema)


def _contents(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(rep, tokens)``: whole token arrays of the wanted sets (rep, doc, key).

    Texts are sieved by doc_id where they are read, so that only the wanted ones' tokens move.
    """
    places, bitmap = _sieve(wanted, "doc")
    ship, tries = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap)), len(places)
    rows = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("text"))
    rows = rows.where("doc IS NOT NULL").select("doc", "text", *[p.alias(f"p{i}") for i, p in enumerate(places)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        bits = np.unpackbits(ship.value).view(bool)
        for batch in batches:
            hit = np.logical_and.reduce([bits[batch.column(f"p{i}").to_numpy()] for i in range(tries)])
            for part in slices([batch.filter(pa.array(hit))], 200):
                tokens = [shingle_hashes(words_of(t), k, known) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        pa.array([xxhash.xxh3_128_digest(t.tobytes()) for t in tokens], pa.binary()),
                        pa.array([t.tobytes() for t in tokens], pa.binary()),
                    ],
                    names=["doc", "key", "tokens"],
                )

    found = rows.mapInArrow(run, "doc bigint, key binary, tokens binary")
    return found.join(wanted, ["doc", "key"]).dropDuplicates(["rep"]).select("rep", "tokens")


def _ties_of_list(rep, n, pos, side, sketch, percent: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the pairs of one list that may be similar; entries sorted by size.

    ``side`` is None where all pairs count, else 0/1: only pairs across the two blocks.
    """
    m = len(rep)
    ints = [int.from_bytes(s, "big") for s in sketch] if m <= 8 else None
    label = np.arange(m)
    stop = 0
    tables: dict[int, tuple[int, np.ndarray]] = {}
    for i in range(m - 1):
        stop = max(stop, i + 1)
        while stop < m and 100 * n[i] >= percent * n[stop]:
            stop += 1  # beyond, every set of the list is too large: the rest is skipped
        if stop == i + 1:
            continue
        if ints is not None:
            for j in range(i + 1, stop):
                if label[i] == label[j] or (side is not None and side[i] == side[j]):
                    continue
                common = least_overlap(n[i], n[j], percent)
                if min(pos[i], pos[j]) + min(n[i] - pos[i], n[j] - pos[j]) < common:
                    continue
                x, y = sketch[i], sketch[j]
                xi, yi = ints[i], ints[j]
                if len(x) != len(y):
                    size = min(len(x), len(y))
                    xi = int.from_bytes(_folded(x, size), "big")
                    yi = int.from_bytes(_folded(y, size), "big")
                if (xi ^ yi).bit_count() <= n[i] + n[j] - 2 * common:
                    label[label == label[j]] = label[i]
                    yield rep[i], rep[j]
            continue
        part = slice(i + 1, stop)
        open_ = label[part] != label[i]
        if side is not None:
            open_ &= side[part] != side[i]
        if not open_.any():
            continue
        at = np.flatnonzero(open_) + i + 1
        common = -(-percent * (n[i] + n[at]) // (100 + percent))
        room = np.minimum(pos[i], pos[at]) + np.minimum(n[i] - pos[i], n[at] - pos[at])
        at, common = at[room >= common], common[room >= common]
        if not len(at):
            continue
        size = len(sketch[i])
        if size not in tables:  # partners are at most twice as long: one folding suffices
            rows = [r for r in range(m) if size <= len(sketch[r]) <= 2 * size]
            joined = b"".join(_folded(sketch[r], size) for r in rows)
            tables[size] = (rows[0], np.frombuffer(joined, np.uint64).reshape(len(rows), size // 8))
        first, table = tables[size]
        apart = np.bitwise_count(table[at - first] ^ table[i - first]).sum(axis=1, dtype=np.int64)
        near = at[apart <= n[i] + n[at] - 2 * common]
        if len(near):
            found, where = np.unique(label[near], return_index=True)
            for j in near[where]:
                yield rep[i], rep[j]
            label[np.isin(label, found)] = label[i]


def _list_ties(lists: DataFrame, percent: int) -> DataFrame:
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows == 0:
                continue
            if batch is not None:
                held.append(batch)
            table = pa.Table.from_batches(held) if held else None
            if table is None:
                return
            keys = np.stack([table.column(c).to_numpy() for c in ("token", "lo", "hi")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            last = len(edges) if batch is not None else len(edges) + 1
            bounds = [0, *edges.tolist(), table.num_rows]
            cols = {c: table.column(c).to_numpy() for c in ("rep", "n", "pos", "block", "lo", "hi")}
            sketch = table.column("sketch").to_pylist()
            for g in range(last):
                s, e = bounds[g], bounds[g + 1]
                if e - s > 1:
                    yield {c: v[s:e] for c, v in cols.items()} | {"sketch": sketch[s:e]}
            held = table.slice(bounds[last]).to_batches() if batch is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            a, b = zip(*seen)
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

        for g in groups(batches):
            side = None if g["lo"][0] == g["hi"][0] else (g["block"] == g["lo"][0]).astype(np.int8)
            if len(g["rep"]) <= 8:
                g = {c: v.tolist() if isinstance(v, np.ndarray) else v for c, v in g.items()}
            for a, b in _ties_of_list(g["rep"], g["n"], g["pos"], side, g["sketch"], percent):
                seen.add((int(min(a, b)), int(max(a, b))))
            if len(seen) > 50_000:
                yield flush()
        if seen:
            yield flush()

    return lists.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keep = [
                _linked(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), percent)
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """Links across the pieces of unresolved clusters, block pair by block pair."""
    size = Window.partitionBy("cluster")
    dealt = (
        members.withColumn("_n", F.count(F.lit(1)).over(size))
        .withColumn("_blocks", F.ceil(F.col("_n") / CLUSTER_BLOCK).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "cluster",
            F.least("_block", "_other").alias("lo"),
            F.greatest("_block", "_other").alias("hi"),
            F.col("_block").alias("block"),
            "rep",
            "piece",
            "tokens",
        )
    )

    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        label = table.column("piece").to_numpy().copy()
        block = table.column("block").to_numpy()
        cross = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        tokens = [np.frombuffer(t, np.int64) for t in table.column("tokens").to_pylist()]
        n = np.array([len(t) for t in tokens])
        sketch = [parity_sketch(t, percent) for t in tokens]
        order = np.argsort(n, kind="stable")
        found: list[tuple[int, int]] = []
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                if 100 * n[i] < percent * n[j]:
                    break
                if label[i] == label[j] or (cross and block[i] == block[j]):
                    continue
                most = n[i] + n[j] - 2 * least_overlap(int(n[i]), int(n[j]), percent)
                width = min(len(sketch[i]), len(sketch[j]))
                p, q = _folded(sketch[i], width), _folded(sketch[j], width)
                if (int.from_bytes(p, "big") ^ int.from_bytes(q, "big")).bit_count() > most:
                    continue
                if _linked(tokens[i], tokens[j], percent):
                    found.append((int(rep[i]), int(rep[j])))
                    label[label == label[j]] = label[i]
        return pa.table(
            {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
        )

    return dealt.groupBy("cluster", "lo", "hi").applyInArrow(run, "a bigint, b bigint")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text, ...).

    Words are split at ASCII white space, A-Z lower-cased.  Two documents link when 100 times
    their common shingles reach ``percent`` times their union; ``component_id`` is the smallest
    doc_id reachable.  Null and word-less texts have an empty set and link with nothing, so
    they stand for themselves.  Repeated rows come back as often as they came; rows that share
    a doc_id count as one document, which links where any of its texts does; a null doc_id links
    with nothing and has a null component.
    Other columns of ``docs`` are ignored.  An empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text")
    with shuffles_deleted(docs.sparkSession), intermediates(docs.sparkSession):
        sets, classes, ties = _candidates(docs, k, percent)
        links = _links(docs, classes, ties, k, percent)
        return settle_outside(_components_of_rows(sets, classes, links), "joined")


def _candidates(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narrow rows ``(doc_id, n, key)``, classes of equal sets ``(key, doc, rep)``, ties to verify.

    First hashes and sketches are wide; they are deleted once the next table has taken them over.
    """
    spark = docs.sparkSession
    with intermediates(spark):
        with intermediates(spark):
            wide = settle(_shingled(docs, k, percent), "wide")
            sets = wide.select("doc_id", "n", "key")
            classes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"))
            classes = classes.withColumn("rep", F.monotonically_increasing_id())  # a number for each set
            classes = settle_outside(classes, "classes", blocks=2)
            one_of_class = wide.withColumnRenamed("doc_id", "doc").join(classes, ["key", "doc"])
            one_of_class = one_of_class.dropDuplicates(["key", "doc"])  # dealt as the join is: no second shuffle
            reps = settle_outside(one_of_class.select("rep", "n", "lead", "sketch"), "reps")
            sets = settle_outside(sets, "sets", blocks=2)

        # entries that only one set holds say nothing; sets left with too few can have no link
        least = f"(({percent} * n + 99) div 100)"  # the smallest partner decides how many it must share
        share = F.expr(f"greatest(1, ({least} - ({percent} * {least} + 99) div 100) div 2)")
        entry = reps.select("rep", F.explode("lead").alias("token"))
        shared = entry.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
        hits = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("hits"))
        busy = settle(hits.join(reps.select("rep", "n"), "rep").where(F.col("hits") >= share).select("rep"), "busy")

        lead = F.expr(f"slice(lead, 1, cast(n - ({percent} * n + 99) div 100 + 1 as int))")
        near = settle(_passed(reps, busy), "near")
        rows = near.select("rep", "n", F.posexplode(lead).alias("pos", "token"))
        by_token = Window.partitionBy("token")
        rows = (
            rows.withColumn("_m", F.count(F.lit(1)).over(by_token))
            .where("_m > 1")
            .withColumn("_at", F.row_number().over(by_token.orderBy("n", "rep")) - 1)
            .withColumn("block", F.expr(f"cast(_at div {LIST_BLOCK} as int)"))
            .withColumn("_blocks", F.expr(f"cast((_m - 1) div {LIST_BLOCK} as int)"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks"))))
            .select(
                "token",
                F.least("block", "_other").alias("lo"),
                F.greatest("block", "_other").alias("hi"),
                "block",
                F.col("n").cast("bigint").alias("n"),
                F.col("pos").cast("bigint").alias("pos"),
                "rep",
            )
            .join(near.select("rep", "sketch"), "rep")
            .repartition("token", "lo", "hi")
            .sortWithinPartitions("token", "lo", "hi", "n", "rep")
        )
        ties = settle_outside(_list_ties(rows, percent), "ties")
    return sets, classes, ties


def _links(docs: DataFrame, classes: DataFrame, ties: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes that hold every cluster together, verified on whole sets."""
    with intermediates(docs.sparkSession):
        clusters = settle(components(ties), "clusters")
        wanted = clusters.join(classes.withColumnRenamed("rep", "node"), "node").select(
            F.col("node").alias("rep"), "doc", "key"
        )
        held = settle(_contents(docs, settle(wanted, "wanted"), k), "contents")
        pairs = ties.join(held.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a").join(
            held.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b"
        )
        links = settle(_verified(pairs.select("a", "b", "x", "y"), percent), "links")
        pieces = settle(_pieces(clusters, components(links)), "pieces")
        open_ = pieces.groupBy("cluster").agg(F.min("piece").alias("p"), F.max("piece").alias("q"))
        open_ = open_.where("p <> q").select("cluster")
        unresolved = pieces.join(open_, "cluster", "left_semi").join(held, "rep")
        more = _cluster_links(unresolved, percent)
        return settle_outside(links.unionByName(more), "links")


def _components_of_rows(sets: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Each row with the smallest doc_id of its component."""
    # rows of one id with different texts (as a rule none) tie their sets together
    several = sets.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("p"), F.max("key").alias("q"))
    several = settle(several.where("p <> q").select("doc_id"), "several")
    own = sets.where("n > 0").join(several, "doc_id", "left_semi").select("doc_id", "key").distinct()
    own = settle(own.join(classes.select("key", "rep"), "key"), "own")
    same = own.groupBy("doc_id").agg(F.min("rep").alias("a")).join(own, "doc_id").select("a", F.col("rep").alias("b"))
    final = settle(components(links.unionByName(same)), "final")
    linked = classes.join(final.withColumnRenamed("node", "rep"), "rep")
    lowest = linked.groupBy("component").agg(F.min("doc").alias("low"))
    linked = linked.join(lowest, "component").select("key", "low")
    of_class = classes.join(linked, "key", "left").select("key", F.coalesce("low", "doc").alias("component"))
    of_several = own.join(of_class, "key").groupBy("doc_id").agg(F.min("component").alias("joint"))
    return (
        sets.select("doc_id", "n", "key")
        .join(of_class, "key", "left")
        .join(settle(of_several, "joint"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("joint").isNotNull(), F.col("joint"))
            .when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
    )


def _pieces(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """Each candidate with its cluster and the part of it that verified links hold together."""
    found = found.withColumnRenamed("component", "piece")
    return clusters.join(found, "node", "left").select(
        F.col("node").alias("rep"),
        F.col("component").alias("cluster"),
        F.coalesce("piece", "node").alias("piece"),
    )
