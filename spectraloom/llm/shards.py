"""Sharding by vector bin packing.

Groups of equal texts have a vector of bytes, tokens and rows.  Groups above a small share of
any total are items of their own (their number is bounded by that share), the others are bundled
by hash, so that the list of items has a fixed largest length however many documents there are.
Items go, largest first, to the shard where the dot product of their vector with the shard's
residual capacity is highest.  A group larger than a shard is cut into pieces by document id.
The law that holds is ``bytes``: sizes of shards are near equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import WORD
from spectraloom.session import settle

BUNDLES = 8192
BIG_SHARE = 500  # a group of a 500th of a shard is an item of its own
CELL_ROWS = 20_000


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: bytes, tokens, rows), by dot product with residual capacity."""
    if not len(items):
        return np.zeros(0, np.int64)
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1)
    left = np.full((shards, items.shape[1]), 1 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((-share[:, 0], -share.max(axis=1))):
        fits = (left >= share[i]).all(axis=1)
        open_ = fits if fits.any() else left[:, 0] >= left[:, 0].max() - 1e-15
        gain = np.where(open_, left @ share[i], -np.inf)
        out[i] = int(np.argmax(gain))
        left[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    Size is the text's UTF-8 bytes plus 1, so null and empty texts weigh 1 and are equal.
    Rows of one text share a shard unless together they exceed one.  Slots count from 0
    without gaps inside a shard, in hash-cell order, then doc_id; repeated rows get slots of
    their own.  ``grown_shard`` is null: this law moves rows when shards are added.
    """
    text = F.coalesce("text", F.lit(""))
    measured = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("tokens"),
    )
    measured = settle(measured, "measured")
    key = ["h", "text_crc32", "size"]
    groups = settle(
        measured.groupBy(*key).agg(
            F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
        ),
        "groups",
    )
    dims = ["bytes", "tokens", "rows"]
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in dims]).first()
    limit = [max(1, t) / (shards * BIG_SHARE) for t in total]
    big = F.lit(False)
    for c, cut in zip(dims, limit):
        big = big | (F.col(c) >= cut)
    most = F.greatest(*[F.col(c) * shards / max(1, t) for c, t in zip(dims, total)])
    tagged = groups.withColumn("big", big).withColumn(
        "pieces", F.when(most > 1, F.ceil(most * 16)).otherwise(1).cast("int")
    )
    # at most 3 * shards * BIG_SHARE groups and BUNDLES bundles
    large = tagged.where("big").select(*key, "pieces", *dims).collect()
    bundles = (
        tagged.where("NOT big")
        .groupBy(F.pmod("h", F.lit(BUNDLES)).cast("int").alias("bundle"))
        .agg(*[F.sum(c).alias(c) for c in dims])
        .collect()
    )
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(*(g[c] for c in key), i, g.pieces) for i, g in enumerate(large)],
        "h bigint, text_crc32 bigint, size bigint, g int, pieces int",
    )
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    # how many rows each piece of a split group really has; few groups exceed a shard
    split = {
        (r.g, r.piece): r.n
        for r in measured.join(F.broadcast(known.where("pieces > 1")), key)
        .groupBy("g", piece.alias("piece"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    }
    names, items = [], []
    for i, g in enumerate(large):
        for at in range(g.pieces):
            part = split.get((i, at), 0) / g.rows if g.pieces > 1 else 1
            names.append(f"g{i}.{at}")
            items.append([g[c] * part for c in dims])
    for b in bundles:
        names.append(f"b{b.bundle}")
        items.append([float(b[c]) for c in dims])
    placed = place(np.array(items, float).reshape(-1, 3), shards)
    plan = spark.createDataFrame(
        [(n, int(s)) for n, s in zip(names, placed)], "item string, shard int"
    )
    item = F.when(
        F.col("g").isNotNull(),
        F.concat(F.lit("g"), "g", F.lit("."), piece),
    ).otherwise(F.concat(F.lit("b"), F.pmod("h", F.lit(BUNDLES))))
    cells = max(1, -(-int(total[2]) // CELL_ROWS))
    dealt = settle(
        measured.drop("tokens")
        .join(F.broadcast(known), key, "left")
        .withColumn("item", item)
        .join(F.broadcast(plan), "item")
        .select(
            "doc_id", "size", "text_crc32", "shard", "h",
            F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells)).cast("int").alias("cell"),
        ),
        "dealt",
    )
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "h")
    return (
        dealt.withColumn("at", F.row_number().over(within) - 1)
        .join(settle(offsets, "offsets"), ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("at")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
