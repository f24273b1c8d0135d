"""Repeatable samples.

Draws follow md5 order over salted keys, so a sample is the same on every run,
on every cluster, and in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.arrays import hash_key, hex_to_long, is_finite
from spectraloom.operators.scale import row_ordinals, take_hashed
from spectraloom.session import settle


def cap_rows(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], cap: int, salt: str = "cap"
) -> DataFrame:
    """At most ``cap`` rows per group, without replacement."""
    return take_hashed(df, keys, hash_key(salt, *ids), ids, cap)


def cap_by_metric(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], metric: str, caps: Mapping[str, int],
    default: int = 30_000, salt: str = "metric",
) -> DataFrame:
    """A cap per (group, metric), overridden for listed metrics."""
    limit = F.lit(default)
    for name, cap in caps.items():
        limit = F.when(F.col(metric) == name, F.lit(cap)).otherwise(limit)
    return take_hashed(df, [*keys, metric], hash_key(salt, metric, *ids), ids, limit)


def balance(
    df: DataFrame, key: str, ids: Sequence[str], value: Column | None = None, salt: str = "balance"
) -> DataFrame:
    """Every class cut to the size of the smallest non-empty one."""
    if value is not None:
        df = df.where(is_finite(value))
    smallest = df.groupBy(key).count().agg(F.min("count")).first()[0]
    return take_hashed(df, [key], hash_key(salt, *ids), ids, int(smallest or 0))


def fraction_rows(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], fraction: float, min_rows: int, salt: str = "frac"
) -> DataFrame:
    """A share of each group, but at least ``min_rows`` (or all there are)."""
    k = F.least(F.col("_n"), F.greatest(F.lit(min_rows), F.bround(F.col("_n") * F.lit(float(fraction)))))
    return take_hashed(df, keys, hash_key(salt, *ids), ids, k)


def two_stage(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], first: int = 3000, fraction: float = 0.2,
    salt: str = "stage",
) -> DataFrame:
    """E5: up to ``first`` rows per group, then a fraction of those, at least one."""
    stage1 = take_hashed(df, keys, hash_key(f"{salt}1", *ids), ids, first)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(fraction))))
    return take_hashed(stage1, keys, hash_key(f"{salt}2", *ids), ids, k)


def draw_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str],
    payload: Sequence[str], max_pairs: int, salt: str = "pairs",
) -> DataFrame:
    """min(max_pairs, n_left * n_right) pairs per key, drawn with replacement.

    Each draw hashes to an ordinal on either side and is fetched by equi-join.
    Result: keys, ``draw``, and the payload columns with suffixes ``_l`` and ``_r``.
    """
    keys = list(keys)
    sides = {}
    for tag, df in (("l", left), ("r", right)):
        sides[tag] = settle(
            row_ordinals(df.select(*keys, *dict.fromkeys([*order, *payload])), keys, order, f"_at_{tag}"),
            f"pairs-{tag}",
        )
    counts = sides["l"].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_l")).join(
        sides["r"].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_r")), keys
    )
    wanted = F.least(F.lit(max_pairs).cast("double"), F.col("_n_l").cast("double") * F.col("_n_r"))
    draws = counts.select(
        *keys, "_n_l", "_n_r", F.explode(F.sequence(F.lit(1), wanted.cast("int"))).alias("draw")
    )
    for tag in ("l", "r"):
        ordinal = F.pmod(hex_to_long(hash_key(f"{salt}-{tag}", *keys, "draw")), F.col(f"_n_{tag}")) + 1
        draws = draws.withColumn(f"_at_{tag}", ordinal)
    for tag in ("l", "r"):
        side = sides[tag].select(*keys, f"_at_{tag}", *[F.col(c).alias(f"{c}_{tag}") for c in payload])
        draws = draws.join(side, [*keys, f"_at_{tag}"])
    return draws.drop("_n_l", "_n_r", "_at_l", "_at_r")


def first_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` pixels of each group in row-major order.

    Whole image rows are counted first; only the rows that can matter are ranked.
    """
    keys = list(keys)
    lines = settle(df.groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("_c")), "lines")
    before = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        lines.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .where(F.col("_before") < n)
        .select(*keys, "row", "_before")
    )
    across = Window.partitionBy(*keys, "row").orderBy("col")
    return (
        df.join(needed, [*keys, "row"])
        .withColumn("_at", F.row_number().over(across) + F.col("_before"))
        .where(F.col("_at") <= n)
        .drop("_at", "_before")
    )


def fixed_bags(
    df: DataFrame, keys: Sequence[str], ids: Sequence[str], size: int, payload: Sequence[str], salt: str = "bag"
) -> DataFrame:
    """Exactly ``size`` rows per group: without replacement, or with it when short.

    Result: keys, ``slot`` 1..size, payload.  The kept rows of a group, at most ``size``,
    become one sorted array, from which the slots are read where it lies.
    """
    keys = list(keys)
    columns = list(dict.fromkeys([*ids, *payload]))
    bag = take_hashed(df.select(*dict.fromkeys([*keys, *columns])), keys, hash_key(salt, *ids), ids, size)
    entry = F.struct(hash_key(salt, *ids).alias("_hash"), *columns)
    bags = bag.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_bag"))
    slots = bags.select(*keys, "_bag", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("slot"))
    n = F.size("_bag")
    again = F.pmod(hex_to_long(hash_key(f"{salt}-again", *keys, "slot")), n) + 1
    drawn = F.element_at("_bag", F.when(n >= size, F.col("slot")).otherwise(again.cast("int")))
    return slots.select(*keys, "slot", *[drawn[c].alias(c) for c in payload])
