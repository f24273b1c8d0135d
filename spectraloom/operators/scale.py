"""Skew-safe order statistics, sampling and running sums.

A single sample may hold a third of all pixels, so nothing here puts a whole
group into one task: groups are cut into range or hash slices first, per-slice
totals (a few rows) are summed up, and only then is work done inside a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.arrays import is_finite
from spectraloom.session import settle

SKETCH_ACCURACY = 1_000
#: Rows up to which a group is sorted as a whole; a sketch of a small group holds all its values anyway.
SMALL_GROUP = 5_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    accuracy: int = SKETCH_ACCURACY,
    small: int = SMALL_GROUP,
) -> DataFrame:
    """Linearly interpolated quantiles of the finite values per group, exact at any size.

    Groups of at most ``small`` rows are sorted, however many they are.  In the others
    count and a quantile sketch are taken in one aggregation.  The sketch brackets each
    wanted rank, a second aggregation keeps only the values inside the brackets (counts
    elsewhere), and the rank is read off there.  A rank the sketch failed to bracket gets
    its bucket in a further pass.

    The result (one row per group) is settled: its true size decides whether a
    join with it broadcasts, so the pixels it is joined to need not be shuffled.
    """
    keys = list(keys)
    values = df.select(*keys, value.cast("double").alias("_v"))
    return _quantiles_by_size(
        values, keys, small,
        lambda part: _sorted_quantiles(part, keys, {"": F.col("_v")}, probs),
        lambda part: _bracketed_quantiles(part.where(is_finite(F.col("_v"))), keys, probs, accuracy),
    )


def joint_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float], small: int = SMALL_GROUP
) -> DataFrame:
    """``exact_quantiles`` of several columns, named ``{prob}_{column}``; NULL where a group has no finite value."""
    keys = list(keys)

    def bracketed(part: DataFrame) -> DataFrame:
        entries = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns]
        long = part.select(*keys, F.inline(F.array(*entries))).where(is_finite(F.col("_v")))
        return _bracketed_quantiles(long, [*keys, "_c"], probs).groupBy(*keys).agg(
            *[F.max(F.when(F.col("_c") == c, F.col(name))).alias(f"{name}_{c}") for c in columns for name in probs]
        )

    return _quantiles_by_size(
        df, keys, small,
        lambda part: _sorted_quantiles(part, keys, {f"_{c}": F.col(c).cast("double") for c in columns}, probs),
        bracketed,
    )


def _quantiles_by_size(
    df: DataFrame, keys: list[str], small: int,
    of_small: Callable[[DataFrame], DataFrame], of_large: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    rows = df.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    # rows bound the finite values from above, and are counted without computing any
    sizes = settle(rows.groupBy(*keys).agg((F.count(F.lit(1)) > small).alias("_large")), "sizes")
    large = sizes.where("_large").select(*keys)
    if not large.take(1):
        return settle(of_small(rows), "quantiles")
    if not sizes.where("NOT _large").take(1):
        return settle(of_large(rows), "quantiles")
    large = settle(large, "large")
    found = of_large(rows.join(large, keys, "left_semi"))
    return settle(found.unionByName(of_small(rows.join(large, keys, "left_anti"))), "quantiles")


def _sorted_quantiles(df: DataFrame, keys: list[str], values: Mapping[str, Column], probs: Mapping[str, float]) -> DataFrame:
    """Every group's finite values as one sorted array; groups without any are left out."""
    finite = [F.when(is_finite(v), v).alias(f"_v{i}") for i, v in enumerate(values.values())]
    keyed = ["_hash", *keys]  # one number tells most groups apart where rows are sorted by group
    held = df.select(F.xxhash64(*keys).alias("_hash"), *keys, *finite).groupBy(*keyed).agg(
        *[F.sort_array(F.collect_list(f"_v{i}")).alias(f"_v{i}") for i in range(len(finite))]
    )
    out = []
    for i, suffix in enumerate(values):
        v = F.col(f"_v{i}")
        for name, p in probs.items():
            at = F.lit(float(p)) * (F.size(v) - 1)
            lo, hi = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
            out.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"{name}{suffix}"))
    return held.where(reduce(or_, [F.size(f"_v{i}") > 0 for i in range(len(finite))])).select(*keys, *out)


def _bracketed_quantiles(
    values: DataFrame, keys: list[str], probs: Mapping[str, float], accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    slack = 2.0 / accuracy
    marks: list[float] = []
    for p in probs.values():
        marks += [max(0.0, p - slack), min(1.0, p + slack)]
    head = settle(
        values.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx("_v", [float(m) for m in marks], accuracy).alias("_edge"),
        ),
        "sketch",
    )
    # a value's bucket counts the bracket edges it has passed: monotone in the value
    passed, inside = F.lit(0), F.lit(False)
    for i in range(0, len(marks), 2):
        lo, hi = F.col("_edge")[i], F.col("_edge")[i + 1]
        passed = passed + (F.col("_v") >= lo).cast("int") + (F.col("_v") > hi).cast("int")
        inside = inside | ((F.col("_v") >= lo) & (F.col("_v") <= hi))
    tagged = values.join(head.select(*keys, "_edge"), keys).select(
        *keys, passed.alias("_bucket"), inside.alias("_inside"), "_v"
    )
    counted = settle(
        tagged.groupBy(*keys, "_bucket", F.when(F.col("_inside"), F.col("_v")).alias("_v")).agg(
            F.count(F.lit(1)).alias("_rows")
        ),
        "brackets",
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_rows").alias("_rows"), F.bool_or(F.col("_v").isNull()).alias("_collapsed"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    asks = [
        F.struct(
            F.lit(name).alias("name"),
            (F.lit(float(p)) * (F.col("_n") - 1)).alias("at"),
        )
        for name, p in probs.items()
    ]
    ranks = head.select(*keys, F.explode(F.array(*asks)).alias("_ask")).select(
        *keys,
        F.col("_ask.name").alias("_name"),
        (F.col("_ask.at") - F.floor("_ask.at")).alias("_frac"),
        F.explode(
            F.array_distinct(F.array(F.floor("_ask.at"), F.ceil("_ask.at")))
        ).alias("_rank"),
    )
    wanted = ranks.join(buckets, keys).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_rows"))
    ).drop("_rows")
    kept = counted.where(F.col("_v").isNotNull())
    missed = wanted.where("_collapsed").select(*keys, "_bucket").distinct()
    if missed.take(1):
        kept = kept.unionByName(
            tagged.join(missed, [*keys, "_bucket"], "left_semi")
            .groupBy(*keys, "_bucket", "_v")
            .agg(F.count(F.lit(1)).alias("_rows"))
        )
    upto = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = kept.join(
        wanted.select(*keys, "_bucket").distinct(), [*keys, "_bucket"], "left_semi"
    ).withColumn("_upto", F.sum("_rows").over(upto))
    hits = placed.join(wanted, [*keys, "_bucket"]).where(
        (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_rows"))
        & (F.col("_rank") < F.col("_before") + F.col("_upto"))
    )
    lo, hi = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    blended = hits.groupBy(*keys, "_name").agg((lo + (hi - lo) * F.first("_frac")).alias("_q"))
    return blended.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probs]
    )


def take_hashed(
    df: DataFrame, keys: Sequence[str], hashed: Column, tie: Sequence[str], k: Column | int
) -> DataFrame:
    """The ``k`` rows of each group with the smallest hash; ``k`` may use ``_n``, the group size.

    The first three hex digits cut a group into at most 4096 cells.  Cell counts
    give the last cell needed, rows beyond it are dropped before any shuffle, and
    ranking happens inside single cells.
    """
    keys = list(keys)
    digested = df.withColumn("_hash", hashed).withColumn("_cell", F.substring("_hash", 1, 3))
    cells = settle(digested.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c")), "cells")
    group = Window.partitionBy(*keys)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    limit = k if isinstance(k, Column) else F.lit(k)
    cut = (
        cells.withColumn("_n", F.sum("_c").over(group))
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .withColumn("_k", limit.cast("bigint"))
        .where(F.col("_before") < F.col("_k"))
        .groupBy(*keys)
        .agg(
            F.max("_cell").alias("_last"),
            F.max_by(F.col("_k") - F.col("_before"), "_cell").alias("_need"),
        )
    )
    within = Window.partitionBy(*keys, "_cell").orderBy("_hash", *tie)
    last = settle(cut, "cut")  # one row per group
    return (
        (digested.join(last, keys) if keys else digested.crossJoin(F.broadcast(last)))
        .where(F.col("_cell") <= F.col("_last"))
        .withColumn("_at", F.row_number().over(within))
        .where((F.col("_cell") < F.col("_last")) | (F.col("_at") <= F.col("_need")))
        .drop("_hash", "_cell", "_last", "_need", "_at")
    )


def range_sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Range-partition by (keys, order) and number the slices; equal rows share a slice.

    The slice count is left to the session, so adaptive execution may merge small
    neighbours, which keeps the order.
    """
    return df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    ties_together: bool = False,
) -> DataFrame:
    """Adds inclusive running sums per group, in ``order``, without one task per group.

    Slice numbers are pinned by writing the sliced rows once; slice totals give
    each slice its offset.  ``ties_together`` gives rows with equal order the same sum.
    """
    keys = list(keys)
    fed = df.select("*", *[c.alias(f"_in_{n}") for n, c in sums.items()])
    ranged = settle(range_sliced(fed, keys, order), "slices")
    offsets = ranged.groupBy(*keys, "_slice").agg(
        *[F.sum(f"_in_{n}").alias(f"_off_{n}") for n in sums]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_off_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    frame = inner.rangeBetween if ties_together else inner.rowsBetween
    inner = frame(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(f"_in_{n}").over(inner).alias(f"_run_{n}") for n in sums])
    joined = local.join(settle(offsets, "offsets"), [*keys, "_slice"])
    return joined.select(
        *df.columns, *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums]
    )


def row_ordinals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """1-based position of each row in its group; ``order`` must be a full key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")})
