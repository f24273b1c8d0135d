"""Two-group comparison: ranks, effect sizes, bootstrap, permutation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.catalog import EFFECT_CUTS, STAR_CUTS
from spectraloom.functions.arrays import hash_key, hex_to_long, is_finite
from spectraloom.functions.tails import mann_whitney_p, student_p
from spectraloom.operators.scale import exact_quantiles, range_sliced, row_ordinals
from spectraloom.session import settle


def rank_counts(
    rows: DataFrame, keys: Sequence[str], value: Column, is_a: Column
) -> DataFrame:
    """Per key the group sizes, Mann-Whitney U of group a, and the tie term.

    Values collapse to a histogram first; the histogram is range-partitioned so a
    hot key spreads over many slices.  U inside a slice needs only that slice; b
    values in earlier slices enter through slice totals, a few rows per key.
    """
    keys = list(keys)
    a = is_a.cast("bigint")
    histogram = (
        rows.where(is_finite(value))
        .groupBy(*keys, value.cast("double").alias("_v"))
        .agg(F.sum(a).alias("_a"), F.sum(1 - a).alias("_b"))
    )
    sliced = range_sliced(histogram, keys, ["_v"])
    below = (
        Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    a_, b_ = F.col("_a").cast("double"), F.col("_b").cast("double")
    t = a_ + b_
    local = (
        sliced.withColumn("_lower", F.coalesce(F.sum("_b").over(below), F.lit(0)))
        .groupBy(*keys, "_slice")
        .agg(
            F.sum("_a").alias("_a"),
            F.sum("_b").alias("_b"),
            F.sum(a_ * (F.col("_lower") + b_ / 2)).alias("_u"),
            F.sum(t * t * t - t).alias("_ties"),
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (
        local.withColumn("_offset", F.coalesce(F.sum("_b").over(earlier), F.lit(0)))
        .groupBy(*keys)
        .agg(
            F.sum("_a").alias("n_a"),
            F.sum("_b").alias("n_b"),
            F.sum(F.col("_u") + F.col("_offset") * F.col("_a")).alias("u"),
            F.sum("_ties").alias("ties"),
        )
    )


def delta_of(u: Column, n_a: Column, n_b: Column) -> Column:
    """Cliff's delta from U."""
    return F.try_divide(u * 2.0, n_a.cast("double") * n_b.cast("double")) - 1.0


def cliffs_delta(rows: DataFrame, keys: Sequence[str], value: Column, is_a: Column) -> DataFrame:
    """J2 per key; NULL where a group is empty."""
    return rank_counts(rows, keys, value, is_a).withColumn(
        "delta", delta_of(F.col("u"), F.col("n_a"), F.col("n_b"))
    )


def two_group_stats(
    rows: DataFrame, keys: Sequence[str], value: Column, is_a: Column
) -> DataFrame:
    """n, mean, median, sample SD per group, with Cliff's delta."""
    keys = list(keys)
    base = rows.where(is_finite(value)).select(*keys, is_a.alias("_is_a"), value.alias("_v"))
    va = F.when(F.col("_is_a"), F.col("_v"))
    vb = F.when(~F.col("_is_a"), F.col("_v"))
    moments = base.groupBy(*keys).agg(
        F.avg(va).alias("mean_a"),
        F.avg(vb).alias("mean_b"),
        F.stddev_samp(va).alias("sd_a"),
        F.stddev_samp(vb).alias("sd_b"),
    )
    medians = exact_quantiles(base, [*keys, "_is_a"], F.col("_v"), {"_med": 0.5})
    medians = medians.groupBy(*keys).agg(
        F.max(F.when(F.col("_is_a"), F.col("_med"))).alias("median_a"),
        F.max(F.when(~F.col("_is_a"), F.col("_med"))).alias("median_b"),
    )
    return cliffs_delta(base, keys, F.col("_v"), F.col("_is_a")).join(moments, keys).join(medians, keys)


def mann_whitney(
    rows: DataFrame, keys: Sequence[str], value: Column, is_a: Column, exact: bool = True
) -> DataFrame:
    """U with its two-sided p-value: exact for small tie-free groups, else (or if not
    ``exact``) normal."""
    counted = rank_counts(rows, keys, value, is_a)
    return counted.withColumn("p", mann_whitney_p("u", "n_a", "n_b", "ties", exact))


def stars(p: Column) -> Column:
    """Significance marks."""
    out = F.lit("ns")
    for cut, mark in reversed(STAR_CUTS):
        out = F.when(p < cut, F.lit(mark)).otherwise(out)
    return out


def welch(rows: DataFrame, keys: Sequence[str], value: Column, is_a: Column) -> DataFrame:
    """Welch's t, its degrees of freedom, p and stars."""
    va, vb = F.when(is_a, value), F.when(~is_a, value)
    m = rows.where(is_finite(value)).groupBy(*keys).agg(
        F.count(va).alias("n_a"), F.count(vb).alias("n_b"),
        F.avg(va).alias("mean_a"), F.avg(vb).alias("mean_b"),
        F.var_samp(va).alias("_va"), F.var_samp(vb).alias("_vb"),
    )
    ea, eb = F.try_divide(F.col("_va"), F.col("n_a")), F.try_divide(F.col("_vb"), F.col("n_b"))
    spread = ea + eb
    df = F.try_divide(
        spread * spread,
        F.try_divide(ea * ea, F.col("n_a") - 1.0) + F.try_divide(eb * eb, F.col("n_b") - 1.0),
    )
    return (
        m.withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(spread)))
        .withColumn("df", df)
        .withColumn("p", student_p("t", "df"))
        .withColumn("stars", stars(F.col("p")))
        .drop("_va", "_vb")
    )


def effect_bin(delta: Column) -> Column:
    """Size label and direction."""
    size = F.lit("large")
    for cut, label in reversed(EFFECT_CUTS):
        size = F.when(F.abs(delta) < cut, F.lit(label)).otherwise(size)
    arrow = F.when(delta > 0, "A>B").when(delta < 0, "A<B").otherwise("A=B")
    return F.when(is_finite(delta), F.concat(size, F.lit(" ("), arrow, F.lit(")"))).otherwise("nan")


def bootstrap_draws(
    rows: DataFrame, keys: Sequence[str], value: Column, is_a: Column, ids: Sequence[str],
    replicates: int, salt: str = "boot",
) -> DataFrame:
    """Every replicate's draws with replacement, ``(keys..., rep, is_a, value)``.

    A draw is a hashed ordinal, so drawing is an equi-join on ordinals; no group
    is held in one place.  ``ids`` must identify a row within its group.
    """
    keys = list(keys)
    base = rows.where(is_finite(value)).select(
        *keys, is_a.alias("_is_a"), value.alias("_v"), *[F.col(i).alias(f"_id_{j}") for j, i in enumerate(ids)]
    )
    group = [*keys, "_is_a"]
    placed = settle(
        row_ordinals(base, group, [f"_id_{j}" for j in range(len(ids))], "_at"), "ordinals"
    )
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    asks = (
        placed.select(*group, "_at")
        .join(settle(sizes, "sizes"), group)
        .select(*group, "_n", "_at", reps)
        .select(
            *group,
            "rep",
            (F.pmod(hex_to_long(hash_key(salt, *group, "rep", "_at")), F.col("_n")) + 1).alias("_at"),
        )
    )
    return asks.join(placed.select(*group, "_at", "_v"), [*group, "_at"]).select(
        *keys, "rep", F.col("_is_a").alias("is_a"), F.col("_v").alias("value")
    )


def bootstrap_interval(
    draws: DataFrame, keys: Sequence[str], statistic: Callable[[DataFrame, list[str]], DataFrame],
    alpha: float = 0.05,
) -> DataFrame:
    """Percentile interval of ``statistic`` (a DataFrame function giving column ``stat``)."""
    per_rep = statistic(draws, [*keys, "rep"])
    bounds = F.percentile("stat", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return per_rep.groupBy(*keys).agg(
        F.count("stat").alias("n_rep"), bounds.alias("_b")
    ).select(*keys, "n_rep", F.col("_b")[0].alias("lo"), F.col("_b")[1].alias("hi"))


def delta_statistic(draws: DataFrame, keys: list[str]) -> DataFrame:
    found = cliffs_delta(draws, keys, F.col("value"), F.col("is_a"))
    return found.select(*keys, F.col("delta").alias("stat"))


def median_gap_statistic(draws: DataFrame, keys: list[str]) -> DataFrame:
    q = exact_quantiles(draws, [*keys, "is_a"], F.col("value"), {"_m": 0.5})
    return q.groupBy(*keys).agg(
        (
            F.max(F.when(F.col("is_a"), F.col("_m"))) - F.max(F.when(~F.col("is_a"), F.col("_m")))
        ).alias("stat")
    )


def preference_exact(rows: DataFrame, keys: Sequence[str], value: Column, is_a: Column) -> DataFrame:
    """J6 without sampling: P(a>b), P(b>a), P(tie) over all pairs, from rank counts.

    U counts each tie as half a win, and U of the swapped groups counts it for the
    other side; a second rank pass is spared by summing tied pairs from the histogram.
    """
    keys = list(keys)
    a = is_a.cast("bigint")
    tied = (
        rows.where(is_finite(value))
        .groupBy(*keys, value.cast("double").alias("_v"))
        .agg(F.sum(a).cast("double").alias("_a"), F.sum(1 - a).cast("double").alias("_b"))
        .groupBy(*keys)
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("_tied"))
    )
    pairs = F.col("n_a").cast("double") * F.col("n_b").cast("double")
    counted = rank_counts(rows, keys, value, is_a).join(tied, keys)
    return counted.select(
        *keys,
        F.try_divide(F.col("u") - F.col("_tied") / 2, pairs).alias("p_a"),
        F.try_divide(pairs - F.col("u") - F.col("_tied") / 2, pairs).alias("p_b"),
        F.try_divide(F.col("_tied"), pairs).alias("p_tie"),
    )


def preference(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """J6 on sampled pairs."""
    share = lambda cond: F.avg(cond.cast("double"))
    return pairs.groupBy(*keys).agg(
        share(F.col(left) > F.col(right)).alias("p_a"),
        share(F.col(right) > F.col(left)).alias("p_b"),
        share(F.col(left) == F.col(right)).alias("p_tie"),
    )


def max_t(
    curves: DataFrame, permutations: int, statistic: str = "diff", salt: str = "perm"
) -> DataFrame:
    """Per-band statistic with family-wise p from label permutations within strata.

    ``curves`` is long: (unit, grp_a boolean, stratum, band, value).  Labels are dealt
    by hash order among the units of a stratum (units, not pixels), and the maxima
    of the permutations are compared with the observed bands by rank, not by
    a pairing of every band with every permutation.
    """
    units = curves.select("unit", "grp_a", "stratum").distinct()
    need = units.groupBy("stratum").agg(F.count_if("grp_a").alias("_need"))
    reps = units.join(need, "stratum").select(
        "unit", "stratum", "_need", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("rep")
    )
    deal = Window.partitionBy("rep", "stratum").orderBy(hash_key(salt, "rep", "unit"), "unit")
    dealt = reps.select(
        "unit", "rep", (F.row_number().over(deal) <= F.col("_need")).alias("_in_a")
    )
    observed = curves.select("unit", F.lit(0).alias("rep"), F.col("grp_a").alias("_in_a"), "band", "value")
    permuted = dealt.join(curves.select("unit", "band", "value"), "unit")
    both = observed.unionByName(permuted.select(observed.columns))
    va, vb = F.when(F.col("_in_a"), F.col("value")), F.when(~F.col("_in_a"), F.col("value"))
    gap = F.avg(va) - F.avg(vb)
    if statistic == "welch":
        noise = F.sqrt(F.var_samp(va) / F.count(va) + F.var_samp(vb) / F.count(vb))
        gap = F.try_divide(gap, noise)
    stat = settle(both.groupBy("rep", "band").agg(gap.alias("obs")), "perm")
    obs = stat.where("rep = 0").select("band", "obs")
    maxima = stat.where("rep > 0").groupBy("rep").agg(F.max(F.abs("obs")).alias("_m"))
    # a relative slack, so that equal statistics count as equal however their sums were ordered
    steps = obs.select((F.abs("obs") * (1 - 1e-12)).alias("_v"), F.lit(0).alias("_hit"), "band", "obs").unionByName(
        maxima.select(
            F.col("_m").alias("_v"), F.lit(1).alias("_hit"),
            F.lit(None).cast("int").alias("band"), F.lit(None).cast("double").alias("obs"),
        )
    )
    # bands plus permutations: at most a few thousand rows, bounded by the two parameters
    down = Window.orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        steps.withColumn("_ge", F.sum("_hit").over(down))
        .where("_hit = 0")
        .select("band", "obs", ((F.col("_ge") + 1.0) / (permutations + 1.0)).alias("p"))
    )


def significance(tested: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """How many bands pass, and their share."""
    return tested.groupBy(*keys).agg(
        F.count_if(F.col("p") < alpha).alias("n_sig"), F.count(F.lit(1)).alias("n_bands")
    )


def three_way(
    sims: DataFrame, value: Column, classes: Sequence[tuple[str, str]], keep: Sequence[str] = ()
) -> DataFrame:
    """J10 input: each class pair as one comparison, rows flagged by side."""
    entries = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in classes]
    )
    fanned = sims.select("pair_class", *keep, value.alias("value"), F.explode(entries).alias("_c"))
    return fanned.where(
        (F.col("pair_class") == F.col("_c.a")) | (F.col("pair_class") == F.col("_c.b"))
    ).select(
        F.concat_ws(" vs ", "_c.a", "_c.b").alias("comparison"),
        (F.col("pair_class") == F.col("_c.a")).alias("is_a"),
        *keep,
        "value",
    )
