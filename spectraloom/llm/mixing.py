"""Mixing sources to target weights by hierarchical budgets, with DataFrame expressions only.

A token budget is passed down a tree of levels (domain, language, source).  Among siblings it
is shared by weight; what a node cannot fill goes to its siblings, and only when all of them
are full does less reach their parent, whose own siblings then take it.  This is water filling
under the nodes' capacities, in whole tokens.  Each leaf then reads its documents in seeded
epochs: whole epochs first, then the prefix of the next epoch's order that reaches the budget.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.llm.common import WORD
from spectraloom.session import settle

BIG = "decimal(38,0)"


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    found = F.lit(weights.get("*", 1))
    for value, w in weights.items():
        if value != "*":
            found = F.when(F.col(level) == value, w).otherwise(found)
    return found.cast(BIG)


def _shared(children: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Budget of each child: ``cap``, ``weight`` and the parent's ``given`` become ``given``."""
    group = Window.partitionBy(*(parent or [F.lit(0)]))
    order = group.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), level)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(BIG)
    filled = (
        children.withColumn("_before", F.coalesce(F.sum("cap").over(ahead), zero).cast(BIG))
        .withColumn(
            "_left", (F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(ahead), zero)).cast(BIG)
        )
        .withColumn(
            "_full",
            F.col("cap") * F.col("_left") <= (F.col("given") - F.col("_before")) * F.col("weight"),
        )
    )
    open_cap = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(zero)).over(group).cast(BIG)
    open_weight = F.sum(F.when(F.col("_full"), zero).otherwise(F.col("weight"))).over(group).cast(BIG)
    filled = filled.withColumn("_pool", (F.col("given") - open_cap).cast(BIG)).withColumn("_share", open_weight)
    filled = filled.withColumn(
        "_take",
        F.expr("CASE WHEN _full THEN cap ELSE CAST((_pool * weight) div _share AS DECIMAL(38,0)) END").cast(BIG),
    )
    spare = F.col("_pool") - F.sum(F.when(F.col("_full"), zero).otherwise(F.col("_take"))).over(group)
    rank = F.row_number().over(group.orderBy("_full", level))
    return filled.withColumn("_spare", spare).withColumn("_rank", rank).withColumn(
        "given",
        (F.col("_take") + F.when(~F.col("_full") & (F.col("_rank") <= F.col("_spare")), 1).otherwise(0)).cast(BIG),
    ).drop("_before", "_left", "_full", "_pool", "_share", "_take", "_spare", "_rank")


def budgets(
    tokens: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], percent: int, epochs: int
) -> DataFrame:
    """Each leaf's ``available`` tokens and ``given`` budget: ``percent`` of all tokens in total."""
    levels = list(levels)
    leaves = settle(
        tokens.groupBy(*levels).agg(F.sum("tokens").cast(BIG).alias("available")), "leaves"
    )
    capped = leaves.withColumn("cap", (F.col("available") * epochs).cast(BIG))
    given = capped.agg(
        F.least(
            (F.sum("available") * percent / 100).cast("decimal(38,2)"), F.sum("cap").cast("decimal(38,2)")
        ).alias("given")
    ).select(F.floor("given").cast(BIG).alias("given"))
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        children = capped.groupBy(*path).agg(
            F.sum("cap").cast(BIG).alias("cap"), F.sum("available").cast(BIG).alias("available")
        ).withColumn("weight", _weight(level, weights.get(level, {})))
        # the root is one row; below it, parents are at most as many as leaves
        known = children.crossJoin(given) if not parent else children.join(given, parent)
        shared = _shared(known, parent, level)
        given = shared.select(*path, "given") if depth < len(levels) - 1 else shared
    return settle(given.select(*levels, "available", "given"), "budgets")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    percent: int = 80,
    epochs: int = 2,
    seed: int = 0,
) -> DataFrame:
    """``(doc_id, <levels>, tokens, budget, copies)`` of the chosen documents.

    ``levels`` name the tree from root to leaf and how a row's node is found; null nodes are
    a node called "".  ``weights`` holds whole positive weights by level and node, ``"*"`` for
    the rest.  Tokens are words at ASCII white space; a null text has none.  ``copies`` says in
    how many epochs a document is read.  The last epoch's prefix ends with the document that
    reaches the leaf's budget.  Documents of a leaf are ordered by md5(seed:epoch:doc_id), ties
    by doc_id and tokens; a null id counts as empty text.  Repeated rows stay rows of their
    own.  Empty leaves and an empty table give nothing.
    """
    names = list(levels)
    tokens = settle(
        docs.select(
            "doc_id",
            *[F.coalesce(c, F.lit("")).alias(n) for n, c in levels.items()],
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("tokens"),
        ),
        "tokens",
    )
    plan = budgets(tokens, names, weights, percent, epochs).where("available > 0").select(
        *names,
        F.col("given").cast("bigint").alias("budget"),
        F.expr("CAST(given div available AS BIGINT)").alias("full"),
        F.expr("CAST(given - (given div available) * available AS BIGINT)").alias("rest"),
    )
    plan = settle(plan, "plan")
    ordered = tokens.join(plan, names).withColumn(
        "at", F.md5(F.concat_ws(":", F.lit(str(seed)), "full", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ).withColumn("cell", F.substring("at", 1, 3))
    # the prefix ends in one of 4096 cells of the order; only that cell's rows need sorting
    cells = ordered.groupBy(*names, "cell", "rest").agg(F.sum("tokens").alias("n"))
    ahead = Window.partitionBy(*names).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    last = settle(
        cells.where("before < rest")
        .groupBy(*names)
        .agg(F.max("cell").alias("last"), F.max_by("before", "cell").alias("before")),
        "last",
    )
    placed = ordered.join(last, names, "left")
    within = Window.partitionBy(*names, "cell").orderBy("at", "doc_id", "tokens").rowsBetween(
        Window.unboundedPreceding, -1
    )
    edge = placed.where("cell = last").withColumn(
        "chosen", F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0)) < F.col("rest")
    )
    whole = placed.where("last IS NULL OR cell <> last").withColumn(
        "chosen", F.coalesce(F.col("cell") < F.col("last"), F.lit(False))
    )
    return (
        whole.unionByName(edge)
        .withColumn("copies", F.col("full") + F.col("chosen").cast("bigint"))
        .where("copies > 0")
        .select("doc_id", *names, "tokens", "budget", "copies")
    )
