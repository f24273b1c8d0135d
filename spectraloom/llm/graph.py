"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.session import settle


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link, component being its smallest node.

    Each round replaces links by links to smaller neighbours (minimum per node, combined
    before the shuffle) and is written to the shared folder; rounds grow with the
    logarithm of the longest path.  Self links and repeated links are allowed; a node
    without links is not returned; no links give an empty table.
    """
    edges = settle(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        joined = large.join(least, "u")
        small = joined.where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(
            least.select("u", F.col("w").alias("v"))
        )
        edges = settle(small.where("u <> v").distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(
        stars.select(F.col("component").alias("node"), "component").distinct()
    )
