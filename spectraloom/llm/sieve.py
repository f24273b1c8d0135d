"""Rows of a wide table without those of some ids; rows of other ids stay where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.session import settle_outside

BITS = 1 << 24
HASHES = 3


def _places(name: str) -> list[Column]:
    return [F.pmod(F.xxhash64(name, F.lit(i)), F.lit(BITS)) for i in range(HASHES)]


def _bitmap(ids: DataFrame, name: str) -> DataFrame:
    """Bloom filter of a column: one row of BITS / 64 words."""
    words = (
        ids.select(F.explode(F.array(*_places(name))).alias("p"))
        .groupBy(F.expr("p div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("set"))
    )
    every = ids.sparkSession.range(BITS // 64).join(words, F.col("id") == F.col("word"), "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("set", F.lit(0)).alias("bits")))).alias("w"))
    return row.select(F.expr("transform(w, x -> x.bits)").alias("_sieve"))


def rows_without(docs: DataFrame, removed: DataFrame, name: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not among ``removed``, a settled table; a null id equals a null id.

    A bitmap of fixed size shows which rows may have to go; only those are joined, and the join
    decides.  A full bitmap lets all rows into the join.  ``docs`` is read twice.
    """
    sieve = F.broadcast(settle_outside(_bitmap(removed.select(name), name), "sieve"))
    tested = docs.crossJoin(sieve)
    maybe = F.lit(True)
    for p in _places(name):
        maybe &= F.getbit(F.get("_sieve", F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
    doubtful = tested.where(maybe).select(*docs.columns)
    gone = removed.select(F.col(name).alias("_gone"))
    return (
        tested.where(~maybe)
        .select(*docs.columns)
        .unionByName(doubtful.join(gone, doubtful[name].eqNullSafe(gone["_gone"]), "left_anti"))
    )
