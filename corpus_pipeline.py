"""A training corpus in five stages, each written to the shared folder and read again.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the
next stage's docs.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bpe, jaccard, mixing, pii, quality
from spectraloom.llm.queries import TOKENIZER, WEIGHTS, levels
from spectraloom.llm.sieve import rows_without
from spectraloom.session import intermediates, new_path, settle_outside, shuffles_deleted

#: Near-duplicate stage: words of a shingle and similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Mixing stage: share of all tokens that is kept; no document is read twice.
MIX_PERCENT, MIX_EPOCHS = 95, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows of one doc_id are judged together."""
    with shuffles_deleted(spark):
        judged = quality.judge(docs).groupBy("doc_id").agg(F.bool_and("kept").alias("kept"))
        failed = settle_outside(judged.where("NOT coalesce(kept, false)").select("doc_id"), "failed")
        return rows_without(docs, failed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Of rows that repeat a doc_id one stays; rows without an id are in no group and stay.
    """
    with shuffles_deleted(spark):
        with intermediates(spark):
            classes = jaccard.jaccard_join(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
            ids = classes.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
            fewer = settle_outside(ids.where("doc_id <> first OR doc_id = first AND n > 1"), "fewer")
            more = settle_outside(fewer.where("doc_id = first").select("doc_id"), "more")  # as a rule none
        others = rows_without(docs, fewer.select("doc_id"))
    return others.unionByName(docs.join(more, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span is replaced by its kind."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill each source's budget."""
    with shuffles_deleted(spark):
        chosen = mixing.mix(docs, levels(), WEIGHTS, MIX_PERCENT, MIX_EPOCHS).select(F.col("doc_id").alias("_id"))
        ids = docs.select("doc_id").distinct()
        left = ids.join(chosen, ids["doc_id"].eqNullSafe(chosen["_id"]), "left_anti")
        return rows_without(docs, settle_outside(left, "left"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed), with digests of ids and of the text decoded from them."""
    ids = bpe.encode(docs.select("doc_id", "text"), TOKENIZER).select("doc_id", "ids")
    decoded = bpe.decode(ids, TOKENIZER)
    return decoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]

#: Tokenising cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
