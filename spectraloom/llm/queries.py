"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import bpe, chat, collocations, jaccard, lm, merkle, mixing, oracles, pii, quality, repeats, shards, topk, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def levels() -> dict:
    """Domain (the number that ends the source's name, modulo 3), language, source."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "[0-9]+$", 0).try_cast("bigint")
    domain = F.concat(F.lit("d"), F.pmod(F.coalesce(number, F.lit(0)), F.lit(3)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


#: Tree of the mixing query: whole weights by level and node.
WEIGHTS = {"domain": {"d0": 3, "d1": 2, "*": 1}, "lang": {"en": 6, "*": 2}, "source": {"*": 1}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    read = chat.read_chats(chat.format_chats(turns.unionByName(probe)))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(
            F.expr(r"array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')").cast("binary"), 256
        ).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, TOKENIZER).select("doc_id", "ids")
    return bpe.digests(bpe.decode(ids, TOKENIZER))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), levels(), WEIGHTS, percent=80, epochs=2, seed=0)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.detect(_table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"), 8)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    shown = {c: F.round(c, 6) + F.lit(0.0) for c in ("char_distance", "word_distance")}
    return judged.withColumns(shown)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.summary(repeats.without_repeats(_table(spark, sf_dir, "documents"), 400))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.tampered(docs, 7))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, percent=80, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_exact_top_k,
        op3_bpe_round_trip,
        op4_toxicity,
        op5_lm_scores,
        op6_source_mixing,
        op7_pii,
        op8_jaccard_join,
        op9_sharding,
        op10_quality_rules,
        op11_suffix_dedup,
        op12_merkle_manifest,
        op13_collocations,
    )
}
ORACLES: dict[str, str] = {
    "op1_chat_formatting": oracles.CHAT,
    "op2_exact_top_k": oracles.TOP_K,
    "op6_source_mixing": oracles.mixing(WEIGHTS, percent=80, epochs=2, seed=0),
    "op8_jaccard_join": oracles.jaccard(k=3, percent=90),
    "op12_merkle_manifest": oracles.MERKLE,
    "op13_collocations": oracles.collocations(least=30, percent=80, top=2000),
    "op10_quality_rules": oracles.quality(
        quality.COMMON_WORDS,
        (quality.CHAR_LIMIT, quality.CHAR_SCATTER),
        (quality.WORD_LIMIT, quality.WORD_SCATTER),
        (quality.LEAST_WORDS, quality.LEAST_CHARS),
    ),
}
