"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import byte_bpe, centroids, hnsw, language_id, lexical, license_scan, packing, quality_rules, reply_trees, sharding, simhash, toxicity, url_lists
from keyloom.llm.common import held_out, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.train(*toxicity.learned_rows(docs, labels, "doc_id", "text", "toxic", ~held_out("doc_id", 5, 0)))
    rows = docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    return toxicity.score(rows, net, "text", ["doc_id", "held_out"])


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise(reply_trees.ASSISTANT)
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(reply_trees.TRICKY).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    return reply_trees.digests(reply_trees.conversations(rows))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", k=5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", WORD_BPE)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, "doc_id", "text", "lang", ~held_out("doc_id", 4, 2))
    rows = docs.select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out"))
    return language_id.predict(rows, model, "text", ["doc_id", "held_out"])


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.evaluate(url_lists.page_captures(pages), url_lists.page_entries(pages), "url", "day", ["page_id"])


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_BPE, public_tokenizers.PATTERN)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents"), "text", ["doc_id"]), ["doc_id"])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k=10)


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(*centroids.clustered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=8, rounds=10))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), 8, as_read=True)
    return sharding.summary(found, "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op2_reply_trees": reply_trees.ORACLE,
        "op6_url_lists": url_lists.ORACLE,
        "op9_quality_rules": quality_rules.ORACLE,
        "op11_ranked_search": lexical.ORACLE,
        "op12_yinyang": centroids.oracle(),
    }
