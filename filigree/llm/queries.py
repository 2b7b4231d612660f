"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, fill_middle, fingerprints, jaccard_join, kd_sharding, pii, quality, run_index, secrets, token_orc, whitening, wrappers
from .twins import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.without_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(_table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = common.new_path(spark, "token-orc")
    token_orc.write(docs, path, _vocabulary("word_bpe_49k.json"), 1, token_orc.files_for(docs))
    return token_orc.checksums(token_orc.read(spark, path))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform("matches", lambda x: x["item_id"].cast("string")))
    return found.select("doc_id", "n_words", decontaminate.covered(F.col("matches")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (F.size("matches") > 0).alias("contaminated"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fingerprints.compare_edited(docs, fingerprints.part_bytes_for(docs))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_copies(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["rank"] < len(pii.BASE))
    return pii.scan(_table(spark, sf_dir, "documents")).select("doc_id", *map(count, pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(_table(spark, sf_dir, "documents"))


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_sharding.assign(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(_table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["rank"] < len(secrets.BASE))
    return secrets.scan(_table(spark, sf_dir, "documents")).select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_run_index, op2_byte_bpe, op3_token_orc, op4_decontaminate, op5_minhash, op5_near_copies, op6_pii, op7_quality, op8_jaccard_join, op9_wrappers, op10_kd_sharding, op11_fill_middle, op12_secrets, op13_whitening)}

__all__ = ["ORACLE_SQL", "QUERIES"]
