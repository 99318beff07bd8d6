"""The registered training-data queries and, where SQL can express them, their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.catalog.base import Query
from meterlens.llm import (
    decontamination, hosts, interaction, licences, neardup, packing, pii, quality, sharding,
    tokenfile, toxicity, vectors, whitening,
)
from meterlens.llm.check_sql import (
    AUDIT_SQL, DEDUP_SQL, HOST_SQL, LEAK_SQL, SEARCH_SQL, SHARD_SQL,
)
from meterlens.llm.common import table

# The key of a real run comes from spark.meterlens.pii.key.
EXAMPLE_KEY = "an example key"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER)


def shard(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def token_file(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenfile.token_folder(spark)
    tokenfile.write_tokens(table(spark, folder, "documents"), path, TOKENIZER)
    return tokenfile.read_tokens(spark, path)


def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), shingle=4)


def search(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get("spark.meterlens.pii.key", EXAMPLE_KEY).encode()


def private(spark: SparkSession, folder: str) -> DataFrame:
    return pii.surrogates(table(spark, folder, "documents").select("doc_id", "text"), pii_key(spark))


def licensed(spark: SparkSession, folder: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, folder, "documents")))


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def good(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def judge_hosts(spark: SparkSession, folder: str) -> DataFrame:
    judged = hosts.host_rules(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("short") | F.col("repeats")).alias("base_failed"), "rejected", "kept",
    )


def whitened(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def audit_filters(spark: SparkSession, folder: str) -> DataFrame:
    return interaction.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_packing": Query(pack),
    "op2_sharding": Query(shard, SHARD_SQL),
    "op3_pii": Query(private),
    "op4_toxicity": Query(toxic),
    "op5_vector_search": Query(search, SEARCH_SQL),
    "op6_token_file": Query(token_file),
    "op7_decontamination": Query(decontaminate, LEAK_SQL),
    "op8_minhash": Query(dedup, DEDUP_SQL),
    "op9_quality": Query(good),
    "op10_licences": Query(licensed),
    "op11_host_rules": Query(judge_hosts, HOST_SQL),
    "op12_whitening": Query(whitened),
    "op13_filter_audit": Query(audit_filters, AUDIT_SQL),
}
