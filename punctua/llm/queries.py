"""The registered queries of this subpackage: opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from punctua.llm import fill_in_middle, fingerprints, language, licenses, minhash, mixing, near_duplicates, packing, prefix_trie, quality, secrets, sharding, topk
from punctua.llm.oracles import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_sharding": lambda spark, d: sharding.shard_documents(table(spark, d, "documents")),
    "op2_quality": lambda spark, d: quality.score_documents(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_near_duplicates": lambda spark, d: near_duplicates.near_duplicates(table(spark, d, "documents")),
    "op4_secrets": lambda spark, d: secrets.scan_documents(table(spark, d, "documents")),
    "op5_fingerprints": lambda spark, d: fingerprints.fingerprint_documents(table(spark, d, "documents")),
    "op6_mixing": lambda spark, d: mixing.mix_documents(table(spark, d, "documents")),
    "op7_language": lambda spark, d: language.identify_documents(table(spark, d, "documents")),
    "op8_topk": lambda spark, d: topk.search(table(spark, d, "embeddings")),
    "op9_licenses": lambda spark, d: licenses.scan_documents(table(spark, d, "documents")),
    "op10_packing": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
    "op11_fill_in_middle": lambda spark, d: fill_in_middle.transform_documents(table(spark, d, "documents")),
    "op12_minhash": lambda spark, d: minhash.near_duplicates(table(spark, d, "documents")),
    "op13_prefix_trie": lambda spark, d: prefix_trie.conversation_trie(table(spark, d, "conversations")),
}

__all__ = ["ORACLE_SQL", "QUERIES"]
