"""One query per operator over its whole table, and SQL where it can say the
same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (ann, bpe, chat_format, exact_dedup, packing, pii, quality_cnn, sharding, simhash, source_audit,
               suffix_dedup, token_align, url_trees)
from .oracles import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"
QUERY_EVERY = 50


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(read_table(spark, sf_dir, "conversations"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), lambda i: i % QUERY_EVERY == 0)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_cnn.score_documents(docs, quality_cnn.train(docs, read_table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(read_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_duplicates(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents")).drop("atom")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = source_audit.audit_sources(read_table(spark, sf_dir, "documents"))
    parts = [rows.withColumn("part", F.lit(part)) for part, rows in (("pair", audit.pairs), ("term", audit.terms))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(read_table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED)).documents


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_exact_dedup, op3_simhash, op4_ann, op5_bpe, op6_pii,
                                   op7_quality, op8_url_filter, op9_packing, op10_suffix_dedup, op11_sharding,
                                   op12_source_audit, op13_token_align)}
