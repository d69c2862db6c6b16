"""The corpus operators over their whole tables, as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallbook.checks.catalogue import Catalogue
from stallbook.llm import (
    conversation_trie, fill_middle, group_join, imatch, license_scan, line_dedup, lm_deleted, lsa_decontam, packing, quality_fm, sharding, simhash_trie, suffix_dedup,
)
from stallbook.llm.common import read

CATALOGUE = Catalogue()


@CATALOGUE.check("op1_license_scan", license_scan.license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


@CATALOGUE.check("op2_imatch")
def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints_with_edits(read(spark, sf_dir, "documents"))


@CATALOGUE.check("op3_pow2_packing")
def op3_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@CATALOGUE.check("op4_interleaved_sharding")
def op4_interleaved_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(read(spark, sf_dir, "documents"), shards=24)


@CATALOGUE.check("op5_quality_fm")
def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, read(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model).withColumn("held_out", quality_fm.held_out())


@CATALOGUE.check("op6_deleted_interpolation")
def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = read(spark, sf_dir, "documents").withColumn("train", ~held_out)
    return lm_deleted.score(docs).withColumn("held_out", held_out)


@CATALOGUE.check("op7_simhash_trie")
def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(read(spark, sf_dir, "documents"))


@CATALOGUE.check("op8_lsa_decontamination")
def op8_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsa_decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@CATALOGUE.check("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_strings(read(spark, sf_dir, "documents"))


@CATALOGUE.check("op10_line_dedup", line_dedup.LINE_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@CATALOGUE.check("op11_group_join")
def op11_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.jaccard_join(read(spark, sf_dir, "documents"))


@CATALOGUE.check("op12_fill_middle", fill_middle.FILL_SQL)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256")]
    return cuts.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@CATALOGUE.check("op13_conversation_trie", conversation_trie.TRIE_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))
