"""The registered queries of this subpackage, one for each operator, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hustings.llm import encoding, fillmiddle, imatch, language, licences, maintext, neighbours, packing, sharding, simhash, spelling, suffixes, toxicity
from hustings.llm.common import table


def word_vocabulary() -> str:
    """Where the public word-end BPE vocabulary lies; the same path on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_digests(table(spark, sf_dir, "documents"), word_vocabulary())


def op2_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_digests(table(spark, sf_dir, "documents"))


def op5_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary())


def op8_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_texts(table(spark, sf_dir, "pages"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.digests(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_chunk_reuse, op2_language_backoff, op3_imatch, op4_suffix_array_dedup, op5_adaptive_dimension_scan, op6_toxicity_noisy_channel, op7_best_fit_packing, op8_balanced_label_propagation, op9_simhash_pivots, op10_licence_scan, op11_host_paths, op12_fill_middle, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op10_licence_scan": licences.scan_sql(), "op12_fill_middle": fillmiddle.digests_sql(), "op13_spelling_variants": spelling.spelling_variants_sql()}
