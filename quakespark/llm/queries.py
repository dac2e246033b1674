"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quakespark.llm import bpe, licenses, mixing, neardup, packing, pii, preference, quality, repair, search, sharding, toxicity, trie
from quakespark.llm.common import table


def vocabulary_file(name: str) -> str:
    """The path of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_report(table(spark, sf_dir, "documents"))


def op2_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op3_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.neighbour_pairs(table(spark, sf_dir, "conversations")))


def op5_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_report(table(spark, sf_dir, "documents"))


def op6_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_attentive_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_report(table(spark, sf_dir, "documents"))


def op9_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_multi_50k.tiktoken"), split_pattern(), space_begins=True)


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary_file("word_bpe_49k.json")))


def op11_stack_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damage(table(spark, sf_dir, "conversations"))).drop("repaired_roles")


def op12_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_repetition, op2_license_index, op3_external_shuffle, op4_preference_format, op5_weighted_minhash,
        op6_bootstrapped_pii, op7_attentive_gru, op8_block_max_wand, op9_tree_bpe, op10_sum_of_squares,
        op11_stack_repair, op12_systematic_mix, op13_prefix_trie,
    )
}

ORACLES: dict[str, str] = {"op4_preference_format": preference.ORACLE, "op11_stack_repair": repair.ORACLE, "op12_systematic_mix": mixing.ORACLE, "op13_prefix_trie": trie.ORACLE}
