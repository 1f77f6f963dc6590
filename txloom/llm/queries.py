"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txloom.llm import alignment, exact, licenses, merkle, mixing, ogg, packing, secret_scan, simhash, sitetree, substring, toxicity, warc
from txloom.llm.common import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.round_trip(_documents(spark, sf_dir))


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op5_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_secret_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_documents(spark, sf_dir))


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_documents(spark, sf_dir))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_documents(spark, sf_dir))


def op13_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_zstd": op2_warc_zstd,
    "op3_ogg_media": op3_ogg_media,
    "op4_license_templates": op4_license_templates,
    "op5_simhash_covering": op5_simhash_covering,
    "op6_toxicity_counterfactual": op6_toxicity_counterfactual,
    "op7_secret_token_efficiency": op7_secret_token_efficiency,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_temperature_mixing": op10_temperature_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_site_style_tree": op13_site_style_tree,
}

ORACLES: dict[str, str] = {
    "op2_warc_zstd": warc.ORACLE,
    "op9_exact_dedup": exact.ORACLE,
    "op10_temperature_mixing": mixing.ORACLE,
}
