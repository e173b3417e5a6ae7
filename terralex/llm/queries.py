"""The corpus operators as registered queries, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralex.llm import bpe, exact_dedup, license_scan, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, sharding, token_counts


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file on the driver; the operators take any path."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _docs(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_shards": _docs(sharding.shard_report),
        "op2_near_dedup": _docs(near_dedup.linked),
        "op3_exact_dedup": _docs(exact_dedup.dedup_report),
        "op4_unigram_counts": _docs(lambda docs: token_counts.counted(docs, tokenizer_file("piece_bpe_32k.model"), byte_fallback=True)),
        "op5_secret_scan": _docs(secret_scan.scanned),
        "op6_divergence_rules": _docs(quality_rules.judged),
        "op7_ftrl_quality": lambda spark, sf_dir: quality_classifier.quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op8_bpe_digests": _docs(lambda docs: bpe.digests(docs, tokenizer_file("byte_bpe_50k.json"))),
        "op9_license_scan": _docs(license_scan.scanned),
        "op10_mix": _docs(mixing.mix_report),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hilbert_shards": sharding.oracle(),
        "op2_near_dedup": near_dedup.ORACLE,
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op10_mix": mixing.ORACLE,
    }
