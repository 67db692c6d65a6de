"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import decontam, fim, licenses, ngram_join, packing, pii, ppm, quality, spelling, substring, suffix, token_output, topk
from bazaarlens.llm.shared import documents
from bazaarlens.llm.sql import CONTAMINATION, INFILLING, TOP_K


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's vocabulary on this machine; executors open the same path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": lambda spark, sf_dir: ngram_join.jaccard_components(documents(spark, sf_dir)),
    "op2_substring_dedup": lambda spark, sf_dir: substring.substring_digest(documents(spark, sf_dir)),
    "op3_best_fit_packing": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir)),
    "op4_quality_rules": lambda spark, sf_dir: quality.quality_digest(documents(spark, sf_dir)),
    "op5_ppm_score": lambda spark, sf_dir: ppm.score_digest(documents(spark, sf_dir)),
    "op6_suffix_dedup": lambda spark, sf_dir: suffix.suffix_digest(documents(spark, sf_dir)),
    "op7_token_output": lambda spark, sf_dir: token_output.token_digest(documents(spark, sf_dir), tokenizer_file()),
    "op8_personal_data": lambda spark, sf_dir: pii.pii_digest(documents(spark, sf_dir)),
    "op9_license_scan": lambda spark, sf_dir: licenses.license_digest(documents(spark, sf_dir)),
    "op10_decontamination": lambda spark, sf_dir: decontam.contamination_digest(documents(spark, sf_dir), benchmark(spark, sf_dir)),
    "op11_fill_in_middle": lambda spark, sf_dir: fim.infill_digest(documents(spark, sf_dir)),
    "op12_exact_top_k": lambda spark, sf_dir: topk.top_k(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0),
    "op13_spelling_variants": lambda spark, sf_dir: spelling.spelling_variants(documents(spark, sf_dir)),
}
ORACLES: dict[str, str] = {"op10_decontamination": CONTAMINATION, "op11_fill_in_middle": INFILLING, "op12_exact_top_k": TOP_K}
