"""The queries of this subpackage and their DuckDB equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, jaccard, langid, packing, pii, quality, suffix_dedup, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_exact_topk": topk.query,
    "op3_pii": pii.query,
    "op4_quality": quality.query,
    "op5_warc": warc.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_jaccard": jaccard.query,
    "op8_langid": langid.query,
    "op9_packing": packing.query,
    "op10_bpe": bpe.query,
}

ORACLES: dict[str, str] = {
    "op2_exact_topk": topk.ORACLE,
    "op4_quality": quality.ORACLE,
    "op5_warc": warc.ORACLE,
}
