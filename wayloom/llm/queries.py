"""Queries of the thirteen operators with production parameters, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayloom.llm import (
    cells, decontaminate, divergence, html, jaccard, lines, pieces, quality, resample, substrings, toxicity, urls, warc,
)

#: Query name, module and the table it reads.
_OPS = (
    ("op1_sentencepiece", pieces, "documents"),
    ("op2_quality", quality, "documents labels"),
    ("op3_substring_dedup", substrings, "documents"),
    ("op4_decontamination", decontaminate, "documents benchmark"),
    ("op5_line_dedup", lines, "documents"),
    ("op6_embedding_dedup", cells, "embeddings"),
    ("op7_jaccard_join", jaccard, "documents"),
    ("op8_url_filters", urls, "pages"),
    ("op9_html_extraction", html, "pages"),
    ("op10_toxicity", toxicity, "documents labels"),
    ("op11_importance_resampling", resample, "documents benchmark"),
    ("op12_warc", warc, "pages"),
    ("op13_source_divergence", divergence, "documents"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(module, tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return module.query(*[_table(spark, sf_dir, t) for t in tables.split()])

    run.__doc__ = module.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module, tables) for name, module, tables in _OPS}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module, _ in _OPS if hasattr(module, "ORACLE")}
