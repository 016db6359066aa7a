"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, near_dedup, packing, pii, quality_rank, quality_rules, secret_scan, token_count, url_filter
from .common import table
from .oracles import SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_near_dedup": near_dedup.query,
    "op2_url_filter": url_filter.query,
    "op3_quality_rank": quality_rank.query,
    "op4_html_text": html_text.query,
    "op5_pii": pii.query,
    "op6_secret_scan": secret_scan.query,
    "op7_quality_rules": quality_rules.query,
    "op8_packing": lambda spark, d: packing.op8(table(spark, d, "documents")),
    "op9_decontaminate": lambda spark, d: decontaminate.op9(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_token_count": lambda spark, d: token_count.op10(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {k: SQL[k] for k in QUERIES if k in SQL}
