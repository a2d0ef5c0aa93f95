"""The catalogue of queries of the engine: every name with its function and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language, sentences as S
from ..sources.tables import table
from . import page_queries, text_queries

MODULES = [text_queries, page_queries]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents to lines to sentences to languages, counted: one plan, no Python worker."""
    lines = table(spark, d, "documents", "doc_id", "text").select(F.explode(F.split("text", "\n")).alias("line"))
    rows = lines.select(F.explode(S.split_sentences(F.col("line"))).alias("sentence")).where(S.is_sentence(F.col("sentence")))
    return rows.groupBy(language.detect_language(F.col("sentence")).alias("lang")).agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


def _all() -> dict[str, tuple]:
    return {name: pair for module in MODULES for name, pair in module.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
