"""Every registered query of the core, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonearm.operators import drift
from tonearm.plans import discs, files, library, streams, texts
from tonearm.shared import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "tag_dumps"))


def p3_scripts(spark: SparkSession, d: str) -> DataFrame:
    return drift.scripts(table(spark, d, "tag_dumps"))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent(table(spark, d, "tag_dumps"))


#: Queries of the core that SQL cannot express; they have tests of their own.
WITHOUT_SQL = frozenset(("image_metrics", "recursive_filter", "resample", "predictors"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {f.__name__: f for f in (p3_found, p3_scripts, p3_table)}
    return own | streams.QUERIES | library.QUERIES | discs.QUERIES | files.QUERIES | texts.QUERIES


def oracle_sql() -> dict[str, str]:
    return streams.SQL | library.SQL | discs.SQL | files.SQL | texts.SQL
