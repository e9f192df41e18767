"""The queries of the training-data problems, by name. Each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import encodings, mixing, names, plainform, residue, tokens, truncation
from tonearm.shared import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.found(table(spark, d, "tracks"))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(table(spark, d, "tracks"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "tracks")
    return names.names_of(tracks, damaged=_damaged(tracks, names.FIELDS))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(_names(spark, d))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(_names(spark, d))


def _damaged(tracks: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """Cells of problems 1 and 5 in the fields ``of``; a cell has one kind of damage at most.

    Problem 5 judges each value by itself, so other fields needn't be read; problem 1 learns from all of its fields.
    """
    plain = plainform.found(tracks, fields=tuple(f for f in plainform.FIELDS if f in of))
    return encodings.found(tracks).filter(F.col("field_name").isin(*of)).union(plain).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "tracks")
    return truncation.found(tracks, _damaged(tracks, truncation.FIELDS))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "tracks")
    return truncation.shares(tracks, _damaged(tracks, truncation.FIELDS))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "tracks")
    return plainform.found(tracks, encodings.found(tracks, plainform.FIELDS))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return plainform.unified(table(spark, d, "tracks"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_use(spark: SparkSession, d: str) -> DataFrame:
    return tokens.vocabulary_use(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(docs, targets), docs, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_entities, p4_found, p4_shares, p5_found, p5_unified, p6_ids, p6_use, p7_mix, p7_shares, p8_found, p8_clean)}


def oracle_sql() -> dict[str, str]:
    return {}
