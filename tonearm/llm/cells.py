"""The text cells of a track table's tags, one row per (track, field)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(tracks: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ("tag_source",)) -> DataFrame:
    """track_id, ``keep``, field_name and value of the cells that hold a character; repeated deliveries count once.

    A null tag, a null or empty field and a null track_id give no row; fields the tag doesn't have are left out.
    """
    has = set(tracks.schema["meta"].dataType.fieldNames())
    cells = [F.struct(F.lit(f).alias("field_name"), F.col(f"meta.{f}").alias("value")) for f in fields if f in has]
    if not cells:
        cells = [F.struct(F.lit("").alias("field_name"), F.lit(None).cast("string").alias("value"))]
    long = tracks.filter("meta is not null and track_id is not null").select("track_id", *keep, F.explode(F.array(*cells)).alias("c")).select("track_id", *keep, "c.field_name", "c.value")
    return long.filter("value is not null and value <> ''").distinct()
