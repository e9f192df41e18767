"""Operators on a library of tracks: summaries, albums, reconciliation of two folders, tags and names.

Tracks are rows with file_format, total_frames, sample_rate, meta and so on. Missing numbers and names of albums sort
and group as if they were the least number and the empty name, so missing equals missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.shared import cut

#: Fixed value: stands for a missing number in sort and group keys.
MISSING = -(1 << 31)
#: Suffixes of file names and the formats that use them.
SUFFIXES = {"wav": ["wav"], "aiff": ["aiff"], "aif": ["aiff"], "au": ["au"], "flac": ["flac"], "oga": ["oggflac"], "ogg": ["ogg"], "opus": ["opus"], "mp3": ["mp3"], "mp2": ["mp2"], "m4a": ["alac", "m4a"], "wv": ["wv"], "ape": ["ape"], "tta": ["tta"], "mpc": ["mpc"]}
LOSSLESS = frozenset(("wav", "aiff", "au", "flac", "alac", "wv", "ape", "tta"))
#: Masks of speaker positions by the number of channels, where a file states none.
MASKS = {1: 0x4, 2: 0x3, 3: 0x7, 4: 0x33, 5: 0x37, 6: 0x3F}


def number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(MISSING))


def name(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def seconds(frames: str = "total_frames", rate: str = "sample_rate") -> Column:
    """Whole CD frames of a file, 75 to the second."""
    return F.expr(f"{frames} * 75 div {rate}")


def summary(tracks: DataFrame, by: str, **sums: Column) -> DataFrame:
    """``by``, is_total, n and the sums: a row for each value, and one for all where there is more than one value."""
    per = tracks.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])
    # the total comes from the few rows of the groups, not from the tracks again
    every = per.agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums], F.count("*").alias("_kinds")).filter("_kinds > 1")
    total = every.select(F.lit(None).cast(per.schema[by].dataType).alias(by), "n", *sums, F.lit(True).alias("is_total"))
    return per.withColumn("is_total", F.lit(False)).unionByName(total)


def most_numerous(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group and mode: the most common value, of equally common ones the one that came in last; null if all differ."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    per = counts.groupBy(group).agg(F.max_by(value, F.struct("c", "first")).alias("mode"), F.max("c").alias("most"), F.count("*").alias("kinds"))
    return per.select(group, F.when((F.col("most") > 1) | (F.col("kinds") == 1), F.col("mode")).alias("mode"))


def single(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no other row has; missing keys are equal. Counted by aggregation, so a hot key is one counter."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1")
    same = reduce(Column.__and__, [df[k].eqNullSafe(once[k]) for k in keys])
    return df.join(once, same, "left_semi")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], fallback: list[str], row: str) -> DataFrame:
    """left_row, right_row and stage: 1 by unique keys, 2 by the fallback among those left over, 3 without a partner."""
    rest_left, rest_right, found = left, right, []
    for stage, on in ((1, keys), (2, fallback)):
        a = single(rest_left, on).select(F.col(row).alias("left_row"), *[F.col(k).alias(f"a_{k}") for k in on])
        b = single(rest_right, on).select(F.col(row).alias("right_row"), *[F.col(k).alias(f"b_{k}") for k in on])
        pairs = a.join(b, reduce(Column.__and__, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in on])).select("left_row", "right_row", F.lit(stage).alias("stage"))
        pairs = cut(pairs)  # two numbers a pair, read three times below
        found.append(pairs)
        rest_left = rest_left.join(pairs, F.col(row) == F.col("left_row"), "left_anti")
        rest_right = rest_right.join(pairs, F.col(row) == F.col("right_row"), "left_anti")
    none = F.lit(None).cast("bigint")
    found += [rest_left.select(F.col(row).alias("left_row"), none.alias("right_row"), F.lit(3).alias("stage")), rest_right.select(none.alias("left_row"), F.col(row).alias("right_row"), F.lit(3).alias("stage"))]
    return reduce(DataFrame.unionByName, found)


def agreed(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """The fields on which all rows of a group agree, null otherwise."""
    same = lambda c: (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.when(same(f), F.min(f)).alias(f.split(".")[-1]) for f in fields])


def merged(old: Column, new: Column) -> Column:
    """A new field where there is one, else the old."""
    return F.coalesce(new, old)


def khz(rate: Column) -> Column:
    """A rate for display, with the hundreds digit unless it is 0."""
    thousands, tenth = F.floor(rate / 1000), F.floor(rate / 100) % 10
    return F.concat(thousands.cast("string"), F.when(tenth > 0, F.concat(F.lit("."), tenth.cast("string"))).otherwise(F.lit("")), F.lit("kHz"))


def size_units(size: Column) -> Column:
    """Bytes for display: whole below 1,024, else in K, M, G or T with one digit cut off after the point."""
    out = F.concat(F.floor(size * 10 / (1 << 40)).cast("double") / 10, F.lit("T"))
    for power, unit in ((30, "G"), (20, "M"), (10, "K")):
        out = F.when(size < 1 << (power + 10), F.concat((F.floor(size * 10 / (1 << power)).cast("double") / 10).cast("string"), F.lit(unit))).otherwise(out)
    return F.when(size < 1024, size.cast("string")).otherwise(out)


def clock(seconds_: Column) -> Column:
    """h:mm:ss."""
    s = seconds_.cast("bigint")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def file_name(track: Column, album: Column, title: Column, suffix: Column) -> Column:
    """A file name of numbers and title; slashes become hyphens, NULs spaces."""
    two = F.lpad(F.coalesce(track, F.lit(0)).cast("string"), 2, "0")
    start = F.when(album.isNotNull(), F.concat(album.cast("string"), two)).otherwise(two)
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "/", "-"), "\u0000", " ")
    return F.concat(start, F.lit(" - "), clean, F.lit("."), suffix)


def cleaned(text: Column) -> Column:
    """A text tag without white space at its ends; null if nothing is left."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare == "", None).otherwise(bare)


def number_pair(text: Column) -> tuple[Column, Column]:
    """Number and total of "a/b", without leading zeros; null where there is no whole number."""
    parts = F.split(text, "/", 2)
    whole = lambda p: F.when(p.rlike(r"^\s*\d{1,9}\s*$"), F.trim(p).cast("int"))
    return whole(parts[0]), whole(F.try_element_at(parts, F.lit(2)))


def mask_channels(mask: Column) -> Column:
    return F.bit_count(mask)
