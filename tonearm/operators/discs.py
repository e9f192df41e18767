"""Disc layouts, disc identifiers and offset checksum look-ups. Offsets are CD frames, 75 to the second.

Layouts are small by nature: a disc has 99 tracks at most, so what is gathered for one disc is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Fixed value: the frames before the first track of a disc that two of the identifiers count.
LEAD_IN = 150


def _order() -> WindowSpec:
    return Window.partitionBy("sheet_id").orderBy("track_number")


def timestamp(frames: Column) -> Column:
    """mm:ss:ff."""
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.length(c.cast("string")), F.lit(2)), F.lit("0"))
    return F.concat(two(F.floor(frames / 4500)), F.lit(":"), two(F.floor(frames / 75) % 60), F.lit(":"), two(frames % 75))


def frames_of(stamp: Column) -> Column:
    p = F.split(stamp, ":")
    return p[0].cast("bigint") * 4500 + p[1].cast("bigint") * 75 + p[2].cast("bigint")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def starts(index: DataFrame) -> DataFrame:
    """sheet_id, track_number, start (index 1) and pre_gap (frames from index 0 to 1, 0 without it)."""
    at = lambda k: F.max(F.when(F.col("index_number") == k, F.col("offset_cdframes")))
    per = index.groupBy("sheet_id", "track_number").agg(at(0).alias("zero"), at(1).alias("start"))
    return per.select("sheet_id", "track_number", "start", F.coalesce(F.col("start") - F.col("zero"), F.lit(0)).alias("pre_gap"))


def lengths(index: DataFrame) -> DataFrame:
    """The same with length: up to the next track's start, null for a disc's last track."""
    return starts(index).withColumn("length", F.lead("start").over(_order()) - F.col("start"))


def running_offsets(sized: DataFrame) -> DataFrame:
    """sheet_id, track_number, length and offset: where each track starts if they follow one another."""
    before = Window.partitionBy("sheet_id").orderBy("track_number").rowsBetween(Window.unboundedPreceding, -1)
    return sized.select("sheet_id", "track_number", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def digit_sum(n: Column) -> Column:
    return F.aggregate(F.split(n.cast("string"), ""), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def identifiers(laid: DataFrame) -> DataFrame:
    """sheet_id, tracks and the three usual disc identifiers of tracks laid one behind the other (running_offsets).

    freedb_id: a checksum of the starts' digits, the length in seconds and the number of tracks. mb_id: SHA-1 of all
    offsets in hex, in base 64. ar_id1 and ar_id2: the sums of the offsets, plain and by track number.
    """
    numbered = laid.withColumn("n", F.row_number().over(_order()))
    per = numbered.groupBy("sheet_id").agg(
        F.count("*").alias("tracks"),
        F.sum("length").alias("lead_out"),
        F.min("offset").alias("first"),
        F.sum(digit_sum(F.floor((F.col("offset") + LEAD_IN) / 75))).alias("digits"),
        F.sum("offset").alias("sum1"),
        F.sum(F.col("n") * F.greatest("offset", F.lit(1))).alias("sum2"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "offset"))), lambda x: x["offset"]).alias("offsets"),
    )
    hex8 = lambda c: F.lpad(F.hex(c), 8, "0")
    seconds = F.floor((F.col("lead_out") + LEAD_IN) / 75) - F.floor((F.col("first") + LEAD_IN) / 75)
    freedb = F.shiftleft(F.col("digits") % 255, 24) + F.shiftleft(seconds, 8) + F.col("tracks")
    padded = F.concat(F.col("offsets"), F.array_repeat(F.lit(-LEAD_IN).cast("bigint"), F.greatest(99 - F.size("offsets"), F.lit(0))))
    text = F.concat(F.lit("01"), F.lpad(F.hex("tracks"), 2, "0"), hex8(F.col("lead_out") + LEAD_IN), F.concat_ws("", F.transform(padded, lambda o: hex8(o + LEAD_IN))))
    mb = F.translate(F.replace(F.base64(F.unhex(F.sha1(text))), F.lit("="), F.lit("-")), "+/", "._")
    return per.select("sheet_id", "tracks", F.lower(hex8(freedb)).alias("freedb_id"), mb.alias("mb_id"), (F.col("sum1") + F.col("lead_out")).alias("ar_id1"), (F.col("sum2") + (F.col("tracks") + 1) * F.col("lead_out")).alias("ar_id2"))


def best_offsets(checksums: DataFrame, known: DataFrame) -> DataFrame:
    """sheet_id, track_number, confidence, crc and frame_offset: the surest known checksum that one of a track's has.

    Equally sure ones: the one nearest to offset 0, then the lower offset. Tracks without a match get offset 0 and its
    checksum, with null confidence.
    """
    hits = checksums.join(known.select("sheet_id", "track_number", "crc", "confidence").distinct(), ["sheet_id", "track_number", "crc"])
    best = hits.groupBy("sheet_id", "track_number").agg(F.max_by(F.struct("confidence", "crc", "frame_offset"), F.struct("confidence", -F.abs("frame_offset"), -F.col("frame_offset"), "crc")).alias("b"))
    zero = checksums.groupBy("sheet_id", "track_number").agg(F.max(F.when(F.col("frame_offset") == 0, F.col("crc"))).alias("crc0"))
    out = zero.join(best, ["sheet_id", "track_number"], "left")
    return out.select("sheet_id", "track_number", "b.confidence", F.coalesce("b.crc", "crc0").alias("crc"), F.coalesce("b.frame_offset", F.lit(0)).alias("frame_offset"))


def cue_lines(sheets: DataFrame, index: DataFrame) -> DataFrame:
    """sheet_id and cue: the text of each disc's cue sheet."""
    marks = index.groupBy("sheet_id", "track_number").agg(F.array_sort(F.collect_list(F.struct("index_number", "offset_cdframes"))).alias("marks"), F.min("file_name").alias("file_name"))
    line = lambda m: F.concat(F.lit("    INDEX "), F.lpad(m["index_number"].cast("string"), 2, "0"), F.lit(" "), timestamp(m["offset_cdframes"]))
    tracks = sheets.join(marks, ["sheet_id", "track_number"])
    quoted = lambda c, word: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'    {word} "'), escaped(F.col(c)), F.lit('"')))
    head = F.concat(F.lit("  TRACK "), F.lpad(F.col("track_number").cast("string"), 2, "0"), F.when(F.col("is_audio"), F.lit(" AUDIO")).otherwise(F.lit(" MODE1/2352")))
    text = F.concat_ws("\n", head, quoted("title", "TITLE"), quoted("performer", "PERFORMER"), F.when(F.col("isrc").isNotNull(), F.concat(F.lit("    ISRC "), F.col("isrc"))), F.concat_ws("\n", F.transform("marks", line)))
    per = tracks.select("sheet_id", "file_name", F.struct("track_number", text.alias("text")).alias("t"))
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]))
    return per.groupBy("sheet_id").agg(F.concat(F.lit('FILE "'), escaped(F.min("file_name")), F.lit('" WAVE\n'), body).alias("cue"))


def parse_cue(cues: DataFrame) -> DataFrame:
    """sheet_id, track_number, index_number and offset_cdframes of cue texts (sheet_id, cue)."""
    lines = cues.select("sheet_id", F.posexplode(F.split("cue", "\r?\n")).alias("pos", "line"))
    number = F.when(F.col("line").rlike(r"^\s*TRACK\s+\d+"), F.regexp_extract("line", r"^\s*TRACK\s+(\d+)", 1).cast("int"))
    told = lines.withColumn("track_number", F.last(number, ignorenulls=True).over(Window.partitionBy("sheet_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    marks = told.filter(F.col("line").rlike(r"^\s*INDEX\s+\d+\s+\d+:\d+:\d+\s*$"))
    stamp = F.regexp_extract("line", r"(\d+:\d+:\d+)", 1)
    return marks.select("sheet_id", "track_number", F.regexp_extract("line", r"INDEX\s+(\d+)", 1).cast("int").alias("index_number"), frames_of(stamp).alias("offset_cdframes"))
