"""Queries of the disc operators over the sheets, checksums and tracks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.operators import discs as D
from tonearm.operators import library as L
from tonearm.plans.registry import Registry
from tonearm.shared import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_STARTS = "WITH p AS (SELECT sheet_id, track_number, max(CASE WHEN index_number = 0 THEN offset_cdframes END) AS zero, max(CASE WHEN index_number = 1 THEN offset_cdframes END) AS start FROM sheet_index GROUP BY 1, 2) "


def index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sheet_index")


@query(_STARTS + "SELECT sheet_id, track_number, start, coalesce(start - zero, 0) AS pre_gap, lead(start) OVER (PARTITION BY sheet_id ORDER BY track_number) - start AS length FROM p")
def track_length(spark: SparkSession, d: str) -> DataFrame:
    return D.lengths(index(spark, d))


@query("SELECT sheet_id, track_number, max(CASE WHEN index_number = 0 THEN offset_cdframes END) AS i0, max(CASE WHEN index_number = 1 THEN offset_cdframes END) AS i1, max(CASE WHEN index_number = 2 THEN offset_cdframes END) AS i2 FROM sheet_index GROUP BY 1, 2")
def index_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = index(spark, d).groupBy("sheet_id", "track_number").pivot("index_number", [0, 1, 2]).max("offset_cdframes")
    return wide.select("sheet_id", "track_number", *[F.col(str(k)).alias(f"i{k}") for k in range(3)])


@query("WITH o AS (SELECT sheet_id, file_name, offset_cdframes > lag(offset_cdframes) OVER (PARTITION BY sheet_id ORDER BY track_number, index_number) AS up FROM sheet_index) SELECT sheet_id, count(DISTINCT file_name) = 1 AND coalesce(bool_and(up), TRUE) AS one_image FROM o GROUP BY 1")
def image_formatted(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sheet_id").orderBy("track_number", "index_number")
    up = index(spark, d).withColumn("up", F.col("offset_cdframes") > F.lag("offset_cdframes").over(w))
    return up.groupBy("sheet_id").agg(((F.countDistinct("file_name") == 1) & F.coalesce(F.every("up"), F.lit(True))).alias("one_image"))


@query("SELECT sheet_id, track_number, lag(title) OVER w AS previous, lead(title) OVER w AS next, row_number() OVER w = 1 AS is_first, lead(track_number) OVER w IS NULL AS is_last FROM sheet_track WINDOW w AS (PARTITION BY sheet_id ORDER BY track_number)")
def prev_next(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("sheet_id").orderBy("track_number")
    return table(spark, d, "sheet_track").select("sheet_id", "track_number", F.lag("title").over(w).alias("previous"), F.lead("title").over(w).alias("next"), (F.row_number().over(w) == 1).alias("is_first"), F.lead("track_number").over(w).isNull().alias("is_last"))


@query("SELECT sheet_id, count(*) AS n, min(track_number) IN (0, 1) AND max(track_number) - min(track_number) = count(*) - 1 AS in_order, bool_and(is_audio) AS audio FROM sheet_track GROUP BY 1")
def track_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("track_number")
    return table(spark, d, "sheet_track").groupBy("sheet_id").agg(F.count("*").alias("n"), (F.min(n).isin(0, 1) & (F.max(n) - F.min(n) == F.count("*") - 1)).alias("in_order"), F.every("is_audio").alias("audio"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """One length for each track number of the discs whose files are known."""
    rows = table(spark, d, "tracks").filter("sheet_id is not null and meta.track_number is not null")
    return rows.groupBy("sheet_id", F.col("meta.track_number").alias("track_number")).agg(F.max(L.seconds()).alias("length"))


_SIZED = "WITH z AS (SELECT sheet_id, meta.track_number AS track_number, CAST(max(total_frames * 75 // sample_rate) AS BIGINT) AS length FROM tracks WHERE sheet_id IS NOT NULL AND meta.track_number IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY sheet_id ORDER BY track_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_, row_number() OVER (PARTITION BY sheet_id ORDER BY track_number) AS n FROM z) "


@query(_SIZED + 'SELECT sheet_id, track_number, length, offset_ AS "offset" FROM o')
def running_offset(spark: SparkSession, d: str) -> DataFrame:
    return D.running_offsets(_sized(spark, d))


_DIGITS = "list_sum([CAST(x AS BIGINT) FOR x IN string_split(CAST((offset_ + 150) // 75 AS VARCHAR), '')])"


@query(_SIZED + f"SELECT sheet_id, count(*) AS tracks, lower(printf('%08X', CAST((sum({_DIGITS}) % 255) * 16777216 + ((sum(length) + 150) // 75 - (min(offset_) + 150) // 75) * 256 + count(*) AS BIGINT))) AS freedb_id FROM o GROUP BY 1")
def disc_id_freedb(spark: SparkSession, d: str) -> DataFrame:
    return D.identifiers(D.running_offsets(_sized(spark, d))).select("sheet_id", "tracks", "freedb_id")


@query(_SIZED + ", t AS (SELECT sheet_id, '01' || printf('%02X', count(*)) || printf('%08X', CAST(sum(length) + 150 AS BIGINT)) || string_agg(printf('%08X', offset_ + 150), '' ORDER BY n) || repeat('00000000', CAST(99 - count(*) AS INTEGER)) AS text FROM o GROUP BY 1) SELECT sheet_id, translate(replace(to_base64(unhex(sha1(text))), '=', '-'), '+/', '._') AS mb_id FROM t")
def disc_id_mb(spark: SparkSession, d: str) -> DataFrame:
    return D.identifiers(D.running_offsets(_sized(spark, d))).select("sheet_id", "mb_id")


@query(_SIZED + "SELECT sheet_id, CAST(sum(offset_) + sum(length) AS BIGINT) AS ar_id1, CAST(sum(n * greatest(offset_, 1)) + (count(*) + 1) * sum(length) AS BIGINT) AS ar_id2 FROM o GROUP BY 1")
def disc_id_ar(spark: SparkSession, d: str) -> DataFrame:
    return D.identifiers(D.running_offsets(_sized(spark, d))).select("sheet_id", "ar_id1", "ar_id2")


@query(
    "WITH h AS (SELECT DISTINCT c.sheet_id, c.track_number, a.confidence, c.crc, c.frame_offset FROM checksums c JOIN ar_db a ON a.sheet_id = c.sheet_id AND a.track_number = c.track_number AND a.crc = c.crc), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, track_number ORDER BY confidence DESC NULLS LAST, abs(frame_offset), frame_offset, crc DESC) AS k FROM h), z AS (SELECT sheet_id, track_number, max(CASE WHEN frame_offset = 0 THEN crc END) AS crc0 FROM checksums GROUP BY 1, 2) "
    "SELECT z.sheet_id, z.track_number, b.confidence, coalesce(b.crc, z.crc0) AS crc, coalesce(b.frame_offset, 0) AS frame_offset FROM z LEFT JOIN b ON b.sheet_id = z.sheet_id AND b.track_number = z.track_number AND b.k = 1"
)
def crc_match(spark: SparkSession, d: str) -> DataFrame:
    return D.best_offsets(table(spark, d, "checksums"), table(spark, d, "ar_db"))


@query("SELECT s.sheet_id, s.track_number, CAST(count(a.crc) AS BIGINT) AS known, coalesce(max(a.confidence), 0) AS surest FROM sheet_track s LEFT JOIN (SELECT DISTINCT * FROM ar_db) a USING (sheet_id, track_number) GROUP BY 1, 2")
def known_checksums(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "ar_db").distinct()
    both = table(spark, d, "sheet_track").select("sheet_id", "track_number").join(known, ["sheet_id", "track_number"], "left")
    return both.groupBy("sheet_id", "track_number").agg(F.count("crc").alias("known"), F.coalesce(F.max("confidence"), F.lit(0)).alias("surest"))


_STAMP = "lpad(CAST(offset_cdframes // 4500 AS VARCHAR), 2, '0') || ':' || lpad(CAST(offset_cdframes // 75 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(offset_cdframes % 75 AS VARCHAR), 2, '0')"


@query(f"SELECT sheet_id, track_number, index_number, {_STAMP} AS stamp, offset_cdframes AS back FROM sheet_index WHERE offset_cdframes < 450000")
def cue_stamps(spark: SparkSession, d: str) -> DataFrame:
    made = index(spark, d).filter("offset_cdframes < 450000").withColumn("stamp", D.timestamp(F.col("offset_cdframes")))
    return made.select("sheet_id", "track_number", "index_number", "stamp", D.frames_of(F.col("stamp")).alias("back"))


def _cues(spark: SparkSession, d: str) -> DataFrame:
    return D.cue_lines(table(spark, d, "sheet_track"), index(spark, d))


_MARKS = f"SELECT sheet_id, track_number, min(file_name) AS file_name, string_agg('    INDEX ' || lpad(CAST(index_number AS VARCHAR), 2, '0') || ' ' || {_STAMP}, chr(10) ORDER BY index_number) AS marks FROM sheet_index GROUP BY 1, 2"
_ESC = "replace(replace({}, '\\', '\\\\'), '\"', '\\\"')"


@query(
    f"WITH m AS ({_MARKS}), t AS (SELECT s.sheet_id, s.track_number, m.file_name, concat_ws(chr(10), '  TRACK ' || lpad(CAST(s.track_number AS VARCHAR), 2, '0') || CASE WHEN s.is_audio THEN ' AUDIO' ELSE ' MODE1/2352' END, '    TITLE \"' || {_ESC.format('s.title')} || '\"', '    PERFORMER \"' || {_ESC.format('s.performer')} || '\"', '    ISRC ' || s.isrc, m.marks) AS text FROM sheet_track s JOIN m USING (sheet_id, track_number)) "
    f"SELECT sheet_id, 'FILE \"' || {_ESC.format('min(file_name)')} || '\" WAVE' || chr(10) || string_agg(text, chr(10) ORDER BY track_number) AS cue FROM t GROUP BY 1"
)
def cue_write(spark: SparkSession, d: str) -> DataFrame:
    return _cues(spark, d)


@query("SELECT i.sheet_id, i.track_number, i.index_number, i.offset_cdframes FROM sheet_index i JOIN sheet_track s USING (sheet_id, track_number)")
def cue_parse(spark: SparkSession, d: str) -> DataFrame:
    """The layouts read back from the cue sheets that cue_write writes."""
    return D.parse_cue(_cues(spark, d))


@query(
    _STARTS + "SELECT a.sheet_id, a.track_number, count(*) AS marks, min(i.offset_cdframes) AS first_mark FROM (SELECT sheet_id, track_number, start, lead(start) OVER (PARTITION BY sheet_id ORDER BY track_number) AS stop FROM p) a "
    "JOIN sheet_index i ON i.sheet_id = a.sheet_id AND i.offset_cdframes >= a.start AND (a.stop IS NULL OR i.offset_cdframes < a.stop) GROUP BY 1, 2"
)
def interval_slice(spark: SparkSession, d: str) -> DataFrame:
    """The marks that lie within each track; tracks and marks meet by disc, of which there are few of each."""
    spans = D.starts(index(spark, d)).withColumn("stop", F.lead("start").over(Window.partitionBy("sheet_id").orderBy("track_number"))).select("sheet_id", "track_number", "start", "stop")
    marks = index(spark, d).select("sheet_id", "offset_cdframes")
    inside = (F.col("offset_cdframes") >= F.col("start")) & (F.col("stop").isNull() | (F.col("offset_cdframes") < F.col("stop")))
    return spans.join(marks, "sheet_id").filter(inside).groupBy("sheet_id", "track_number").agg(F.count("*").alias("marks"), F.min("offset_cdframes").alias("first_mark"))


@query(_STARTS + "SELECT sheet_id, upper(to_hex(count(*))) || '+' || string_agg(upper(to_hex(start + 150)), '+' ORDER BY track_number) AS toc FROM p WHERE start IS NOT NULL GROUP BY 1")
def cdtoc(spark: SparkSession, d: str) -> DataFrame:
    rows = D.starts(index(spark, d)).filter("start is not null").select("sheet_id", F.struct("track_number", (F.col("start") + D.LEAD_IN).alias("o")).alias("x"))
    text = F.concat_ws("+", F.transform(F.array_sort(F.collect_list("x")), lambda x: F.hex(x["o"])))
    return rows.groupBy("sheet_id").agg(F.concat(F.hex(F.count("*")), F.lit("+"), text).alias("toc"))


@query("SELECT sheet_id, CAST(count(*) FILTER (pre_emphasis) AS BIGINT) AS emphasised, CAST(count(*) FILTER (copy_permitted) AS BIGINT) AS copyable, CAST(count(isrc) AS BIGINT) AS with_isrc FROM sheet_track GROUP BY 1")
def track_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sheet_track").groupBy("sheet_id").agg(F.count_if("pre_emphasis").alias("emphasised"), F.count_if("copy_permitted").alias("copyable"), F.count("isrc").alias("with_isrc"))
