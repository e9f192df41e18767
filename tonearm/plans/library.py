"""Queries of the library operators over tracks and tag_dumps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import library as L
from tonearm.plans.registry import Registry
from tonearm.shared import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

TAGS = ("track_name", "album_name", "artist_name", "performer_name", "composer_name", "publisher", "year", "comment")


def tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tracks")


_CD = "CAST(total_frames AS HUGEINT) * 75 // sample_rate"


@query(f"SELECT file_format, is_total, n, frames, bytes FROM (SELECT file_format, grouping(file_format) = 1 AS is_total, count(*) AS n, CAST(sum({_CD}) AS BIGINT) AS frames, CAST(sum(file_size) AS BIGINT) AS bytes FROM tracks GROUP BY ROLLUP (file_format))")
def length_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.summary(tracks(spark, d), "file_format", frames=L.seconds(), bytes=F.col("file_size"))


@query("SELECT file_format, grouping(file_format) = 1 AS is_total, count(*) AS n, CAST(count(*) FILTER (total_frames > 0 AND file_size > 0) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT coalesce(total_frames > 0 AND file_size > 0, FALSE)) AS BIGINT) AS failed FROM tracks GROUP BY ROLLUP (file_format)")
def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce((F.col("total_frames") > 0) & (F.col("file_size") > 0), F.lit(False)).cast("int")
    return L.summary(tracks(spark, d), "file_format", ok=ok, failed=1 - ok)


@query("SELECT coalesce(meta.album_number, -2147483648) AS album_number, coalesce(meta.album_name, '') AS album_name, count(*) AS n, string_agg(CAST(track_id AS VARCHAR), ' ' ORDER BY path, track_id) AS track_ids FROM tracks GROUP BY 1, 2")
def album_group(spark: SparkSession, d: str) -> DataFrame:
    """Albums by number and name; the tracks of each in order of their paths."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("path", "track_id"))), lambda x: x["track_id"].cast("string"))
    return tracks(spark, d).groupBy(L.number("meta.album_number").alias("album_number"), L.name("meta.album_name").alias("album_name")).agg(F.count("*").alias("n"), F.concat_ws(" ", ids).alias("track_ids"))


@query("SELECT track_id, path FROM tracks ORDER BY coalesce(meta.album_number, -2147483648) DESC, coalesce(meta.track_number, -2147483648) DESC, path DESC, track_id LIMIT 100")
def track_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    order = [L.number("meta.album_number").desc(), L.number("meta.track_number").desc(), F.desc("path"), F.asc("track_id")]
    return tracks(spark, d).orderBy(*order).limit(100).select("track_id", "path")


@query("WITH c AS (SELECT sheet_id, sample_rate, count(*) AS c, min(track_id) AS f FROM tracks WHERE sheet_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY c DESC, f DESC) AS k, count(*) OVER (PARTITION BY sheet_id) AS kinds FROM c) SELECT sheet_id, CASE WHEN c > 1 OR kinds = 1 THEN sample_rate END AS mode FROM r WHERE k = 1")
def mode_rate(spark: SparkSession, d: str) -> DataFrame:
    return L.most_numerous(tracks(spark, d).filter("sheet_id is not null"), "sheet_id", "sample_rate", "track_id")


_SIDES = """WITH t AS (SELECT DISTINCT track_id, bits_per_sample AS b, channels AS c, sample_rate AS r, total_frames AS f, meta.track_number AS n, meta.album_number AS a FROM tracks),
l AS (SELECT * FROM t WHERE track_id % 2 = 0), q AS (SELECT * FROM t WHERE track_id % 2 = 1),
p1 AS (SELECT x.track_id AS left_row, y.track_id AS right_row FROM (SELECT *, count(*) OVER (PARTITION BY b, c, r, f) AS k FROM l) x JOIN (SELECT *, count(*) OVER (PARTITION BY b, c, r, f) AS k FROM q) y ON x.k = 1 AND y.k = 1 AND x.b IS NOT DISTINCT FROM y.b AND x.c IS NOT DISTINCT FROM y.c AND x.r IS NOT DISTINCT FROM y.r AND x.f IS NOT DISTINCT FROM y.f),
l2 AS (SELECT *, count(*) OVER (PARTITION BY n, a) AS k FROM l WHERE track_id NOT IN (SELECT left_row FROM p1)), q2 AS (SELECT *, count(*) OVER (PARTITION BY n, a) AS k FROM q WHERE track_id NOT IN (SELECT right_row FROM p1)),
p2 AS (SELECT x.track_id AS left_row, y.track_id AS right_row FROM l2 x JOIN q2 y ON x.k = 1 AND y.k = 1 AND x.n IS NOT DISTINCT FROM y.n AND x.a IS NOT DISTINCT FROM y.a),
every AS (SELECT left_row, right_row, 1 AS stage FROM p1 UNION ALL SELECT left_row, right_row, 2 FROM p2 UNION ALL SELECT track_id, NULL, 3 FROM l2 WHERE track_id NOT IN (SELECT left_row FROM p2) UNION ALL SELECT NULL, track_id, 3 FROM q2 WHERE track_id NOT IN (SELECT right_row FROM p2))
"""


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Two folders, of even and of odd track_ids, matched by what is in the files and then by their numbers."""
    every = tracks(spark, d).select("track_id", "bits_per_sample", "channels", "sample_rate", "total_frames", F.col("meta.track_number").alias("track_number"), F.col("meta.album_number").alias("album_number")).distinct()
    left, right = every.filter("track_id % 2 = 0"), every.filter("track_id % 2 = 1")
    return L.reconcile(left, right, ["bits_per_sample", "channels", "sample_rate", "total_frames"], ["track_number", "album_number"], "track_id")


@query(_SIDES + "SELECT left_row, right_row, stage FROM every WHERE stage = 1")
def reconcile_unique(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).filter("stage = 1")


@query(_SIDES + "SELECT left_row, right_row, stage FROM every WHERE stage = 2")
def reconcile_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).filter("stage = 2")


@query(_SIDES + "SELECT left_row, right_row, stage FROM every WHERE stage = 3")
def reconcile_missing(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).filter("stage = 3")


@query(_SIDES + "SELECT CAST(count(*) FILTER (stage < 3) AS BIGINT) AS matched, CAST(count(*) FILTER (stage = 3) AS BIGINT) AS missing, count(*) AS total FROM every")
def reconcile_summary(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).agg(F.count_if(F.col("stage") < 3).alias("matched"), F.count_if(F.col("stage") == 3).alias("missing"), F.count("*").alias("total"))


@query("SELECT DISTINCT t.track_id, coalesce(t.meta.track_name, s.title) AS title, coalesce(t.meta.performer_name, s.performer) AS performer, coalesce(t.meta.isrc, s.isrc) AS isrc FROM tracks t LEFT JOIN sheet_track s ON t.sheet_id = s.sheet_id AND t.meta.track_number = s.track_number")
def tag_left_merge(spark: SparkSession, d: str) -> DataFrame:
    """A track's own fields, and the sheet's where they are missing."""
    own = tracks(spark, d).select("track_id", "sheet_id", F.col("meta.track_number").alias("track_number"), F.col("meta.track_name").alias("t"), F.col("meta.performer_name").alias("p"), F.col("meta.isrc").alias("i"))
    sheet = table(spark, d, "sheet_track").select("sheet_id", "track_number", "title", "performer", F.col("isrc").alias("si"))
    both = own.join(sheet, ["sheet_id", "track_number"], "left")
    return both.select("track_id", L.merged(F.col("title"), F.col("t")).alias("title"), L.merged(F.col("performer"), F.col("p")).alias("performer"), L.merged(F.col("si"), F.col("i")).alias("isrc")).distinct()


@query("SELECT DISTINCT t.track_id, coalesce(s.title, t.meta.track_name) AS title, s.title IS NOT NULL AND s.title IS DISTINCT FROM t.meta.track_name AS changed FROM tracks t LEFT JOIN sheet_track s ON t.sheet_id = s.sheet_id AND t.meta.track_number = s.track_number")
def tag_overwrite_merge(spark: SparkSession, d: str) -> DataFrame:
    own = tracks(spark, d).select("track_id", "sheet_id", F.col("meta.track_number").alias("track_number"), F.col("meta.track_name").alias("t"))
    both = own.join(table(spark, d, "sheet_track").select("sheet_id", "track_number", "title"), ["sheet_id", "track_number"], "left")
    changed = F.col("title").isNotNull() & ~F.col("title").eqNullSafe(F.col("t"))
    return both.select("track_id", L.merged(F.col("t"), F.col("title")).alias("title"), changed.alias("changed")).distinct()


_AGREE = ", ".join(f"CASE WHEN count(meta.{f}) = count(*) AND min(meta.{f}) = max(meta.{f}) THEN min(meta.{f}) END AS {f}" for f in TAGS)


@query(f"SELECT sheet_id, count(*) AS n, {_AGREE} FROM tracks WHERE sheet_id IS NOT NULL GROUP BY 1")
def tag_intersection(spark: SparkSession, d: str) -> DataFrame:
    return L.agreed(tracks(spark, d).filter("sheet_id is not null"), "sheet_id", [f"meta.{f}" for f in TAGS])


_FILLED = " UNION ALL ".join(f"SELECT '{f}' AS field_name, tag_source, CAST(count(meta.{f}) AS BIGINT) AS filled, CAST(count(*) - count(meta.{f}) AS BIGINT) AS empty FROM tracks WHERE meta IS NOT NULL GROUP BY 2" for f in TAGS)


@query(_FILLED)
def metadata_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each field is filled, by tag source: one pass, fields unpivoted."""
    flat = tracks(spark, d).filter("meta is not null").select("tag_source", *[F.col(f"meta.{f}").cast("string").alias(f) for f in TAGS])
    long = flat.unpivot(["tag_source"], list(TAGS), "field_name", "value")
    return long.groupBy("field_name", "tag_source").agg(F.count("value").alias("filled"), (F.count("*") - F.count("value")).alias("empty"))


@query("SELECT i.type AS image_type, i.mime_type AS mime_type, count(*) AS n, max(i.width * i.height) AS largest FROM (SELECT unnest(images) AS i FROM tracks) GROUP BY 1, 2")
def image_filters(spark: SparkSession, d: str) -> DataFrame:
    each = tracks(spark, d).select(F.explode("images").alias("i"))
    return each.groupBy(F.col("i.type").alias("image_type"), F.col("i.mime_type").alias("mime_type")).agg(F.count("*").alias("n"), F.max(F.col("i.width") * F.col("i.height")).alias("largest"))


@query("SELECT track_id, loaded_at, len(list_filter(images, lambda i: i.type = 0)) AS front, len(list_filter(images, lambda i: i.type <> 0)) AS others FROM tracks WHERE images IS NOT NULL")
def front_covers(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter("images", lambda i: i["type"] == 0)
    return tracks(spark, d).filter("images is not null").select("track_id", "loaded_at", F.size(kept).cast("bigint").alias("front"), F.size(F.filter("images", lambda i: i["type"] != 0)).cast("bigint").alias("others"))


@query("SELECT sheet_id, bool_and(channels = 2 AND sample_rate = 44100 AND bits_per_sample = 16) AS is_cd FROM tracks WHERE sheet_id IS NOT NULL GROUP BY 1")
def cd_predicate(spark: SparkSession, d: str) -> DataFrame:
    fits = (F.col("channels") == 2) & (F.col("sample_rate") == 44100) & (F.col("bits_per_sample") == 16)
    return tracks(spark, d).filter("sheet_id is not null").groupBy("sheet_id").agg(F.every(fits).alias("is_cd"))


@query("SELECT lossless, file_format IN ('wav', 'aiff', 'au', 'flac', 'alac', 'wv', 'ape', 'tta') AS can_be, count(*) AS n FROM tracks GROUP BY 1, 2")
def lossless_formats(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).groupBy("lossless", F.col("file_format").isin(*sorted(L.LOSSLESS)).alias("can_be")).agg(F.count("*").alias("n"))


@query("SELECT path, min(track_id) AS track_id, count(*) AS deliveries FROM tracks GROUP BY 1")
def dedupe_paths(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).groupBy("path").agg(F.min("track_id").alias("track_id"), F.count("*").alias("deliveries"))


_FILE = "CASE WHEN meta.album_number IS NOT NULL THEN CAST(meta.album_number AS VARCHAR) ELSE '' END || lpad(CAST(coalesce(meta.track_number, 0) AS VARCHAR), 2, '0') || ' - ' || replace(coalesce(meta.track_name, ''), '/', '-') || '.' || file_format"


def _named(spark: SparkSession, d: str) -> DataFrame:
    made = L.file_name(F.col("meta.track_number"), F.col("meta.album_number"), F.col("meta.track_name"), F.col("file_format"))
    return tracks(spark, d).select("track_id", made.alias("file_name")).distinct()


@query(f"SELECT DISTINCT track_id, {_FILE} AS file_name FROM tracks")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d)


@query(f"SELECT file_name, count(*) AS n FROM (SELECT DISTINCT track_id, {_FILE} AS file_name FROM tracks) GROUP BY 1 HAVING count(*) > 1")
def duplicate_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).groupBy("file_name").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT suffix, count(*) AS n, suffix = 'm4a' AS ambiguous FROM (SELECT regexp_extract(path, '\\.([^./]+)$', 1) AS suffix FROM tracks) GROUP BY 1")
def suffix_types(spark: SparkSession, d: str) -> DataFrame:
    known = F.broadcast(spark.createDataFrame([(s, t) for s, ts in L.SUFFIXES.items() for t in ts], "suffix string, of string").groupBy("suffix").agg(F.count("*").alias("types")))
    rows = tracks(spark, d).select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))
    return rows.join(known, "suffix", "left").select("suffix", "n", F.coalesce(F.col("types") > 1, F.lit(False)).alias("ambiguous"))


@query("SELECT sheet_id, count(replay_gain.track_gain) = count(*) AS reuse, count(*) AS n, max(replay_gain.album_peak) AS album_peak FROM tracks WHERE sheet_id IS NOT NULL GROUP BY 1")
def gain_reuse(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).filter("sheet_id is not null").groupBy("sheet_id")
    return rows.agg((F.count("replay_gain.track_gain") == F.count("*")).alias("reuse"), F.count("*").alias("n"), F.max("replay_gain.album_peak").alias("album_peak"))


@query("SELECT DISTINCT track_id, round(pow(10::DOUBLE, replay_gain.track_gain / 20), 6) AS factor, round(least(pow(10::DOUBLE, replay_gain.track_gain / 20), 1 / nullif(replay_gain.track_peak, 0)), 6) AS safe FROM tracks WHERE replay_gain.track_gain IS NOT NULL AND replay_gain.track_peak > 0")
def gain_factors(spark: SparkSession, d: str) -> DataFrame:
    factor = F.pow(F.lit(10.0), F.col("replay_gain.track_gain") / 20)
    rows = tracks(spark, d).filter("replay_gain.track_gain is not null and replay_gain.track_peak > 0")
    return rows.select("track_id", F.round(factor, 6).alias("factor"), F.round(F.least(factor, 1 / F.col("replay_gain.track_peak")), 6).alias("safe")).distinct()


@query("SELECT DISTINCT track_id, CASE WHEN total_frames >= sample_rate THEN file_size * 8 // 1024 // (total_frames // sample_rate) ELSE 0 END AS kbps, CASE WHEN total_frames * channels * bits_per_sample > 0 THEN round(file_size / (total_frames * channels * bits_per_sample / 8.0::DOUBLE), 6) ELSE 0 END AS ratio FROM tracks")
def bitrate_ratio(spark: SparkSession, d: str) -> DataFrame:
    rate = F.when(F.col("total_frames") >= F.col("sample_rate"), F.expr("file_size * 8 div 1024 div (total_frames div sample_rate)")).otherwise(0)
    raw = F.col("total_frames") * F.col("channels") * F.col("bits_per_sample")
    return tracks(spark, d).select("track_id", rate.alias("kbps"), F.when(raw > 0, F.round(F.col("file_size") / (raw / 8.0), 6)).otherwise(0).alias("ratio")).distinct()


@query("SELECT sample_rate, CAST(sample_rate // 1000 AS VARCHAR) || CASE WHEN sample_rate // 100 % 10 > 0 THEN '.' || CAST(sample_rate // 100 % 10 AS VARCHAR) ELSE '' END || 'kHz' AS shown, count(*) AS n FROM tracks GROUP BY 1, 2")
def khz_display(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).groupBy("sample_rate", L.khz(F.col("sample_rate")).alias("shown")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT track_id, CASE WHEN file_size IS NULL THEN NULL WHEN file_size < 1024 THEN CAST(file_size AS VARCHAR) WHEN file_size < 1048576 THEN printf('%.1fK', floor(file_size * 10 / 1024.0) / 10) WHEN file_size < 1073741824 THEN printf('%.1fM', floor(file_size * 10 / 1048576.0) / 10) ELSE printf('%.1fG', floor(file_size * 10 / 1073741824.0) / 10) END AS size, CAST(total_frames // sample_rate // 3600 AS VARCHAR) || ':' || lpad(CAST(total_frames // sample_rate // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(total_frames // sample_rate % 60 AS VARCHAR), 2, '0') AS length FROM tracks")
def display_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).select("track_id", L.size_units(F.col("file_size")).alias("size"), L.clock(F.expr("total_frames div sample_rate")).alias("length")).distinct()


@query("SELECT DISTINCT track_id, nullif(regexp_replace(meta.track_name, '^\\s+|\\s+$', '', 'g'), '') AS track_name, nullif(regexp_replace(meta.year, '^\\s+|\\s+$', '', 'g'), '') AS year, meta.track_name IS DISTINCT FROM nullif(regexp_replace(meta.track_name, '^\\s+|\\s+$', '', 'g'), '') AS fixed FROM tracks WHERE meta IS NOT NULL")
def tag_clean(spark: SparkSession, d: str) -> DataFrame:
    clean = L.cleaned(F.col("meta.track_name"))
    return tracks(spark, d).filter("meta is not null").select("track_id", clean.alias("track_name"), L.cleaned(F.col("meta.year")).alias("year"), (~F.col("meta.track_name").eqNullSafe(clean)).alias("fixed")).distinct()


@query("SELECT regexp_extract(meta.year, '(\\d{4})', 1) AS year4, count(*) AS n FROM tracks WHERE meta.year IS NOT NULL GROUP BY 1")
def year_of_text(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).filter("meta.year is not null").groupBy(F.regexp_extract("meta.year", r"(\d{4})", 1).alias("year4")).agg(F.count("*").alias("n"))


_TRCK = "json_extract_string(payload, '$.\"TRCK\"')"


@query(f"SELECT DISTINCT feed_id, batch_no, track_ref, CASE WHEN regexp_full_match(split_part({_TRCK}, '/', 1), '\\s*\\d{{1,9}}\\s*') THEN CAST(trim(split_part({_TRCK}, '/', 1)) AS INTEGER) END AS number, CASE WHEN regexp_full_match(split_part({_TRCK}, '/', 2), '\\s*\\d{{1,9}}\\s*') THEN CAST(trim(split_part({_TRCK}, '/', 2)) AS INTEGER) END AS total FROM tag_dumps WHERE {_TRCK} IS NOT NULL")
def number_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tag_dumps").select("feed_id", "batch_no", "track_ref", F.get_json_object("payload", "$.TRCK").alias("t")).filter("t is not null")
    a, b = L.number_pair(F.col("t"))
    return rows.select("feed_id", "batch_no", "track_ref", a.alias("number"), b.alias("total")).distinct()


@query("SELECT frame_id, count(*) AS records FROM (SELECT unnest(json_keys(payload)) AS frame_id FROM tag_dumps) GROUP BY 1")
def frame_use(spark: SparkSession, d: str) -> DataFrame:
    keys = F.explode(F.map_keys(F.from_json("payload", "map<string,string>"))).alias("frame_id")
    return table(spark, d, "tag_dumps").select(keys).groupBy("frame_id").agg(F.count("*").alias("records"))


@query("SELECT channels, channel_mask, CAST(bit_count(channel_mask) AS INTEGER) AS in_mask, CASE WHEN channel_mask = 0 THEN CASE channels WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 51 WHEN 5 THEN 55 WHEN 6 THEN 63 END ELSE channel_mask END AS mask, count(*) AS n FROM tracks GROUP BY 1, 2")
def channel_masks(spark: SparkSession, d: str) -> DataFrame:
    usual = F.create_map(*[F.lit(x) for kv in L.MASKS.items() for x in kv])
    rows = tracks(spark, d).groupBy("channels", "channel_mask").agg(F.count("*").alias("n"))
    return rows.select("channels", "channel_mask", L.mask_channels(F.col("channel_mask")).alias("in_mask"), F.when(F.col("channel_mask") == 0, usual[F.col("channels")]).otherwise(F.col("channel_mask")).alias("mask"), "n")


@query("SELECT folder, count(*) AS n, CAST(max(length(base)) AS INTEGER) AS widest FROM (SELECT regexp_extract(path, '^(.*)/', 1) AS folder, regexp_extract(path, '([^/]*)$', 1) AS base FROM tracks) GROUP BY 1")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("base"))
    return rows.groupBy("folder").agg(F.count("*").alias("n"), F.max(F.length("base")).alias("widest"))


@query("SELECT meta.album_name AS album_name, count(*) AS n, count(DISTINCT meta.artist_name) AS artists, coalesce(bool_or(meta.compilation), FALSE) AS compilation FROM tracks WHERE meta.album_name <> '' GROUP BY 1")
def album_artists(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks(spark, d).filter("meta.album_name <> ''").groupBy(F.col("meta.album_name").alias("album_name"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("meta.artist_name").alias("artists"), F.coalesce(F.bool_or("meta.compilation"), F.lit(False)).alias("compilation"))


@query("SELECT file_format, count(*) AS n FROM tracks WHERE file_format IN ('flac', 'wav', 'alac') GROUP BY 1")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return tracks(spark, d).filter(F.col("file_format").isin("flac", "wav", "alac")).groupBy("file_format").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT max(length(file_format)) AS w FROM tracks), c AS (SELECT file_format, count(*) AS n FROM tracks GROUP BY 1) SELECT rpad(file_format, CAST(w AS INTEGER), ' ') || ' | ' || lpad(CAST(n AS VARCHAR), 8, ' ') AS line FROM c, w")
def text_table(spark: SparkSession, d: str) -> DataFrame:
    """A table for a terminal: names to the left, counts to the right."""
    counts = tracks(spark, d).groupBy("file_format").agg(F.count("*").alias("n"))
    width = counts.agg(F.max(F.length("file_format")).alias("w"))
    rows = counts.join(F.broadcast(width), F.lit(True))
    return rows.select(F.concat(F.expr("rpad(file_format, w, ' ')"), F.lit(" | "), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"))
