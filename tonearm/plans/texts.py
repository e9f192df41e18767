"""Queries of texts about discs, tags and batches of floats, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.operators import discs as D
from tonearm.operators import sheets as T
from tonearm.plans.registry import Registry
from tonearm.shared import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return D.starts(table(spark, d, "sheet_index"))


_P = "WITH p AS (SELECT sheet_id, track_number, max(CASE WHEN index_number = 1 THEN offset_cdframes END) AS start FROM sheet_index GROUP BY 1, 2) "


@query(_P + "SELECT sheet_id, CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY track_number) AS INTEGER) AS ordinal, start FROM p WHERE start IS NOT NULL")
def toc_parse(spark: SparkSession, d: str) -> DataFrame:
    """The starts read back from TOC files written for the layouts."""
    return T.parse_toc(T.toc_text(_starts(spark, d)))


@query("SELECT 'toc' AS kind, count(DISTINCT sheet_id) AS n FROM sheet_index WHERE index_number = 1 UNION ALL SELECT 'cue', count(DISTINCT sheet_id) FROM sheet_track JOIN sheet_index USING (sheet_id, track_number)")
def sheet_dispatch(spark: SparkSession, d: str) -> DataFrame:
    cues = D.cue_lines(table(spark, d, "sheet_track"), table(spark, d, "sheet_index")).select(F.col("cue").alias("text"))
    every = T.toc_text(_starts(spark, d)).select(F.col("toc").alias("text")).unionByName(cues)
    return every.groupBy(T.sheet_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT sheet_id, track_number, coalesce(title, '') AS title FROM sheet_track")
def xml_answers(spark: SparkSession, d: str) -> DataFrame:
    return T.parse_xml(T.answers_xml(table(spark, d, "sheet_track")))


@query("SELECT sheet_id, 'Artist of ' || sheet_id AS artist, 'Disc ' || sheet_id AS album, track_number, coalesce(title, '') AS title FROM sheet_track")
def xmcd_answers(spark: SparkSession, d: str) -> DataFrame:
    tracks = table(spark, d, "sheet_track")
    named = tracks.select("sheet_id").distinct().select("sheet_id", F.concat(F.lit("Artist of "), "sheet_id").alias("artist"), F.concat(F.lit("Disc "), "sheet_id").alias("album"))
    return T.parse_xmcd(T.xmcd_text(named, tracks))


@query("SELECT track_id, loaded_at, len(list_filter(images, lambda i: i.type = 0)) AS front FROM tracks WHERE len(images) > 0")
def json_images(spark: SparkSession, d: str) -> DataFrame:
    """Front covers by way of a JSON answer, as a cover archive gives."""
    kept = F.to_json(F.transform("images", lambda i: F.struct(i["type"].alias("type"), i["mime_type"].alias("mime"))))
    rows = table(spark, d, "tracks").filter("size(images) > 0").select("track_id", "loaded_at", kept.alias("answer"))
    parsed = F.from_json("answer", "array<struct<type int, mime string>>")
    return rows.select("track_id", "loaded_at", F.size(F.filter(parsed, lambda i: i["type"] == 0)).cast("bigint").alias("front"))


@query("SELECT s.sheet_id, s.track_number, count(*) OVER (PARTITION BY s.sheet_id) AS track_total, a.n IS NOT NULL AS answered FROM sheet_track s LEFT JOIN (SELECT sheet_id, count(*) AS n FROM ar_db GROUP BY 1) a USING (sheet_id)")
def lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Each disc's tracks with number and total, whether or not a look-up knew the disc."""
    known = table(spark, d, "ar_db").select("sheet_id").distinct().withColumn("hit", F.lit(True))
    rows = table(spark, d, "sheet_track").select("sheet_id", "track_number").join(known, "sheet_id", "left")
    return rows.select("sheet_id", "track_number", F.count("*").over(Window.partitionBy("sheet_id")).alias("track_total"), F.coalesce("hit", F.lit(False)).alias("answered"))


@query(_P + "SELECT sheet_id, max(start) + 9000 - sum(CASE WHEN nxt IS NOT NULL THEN nxt - start ELSE 0 END) - min(start) AS last_length FROM (SELECT *, lead(start) OVER (PARTITION BY sheet_id ORDER BY track_number) AS nxt FROM p) GROUP BY 1")
def last_track_repair(spark: SparkSession, d: str) -> DataFrame:
    """An image that ends 9,000 frames behind the last start: what the known lengths leave for the last track."""
    per = D.lengths(table(spark, d, "sheet_index")).groupBy("sheet_id")
    return per.agg((F.max("start") + 9000 - F.sum(F.coalesce("length", F.lit(0))) - F.min("start")).alias("last_length"))


@query(_P + "SELECT sheet_id, track_number, start * 588 AS sample_offset FROM p")
def layout_in_samples(spark: SparkSession, d: str) -> DataFrame:
    return _starts(spark, d).select("sheet_id", "track_number", (F.col("start") * 588).alias("sample_offset"))


@query("SELECT sheet_id, count(*) >= 2 AND count(meta.track_number) = count(*) AND count(DISTINCT meta.track_total) <= 1 AND min(meta.track_number) <= 1 AS has_pre_gap_form FROM tracks WHERE sheet_id IS NOT NULL GROUP BY 1")
def pre_gap_test(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("meta.track_number")
    fits = (F.count("*") >= 2) & (F.count(n) == F.count("*")) & (F.countDistinct("meta.track_total") <= 1) & (F.min(n) <= 1)
    return table(spark, d, "tracks").filter("sheet_id is not null").groupBy("sheet_id").agg(fits.alias("has_pre_gap_form"))


@query("SELECT sheet_id, min(sample_rate) = max(sample_rate) AND min(channels) = max(channels) AND min(bits_per_sample) = max(bits_per_sample) AND count(DISTINCT nullif(channel_mask, 0)) <= 1 AS joins FROM tracks WHERE sheet_id IS NOT NULL GROUP BY 1")
def stream_identity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the files of a disc can be joined: one format, and one mask besides the unknown one."""
    one = lambda c: F.min(c) == F.max(c)
    masks = F.countDistinct(F.when(F.col("channel_mask") != 0, F.col("channel_mask"))) <= 1
    return table(spark, d, "tracks").filter("sheet_id is not null").groupBy("sheet_id").agg((one("sample_rate") & one("channels") & one("bits_per_sample") & masks).alias("joins"))


@query("WITH a AS (SELECT sheet_id, track_id, row_number() OVER (PARTITION BY sheet_id ORDER BY path, track_id) AS k FROM (SELECT DISTINCT sheet_id, track_id, path FROM tracks WHERE sheet_id IS NOT NULL)), b AS (SELECT sheet_id, track_number, row_number() OVER (PARTITION BY sheet_id ORDER BY track_number) AS k FROM sheet_track) SELECT a.sheet_id, a.track_id, b.track_number FROM a JOIN b ON a.sheet_id = b.sheet_id AND a.k = b.k")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    """Files and tracks of a disc one by one, in the order of paths and numbers."""
    files = table(spark, d, "tracks").filter("sheet_id is not null").select("sheet_id", "track_id", "path").distinct().withColumn("k", F.row_number().over(Window.partitionBy("sheet_id").orderBy("path", "track_id")))
    tracks = table(spark, d, "sheet_track").withColumn("k", F.row_number().over(Window.partitionBy("sheet_id").orderBy("track_number"))).select("sheet_id", "track_number", "k")
    return files.join(tracks, ["sheet_id", "k"]).select("sheet_id", "track_id", "track_number")


@query("SELECT meta.album_name AS album_name, meta.track_number AS track_number, coalesce(max(CASE WHEN tag_source = 'id3v2_3' THEN meta.track_name END), max(CASE WHEN tag_source = 'id3v1' THEN meta.track_name END)) AS track_name FROM tracks WHERE meta.album_name <> '' AND meta.track_number IS NOT NULL GROUP BY 1, 2")
def precedence_merge(spark: SparkSession, d: str) -> DataFrame:
    """The later kind of tag before the older one."""
    of = lambda s: F.max(F.when(F.col("tag_source") == s, F.col("meta.track_name")))
    rows = table(spark, d, "tracks").filter("meta.album_name <> '' and meta.track_number is not null")
    return rows.groupBy(F.col("meta.album_name").alias("album_name"), F.col("meta.track_number").alias("track_number")).agg(F.coalesce(of("id3v2_3"), of("id3v1")).alias("track_name"))


_FIELD_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in T.FRAME_FIELDS.items())


@query(f"SELECT feed_id, field_name, count(*) AS n FROM (SELECT feed_id, unnest(json_keys(payload)) AS frame_id FROM tag_dumps) JOIN (VALUES {_FIELD_ROWS}) m(frame_id, field_name) USING (frame_id) GROUP BY 1, 2")
def frame_fields(spark: SparkSession, d: str) -> DataFrame:
    """How often each feed fills each field of a track, by the frames that hold it."""
    known = F.broadcast(spark.createDataFrame(list(T.FRAME_FIELDS.items()), "frame_id string, field_name string"))
    rows = table(spark, d, "tag_dumps").select("feed_id", F.explode(F.map_keys(F.from_json("payload", "map<string,string>"))).alias("frame_id"))
    return rows.join(known, "frame_id").groupBy("feed_id", "field_name").agg(F.count("*").alias("n"))


@query("SELECT feed_id, batch_no, track_ref, len(k) AS frames, len(list_distinct([lower(x) FOR x IN k])) AS distinct_frames FROM (SELECT DISTINCT feed_id, batch_no, track_ref, payload, json_keys(payload) AS k FROM tag_dumps)")
def duplicate_frames(spark: SparkSession, d: str) -> DataFrame:
    keys = F.map_keys(F.from_json("payload", "map<string,string>"))
    rows = table(spark, d, "tag_dumps").select("feed_id", "batch_no", "track_ref", "payload").distinct().withColumn("k", keys)
    return rows.select("feed_id", "batch_no", "track_ref", F.size("k").cast("bigint").alias("frames"), F.size(F.array_distinct(F.transform("k", F.lower))).cast("bigint").alias("distinct_frames"))


@query("SELECT DISTINCT track_id, printf('%.2f', replay_gain.track_gain) || ' dB' AS tag, round(replay_gain.track_gain, 2) AS back FROM tracks WHERE replay_gain.track_gain IS NOT NULL")
def gain_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tracks").filter("replay_gain.track_gain is not null").select("track_id", T.gain_text(F.col("replay_gain.track_gain")).alias("tag")).distinct()
    return rows.withColumn("back", T.gain_of(F.col("tag")))


@query("SELECT DISTINCT track_id, CAST(round((64.82::DOUBLE - replay_gain.track_gain) * 256) AS BIGINT) AS stored, round(64.82::DOUBLE - CAST(round((64.82::DOUBLE - replay_gain.track_gain) * 256) AS BIGINT) / 256.0::DOUBLE, 6) AS back FROM tracks WHERE replay_gain.track_gain IS NOT NULL")
def gain_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    """A gain in 256ths below a reference level, and back."""
    stored = F.round((F.lit(64.82) - F.col("replay_gain.track_gain")) * 256).cast("bigint")
    rows = table(spark, d, "tracks").filter("replay_gain.track_gain is not null").select("track_id", stored.alias("stored")).distinct()
    return rows.withColumn("back", F.round(F.lit(64.82) - F.col("stored") / 256.0, 6))


_SS = "((file_size % 268435456) & 127) + ((((file_size % 268435456) >> 7) & 127) << 8) + ((((file_size % 268435456) >> 14) & 127) << 16) + ((((file_size % 268435456) >> 21) & 127) << 24)"


@query(f"SELECT DISTINCT track_id, {_SS} AS packed, file_size % 268435456 AS back FROM tracks WHERE file_size IS NOT NULL")
def sync_safe_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tracks").filter("file_size is not null").select("track_id", T.sync_safe(F.col("file_size") % (1 << 28)).alias("packed")).distinct()
    return rows.withColumn("back", T.from_sync_safe(F.col("packed")))


@query("SELECT DISTINCT track_id, meta.track_name AS back, CAST(length(meta.track_name) AS INTEGER) AS chars FROM tracks WHERE meta.track_name IS NOT NULL")
def text_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Names to UTF-16 bytes and back."""
    rows = table(spark, d, "tracks").filter("meta.track_name is not null").select("track_id", F.encode("meta.track_name", "UTF-16BE").alias("raw")).distinct()
    back = F.decode("raw", "UTF-16BE")
    return rows.select("track_id", back.alias("back"), F.length(back).alias("chars"))


@query("SELECT field_name, count(*) AS n, CAST(count(*) FILTER ((length(v) - length(replace(v, chr(65533), ''))) * 100 >= 10 * length(v)) AS BIGINT) AS rejected FROM (SELECT 'comment' AS field_name, meta.comment AS v FROM tracks WHERE meta.comment <> '' UNION ALL SELECT 'track_name', meta.track_name FROM tracks WHERE meta.track_name <> '') GROUP BY 1")
def text_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Texts of which a tenth or more are replacement characters."""
    long = table(spark, d, "tracks").select(F.col("meta.comment").alias("comment"), F.col("meta.track_name").alias("track_name")).unpivot([], ["comment", "track_name"], "field_name", "v").filter("v <> ''")
    lost = F.length("v") - F.length(F.replace("v", F.lit("�"), F.lit("")))
    return long.groupBy("field_name").agg(F.count("*").alias("n"), F.count_if(lost * 100 >= F.length("v") * 10).alias("rejected"))


@query("SELECT track_id, path FROM (SELECT DISTINCT track_id, path FROM tracks) ORDER BY md5('7:' || CAST(track_id AS VARCHAR)), track_id LIMIT 50")
def shuffled_play(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 files of a random order that can be had again: by a hash with a seed."""
    rows = table(spark, d, "tracks").select("track_id", "path").distinct()
    return rows.orderBy(F.md5(F.concat(F.lit("7:"), F.col("track_id").cast("string"))), "track_id").limit(50)


@query("SELECT DISTINCT meta.artist_name AS artist_name FROM tracks WHERE tag_source = 'id3v1' AND meta.artist_name IS NOT NULL INTERSECT SELECT meta.artist_name FROM tracks WHERE tag_source = 'vorbis'")
def shared_artists(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: table(spark, d, "tracks").filter((F.col("tag_source") == s) & F.col("meta.artist_name").isNotNull()).select(F.col("meta.artist_name").alias("artist_name"))
    return of("id3v1").intersect(of("vorbis"))


@query("SELECT DISTINCT meta.artist_name AS artist_name FROM tracks WHERE tag_source = 'id3v1' AND meta.artist_name IS NOT NULL EXCEPT SELECT meta.artist_name FROM tracks WHERE tag_source = 'vorbis'")
def missing_artists(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: table(spark, d, "tracks").filter((F.col("tag_source") == s) & F.col("meta.artist_name").isNotNull()).select(F.col("meta.artist_name").alias("artist_name"))
    return of("id3v1").subtract(of("vorbis"))


@query("SELECT vec_id, round(list_sum(embedding[1:20]), 4) AS head, round(list_sum(embedding[21:64]), 4) AS tail, CAST(len(embedding) * 2 AS BIGINT) AS doubled, embedding[1:20] || embedding[21:64] = embedding AS whole FROM embeddings")
def float_batches(spark: SparkSession, d: str) -> DataFrame:
    """A batch of floats split in two, put together and repeated."""
    head, tail = F.slice("embedding", 1, 20), F.slice("embedding", 21, 44)
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 4)
    return table(spark, d, "embeddings").select("vec_id", total(head).alias("head"), total(tail).alias("tail"), F.size(F.flatten(F.array_repeat("embedding", 2))).cast("bigint").alias("doubled"), (F.concat(head, tail) == F.col("embedding")).alias("whole"))


@query("SELECT v.vec_id, CAST(i // 2 AS BIGINT) AS frame_idx, CAST(i % 2 AS BIGINT) AS channel, v.embedding[i + 1] AS value FROM embeddings v, (SELECT unnest(range(64)) AS i)")
def float_frames(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 64 floats as 32 frames of two channels."""
    each = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "value"))
    return each.select("vec_id", F.expr("cast(i div 2 as bigint)").alias("frame_idx"), (F.col("i") % 2).cast("bigint").alias("channel"), "value")


@query(
    "SELECT DISTINCT track_id, concat_ws(' ', CASE WHEN channels = 2 THEN NULL WHEN channels = 1 THEN 'duplicate' ELSE 'downmix' END, CASE WHEN sample_rate <> 44100 THEN 'resample' END, CASE WHEN bits_per_sample < 16 THEN 'widen' WHEN bits_per_sample > 16 THEN 'narrow' END) AS steps, CAST(CAST(total_frames AS HUGEINT) * 44100 // sample_rate AS BIGINT) AS frames FROM tracks"
)
def conversion_plan(spark: SparkSession, d: str) -> DataFrame:
    """The steps from a file to two channels at 44,100 frames of 16 bits: channels, then rate, then bits."""
    channels = F.when(F.col("channels") == 1, "duplicate").when(F.col("channels") > 2, "downmix")
    bits = F.when(F.col("bits_per_sample") < 16, "widen").when(F.col("bits_per_sample") > 16, "narrow")
    steps = F.concat_ws(" ", channels, F.when(F.col("sample_rate") != 44100, "resample"), bits)
    return table(spark, d, "tracks").select("track_id", steps.alias("steps"), F.expr("total_frames * 44100 div sample_rate").alias("frames")).distinct()


@query("SELECT track_id, loaded_at, len(images) + 1 AS added, len(list_filter(images, lambda i: i.type <> 1)) AS without_back FROM tracks WHERE images IS NOT NULL")
def image_edit(spark: SparkSession, d: str) -> DataFrame:
    """A picture added to the end, and pictures of a type taken away."""
    rows = table(spark, d, "tracks").filter("images is not null")
    return rows.select("track_id", "loaded_at", F.size(F.concat("images", F.array(F.try_element_at("images", F.lit(1))))).cast("bigint").alias("added"), F.size(F.filter("images", lambda i: i["type"] != 1)).cast("bigint").alias("without_back"))


@query("WITH k AS (SELECT sheet_id, track_number, index_number, offset_cdframes, row_number() OVER (PARTITION BY sheet_id, track_number, index_number ORDER BY offset_cdframes) AS r FROM sheet_index) SELECT sheet_id, CAST(count(*) FILTER (r = 1) AS BIGINT) AS kept, CAST(count(*) FILTER (r > 1) AS BIGINT) AS dropped FROM k GROUP BY 1")
def block_clean(spark: SparkSession, d: str) -> DataFrame:
    """One mark of each kind for a track, the first."""
    per = table(spark, d, "sheet_index").groupBy("sheet_id", "track_number", "index_number").agg(F.count("*").alias("n"))
    return per.groupBy("sheet_id").agg(F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("dropped"))
