"""Queries of containers, tags, filters and live feeds, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.operators import filters
from tonearm.operators import streams as S
from tonearm.plans.registry import Registry
from tonearm.plans.streams import samples, stereo
from tonearm.shared import table
from tonearm.sources import containers, pictures, reader, tags
from tonearm.streaming import live

query = Registry("WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx, CAST(round(value * 100) AS BIGINT) - 24500 AS sample, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS other FROM events) ")
QUERIES, SQL = query.queries, query.sql
_LONG = "SELECT user_id, frame_idx, CAST(c AS INTEGER) AS channel, CASE c WHEN 0 THEN sample ELSE other END AS sample FROM s, (SELECT unnest(range(2)) AS c)"


def _channels(spark: SparkSession, d: str) -> DataFrame:
    return stereo(spark, d).select("user_id", "frame_idx", F.posexplode(F.array("sample", "other")).alias("channel", "sample"))


def _through(spark: SparkSession, d: str, kind: str, rate: int, bits: int) -> DataFrame:
    """The streams written as files of a kind and read again."""
    return reader.decoded(reader.encoded(_channels(spark, d), "user_id", kind, rate, bits), "user_id", kind)


@query(_LONG)
def wav_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, d, "wav", 44100, 16)


@query(_LONG)
def aiff_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, d, "aiff", 48000, 24)


@query(_LONG)
def au_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, d, "au", 8000, 16)


@query("SELECT user_id, 'wav' AS format, 0 AS faults, 44 + 4 * count(*) AS bytes FROM s GROUP BY 1")
def wav_verify(spark: SparkSession, d: str) -> DataFrame:
    """Format by content, structural faults and size of the streams as WAV files of 16 bits.

    The size asked for is that of 16 bits, so samples beyond are held at the ends of the range, as the reference's writer
    does (src/pcm_conv.c:347); no sample is part of the answer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("content").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("user_id"), pa.array([tags.sniff(x) for x in data], pa.string()), pa.array([len(containers.faults(x)) for x in data], pa.int32()), pa.array([len(x) for x in data], pa.int64())], ["user_id", "format", "faults", "bytes"])

    held = _channels(spark, d).withColumn("sample", S.clamp(F.col("sample"), 16))
    return reader.encoded(held, "user_id", "wav", 44100, 16).mapInArrow(run, "user_id bigint, format string, faults int, bytes bigint")


def _tagged(spark: SparkSession, d: str, system: int, write: object) -> DataFrame:
    """path (the track_id) and content: the tags of the tracks in a system of tags."""
    keys = [(f, names[system]) for f, names in tags.FIELDS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(f).to_pylist() for f, _ in keys]
            data = [write([(k, c[i]) for (_, k), c in zip(keys, columns) if c[i]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(data, pa.binary())], ["path", "content"])

    rows = table(spark, d, "tracks").filter("meta is not null").select(F.col("track_id").cast("string").alias("path"), *[F.col(f"meta.{f}").alias(f) for f, _ in keys]).distinct()
    return rows.mapInArrow(run, "path string, content binary")


def _tag_sql(system: int) -> str:
    return " UNION ALL ".join(f"SELECT DISTINCT CAST(track_id AS VARCHAR) AS path, '{names[system]}' AS key, meta.{f} AS value FROM tracks WHERE meta.{f} <> ''" for f, names in tags.FIELDS.items())


@query(_tag_sql(0), base=False)
def id3v2_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return reader.tag_items(_tagged(spark, d, 0, tags.to_id3v2), "id3v2").select("path", "key", "value")


@query(_tag_sql(1), base=False)
def vorbis_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return reader.tag_items(_tagged(spark, d, 1, tags.to_vorbis), "vorbis").select("path", "key", "value")


@query(_tag_sql(2), base=False)
def ape_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return reader.tag_items(_tagged(spark, d, 2, tags.to_ape), "ape").select("path", "key", "value")


@query("SELECT count(*) AS images, CAST(count(*) FILTER (octet_length(i.data) > 0) AS BIGINT) AS with_data FROM (SELECT unnest(images) AS i FROM tracks)", base=False)
def image_data(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "tracks").select(F.explode("images").alias("i"))
    return each.agg(F.count("*").alias("images"), F.count_if(F.octet_length("i.data") > 0).alias("with_data"))


@query()
def image_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What the pictures' own bytes say of their format, beside what the tag says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pictures.metrics(x or b"") or (None, None, None, None, None) for x in b.column("data").to_pylist()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("track_id"), b.column("mime_type"), *[pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)]], ["track_id", "mime_type", "found_type", "width", "height", "depth", "colours"])

    each = table(spark, d, "tracks").select("track_id", F.explode("images").alias("i")).select("track_id", "i.mime_type", "i.data")
    return each.mapInArrow(run, "track_id bigint, mime_type string, found_type string, width int, height int, depth int, colours int")


@query()
def recursive_filter(spark: SparkSession, d: str) -> DataFrame:
    """The streams through a high-pass filter at 150 Hz, at 8,000 frames a second."""
    b, a = filters.high_pass(8000, 150)
    return filters.filtered(samples(spark, d), "user_id", b, a)


@query()
def resample(spark: SparkSession, d: str) -> DataFrame:
    return filters.resampled(samples(spark, d), "user_id", 44100, 48000)


@query()
def predictors(spark: SparkSession, d: str) -> DataFrame:
    return filters.predictors(S.autocorrelation(samples(spark, d), "user_id", 8), "user_id", 8)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", base=False)
def live_hours(spark: SparkSession, d: str) -> DataFrame:
    """tumbling_hours over a stream."""
    rows = live.drain(live.tumbling(live.feed(spark, f"{d}/events.parquet")), "complete")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, count(*) AS n FROM n GROUP BY user_id, s", base=False)
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = live.drain(live.sessions(live.feed(spark, f"{d}/events.parquet")), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


@query("SELECT user_id, k // 10 AS window_no, round(sum(value * value) / 10, 6) AS power FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1, 2 HAVING count(*) = 10", base=False)
def live_loudness(spark: SparkSession, d: str) -> DataFrame:
    rows = live.drain(live.loudness_windows(live.feed(spark, f"{d}/events.parquet"), 10))
    return rows.select("user_id", "window_no", F.round("power", 6).alias("power"))
