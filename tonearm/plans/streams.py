"""Queries of the stream operators, with their SQL. The events are the streams: one for each user_id.

A sample is the event's value in hundredths, moved to be signed; a second channel comes from the event's property k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm.operators import loudness
from tonearm.operators import streams as S
from tonearm.plans.registry import Registry
from tonearm.shared import table

#: Frames of a loudness window: 50 ms of the events' stream at 200 frames a second.
WINDOW_FRAMES = 10
_U = "user_id"
_BASE = """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_idx,
 CAST(round(value * 100) AS BIGINT) - 24500 AS sample, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS other FROM events)
"""


query = Registry(_BASE)
QUERIES, SQL = query.queries, query.sql


def stereo(spark: SparkSession, d: str) -> DataFrame:
    """user_id, frame_idx, sample and other (the second channel)."""
    events = table(spark, d, "events").select("user_id", "event_id", "value", "props")
    rows = S.numbered(events, "user_id", "event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return rows.select("user_id", "frame_idx", (F.round(F.col("value") * 100).cast("bigint") - 24500).alias("sample"), (k * 100).alias("other"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return stereo(spark, d).drop("other")


@query("SELECT user_id, CAST(frame_idx AS BIGINT) AS frame_idx, sample FROM s")
def pcm_stream(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d)


def _window_sql(offset: int, frames: int) -> str:
    return f"SELECT i.user_id, n.n AS frame_idx, coalesce(s.sample, 0) AS sample FROM (SELECT DISTINCT user_id FROM s) i CROSS JOIN (SELECT unnest(range({frames})) AS n) n LEFT JOIN s ON s.user_id = i.user_id AND s.frame_idx = n.n + ({offset})"


@query(_window_sql(-3, 40))
def window_pad(spark: SparkSession, d: str) -> DataFrame:
    return S.window(samples(spark, d), _U, -3, 40)


@query(_window_sql(0, 60))
def head_pad(spark: SparkSession, d: str) -> DataFrame:
    return S.window(samples(spark, d), _U, 0, 60)


@query("SELECT user_id, frame_idx - 5 AS frame_idx, sample FROM s WHERE frame_idx >= 5")
def head_drop(spark: SparkSession, d: str) -> DataFrame:
    return S.de_head(samples(spark, d), _U, 5)


@query("SELECT user_id, frame_idx + 4 AS frame_idx, sample FROM s UNION ALL SELECT user_id, n, 0 FROM (SELECT DISTINCT user_id FROM s), (SELECT unnest(range(4)) AS n)")
def silence_before(spark: SparkSession, d: str) -> DataFrame:
    return S.de_head(samples(spark, d), _U, -4)


@query("SELECT user_id, frame_idx, sample FROM s WHERE frame_idx < 25")
def stream_limit(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).filter("frame_idx < 25")


@query("SELECT user_id, frame_idx, sample FROM s UNION ALL SELECT s.user_id, s.frame_idx + t.n, -s.sample FROM s JOIN (SELECT user_id, count(*) AS n FROM s GROUP BY 1) t USING (user_id)")
def concat_reindex(spark: SparkSession, d: str) -> DataFrame:
    one = samples(spark, d)
    return S.concat([one, one.withColumn("sample", -F.col("sample"))], _U)


@query("SELECT s.user_id, r.r * t.n + s.frame_idx AS frame_idx, s.sample FROM s JOIN (SELECT user_id, count(*) AS n FROM s GROUP BY 1) t USING (user_id) CROSS JOIN (SELECT unnest(range(3)) AS r) r")
def stream_repeat(spark: SparkSession, d: str) -> DataFrame:
    return S.repeat(samples(spark, d), _U, 3)


@query("SELECT user_id, CASE WHEN frame_idx >= 17 THEN 1 ELSE 0 END AS part, CASE WHEN frame_idx >= 17 THEN frame_idx - 17 ELSE frame_idx END AS frame_idx, sample FROM s")
def stream_split(spark: SparkSession, d: str) -> DataFrame:
    return S.split(samples(spark, d), _U, 17)


@query("SELECT min(CASE WHEN a.frame_idx IS NULL OR b.frame_idx IS NULL OR a.sample IS DISTINCT FROM b.sample THEN coalesce(a.frame_idx, b.frame_idx) END) AS first_difference FROM (SELECT * FROM s WHERE user_id = 1) a FULL JOIN (SELECT * FROM s WHERE user_id = 2) b ON a.frame_idx = b.frame_idx")
def frame_compare(spark: SparkSession, d: str) -> DataFrame:
    every = samples(spark, d)
    return S.first_difference(every.filter("user_id = 1"), every.filter("user_id = 2"))


@query("SELECT user_id, min(CASE WHEN sample <> other THEN frame_idx END) AS first_difference, bool_and(sample = other) AS equal FROM s GROUP BY 1")
def channel_compare(spark: SparkSession, d: str) -> DataFrame:
    differs = F.col("sample") != F.col("other")
    return stereo(spark, d).groupBy(_U).agg(F.min(F.when(differs, F.col("frame_idx"))).alias("first_difference"), F.every(~differs).alias("equal"))


@query("SELECT user_id, frame_idx, other AS c0, sample AS c1, other AS c2 FROM s")
def channel_reorder(spark: SparkSession, d: str) -> DataFrame:
    frames = stereo(spark, d).select(_U, "frame_idx", F.array("sample", "other").alias("samples"))
    order = [1, 0, 1]
    return frames.select(_U, "frame_idx", *[F.element_at("samples", c + 1).alias(f"c{k}") for k, c in enumerate(order)])


@query("SELECT user_id, frame_idx, sample AS c0, other AS c1 FROM s")
def channel_zip(spark: SparkSession, d: str) -> DataFrame:
    both = stereo(spark, d)
    left = both.select(_U, "frame_idx", F.col("sample").alias("c0"))
    return left.join(both.select(_U, "frame_idx", F.col("other").alias("c1")), [_U, "frame_idx"])


@query("SELECT user_id, 2 * frame_idx + c AS pos, CASE c WHEN 0 THEN sample ELSE other END AS sample FROM s, (SELECT unnest(range(2)) AS c)")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    frames = stereo(spark, d).select(_U, "frame_idx", F.posexplode(F.array("sample", "other")).alias("c", "sample"))
    return frames.select(_U, (F.col("frame_idx") * 2 + F.col("c")).alias("pos"), "sample")


@query("SELECT user_id, frame_idx // 2 AS frame_idx, frame_idx % 2 AS channel, sample - 8192 AS sample FROM s")
def list_to_frames(spark: SparkSession, d: str) -> DataFrame:
    """A list of unsigned samples, two channels one after the other, as signed frames."""
    return samples(spark, d).select(_U, F.expr("frame_idx div 2").alias("frame_idx"), (F.col("frame_idx") % 2).alias("channel"), (F.col("sample") - (1 << 13)).alias("sample"))


@query("SELECT user_id, sample FROM s WHERE frame_idx = 3")
def one_frame(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).filter("frame_idx = 3").select(_U, "sample")


@query("SELECT user_id, count(*) * 4 AS bytes, greatest(1, (count(*) * 4 - 3) // 4) AS frames FROM s GROUP BY 1")
def byte_frames(spark: SparkSession, d: str) -> DataFrame:
    """Whole frames in a count of bytes, one at least."""
    size = F.count("*") * 4
    return samples(spark, d).groupBy(_U).agg(size.alias("bytes")).withColumn("frames", F.greatest(F.lit(1), F.expr("(bytes - 3) div 4")))


@query("SELECT user_id, frame_idx, (sample + other) // 2 AS mono FROM s")
def mono_mix(spark: SparkSession, d: str) -> DataFrame:
    frames = stereo(spark, d).select(_U, "frame_idx", F.array("sample", "other").alias("samples"))
    return frames.select(_U, "frame_idx", S.mono("samples").alias("mono"))


_LAGS = "lag(sample, 1, 0) OVER w AS c, lag(sample, 2, 0) OVER w AS bl, lag(sample, 3, 0) OVER w AS br"


@query(
    f", t AS (SELECT user_id, frame_idx, sample AS fl, other AS fr, {_LAGS} FROM s WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)) "
    "SELECT user_id, frame_idx, greatest(-32768, least(32767, CAST(round(fl + (bl + br) * 0.7::DOUBLE * 0.6::DOUBLE + c * 0.7::DOUBLE) AS BIGINT))) AS l, greatest(-32768, least(32767, CAST(round(fr - (bl + br) * 0.7::DOUBLE * 0.6::DOUBLE + c * 0.7::DOUBLE) AS BIGINT))) AS r FROM t"
)
def downmix(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(_U).orderBy("frame_idx")
    lag = lambda k: F.lag("sample", k, 0).over(w)
    five = stereo(spark, d).select(_U, "frame_idx", "sample", "other", lag(1).alias("c"), lag(2).alias("bl"), lag(3).alias("br"))
    left, right = S.downmix(*map(F.col, ("sample", "other", "c", "bl", "br")), 16)
    return five.select(_U, "frame_idx", left.alias("l"), right.alias("r"))


@query("SELECT user_id, frame_idx, sample << 8 AS up, sample >> 4 AS down FROM (SELECT user_id, frame_idx, sample FROM s WHERE sample >= 0) UNION ALL SELECT user_id, frame_idx, sample * 256, CAST(floor(sample / 16.0) AS BIGINT) FROM s WHERE sample < 0")
def bit_depth(spark: SparkSession, d: str) -> DataFrame:
    """To 24 and to 12 bits, without dither."""
    return samples(spark, d).select(_U, "frame_idx", F.shiftleft("sample", 8).alias("up"), F.shiftright("sample", 4).alias("down"))


_FLOAT = "CASE WHEN sample >= 0 THEN sample / 32767.0::DOUBLE ELSE sample / 32768.0::DOUBLE END"


@query(f"SELECT user_id, frame_idx, round({_FLOAT}, 9) AS value, CAST(trunc(round(CASE WHEN sample >= 0 THEN {_FLOAT} * 32767 ELSE {_FLOAT} * 32768 END, 6)) AS BIGINT) AS back FROM s")
def int_float_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    value = S.to_float(F.col("sample"), 16)
    exact = F.round(F.when(F.col("sample") >= 0, value * 32767.0).otherwise(value * 32768.0), 6).cast("bigint")
    return samples(spark, d).select(_U, "frame_idx", F.round(value, 9).alias("value"), exact.alias("back"))


@query("SELECT user_id, frame_idx, CAST(greatest(-32768, least(32767, trunc(CASE WHEN sample >= 0 THEN sample / 20000.0::DOUBLE * 32767 ELSE sample / 20000.0::DOUBLE * 32768 END))) AS BIGINT) AS quantized FROM s")
def float_to_int(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select(_U, "frame_idx", S.to_whole(F.col("sample") / 20000.0, 16).alias("quantized"))


@query("SELECT user_id, frame_idx, CAST(round(sample * least(frame_idx, 30) / 30.0::DOUBLE) AS BIGINT) AS faded_in, CAST(round(sample * greatest(30 - frame_idx, 0) / 30.0::DOUBLE) AS BIGINT) AS faded_out FROM s")
def fade(spark: SparkSession, d: str) -> DataFrame:
    sample, at = F.col("sample"), F.col("frame_idx")
    return samples(spark, d).select(_U, "frame_idx", S.fade_in(sample, at, 30).alias("faded_in"), S.fade_out(sample, at, 30).alias("faded_out"))


@query(
    ", p AS (SELECT user_id, max(abs(sample)) / 32768.0::DOUBLE AS peak FROM s GROUP BY 1) SELECT s.user_id, frame_idx, greatest(-32768, least(32767, CAST(round(sample * CASE WHEN pow(10.0::DOUBLE, ((user_id % 7) - 3.0::DOUBLE) / 20.0::DOUBLE) > 1 "
    "THEN least(pow(10.0::DOUBLE, ((user_id % 7) - 3.0::DOUBLE) / 20.0::DOUBLE), 1.0::DOUBLE / peak) ELSE pow(10.0::DOUBLE, ((user_id % 7) - 3.0::DOUBLE) / 20.0::DOUBLE) END) AS BIGINT))) AS gained FROM s JOIN p USING (user_id)"
)
def gain_apply(spark: SparkSession, d: str) -> DataFrame:
    """A gain of -3 to 3 dB by user, held back by the stream's peak."""
    every = samples(spark, d)
    peaks = every.groupBy(_U).agg((F.max(F.abs("sample")) / 32768.0).alias("peak"))
    gain = F.col("user_id") % 7 - F.lit(3.0)
    return every.join(peaks, _U).select(_U, "frame_idx", S.gained(F.col("sample"), gain, F.col("peak"), 16).alias("gained"))


@query("SELECT user_id, bool_or(sample <> 0) AS sounds, max(abs(sample)) AS loudest FROM s WHERE frame_idx < 5 GROUP BY 1")
def silence_test(spark: SparkSession, d: str) -> DataFrame:
    first = samples(spark, d).filter("frame_idx < 5")
    return first.groupBy(_U).agg(F.bool_or(F.col("sample") != 0).alias("sounds"), F.max(F.abs("sample")).alias("loudest"))


@query("SELECT user_id % 10 AS album, user_id AS title, round(max(greatest(abs(sample), abs(other))) / 32768.0::DOUBLE, 9) AS peak FROM s GROUP BY ROLLUP (user_id % 10, user_id) HAVING grouping(user_id % 10) = 0")
def peak_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = stereo(spark, d).select((F.col("user_id") % 10).alias("album"), F.col("user_id").alias("title"), F.greatest(F.abs("sample"), F.abs("other")).alias("top"))
    rolled = rows.rollup("album", "title").agg(F.max("top").alias("top"), F.grouping("album").alias("g"))
    return rolled.filter("g = 0").select("album", "title", F.round(F.col("top") / 32768.0, 9).alias("peak"))


_WINDOWS = f", w AS (SELECT user_id, frame_idx // {WINDOW_FRAMES} AS w, sum(CAST(sample AS DOUBLE) * sample) AS power FROM s GROUP BY 1, 2 HAVING count(*) = {WINDOW_FRAMES}), b AS (SELECT user_id, greatest(0, least(11999, CAST(trunc(1000 * log10((power + power) / {WINDOW_FRAMES} * 0.5 + 1e-37)) AS INTEGER))) AS bin FROM w), h AS (SELECT user_id, bin, count(*) AS cnt FROM b GROUP BY 1, 2) "


@query(_WINDOWS + "SELECT user_id, bin, cnt FROM h")
def rms_hist(spark: SparkSession, d: str) -> DataFrame:
    return loudness.rms_hist(samples(spark, d), _U, WINDOW_FRAMES)


@query(_WINDOWS + ", c AS (SELECT user_id, bin, sum(cnt) OVER (PARTITION BY user_id) AS n, sum(cnt) OVER (PARTITION BY user_id ORDER BY bin DESC) AS top FROM h), g AS (SELECT user_id, 64.82::DOUBLE - max(bin) / 100.0::DOUBLE AS gain_db FROM c WHERE top >= ceil(n * (1.0::DOUBLE - 0.95::DOUBLE)) GROUP BY 1) SELECT u.user_id, gain_db FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN g USING (user_id)")
def gain_percentile(spark: SparkSession, d: str) -> DataFrame:
    return loudness.gain_percentile(samples(spark, d), _U, WINDOW_FRAMES)


@query(_WINDOWS + ", a AS (SELECT user_id % 10 AS album, bin, sum(cnt) AS cnt FROM h GROUP BY 1, 2), c AS (SELECT album, bin, sum(cnt) OVER (PARTITION BY album) AS n, sum(cnt) OVER (PARTITION BY album ORDER BY bin DESC) AS top FROM a) SELECT album, 64.82::DOUBLE - max(bin) / 100.0::DOUBLE AS gain_db FROM c WHERE top >= ceil(n * (1.0::DOUBLE - 0.95::DOUBLE)) GROUP BY 1")
def album_gain(spark: SparkSession, d: str) -> DataFrame:
    """The gain of ten albums of streams from the titles' histograms, which are added up."""
    hist = loudness.rms_hist(samples(spark, d), _U, WINDOW_FRAMES)
    albums = hist.groupBy((F.col("user_id") % 10).alias("album"), "bin").agg(F.sum("cnt").alias("cnt"))
    return loudness.percentile_gain(albums, "album")


_WORDS = ", f AS (SELECT user_id, frame_idx + 1 AS j, ((other % 65536 + 65536) % 65536) * 65536 + (sample % 65536 + 65536) % 65536 AS word FROM s), n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1) "


def _words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words = stereo(spark, d).select(_U, "frame_idx", S.frame_word(F.col("sample"), F.col("other")).alias("word"))
    bounds = words.groupBy(_U).agg(F.lit(3).cast("bigint").alias("start"), (F.count("*") - 8).alias("end")).filter("end >= start")
    return words, bounds


@query(_WORDS + "SELECT n.user_id, o.o AS offset, CAST(sum(((f.j - o.o) * f.word) % 4294967296) % 4294967296 AS BIGINT) AS crc FROM n CROSS JOIN (SELECT unnest(range(6)) AS o) o JOIN f ON f.user_id = n.user_id AND f.j - o.o BETWEEN 3 AND n.n - 8 WHERE n.n - 8 >= 3 GROUP BY 1, 2")
def offset_checksum_v1(spark: SparkSession, d: str) -> DataFrame:
    words, bounds = _words(spark, d)
    return S.offset_checksums(words, _U, bounds, 6)


@query(_WORDS + "SELECT f.user_id, CAST((sum((j * word) % 4294967296) + sum((j * word) >> 32)) % 4294967296 AS BIGINT) AS crc2 FROM f JOIN n USING (user_id) WHERE j BETWEEN 3 AND n - 8 GROUP BY 1")
def offset_checksum_v2(spark: SparkSession, d: str) -> DataFrame:
    words, bounds = _words(spark, d)
    return S.checksum_v2(words, _U, bounds)


@query("SELECT user_id, CAST(bit_or(sample) AS BIGINT) AS bits, CASE WHEN bit_or(sample) = 0 THEN 0 ELSE CAST(round(log2(CAST(bit_or(sample) & -bit_or(sample) AS DOUBLE))) AS INTEGER) END AS wasted FROM s GROUP BY 1")
def wasted_bits(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy(_U).agg(F.bit_or("sample").alias("bits")).withColumn("wasted", S.trailing_zeros(F.col("bits")))


@query("SELECT user_id, frame_idx // 4 AS block, min(sample // 4096) = max(sample // 4096) AS constant FROM s GROUP BY 1, 2")
def constant_block(spark: SparkSession, d: str) -> DataFrame:
    coarse = samples(spark, d).select(_U, F.expr("frame_idx div 4").alias("block"), F.expr("sample div 4096").alias("v"))
    return coarse.groupBy(_U, "block").agg((F.min("v") == F.max("v")).alias("constant"))


_D = "".join(f", d{k} AS (SELECT *, d{k - 1}_ - lag(d{k - 1}_) OVER (PARTITION BY user_id, block ORDER BY frame_idx) AS d{k}_ FROM d{k - 1})" for k in range(1, 5))


@query(
    f", d0 AS (SELECT user_id, frame_idx // 32 AS block, frame_idx, sample AS d0_, row_number() OVER (PARTITION BY user_id, frame_idx // 32 ORDER BY frame_idx) AS n FROM s){_D} SELECT user_id, block, "
    + ", ".join(f"CAST(sum(abs(d{k}_)) AS BIGINT) AS sum{k}" for k in range(5))
    + ", CAST(list_position([sum(abs(d0_)), sum(abs(d1_)), sum(abs(d2_)), sum(abs(d3_)), sum(abs(d4_))], list_min([sum(abs(d0_)), sum(abs(d1_)), sum(abs(d2_)), sum(abs(d3_)), sum(abs(d4_))])) - 1 AS INTEGER) AS best_order FROM d4 WHERE n > 4 GROUP BY 1, 2"
)
def fixed_diff(spark: SparkSession, d: str) -> DataFrame:
    return S.differences(samples(spark, d), _U, 32)


@query("SELECT a.user_id, g.g AS lag, CAST(sum(a.sample * b.sample) AS BIGINT) AS r FROM s a CROSS JOIN (SELECT unnest(range(9)) AS g) g JOIN s b ON b.user_id = a.user_id AND b.frame_idx = a.frame_idx + g.g GROUP BY 1, 2")
def autocorr(spark: SparkSession, d: str) -> DataFrame:
    return S.autocorrelation(samples(spark, d), _U, 8)


@query(
    ", u AS (SELECT user_id, frame_idx // 16 AS block, CASE WHEN sample >= 0 THEN sample * 2 ELSE -sample * 2 - 1 END AS u FROM s), b AS (SELECT user_id, block, p.p AS parameter, CAST(sum((u >> p.p) + 1 + p.p) AS BIGINT) AS bits FROM u, (SELECT unnest(range(15)) AS p) p GROUP BY 1, 2, 3) "
    "SELECT user_id, block, CAST(arg_min(parameter, bits * 100 + parameter) AS INTEGER) AS parameter, min(bits) AS bits FROM b GROUP BY 1, 2"
)
def rice_parameter(spark: SparkSession, d: str) -> DataFrame:
    return S.rice(samples(spark, d), _U, 16)


@query("SELECT user_id, frame_idx // 16 AS block, CAST(max(length(bin(abs(sample)))) AS INTEGER) AS widest FROM s GROUP BY 1, 2")
def residual_bits(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy(_U, F.expr("frame_idx div 16").alias("block")).agg(F.max(F.length(F.bin(F.abs("sample")))).alias("widest"))


@query("SELECT user_id, frame_idx, (sample + other) >> 1 AS mid, sample - other AS side FROM s WHERE sample + other >= 0 UNION ALL SELECT user_id, frame_idx, CAST(floor((sample + other) / 2.0) AS BIGINT), sample - other FROM s WHERE sample + other < 0")
def mid_side(spark: SparkSession, d: str) -> DataFrame:
    return stereo(spark, d).select(_U, "frame_idx", F.shiftright(F.col("sample") + F.col("other"), 1).alias("mid"), (F.col("sample") - F.col("other")).alias("side"))


@query("SELECT p.user_id, p.point, max(b.start) AS start FROM (SELECT user_id, unnest(range(0, max(frame_idx) + 1, 25)) AS point FROM s GROUP BY 1) p LEFT JOIN (SELECT user_id, frame_idx AS start FROM s WHERE frame_idx % 7 = 0) b ON b.user_id = p.user_id AND b.start <= p.point GROUP BY 1, 2")
def seek_points(spark: SparkSession, d: str) -> DataFrame:
    """A point every 25 frames, at the last block of 7 frames that starts there or before."""
    every = samples(spark, d)
    points = S.totals(every, _U).select(_U, F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(25))).alias("point"))
    return S.as_of(points, every.filter("frame_idx % 7 = 0").select(_U, F.col("frame_idx").alias("start")), _U)


@query("SELECT user_id, count(*) * 48000 // 44100 AS resampled, count(*) * 75 // 200 AS cd_frames FROM s GROUP BY 1")
def resampled_length(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy(_U).agg(F.count("*").alias("n")).select(_U, F.expr("n * 48000 div 44100").alias("resampled"), F.expr("n * 75 div 200").alias("cd_frames"))


@query("SELECT CAST(i AS BIGINT) AS frame_idx, CAST(trunc(16000 * sin(i * 2 * pi() * 441 / 44100) + 8000 * sin(i * 2 * pi() * 882 / 44100) + 0.5) AS BIGINT) AS sample FROM (SELECT unnest(range(2000)) AS i)", base=False)
def sine(spark: SparkSession, d: str) -> DataFrame:
    from math import pi

    wave = lambda a, f: a * F.sin(F.col("id") * 2 * F.lit(pi) * f / 44100)
    return spark.range(2000).select(F.col("id").alias("frame_idx"), (wave(16000, 441) + wave(8000, 882) + 0.5).cast("bigint").alias("sample"))


@query("SELECT CAST(i AS BIGINT) AS frame_idx, 1 AS sample FROM (SELECT unnest(range(1000)) AS i)", base=False)
def constant_stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("frame_idx"), F.lit(1).alias("sample"))


@query("SELECT user_id, md5(string_agg(printf('%04X', (sample % 65536 + 65536) % 65536), '' ORDER BY frame_idx)) AS digest, count(*) AS frames FROM s WHERE frame_idx < 4096 GROUP BY 1")
def block_digest(spark: SparkSession, d: str) -> DataFrame:
    """MD5 of each stream's first block of at most 4096 frames, as big-endian hex."""
    word = F.lpad(F.hex(F.pmod("sample", F.lit(65536))), 4, "0")
    rows = samples(spark, d).filter("frame_idx < 4096").select(_U, F.struct("frame_idx", word.alias("w")).alias("x"))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]))
    return rows.groupBy(_U).agg(F.md5(text).alias("digest"), F.count("*").alias("frames"))


@query("SELECT user_id, frame_idx, printf('%04X', (sample % 65536 + 65536) % 65536) AS big, substr(printf('%04X', (sample % 65536 + 65536) % 65536), 3, 2) || substr(printf('%04X', (sample % 65536 + 65536) % 65536), 1, 2) AS little FROM s")
def to_bytes(spark: SparkSession, d: str) -> DataFrame:
    big = F.lpad(F.hex(F.pmod("sample", F.lit(65536))), 4, "0")
    return samples(spark, d).select(_U, "frame_idx", big.alias("big"), F.concat(F.substring(big, 3, 2), F.substring(big, 1, 2)).alias("little"))


@query("SELECT user_id, frame_idx, sample AS signed FROM s")
def from_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Back from two bytes in hex, as a signed number."""
    value = F.conv("big", 16, 10).cast("bigint")
    return to_bytes(spark, d).select(_U, "frame_idx", F.when(value >= 32768, value - 65536).otherwise(value).alias("signed"))


@query("SELECT CAST((sum(sample) // 1000) * 1000 AS BIGINT) AS level, count(*) AS frames, count(DISTINCT user_id) AS streams FROM s")
def counters(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).agg(F.expr("sum(sample) div 1000 * 1000").alias("level"), F.count("*").alias("frames"), F.countDistinct(_U).alias("streams"))


@query("SELECT a.user_id, a.event_type, count(*) AS n, min(event_id) AS first_id FROM events a GROUP BY 1, 2 HAVING count(*) > 1", base=False)
def stream_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).filter("n > 1")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1", base=False)
def tumbling_hours(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")
