"""Operators on sampled streams: rows of (stream, frame_idx, sample), or of arrays of samples by channel.

frame_idx counts from 0 in each stream. Running sums over long streams are taken in two levels, within chunks of
``CHUNK`` frames and over the chunks, so a stream of any length is spread over tasks. Streams without frames have no
rows. Samples may be null where a docstring says so; a null sample makes the aggregates skip it, as SQL does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def running(df: DataFrame, stream: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its expression from the stream's start up to the row."""
    named = df.withColumn("_chunk", F.floor(F.col(order) / CHUNK)).select("*", *[e.alias(f"_{n}") for n, e in sums.items()])
    inside = Window.partitionBy(stream, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    chunks = named.groupBy(stream, "_chunk").agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in sums])
    before = Window.partitionBy(stream).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = chunks.select(stream, "_chunk", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    out = named.select("*", *[F.sum(f"_{n}").over(inside).alias(f"_in_{n}") for n in sums]).join(base, [stream, "_chunk"])
    return out.select(*df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, stream: str, order: str) -> DataFrame:
    """Adds frame_idx by the unique whole number ``order``."""
    return running(df, stream, order, {"_n": F.lit(1)}).withColumn("frame_idx", F.col("_n") - 1).drop("_n")


def totals(samples: DataFrame, stream: str) -> DataFrame:
    return samples.groupBy(stream).agg(F.max("frame_idx").alias("last"), F.count("*").alias("total"))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def window(samples: DataFrame, stream: str, offset: int, frames: int) -> DataFrame:
    """Exactly ``frames`` frames of each stream from ``offset``, which may be negative; zero where there is none."""
    spine = samples.select(stream).distinct().select(stream, F.explode(_upto(frames)).alias("frame_idx"))
    there = samples.filter((F.col("frame_idx") >= offset) & (F.col("frame_idx") < offset + frames)).select(stream, (F.col("frame_idx") - offset).alias("frame_idx"), "sample")
    return spine.join(there, [stream, "frame_idx"], "left").select(stream, "frame_idx", F.coalesce("sample", F.lit(0)).alias("sample"))


def de_head(samples: DataFrame, stream: str, frames: int) -> DataFrame:
    """Without the first frames, or with zeros in front for a negative count."""
    moved = samples.filter(F.col("frame_idx") >= frames).select(stream, (F.col("frame_idx") - frames).alias("frame_idx"), "sample")
    if frames >= 0:
        return moved
    zeros = samples.select(stream).distinct().select(stream, F.explode(_upto(-frames)).alias("frame_idx"), F.lit(0).cast("bigint").alias("sample"))
    return moved.unionByName(zeros)


def concat(parts: list[DataFrame], stream: str) -> DataFrame:
    """The streams of the same name of all parts, one behind the other."""
    if not parts:
        raise ValueError("nothing to concatenate")
    every = reduce(DataFrame.unionByName, [p.select(stream, "frame_idx", "sample", F.lit(k).alias("part")) for k, p in enumerate(parts)])
    sizes = every.groupBy(stream, "part").agg((F.max("frame_idx") + 1).alias("size"))
    starts = sizes.select(stream, "part", F.coalesce(F.sum("size").over(Window.partitionBy(stream).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return every.join(starts, [stream, "part"]).select(stream, (F.col("start") + F.col("frame_idx")).alias("frame_idx"), "sample")


def repeat(samples: DataFrame, stream: str, times: int) -> DataFrame:
    sized = samples.join(totals(samples, stream), stream)
    return sized.select(stream, F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("r"), "frame_idx", "total", "sample").select(stream, (F.col("r") * F.col("total") + F.col("frame_idx")).alias("frame_idx"), "sample")


def split(samples: DataFrame, stream: str, frames: int) -> DataFrame:
    """part 0 holds the first frames, part 1 the rest, each counted from 0."""
    if frames < 0:
        raise ValueError("a split needs a count of 0 or more")
    late = (F.col("frame_idx") >= frames).cast("int")
    return samples.select(stream, late.alias("part"), (F.col("frame_idx") - late * frames).alias("frame_idx"), "sample")


def first_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: the first frame at which two streams (frame_idx, sample) differ, null if they never do."""
    both = left.select("frame_idx", F.col("sample").alias("a"), F.lit(1).alias("in_a")).join(right.select("frame_idx", F.col("sample").alias("b"), F.lit(1).alias("in_b")), "frame_idx", "full")
    same = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.min(F.when(~same, F.col("frame_idx"))).alias("first_difference"))


def mono(samples: str) -> Column:
    """The mean of the channels in an array column, toward zero."""
    return F.expr(f"aggregate({samples}, 0L, (a, x) -> a + x) div size({samples})")


def clamp(value: Column, bits: int) -> Column:
    return F.greatest(F.lit(-(1 << (bits - 1))), F.least(F.lit((1 << (bits - 1)) - 1), value))


def whole(value: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.round(value).cast("bigint")


def downmix(front_left: Column, front_right: Column, centre: Column, back_left: Column, back_right: Column, bits: int) -> tuple[Column, Column]:
    """Left and right of a surround frame; the low-frequency channel isn't used."""
    back = (back_left + back_right) * 0.7
    return clamp(whole(front_left + back * 0.6 + centre * 0.7), bits), clamp(whole(front_right - back * 0.6 + centre * 0.7), bits)


def to_float(sample: Column, bits: int) -> Column:
    return F.when(sample >= 0, sample / float((1 << (bits - 1)) - 1)).otherwise(sample / float(1 << (bits - 1)))


def to_whole(value: Column, bits: int) -> Column:
    """Back from a float, toward zero, within range."""
    scaled = F.when(value >= 0, value * float((1 << (bits - 1)) - 1)).otherwise(value * float(1 << (bits - 1)))
    return clamp(scaled.cast("bigint"), bits)


def fade_in(sample: Column, at: Column, over: int) -> Column:
    return whole(sample * F.least(at, F.lit(over)) / float(over))


def fade_out(sample: Column, at: Column, over: int) -> Column:
    return whole(sample * F.greatest(F.lit(over) - at, F.lit(0)) / float(over))


def gained(sample: Column, gain_db: Column, peak: Column, bits: int) -> Column:
    """The gain as a factor; one that amplifies never goes beyond what the peak leaves."""
    factor = F.pow(F.lit(10.0), gain_db / 20.0)
    factor = F.when(factor > 1.0, F.least(factor, 1.0 / peak)).otherwise(factor)
    return clamp(whole(sample * factor), bits)


WORD = 4294967296


def frame_word(left: Column, right: Column) -> Column:
    """A stereo frame of 16 bits as an unsigned word, the right channel in the upper half."""
    return F.pmod(right, F.lit(65536)) * 65536 + F.pmod(left, F.lit(65536))


def offset_checksums(words: DataFrame, stream: str, bounds: DataFrame, offsets: int) -> DataFrame:
    """stream, offset and crc: the sum of i * word(offset + i) modulo 2^32 over start <= i <= end, i counted from 1.

    ``words`` has (stream, frame_idx, word), ``bounds`` (stream, start, end). With running sums S of the words and T of
    position times word, each offset takes two look-ups: (T(r+e) - T(r+s-1)) - r (S(r+e) - S(r+s-1)).
    """
    sums = running(words.withColumn("j", F.col("frame_idx") + 1), stream, "frame_idx", {"s_sum": F.col("word"), "t_sum": ((F.col("frame_idx") + 1) % WORD * F.col("word")) % WORD}).select(stream, "j", (F.col("s_sum") % WORD).alias("s_sum"), (F.col("t_sum") % WORD).alias("t_sum"))
    asked = bounds.select(stream, "start", "end", F.explode(_upto(offsets)).alias("offset"))
    high = sums.select(stream, F.col("j").alias("jh"), F.col("s_sum").alias("sh"), F.col("t_sum").alias("th"))
    low = sums.select(stream, F.col("j").alias("jl"), F.col("s_sum").alias("sl"), F.col("t_sum").alias("tl"))
    got = asked.withColumn("jh", F.col("offset") + F.col("end")).withColumn("jl", F.col("offset") + F.col("start") - 1).join(high, [stream, "jh"]).join(low, [stream, "jl"], "left")
    s = F.pmod(F.col("sh") - F.coalesce("sl", F.lit(0)), F.lit(WORD))
    t = F.col("th") - F.coalesce("tl", F.lit(0))
    return got.select(stream, "offset", F.pmod(t - (F.col("offset") * s) % WORD, F.lit(WORD)).alias("crc"))


def checksum_v2(words: DataFrame, stream: str, bounds: DataFrame) -> DataFrame:
    """stream and crc2: the sums of the upper and lower words of i * word(i), modulo 2^32."""
    i = F.col("frame_idx") + 1
    inside = words.join(bounds, stream).filter((i >= F.col("start")) & (i <= F.col("end")))
    product = i * F.col("word")
    return inside.groupBy(stream).agg(((F.sum(product % WORD) + F.sum(F.shiftright(product, 32))) % WORD).alias("crc2"))


def differences(samples: DataFrame, stream: str, block: int, orders: int = 4) -> DataFrame:
    """stream, block and, for each order k, the sum of the absolute k-th differences within the block, with the best order."""
    w = Window.partitionBy(stream, "block").orderBy("frame_idx")
    df = samples.select(stream, F.floor(F.col("frame_idx") / block).alias("block"), "frame_idx", F.col("sample").alias("d0"))
    for k in range(1, orders + 1):
        df = df.withColumn(f"d{k}", F.col(f"d{k - 1}") - F.lag(f"d{k - 1}").over(w))
    warm = F.row_number().over(w) > orders
    df = df.withColumn("warm", warm).filter("warm")
    sums = df.groupBy(stream, "block").agg(*[F.sum(F.abs(f"d{k}")).alias(f"sum{k}") for k in range(orders + 1)])
    best = F.array_min(F.array(*[F.struct(F.col(f"sum{k}").alias("s"), F.lit(k).alias("k")) for k in range(orders + 1)]))["k"]
    return sums.withColumn("best_order", best)


def autocorrelation(samples: DataFrame, stream: str, lags: int) -> DataFrame:
    """stream, lag and the sum of x(i) x(i + lag), for lags from 0."""
    asked = samples.select(stream, "frame_idx", "sample", F.explode(_upto(lags + 1)).alias("lag"))
    later = samples.select(stream, F.col("frame_idx").alias("at"), F.col("sample").alias("other"))
    met = asked.withColumn("at", F.col("frame_idx") + F.col("lag")).join(later, [stream, "at"])
    return met.groupBy(stream, "lag").agg(F.sum(F.col("sample") * F.col("other")).alias("r"))


def trailing_zeros(bits: Column) -> Column:
    """How many low bits of a whole number are 0; 0 for the number 0."""
    low = bits.bitwiseAND(-bits)
    return F.when(bits == 0, 0).otherwise(F.round(F.log2(low.cast("double"))).cast("int"))


def rice(residuals: DataFrame, stream: str, block: int, top: int = 14) -> DataFrame:
    """stream, block, the Rice parameter with the fewest bits for the residuals in ``sample``, and these bits."""
    folded = F.when(F.col("sample") >= 0, F.col("sample") * 2).otherwise(-F.col("sample") * 2 - 1)
    per = residuals.select(stream, F.floor(F.col("frame_idx") / block).alias("block"), folded.alias("u"), F.explode(F.sequence(F.lit(0), F.lit(top))).alias("parameter"))
    bits = per.groupBy(stream, "block", "parameter").agg(F.sum(F.expr("shiftright(u, parameter)") + 1 + F.col("parameter")).alias("bits"))
    return bits.groupBy(stream, "block").agg(F.min_by("parameter", F.struct("bits", "parameter")).alias("parameter"), F.min("bits").alias("bits"))


def as_of(points: DataFrame, frames: DataFrame, stream: str) -> DataFrame:
    """For each (stream, point) the last frame start at or before it: one sorted pass over both, no range join."""
    both = frames.select(stream, F.col("start").alias("at"), F.lit(0).alias("asks"), "start").unionByName(points.select(stream, F.col("point").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("bigint").alias("start")))
    known = F.last("start", ignorenulls=True).over(Window.partitionBy(stream).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("start", known).filter("asks = 1").select(stream, F.col("at").alias("point"), "start")
