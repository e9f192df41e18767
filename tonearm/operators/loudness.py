"""Percentile loudness of streams, flat-weighted: windowed mean square, histogram, gain from the top.

A mono stream counts as two equal channels. The partial window at a stream's end is dropped; a stream without a full
window has a null gain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_DB = 100
BINS = 12000
PINK_REF = 64.82


def rms_hist(samples: DataFrame, stream: str, window_frames: int) -> DataFrame:
    """stream, bin and cnt from (stream, frame_idx from 0, sample)."""
    square = F.col("sample").cast("double") * F.col("sample")
    windows = samples.groupBy(stream, F.floor(F.col("frame_idx") / window_frames).alias("w")).agg(F.count("*").alias("frames"), F.sum(square).alias("power"))
    val = STEPS_PER_DB * F.lit(10.0) * F.log10((F.col("power") + F.col("power")) / F.col("frames") * 0.5 + 1e-37)
    binned = windows.filter(F.col("frames") == window_frames).select(stream, F.greatest(F.lit(0), F.least(F.lit(BINS - 1), val.cast("int"))).alias("bin"))
    return binned.groupBy(stream, "bin").agg(F.count("*").alias("cnt"))


def percentile_gain(hist: DataFrame, stream: str) -> DataFrame:
    """stream and gain_db: the highest bin at which the count from the top reaches 5 % of the windows."""
    n = F.sum("cnt").over(Window.partitionBy(stream))
    top = F.sum("cnt").over(Window.partitionBy(stream).orderBy(F.desc("bin")))
    reached = hist.withColumn("n", n).withColumn("top", top).filter(F.col("top") >= F.ceil(F.col("n") * (1.0 - 0.95)))
    return reached.groupBy(stream).agg((F.lit(PINK_REF) - F.max("bin") / F.lit(float(STEPS_PER_DB))).alias("gain_db"))


def gain_percentile(samples: DataFrame, stream: str, window_frames: int) -> DataFrame:
    gains = percentile_gain(rms_hist(samples, stream, window_frames), stream)
    return samples.select(stream).distinct().join(gains, stream, "left")
