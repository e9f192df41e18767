"""Structured Streaming over feeds of events (event_id, ts, user_id, value, ...).

``tumbling`` has a watermark, so its state is bounded by the windows that are still open; late rows beyond it are
dropped by Spark, as a watermark means. ``loudness_windows`` keeps for each user the windows that aren't full yet.
``drain`` runs a streaming frame over what is there and returns the result as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonearm.shared import temporary


def feed(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The Parquet files of a path, a folder or a single file, as a stream in the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    pattern = path if path.endswith("*") else f"{path[:-1]}[{path[-1]}]"  # a plain path to a file is refused
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, n and total of each window of time."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = timed.groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, stop and n of each run of events with no longer pause than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    per = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once, with state for as long as a repetition may still come."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def loudness_windows(events: DataFrame, frames: int) -> DataFrame:
    """user_id, window_no and power (the mean square) of each full window of ``frames`` events, in the order of arrival.

    The state of a user is the number of events seen, and the sum and count of the open window.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, count, power = state.get if state.exists else (0, 0, 0.0)
        out = []
        for batch in batches:
            for value in batch.sort_values("event_id")["value"]:
                count, power = count + 1, power + value * value
                if count == frames:
                    out.append((key[0], number, power / frames))
                    number, count, power = number + 1, 0, 0.0
        state.update((number, count, power))
        yield pd.DataFrame(out, columns=["user_id", "window_no", "power"])

    rows = events.select("user_id", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, window_no bigint, power double", "number bigint, count bigint, power double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available into the shared folder and returns what came out."""
    spark = stream.sparkSession
    at = temporary(spark)
    if mode == "append":
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/log").format("parquet").option("path", f"{at}/out").outputMode("append").start()
    else:  # each batch holds the whole result: the last one stands
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/log").foreachBatch(write).outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
