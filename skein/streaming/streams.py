"""Telemetry as streams: windows with watermarks, dead letters and state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUESTS = "id bigint, ts timestamp, key bigint, kind string, seconds double"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Stream of Parquet files of requests."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_metrics(requests: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and mean seconds per kind and window; rows later than the watermark are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return requests.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("avg_seconds")).select(F.col("w.start").alias("window_start"), "kind", "n", "avg_seconds")


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return requests.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("session_start"), "n")


def first_seen(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests without those that repeat an id within the watermark."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def failure_runs(requests: DataFrame) -> DataFrame:
    """Failures of each key since its last success, after every batch: ``(key, attempts, permanent)``.

    Within a batch rows are taken by time; the state of a key is one number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for kind in rows["kind"]:
            attempts = attempts + 1 if kind == "error" else 0
        state.update((attempts,))
        yield pd.DataFrame({"key": [key[0]], "attempts": [attempts], "permanent": [attempts >= 3]})

    return requests.groupBy("key").applyInPandasWithState(step, "key bigint, attempts bigint, permanent boolean", "attempts bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run over what is there and stop; the result is the in-memory table ``name``."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
