"""The event log as a stream: distinct events, windows, and state of task queues.

Streams are files read with availableNow; each result is a table written under spark.checkpoint.dir, with the
stream's own checkpoint beside it, so a restarted stream goes on where it was. Event-time windows and watermarks are
additions of this library.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.sources.tables import shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder as a stream; a watermark needs a moment with a zone, so `ts` becomes one, in the session's zone."""
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; in the folder of an earlier run it goes on from there."""
    spark = stream.sparkSession
    out = folder or shared_folder(spark, f"stream-{name}")
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{out}/table")
    stream.writeStream.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/table/batch={k}")).option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/table")


def distinct_events(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def closed_windows(stream: DataFrame, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by window and kind, once a window is over for good."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def queue_outcomes(tasks: DataFrame, slots: int = 2, waiting: int = 20) -> DataFrame:
    """Tasks of each owner's queue: begun_at and state (done, refused). A queue is sequential, so it is one group's work."""

    def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
        free, queue, out = [0.0] * slots, [], []
        for r in pdf.sort_values(["at", "event_id"]).itertuples(index=False):
            queue = [b for b in queue if b > r.at]
            begin = max(r.at, min(free))
            if begin > r.at and len(queue) >= waiting:
                out.append((r.user_id, r.event_id, None, "refused"))
                continue
            free[free.index(min(free))] = begin + r.seconds
            queue += [begin] if begin > r.at else []
            out.append((r.user_id, r.event_id, begin, "done"))
        return pd.DataFrame(out, columns=["user_id", "event_id", "begun_at", "state"]).astype({"begun_at": "float64"})

    return tasks.groupBy("user_id").applyInPandas(simulate, "user_id long, event_id long, begun_at double, state string")
