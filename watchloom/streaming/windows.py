"""Streaming jobs: events -> closed window features, as Structured Streaming queries.

State lives in Spark's state store, keyed by (entity, window) and dropped once the
watermark passes the window's end; offsets and state are in the checkpoint folder, so a
lost executor or a restart goes on from there and no window is emitted twice.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchloom.operators.analysis import with_running_max


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below a temporary one where that is unset (one machine)."""
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = there.get() if there.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="watchloom-", dir=os.environ.get("WATCHLOOM_TMP"))
    return f"{base}/stream-{uuid.uuid4().hex}"


def closed_window_features(events: DataFrame, size: str, lateness: str = "10 minutes") -> DataFrame:
    """Features of each (entity, window) once the watermark has passed its end; an event id counts once.

    Events later than the watermark are left out here (dispositions() says how many).
    Works on a stream (append mode); a null time or entity is no event.
    """
    x = events.where("ts is not null and entity_id is not null").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    bad = F.count_if(F.col("outcome") == "failure")
    return (
        x.groupBy("entity_id", F.window("ts", size).alias("w"))
        .agg(F.count(F.lit(1)).alias("attempts"), bad.alias("failures"), F.size(F.collect_set("host_id")).alias("distinct_devices"), F.size(F.collect_set("source_ip")).alias("distinct_ips"))
        .select("entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "attempts", "failures", (F.col("failures") / F.col("attempts")).alias("failure_rate"), "distinct_devices", "distinct_ips")
    )


def dispositions(events: DataFrame, arrival: str, received: str, lateness: str = "10 minutes", future: str = "5 minutes", by: str = "entity_id") -> DataFrame:
    """What becomes of each arrival: duplicate, future_rejected, late_accepted or added.

    The batch form of the stream's rules, for replays and for the counters: the first
    arrival of an event id counts, the watermark is the entity's running maximum of the
    times that were not in the future.
    """
    first = F.row_number().over(Window.partitionBy("event_id").orderBy(arrival))
    ahead = F.coalesce(F.col("ts") > F.col(received) + F.expr(f"interval {future}"), F.lit(False))
    x = events.withColumn("_n", first).withColumn("_ahead", ahead)
    x = with_running_max(x, "_newest", F.when((F.col("_n") == 1) & ~F.col("_ahead"), F.col("ts")), arrival, by)
    mark = F.col("_newest") - F.expr(f"interval {lateness}")
    told = F.when(F.col("_n") > 1, "duplicate").when(F.col("_ahead"), "future_rejected").when(F.col("ts") < mark, "late_accepted").otherwise("added")
    return x.withColumn("disposition", told).drop("_n", "_ahead", "_newest")


def start(features: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Appends closed windows to a Parquet folder; the sink's log makes each of them appear once."""
    out = features.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def replay(events: DataFrame, size: str, lateness: str = "10 minutes") -> DataFrame:
    """All that is there now through the streaming job, and the windows that it closed."""
    spark = events.sparkSession
    base = shared_folder(spark)
    features = closed_window_features(events, size, lateness)
    start(features, f"{base}/features", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(features.schema).parquet(f"{base}/features")
