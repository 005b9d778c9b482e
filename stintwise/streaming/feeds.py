"""Continuous versions of the telemetry state, on Structured Streaming.

State is keyed by driver or session and holds one row per key, so it is bounded
by the number of keys; a recency limit (45 s, 3 min, 5 min) is a filter on what
is read out, not on what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stintwise.functions.scoring import ALERT_ABOVE
from stintwise.operators.snapshots import newest_by_key
from stintwise.session import remove

c = F.col
DRIVER = ["session_key", "driver_number"]
CAR_SECONDS = 45
POSITION_SECONDS = 180
WEATHER_SECONDS = 300


def incremental_files(
    spark: SparkSession,
    folder: str,
    schema: str,
    fmt: str = "json",
    pattern: str = "*",
    files_per_batch: int = 1000,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream; what was read is remembered by the query's checkpoint.

    A batch is bounded by a number of files, or by their size when given.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if bytes_per_batch is None:
        return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)
    return reader.option("maxBytesPerTrigger", bytes_per_batch).load(folder)


# sinks ----------------------------------------------------------------------


def log_delivery(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = 60) -> StreamingQuery:
    """GZIP JSON delivery every ``seconds``; ``None`` delivers what is there and stops.

    Batch size is bounded at the source (see ``incremental_files``).
    """
    writer = stream.writeStream.format("json").option("compression", "gzip").option("checkpointLocation", checkpoint)
    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.option("path", path).trigger(**when).start()


def state_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    seconds: int | None = None,
    mode: str = "update",
    keys: list[str] | None = None,
    compact_every: int = 50,
) -> StreamingQuery:
    """Changed rows of each micro-batch under their own folder.  A replayed batch replaces its folder.

    With ``keys``, every ``compact_every``-th folder holds the newest state of all
    keys, and what lies before the last such folder but one is removed: the table
    keeps two generations, from the older of which a replayed batch is made again.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not keys or batch_id == 0 or batch_id % compact_every:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            return
        earlier = spark.read.parquet(path).where(c("batch") < batch_id)
        known = earlier.unionByName(batch.withColumn("batch", F.lit(batch_id)))
        rest = [x for x in known.columns if x not in (*keys, "batch")]
        newest_by_key(known, keys, "batch", rest).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        oldest = batch_id - compact_every
        for r in earlier.where(c("batch") < oldest).select("batch").distinct().collect():  # two generations at most
            remove(spark, f"{path}/batch={r.batch}")

    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**when)
        .start()
    )


def read_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest state of each key."""
    rows = spark.read.parquet(path)
    return newest_by_key(rows, keys, "batch", [x for x in rows.columns if x not in (*keys, "batch")])


def on_new_raw(stream: DataFrame, action, checkpoint: str) -> StreamingQuery:
    """Run ``action(batch, batch_id)`` once for the files that have arrived since the last run."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# state ----------------------------------------------------------------------


def car_state(stream: DataFrame) -> DataFrame:
    """Newest car telemetry of each driver."""
    return newest_by_key(stream, DRIVER, "date")


def live_positions(stream: DataFrame) -> DataFrame:
    """Newest track position of each driver."""
    return newest_by_key(stream, DRIVER, "date", ["date", "x", "y"])


def weather_state(stream: DataFrame) -> DataFrame:
    """Newest weather reading of each session."""
    return newest_by_key(stream, ["session_key"], "date")


def recent(state: DataFrame, seconds: int, now: Column | None = None, time: str = "date") -> DataFrame:
    """State rows not older than ``seconds`` at ``now`` (default: the newest row's time)."""
    end = state.agg(F.max(time)).scalar() if now is None else now
    return state.where(c(time) >= end - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))


def with_staleness(state: DataFrame, now: Column, seconds: int = WEATHER_SECONDS, time: str = "date") -> DataFrame:
    limit = now - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return state.withColumn("stale", c(time) < limit)


# events ---------------------------------------------------------------------


def alert_stream(stream: DataFrame, threshold: float = ALERT_ABOVE) -> DataFrame:
    """Every prediction above the threshold, each cycle anew."""
    return stream.where(c("pitstop_probability") > threshold)


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """First record of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def minute_averages(stream: DataFrame, value: str, name: str, delay: str = "10 minutes") -> DataFrame:
    """Average per driver and minute; records later than ``delay`` are dropped."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute"), "driver_name")
        .agg(F.avg(value).alias(name))
        .select(c("window.start").alias("bucket"), "driver_name", name)
    )
