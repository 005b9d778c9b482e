"""Minute rollups of the metric and prediction logs, kept by micro-batches.

Each batch writes what it adds to its minutes: sums, counts, extremes, a KLL
sketch of the values and a theta sketch of the drivers.  All of these merge, so
a dashboard over any window reads the rollup's minutes and not the log, and a
batch that is run again replaces its own folder.  Records that come after their
minute was thought closed are added like any other; what they change is written
beside the rollup, with the minute's totals before and after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

c = F.col
#: Sketch sizes: a KLL rank is off by about 1.3 % with ``k`` 200; theta counts are exact up to ``2 ** 16`` drivers.
KLL_K, THETA_LG = 200, 16
POINT_KEYS = ["metric_name", "function_name"]


def point_partials(points: DataFrame) -> DataFrame:
    """What metric points add to their minutes."""
    return points.groupBy(F.date_trunc("minute", "ts").alias("minute"), *POINT_KEYS).agg(
        F.sum("metric_value").alias("total"), F.count("metric_value").alias("n"), F.min("metric_value").alias("low"),
        F.max("metric_value").alias("high"), F.kll_sketch_agg_double(c("metric_value").cast("double"), F.lit(KLL_K)).alias("values"),
    )


def driver_partials(predictions: DataFrame) -> DataFrame:
    """What prediction records add to their minutes: averages' sums, and who was seen."""
    return predictions.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.sum("pitstop_probability").alias("total"), F.count("pitstop_probability").alias("n"), F.min("pitstop_probability").alias("low"),
        F.max("pitstop_probability").alias("high"), F.theta_sketch_agg(c("driver_number").cast("long"), F.lit(THETA_LG)).alias("drivers"),
    )


def merged(partials: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Partials added up by ``keys``."""
    sums = [F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    sketches = {"values": F.kll_merge_agg_double("values").alias("values"), "drivers": F.theta_union_agg("drivers", F.lit(THETA_LG)).alias("drivers")}
    return partials.groupBy(*keys).agg(*sums, *[s for n, s in sketches.items() if n in partials.columns])


def keep_rollup(
    stream: DataFrame, partials: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, delay: str = "10 minutes", seconds: int | None = None
) -> StreamingQuery:
    """Keep the rollup under ``path``; ``seconds=None`` adds what is there and stops.

    Minutes more than ``delay`` behind the newest of earlier batches count as
    closed; a batch that adds to one corrects it.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        partials(batch.where("ts IS NOT NULL")).write.mode("overwrite").parquet(f"{path}/partials/batch={batch_id}")
        every = spark.read.parquet(f"{path}/partials")
        added, earlier = every.where(c("batch") == batch_id), every.where(c("batch") < batch_id)
        keys = [n for n in ("minute", *POINT_KEYS) if n in every.columns]
        closed = earlier.agg(F.max("minute") - F.expr(f"INTERVAL {delay}")).scalar()
        late = added.where(c("minute") < closed)
        was = merged(earlier.join(late.select(*keys).distinct(), keys, "left_semi"), keys).select(*keys, c("total").alias("total_before"), c("n").alias("n_before"))
        now = late.join(was, keys, "left").select(
            *keys, F.coalesce("total_before", F.lit(0.0)).alias("total_before"), F.coalesce("n_before", F.lit(0)).alias("n_before"),
            (F.coalesce("total_before", F.lit(0.0)) + F.coalesce("total", F.lit(0.0))).alias("total_after"),
            (F.coalesce("n_before", F.lit(0)) + c("n")).alias("n_after"),
        )
        now.write.mode("overwrite").parquet(f"{path}/corrections/batch={batch_id}")

    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**when).start()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The partials of all minutes; what reads them merges them."""
    return spark.read.parquet(f"{path}/partials").drop("batch")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """Closed minutes that late records changed, by batch."""
    return spark.read.parquet(f"{path}/corrections")


# dashboards from the rollup ------------------------------------------------------


def _sized(partials: DataFrame, metric: str, size: str) -> DataFrame:
    return partials.where(c("metric_name") == metric).withColumn("bucket", F.date_trunc(size, "minute"))


def metric_totals(partials: DataFrame, metric: str, name: str, size: str = "hour") -> DataFrame:
    """Sum of a metric by function and bucket."""
    return merged(_sized(partials, metric, size), ["bucket", "function_name"]).select("bucket", "function_name", c("total").alias(name))


def metric_percentile(partials: DataFrame, metric: str, p: float, name: str, size: str = "hour") -> DataFrame:
    """Percentile of a metric by function and bucket, from sketches; see ``KLL_K`` for its error."""
    found = merged(_sized(partials, metric, size), ["bucket", "function_name"])
    return found.select("bucket", "function_name", F.kll_sketch_get_quantile_double("values", F.lit(p)).alias(name))


def drivers_between(partials: DataFrame, start: Column, end: Column) -> DataFrame:
    """A sketch of the drivers seen from ``start`` on and before ``end``."""
    return partials.where((c("minute") >= start) & (c("minute") < end)).agg(F.theta_union_agg("drivers", F.lit(THETA_LG)).alias("drivers"))


def drivers_lost(partials: DataFrame, minutes: int, now: Column) -> DataFrame:
    """``seen, before, lost``: drivers of the last ``minutes``, of those before them, and who is of these only."""
    length = F.make_dt_interval(mins=F.lit(minutes))
    seen = drivers_between(partials, now - length, now).select(c("drivers").alias("now_seen"))
    before = drivers_between(partials, now - length - length, now - length).select(c("drivers").alias("was_seen"))
    number = lambda s: F.coalesce(F.theta_sketch_estimate(s), F.lit(0))
    gone = F.when(c("now_seen").isNull(), number("was_seen")).otherwise(number(F.theta_difference("was_seen", "now_seen")))
    return seen.crossJoin(before).select(number("now_seen").alias("seen"), number("was_seen").alias("before"), F.coalesce(gone, F.lit(0)).alias("lost"))

