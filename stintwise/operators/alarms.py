"""Threshold alarms over metric series.

A period without data never breaches, so an alarm over ``n`` periods means that
all of the last ``n`` calendar periods are present and breaching.  Counting
breaches in a range frame over the period number says exactly that, without a
spine of empty periods; it runs on one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.quantiles import exact_percentile

c = F.col

COMPARE = {
    ">": lambda x, limit: x > limit,
    ">=": lambda x, limit: x >= limit,
    "<": lambda x, limit: x < limit,
    "<=": lambda x, limit: x <= limit,
}


def period_number(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


def period_start(number: Column, seconds: int) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=(number * seconds).cast("decimal(18,6)"))


def by_period(points: DataFrame, keys: list[str], seconds: int, stat: str) -> DataFrame:
    """One row per key and period with the statistic as ``value``."""
    numbered = points.withColumn("_period", period_number(c("ts"), seconds))
    at = [*keys, "_period"]
    if stat.startswith("p"):
        return exact_percentile(numbered, at, "metric_value", float(stat[1:]) / 100, "value")
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[stat]
    return numbered.groupBy(*at).agg(agg("metric_value").alias("value"))


def threshold_alarm(
    points: DataFrame,
    metric: str,
    stat: str,
    seconds: int,
    compare: str,
    threshold: float,
    periods: int = 1,
    keys: tuple[str, ...] = ("function_name",),
) -> DataFrame:
    """Value, breach and alarm state of every period that has data."""
    names = list(keys)
    per = by_period(points.where(c("metric_name") == metric), names, seconds, stat)
    breach = COMPARE[compare](c("value"), F.lit(threshold))
    w = Window.partitionBy(*names).orderBy("_period").rangeBetween(-(periods - 1), 0)
    return per.withColumn("breaching", breach).select(
        *names,
        period_start(c("_period"), seconds).alias("period_start"),
        "value",
        "breaching",
        (F.sum(c("breaching").cast("int")).over(w) == periods).alias("alarm"),
    )


def drift_alarm(points: DataFrame, seconds: int = 60, threshold: float = 0.65, periods: int = 10) -> DataFrame:
    """Mean confidence below the threshold in each of ten periods in a row."""
    return threshold_alarm(
        points, "PredictionConfidence", "avg", seconds, "<", threshold, periods, keys=("metric_name",)
    )


def error_alarm(points: DataFrame, seconds: int = 300, threshold: float = 5.0) -> DataFrame:
    return threshold_alarm(points, "Errors", "sum", seconds, ">", threshold)


def latency_alarm(points: DataFrame, seconds: int = 60, threshold: float = 15000.0, periods: int = 3) -> DataFrame:
    """p99 above the threshold in three periods in a row; ``threshold`` is in the metric's own unit."""
    return threshold_alarm(points, "ModelLatency", "p99", seconds, ">", threshold, periods)


def delivery_alarm(
    points: DataFrame,
    metric: str = "DeliverySuccess",
    seconds: int = 300,
    compare: str = ">",
    threshold: float = 0.0,
) -> DataFrame:
    """Fires on success above 0 as given; pass ``"<"`` and 1 to fire on failure."""
    return threshold_alarm(points, metric, "avg", seconds, compare, threshold)


def billing_alarm(points: DataFrame, metric: str = "EstimatedCharges", threshold: float = 10.0) -> DataFrame:
    """Highest charge of a day above the cap."""
    return threshold_alarm(points, metric, "max", 86400, ">", threshold)
