"""Function logs and metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# The shapes of the log lines.
NOISE = r"^(START|END) RequestId"
REPORT = r"^REPORT RequestId"
PROBLEM = r"^\[?(ERROR|WARNING|CRITICAL)\]?\s*(.*)$"
LATENCY = r"ModelLatency:\s*(-?[0-9]+(?:\.[0-9]+)?)"
LATENCY_METRICS = ["InvocationLatency", "ModelLatency", "OverheadLatency"]


def drop_noise_logs(df: DataFrame) -> DataFrame:
    return df.where(~c("message").rlike(NOISE))


def _number(label: str, unit: str) -> Column:
    found = F.regexp_extract("message", rf"{label}: (-?[0-9]+(?:\.[0-9]+)?) {unit}", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def parse_report_lines(df: DataFrame) -> DataFrame:
    """Level, tag and numbers of each line; start and end lines are dropped."""
    m = c("message")
    report, problem = m.rlike(REPORT), m.rlike(PROBLEM)
    structured, latency = m.startswith("{"), m.rlike(LATENCY)
    init = F.when(report, _number("Init Duration", "ms"))
    model_us = F.when(latency, F.regexp_extract(m, LATENCY, 1).try_cast("double"))
    level = (
        F.when(report, "REPORT")
        .when(problem, F.regexp_extract(m, PROBLEM, 1))
        .when(structured, "INFO")
        .when(latency, "METRIC")
    )
    tag = (
        F.when(report & init.isNotNull(), "cold_start")
        .when(report, "function_report")
        .when(problem, "function_error")
        .when(structured, "structured_log")
        .when(latency, "model_latency")
    )
    rest = [x for x in df.columns if x != "message"]
    return drop_noise_logs(df).select(
        *rest,
        level.alias("log_level"),
        tag.alias("tag"),
        F.when(report, F.regexp_extract(m, r"RequestId: (\S+)", 1)).alias("request_id"),
        F.when(report, _number(r"RequestId: \S+\s+Duration", "ms")).alias("duration_ms"),
        F.when(report, _number("Billed Duration", "ms")).alias("billed_duration_ms"),
        F.when(report, _number("Memory Size", "MB")).cast("int").alias("memory_size_mb"),
        F.when(report, _number("Max Memory Used", "MB")).cast("int").alias("memory_used_mb"),
        init.alias("init_duration_ms"),
        F.when(problem, F.regexp_extract(m, PROBLEM, 2)).alias("error_message"),
        F.when(structured, F.from_json(m, "map<string,string>")).alias("parsed"),
        (model_us / 1000.0).alias("model_latency_ms"),
    )


def latency_to_ms(points: DataFrame) -> DataFrame:
    """Milliseconds next to the microseconds of the latency metrics; null for all others."""
    return points.withColumn(
        "metric_value_ms", F.when(c("metric_name").isin(LATENCY_METRICS), c("metric_value") / 1000.0)
    )


def has_errors(df: DataFrame, total: str) -> DataFrame:
    return df.withColumn("has_errors", c(total) > 0)
