"""Safety-car feature tables: one row per session and lap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions.parsing import parse_gap_or_null, rain_flag

c = F.col
LAP = ["session_key", "lap_number"]


def _incidents() -> Column:
    return F.sum(F.coalesce(c("had_incident").cast("int"), F.lit(0))).cast("int")


def _with_previous_five(per_lap: DataFrame) -> DataFrame:
    """Incidents of the laps ``n-5 .. n-1`` of the session, by lap number.

    Every lap with incidents adds to its next five laps.  Few laps have any, and
    the join runs on the ``(session, lap)`` partitioning the laps already have, so
    no session is gathered in one task.
    """
    ahead = (
        per_lap.where(c("_incidents") > 0)
        .select(
            "session_key",
            F.explode(F.sequence(c("lap_number") + 1, c("lap_number") + 5)).alias("lap_number"),
            "_incidents",
        )
        .groupBy(*LAP)
        .agg(F.sum("_incidents").cast("int").alias("incident_count_last_5_laps"))
    )
    return per_lap.join(ahead, LAP, "left").fillna(0, ["incident_count_last_5_laps"])


def incidents_last_5(laps: DataFrame) -> DataFrame:
    per_lap = laps.groupBy(*LAP).agg(_incidents().alias("_incidents"))
    return _with_previous_five(per_lap).select(*LAP, "incident_count_last_5_laps")


def build_safety_car_features(laps: DataFrame) -> DataFrame:
    """Every column of a lap is an aggregate over its cars, so the result does not depend on row order."""
    per_lap = laps.groupBy(*LAP).agg(
        F.stddev_samp(parse_gap_or_null(c("gap_to_leader"))).alias("gap_variance"),
        F.count(F.lit(1)).alias("cars_on_track"),
        F.max(rain_flag(c("rainfall"))).alias("rainfall"),
        _incidents().alias("_incidents"),
        F.max("yellow_flag_count").alias("yellow_flag_count"),
        F.max("circuit_id").alias("circuit_id"),
        F.max("total_laps").alias("total_laps"),
        F.max("safety_car_within_5_laps").alias("safety_car_within_5_laps"),
    )
    return _with_previous_five(per_lap).select(
        *LAP,
        "gap_variance",
        "cars_on_track",
        "rainfall",
        "incident_count_last_5_laps",
        "yellow_flag_count",
        "circuit_id",
        "total_laps",
        "safety_car_within_5_laps",
    )
