"""Training rows from recorded sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.functions.parsing import parse_gap
from stintwise.operators.joins import (
    DRIVER,
    join_stint_for_lap,
    label_sc_within_5,
    latest_weather,
    weather_columns,
)
from stintwise.operators.laps import sector_delta_history
from stintwise.operators.series import lap_series, with_totals

# The columns of a training row, in file order.
ROW = [
    "session_key",
    "driver_number",
    "lap_number",
    "event_time",
    "tyre_age",
    "stint_number",
    "tyre_compound",
    "gap_to_leader",
    "air_temperature",
    "track_temperature",
    "rainfall",
    "sector_delta",
    "lap_duration",
    "did_pit",
    "pitstop_within_3_laps",
    "safety_car_within_5_laps",
    "total_laps",
]


def lap_marks(intervals: DataFrame, pit: DataFrame) -> DataFrame:
    """What is recorded of a lap, a row per driver and lap: its newest gap, whether it ends in a stop, whether one is near."""
    none = {"_gap": F.lit(None).cast("double"), "_date": F.lit(None).cast("timestamp")}
    gaps = intervals.select(
        *DRIVER, "lap_number", parse_gap(F.col("gap_to_leader")).alias("_gap"), F.col("date").cast("timestamp").alias("_date"),
        F.lit(0).alias("_pit"), F.lit(0).alias("_soon"),
    )
    # A stop marks its own lap, and the three laps before it as close to a stop.
    ahead = F.col("_ahead")
    stops = pit.select(*DRIVER, "lap_number", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_ahead")).select(
        *DRIVER, (F.col("lap_number") - ahead).alias("lap_number"), *[v.alias(n) for n, v in none.items()],
        (ahead == 0).cast("int").alias("_pit"), (ahead > 0).cast("int").alias("_soon"),
    )
    return (
        gaps.unionByName(stops)
        .where("lap_number IS NOT NULL")
        .groupBy(*DRIVER, "lap_number")
        .agg(F.max_by("_gap", "_date").alias("_gap"), F.max("_pit").alias("_pit"), F.max("_soon").alias("_soon"))
    )


def build_training_rows(
    laps: DataFrame,
    stints: DataFrame,
    intervals: DataFrame,
    pit: DataFrame,
    weather: DataFrame,
    race_control: DataFrame,
    places: int | None = 3,
) -> DataFrame:
    """One row per driver and lap with features and both labels.

    The laps are exchanged three times: by driver and lap for all that is recorded
    of a lap, by driver and block of laps for the stint, and by driver for the lap
    count and the pace window.  Readings and safety-car laps are few per session
    and usually broadcast.
    """
    narrow = laps.select(*DRIVER, "lap_number", "event_time", "duration_sector_1", "lap_duration")
    rows = narrow.join(lap_marks(intervals, pit), [*DRIVER, "lap_number"], "left").withColumns(
        {
            "gap_to_leader": F.coalesce("_gap", F.lit(0.0)),
            "did_pit": F.coalesce("_pit", F.lit(0)),
            "pitstop_within_3_laps": F.coalesce("_soon", F.lit(0)),
        }
    )
    rows = join_stint_for_lap(rows.drop("_gap", "_pit", "_soon"), stints, driven=laps)
    by_lap = lap_series(rows, measure=laps.select(*DRIVER))
    rows = with_totals(by_lap.replace(rows), {"total_laps": F.count(F.lit(1))})
    rows = sector_delta_history(rows, places, by_lap.replace(rows))
    rows = rows.join(latest_weather(weather), "session_key", "left").withColumns(weather_columns())
    rows = label_sc_within_5(rows, race_control)
    return rows.select(*[F.col(x) for x in ROW])
