"""Pit-stop feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from stintwise.functions.features import derived, tyre_stress
from stintwise.functions.parsing import compound_flags, parse_gap_or_null, rain_flag
from stintwise.operators.laps import pit_count_so_far, prior_mean, zero_if_null
from stintwise.operators.series import lap_series, with_frames, with_running

c = F.col

# The columns of the feature table, in the order readers of it expect.
FEATURE_TABLE = [
    "session_key",
    "driver_number",
    "lap_number",
    "tyre_age",
    "stint_number",
    "gap_to_leader",
    "air_temperature",
    "track_temperature",
    "rainfall",
    "sector_delta",
    "tyre_age_sq",
    "heat_deg_interaction",
    "wet_stint",
    "abs_sector_delta",
    "deg_rate",
    "gap_trend",
    "rolling_sector_delta_5",
    "tyre_stress_index",
    "compound_soft",
    "compound_medium",
    "compound_hard",
    "pitstop_within_3_laps",
    "tyre_compound",
    "event_time",
]


def project_pitstop_features(df: DataFrame) -> DataFrame:
    return df.select(*FEATURE_TABLE)


def build_pitstop_features(laps: DataFrame) -> DataFrame:
    """One row per driver and lap with all features and the three-lap label.

    All windows share one ``(session, driver)`` order by lap, so the laps are
    exchanged once and sorted once.  Frames reach 8 laps back (five deltas, each
    over three laps) and 3 ahead.
    """
    narrow = laps.select(
        "session_key",
        "driver_number",
        "lap_number",
        "event_time",
        "tyre_compound",
        "duration_sector_1",
        "did_pit",
        "pit_lap",
        "air_temperature",
        "track_temperature",
        parse_gap_or_null(c("gap_to_leader")).alias("gap_to_leader"),
        rain_flag(c("rainfall")).alias("rainfall"),
    )
    by_lap = lap_series(narrow)
    stints = with_running(by_lap, sums={"_pits": pit_count_so_far()}, lasts={"_last_pit": c("pit_lap")})
    aged = stints.withColumns(
        {
            "tyre_age": F.coalesce(c("lap_number") - c("_last_pit"), F.lit(0)),
            "stint_number": (c("_pits") + 1).cast("int"),
        }
    )

    def pace(rows: DataFrame, w: WindowSpec) -> DataFrame:
        s1 = c("duration_sector_1")
        deltas = rows.withColumns(
            {
                "sector_delta": zero_if_null(s1 - prior_mean(s1, w, 3)),
                "gap_trend": zero_if_null(c("gap_to_leader") - F.lag("gap_to_leader", 3).over(w)),
                "pitstop_within_3_laps": F.coalesce(F.max("did_pit").over(w.rowsBetween(1, 3)), F.lit(0)).cast("int"),
            }
        )
        return deltas.withColumns(
            {
                "deg_rate": zero_if_null(c("sector_delta") - F.lag("sector_delta", 1).over(w)),
                "rolling_sector_delta_5": zero_if_null(prior_mean(F.abs("sector_delta"), w, 5)),
            }
        )

    paced = with_frames(by_lap.replace(aged), pace, before=8, after=3)
    full = paced.withColumns(
        derived(c("tyre_age"), c("stint_number"), c("track_temperature"), c("rainfall"), c("sector_delta"))
        | {"tyre_stress_index": tyre_stress(c("tyre_age"), c("rolling_sector_delta_5"))}
        | compound_flags(c("tyre_compound"))
    )
    return project_pitstop_features(full)


def engineer_features(rows: DataFrame) -> DataFrame:
    """Training variant, over rows that already hold the seven raw features.

    The rolling mean includes the lap itself here.
    """

    def pace(laps: DataFrame, w: WindowSpec) -> DataFrame:
        return laps.withColumns(
            {
                "deg_rate": zero_if_null(c("sector_delta") - F.lag("sector_delta", 1).over(w)),
                "gap_trend": zero_if_null(c("gap_to_leader") - F.lag("gap_to_leader", 3).over(w)),
                "rolling_sector_delta_5": F.avg(F.abs("sector_delta")).over(w.rowsBetween(-4, 0)),
            }
        )

    rolled = with_frames(lap_series(rows), pace, before=4)
    return rolled.withColumns(
        derived(c("tyre_age"), c("stint_number"), c("track_temperature"), c("rainfall"), c("sector_delta"))
        | {"tyre_stress_index": tyre_stress(c("tyre_age"), c("rolling_sector_delta_5"))}
        | compound_flags(c("tyre_compound"))
    )
