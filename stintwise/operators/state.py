"""Latest state per driver or session, and the live feature vector built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.functions.features import derived, tyre_stress
from stintwise.functions.parsing import compound_flags, drs_active, parse_gap
from stintwise.operators.joins import DRIVER, join_driver_grid, latest_weather, salted_lookup, weather_columns
from stintwise.operators.laps import live_pace
from stintwise.operators.series import lap_series, short_lap_series, with_position
from stintwise.operators.snapshots import newest_by_key
from stintwise.schemas import MODEL_FEATURES

c = F.col


def newest_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "_newest") -> DataFrame:
    """The ``n`` newest rows of each key.  Spark trims to ``n`` rows per task before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(c(rank) <= n)


def group_by_driver(df: DataFrame, rows_per_part: int = 1024) -> DataFrame:
    """All records of each driver as ordered arrays, in parts of bounded length.

    A driver's race fits in part 0; a longer series continues in further parts.
    """
    placed = with_position(lap_series(df), "_pos")
    record = F.struct(*[x for x in df.columns if x not in DRIVER])
    part = F.floor((c("_pos") - 1) / rows_per_part).cast("int")
    return (
        placed.groupBy(*DRIVER, part.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("_pos", record.alias("r")))).alias("_rows"))
        .select(*DRIVER, "part", F.transform("_rows", lambda x: x["r"]).alias("records"))
    )


def latest_per_driver(df: DataFrame) -> DataFrame:
    """Newest record of each driver by date."""
    return newest_by_key(df, DRIVER, "date")


def completed_pits(pit: DataFrame) -> DataFrame:
    """Stops without the out-laps."""
    return pit.where(~F.coalesce("pit_out_lap", F.lit(False)))


def pit_summary(pit: DataFrame) -> DataFrame:
    """Number of stops, length of the last one (2 decimals) and its lap."""
    return (
        completed_pits(pit)
        .groupBy(*DRIVER)
        .agg(
            F.count(F.lit(1)).alias("pits_completed"),
            F.max_by(F.struct("pit_duration", "lap_number"), "lap_number").alias("_last"),
        )
        .select(
            *DRIVER,
            "pits_completed",
            F.round(F.nullif(c("_last.pit_duration"), F.lit(0.0)), 2).alias("last_pit_duration"),
            c("_last.lap_number").alias("last_pit_lap"),
        )
    )


def total_laps(laps: DataFrame) -> DataFrame:
    return laps.groupBy(*DRIVER).agg(F.count(F.lit(1)).alias("total_laps"))


def current_lap(df: DataFrame) -> DataFrame:
    return df.groupBy("session_key").agg(
        F.coalesce(F.max(F.nullif(c("lap_number"), F.lit(0))), F.lit(0)).alias("current_lap")
    )


# session flags --------------------------------------------------------------


def _flag_text() -> tuple[Column, Column]:
    blank = F.lit("")
    return F.upper(F.coalesce("flag", blank)), F.upper(F.coalesce("message", blank))


def safety_car_active(race_control: DataFrame) -> DataFrame:
    """Whether the newest deciding message puts a safety car on track."""
    flag, message = _flag_text()
    state = (
        F.when(flag.isin("SC", "VSC") | message.contains("SAFETY CAR"), True)
        .when((flag == "GREEN") | message.contains("GREEN FLAG"), False)
        .otherwise(None)
    )
    at = F.when(state.isNotNull(), F.struct("date", "event_id"))
    return race_control.groupBy("session_key").agg(
        F.coalesce(F.max_by(state, at), F.lit(False)).alias("safety_car_active")
    )


def race_finished(race_control: DataFrame) -> DataFrame:
    flag, message = _flag_text()
    return race_control.groupBy("session_key").agg(
        F.bool_or((flag == "CHEQUERED") | message.contains("CHEQUERED")).alias("race_finished")
    )


def stop_on_finish(df: DataFrame, race_control: DataFrame, time: str | None = None) -> DataFrame:
    """Rows of sessions whose race is still on; with ``time``, also those recorded before their race finished."""
    if time is None:
        over = race_finished(race_control).where("race_finished").select("session_key")
        return df.join(over, "session_key", "left_anti")
    flag, message = _flag_text()
    finish = race_control.where((flag == "CHEQUERED") | message.contains("CHEQUERED"))
    ends = finish.groupBy("session_key").agg(F.min("date").alias("_finish"))
    return df.join(ends, "session_key", "left").where(c("_finish").isNull() | (c(time) < c("_finish"))).drop("_finish")


# fallbacks ------------------------------------------------------------------


def stints_with_fallback(current: DataFrame, cached: DataFrame) -> DataFrame:
    """Current stints, and the cached ones of sessions whose feed is empty."""
    fed = current.select("session_key").distinct()
    return current.unionByName(cached.join(fed, "session_key", "left_anti"))


def last_good_predictions(current: DataFrame, last_good: DataFrame) -> DataFrame:
    """Current predictions, or a session's last good batch marked stale."""
    served = current.select("session_key").distinct()
    stale = last_good.join(served, "session_key", "left_anti").withColumn("stale", F.lit(True))
    return current.withColumn("stale", F.lit(False)).unionByName(stale)


# driver state and live features ---------------------------------------------


def current_stints(stints: DataFrame) -> DataFrame:
    row = F.struct("stint_number", "lap_start", "lap_end", "compound")
    return stints.groupBy(*DRIVER).agg(F.max_by(row, "stint_number").alias("stint"))


def _latest_lap(laps: DataFrame) -> DataFrame:
    return laps.groupBy(*DRIVER).agg(
        F.max("lap_number").alias("lap_number"), F.count(F.lit(1)).alias("laps_recorded")
    )


def driver_state(
    laps: DataFrame,
    stints: DataFrame,
    intervals: DataFrame,
    weather: DataFrame,
    pit: DataFrame,
    car_data: DataFrame,
) -> DataFrame:
    """Newest state of every driver with laps: one aggregate per feed, then joins of the small results."""
    gaps = intervals.groupBy(*DRIVER).agg(F.max_by(parse_gap(c("gap_to_leader")), "date").alias("_gap"))
    car = latest_per_driver(car_data).select(
        *DRIVER, F.struct("speed", "throttle", "brake", "drs", "n_gear").alias("_car")
    )
    state = (
        _latest_lap(laps)
        .join(current_stints(stints), DRIVER, "left")
        .join(gaps, DRIVER, "left")
        .join(pit_summary(pit), DRIVER, "left")
        .join(car, DRIVER, "left")
    )
    zero = F.lit(0)
    return (
        state.join(latest_weather(weather), "session_key", "left")
        .withColumns(weather_columns())
        .withColumns(
            {
                "stint_number": F.coalesce("stint.stint_number", F.lit(1)),
                "tyre_compound": F.when(c("stint").isNull(), "UNKNOWN").otherwise(c("stint.compound")),
                "gap_to_leader": F.coalesce("_gap", F.lit(0.0)),
                "pits_completed": F.coalesce("pits_completed", zero),
                "speed": F.coalesce("_car.speed", F.lit(0.0)),
                "throttle": F.coalesce("_car.throttle", zero),
                "brake": F.coalesce("_car.brake", zero),
                "gear": F.coalesce("_car.n_gear", zero),
                "drs_active": drs_active(c("_car.drs")),
            }
        )
        .drop("_gap", "_car")
    )


def tyre_age_live(laps: DataFrame, stints: DataFrame) -> DataFrame:
    """Length of the newest stint: its bounds when closed, else the laps driven in it."""
    laid = salted_lookup(
        laps.select(*DRIVER, "lap_number"), current_stints(stints), DRIVER, ["lap_number"]
    )
    start = F.coalesce("stint.lap_start", F.lit(0))
    return (
        laid.groupBy(*DRIVER)
        .agg(
            F.count_if(c("lap_number") >= start).alias("_in_stint"),
            F.count(F.lit(1)).alias("_all"),
            F.first("stint", ignorenulls=True).alias("stint"),
        )
        .select(
            *DRIVER,
            F.when(F.coalesce("stint.lap_end", F.lit(0)) != 0, c("stint.lap_end") - start)
            .otherwise(F.coalesce(F.nullif(c("_in_stint"), F.lit(0)), c("_all")))
            .cast("int")
            .alias("tyre_age"),
        )
    )


def gap_trend_live(intervals: DataFrame) -> DataFrame:
    """Newest gap against the one three records before; 0 with fewer than four or bad text."""
    four = newest_rows(intervals, DRIVER, [F.desc("date")], 4)
    text = F.coalesce(F.replace(c("gap_to_leader"), F.lit("+"), F.lit("")), F.lit("0")).try_cast("double")
    return four.groupBy(*DRIVER).agg(
        F.coalesce(F.max(F.when(c("_newest") == 1, text)) - F.max(F.when(c("_newest") == 4, text)), F.lit(0.0)).alias(
            "gap_trend"
        )
    )


def live_features(
    laps: DataFrame,
    stints: DataFrame,
    intervals: DataFrame,
    weather: DataFrame,
    pit: DataFrame,
    car_data: DataFrame,
) -> DataFrame:
    """The 18 model features and metadata of every driver at its newest lap.

    Pace needs only the six newest laps, so the rest never leaves the scan tasks.
    """
    times = laps.select(*DRIVER, "lap_number", "duration_sector_1")
    six = newest_rows(times, DRIVER, [F.desc("lap_number")], 6).drop("_newest")
    pace_names = ["sector_delta", "deg_rate", "rolling_sector_delta_5"]
    pace = newest_by_key(live_pace(six, short_lap_series(six)), DRIVER, "lap_number", pace_names)
    rows = (
        driver_state(laps, stints, intervals, weather, pit, car_data)
        .join(tyre_age_live(laps, stints), DRIVER, "left")
        .join(pace, DRIVER, "left")
        .join(gap_trend_live(intervals), DRIVER, "left")
        .fillna(0.0, ["gap_trend"])
    )
    full = rows.withColumns(
        derived(c("tyre_age"), c("stint_number"), c("track_temperature"), c("rainfall"), c("sector_delta"))
        | {"tyre_stress_index": tyre_stress(c("tyre_age"), c("rolling_sector_delta_5"))}
        | compound_flags(c("tyre_compound"))
    )
    return join_driver_grid(full).drop("stint", "nationality")


def feature_array(df: DataFrame) -> DataFrame:
    return df.withColumn("features", F.array(*[c(x).cast("double") for x in MODEL_FEATURES]))
