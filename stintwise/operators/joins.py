"""Joins between telemetry tables.

Sides that grow with the data carry no broadcast hint: Spark broadcasts them at
run time when their measured size is under its threshold, and shuffles them
otherwise.  Only the fixed tables of ``dimensions`` are hinted or inlined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.dimensions import COUNTRY_CIRCUIT, DEFAULT_STRENGTH, TEAM_STRENGTH, driver_grid, lookup
from stintwise.functions.parsing import parse_gap, parse_gap_or_null, rain_flag
from stintwise.operators.series import series, with_running
from stintwise.operators.snapshots import newest_by_key

c = F.col
DRIVER = ["session_key", "driver_number"]
SC_LENGTH = 5


def salted_lookup(df: DataFrame, one_per_key: DataFrame, keys: list[str], vary: list[str], salts: int = 32) -> DataFrame:
    """Left join of many rows to one row per key, spreading a hot key over ``salts`` tasks.

    ``vary`` are columns that differ within a key.  The small side is repeated per salt.
    """
    left = df.withColumn("_salt", F.pmod(F.hash(*vary), F.lit(salts)))
    right = one_per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


# lap-level statistics -------------------------------------------------------


def gap_stats(df: DataFrame) -> DataFrame:
    """Sample deviation of the gaps and number of cars per session and lap."""
    gap = parse_gap_or_null(c("gap_to_leader"))
    return df.groupBy("session_key", "lap_number").agg(
        F.stddev_samp(gap).alias("gap_variance"), F.count(F.lit(1)).alias("cars_on_track")
    )


def join_gap_stats(df: DataFrame) -> DataFrame:
    return df.join(gap_stats(df), ["session_key", "lap_number"], "left")


# laps and stints ------------------------------------------------------------


def stint_blocks(laps: DataFrame, stints: DataFrame, block: int) -> DataFrame:
    """``_stints`` per driver and block of laps: the distinct stints that touch it, in the order that decides.

    An open stint ends with its driver's last lap, so a stint is repeated for the
    blocks that its driver drove and no more.
    """
    last = laps.groupBy(*DRIVER).agg(F.max("lap_number").alias("_last"))
    end = F.least(F.coalesce("lap_end", "_last"), c("_last"))
    pieces = (
        stints.select(*DRIVER, "stint_number", "lap_start", "lap_end", "compound")
        .join(last, DRIVER)
        .where(c("lap_start") <= end)
        .withColumn("_block", F.explode(F.sequence(F.floor(c("lap_start") / block), F.floor(end / block))))
    )
    # collect_set folds copies; a block of laps meets few stints.
    return pieces.groupBy(*DRIVER, "_block").agg(
        F.collect_set(F.struct("stint_number", "lap_start", "lap_end", "compound")).alias("_stints")
    )


def stint_columns(lap: Column, stints: Column) -> dict[str, Column]:
    """Tyre age, stint and compound from the first of ``stints`` that holds a lap, with defaults where none does."""
    holds = F.filter(stints, lambda s: (s["lap_start"] <= lap) & (s["lap_end"].isNull() | (lap <= s["lap_end"])))
    # Equal starts: the shorter stint first, an open one last.
    by_end = F.transform(
        holds,
        lambda s: F.struct(
            s["stint_number"].alias("stint_number"), s["lap_start"].alias("lap_start"), s["lap_end"].isNull().alias("open"),
            s["lap_end"].alias("lap_end"), s["compound"].alias("compound"),
        ),
    )
    first = F.array_min(by_end)
    return {
        "tyre_age": F.greatest(F.lit(0), lap - F.coalesce(first["lap_start"], F.lit(1))).cast("int"),
        "tyre_compound": F.when(first.isNull(), F.lit("UNKNOWN")).otherwise(first["compound"]),
        "stint_number": F.coalesce(first["stint_number"], F.lit(1)),
    }


def join_stint_for_lap(laps: DataFrame, stints: DataFrame, block: int = 32, driven: DataFrame | None = None) -> DataFrame:
    """First stint that contains each lap, with defaults where none does.

    ``driven`` is a cheaper frame with the same drivers and last laps, if there is one.

    A range join turned into an equi-join on driver and block of laps: the laps are
    exchanged once, and a driver with very many laps spreads over its blocks.
    """
    blocked = laps.withColumn("_block", F.floor(c("lap_number") / block))
    joined = blocked.join(stint_blocks(laps if driven is None else driven, stints, block), [*DRIVER, "_block"], "left")
    return joined.withColumns(stint_columns(c("lap_number"), c("_stints"))).drop("_block", "_stints")


# intervals, pits, safety car ------------------------------------------------


def join_interval_by_lap(laps: DataFrame, intervals: DataFrame) -> DataFrame:
    """Gap recorded for the lap; of several records the newest counts; default 0."""
    newest = (
        intervals.where(c("lap_number").isNotNull())
        .groupBy(*DRIVER, "lap_number")
        .agg(F.max_by(parse_gap(c("gap_to_leader")), "date").alias("_gap"))
    )
    return (
        laps.join(newest, [*DRIVER, "lap_number"], "left")
        .withColumn("gap_to_leader", F.coalesce("_gap", F.lit(0.0)))
        .drop("_gap")
    )


def _flag(df: DataFrame, marks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """1 where the row's key is among ``marks``, else 0."""
    return (
        df.join(marks.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
        .withColumn(name, F.coalesce(c("_hit"), F.lit(0)))
        .drop("_hit")
    )


def flag_did_pit(laps: DataFrame, pit: DataFrame) -> DataFrame:
    return _flag(laps, pit, [*DRIVER, "lap_number"], "did_pit")


def _laps_before(marks: DataFrame, first: int, last: int) -> DataFrame:
    """Laps from which a mark lies ``first`` to ``last`` laps ahead."""
    return marks.withColumn(
        "lap_number", F.explode(F.sequence(c("lap_number") - last, c("lap_number") - first))
    )


def label_pit_within_3(laps: DataFrame, pit: DataFrame) -> DataFrame:
    ahead = _laps_before(pit.select(*DRIVER, "lap_number").where("lap_number is not null").distinct(), 1, 3)
    return _flag(laps, ahead, [*DRIVER, "lap_number"], "pitstop_within_3_laps")


def safety_car_laps(race_control: DataFrame) -> DataFrame:
    """Laps under a safety car: the lap of the message and the four after it."""
    called = race_control.where(F.upper("message").contains("SAFETY CAR") & (F.coalesce("lap_number", F.lit(0)) != 0))
    start = c("lap_number")
    return (
        called.select("session_key", "lap_number")
        .distinct()
        .select("session_key", F.explode(F.sequence(start, start + SC_LENGTH - 1)).alias("lap_number"))
        .distinct()
    )


def label_sc_within_5(laps: DataFrame, race_control: DataFrame) -> DataFrame:
    ahead = _laps_before(safety_car_laps(race_control), 1, 5)
    return _flag(laps, ahead, ["session_key", "lap_number"], "safety_car_within_5_laps")


# weather --------------------------------------------------------------------


def latest_weather(weather: DataFrame) -> DataFrame:
    return newest_by_key(weather, ["session_key"], "date", ["air_temperature", "track_temperature", "rainfall"])


def weather_columns() -> dict[str, Column]:
    return {
        "air_temperature": F.coalesce("air_temperature", F.lit(25.0)),
        "track_temperature": F.coalesce("track_temperature", F.lit(35.0)),
        "rainfall": rain_flag(c("rainfall")),
    }


def latest_weather_per_driver(laps: DataFrame, weather: DataFrame) -> DataFrame:
    """The session's newest reading for each of its drivers: one small row per driver."""
    drivers = laps.select(*DRIVER).distinct()
    return drivers.join(latest_weather(weather), "session_key", "left")


def join_latest_weather(laps: DataFrame, weather: DataFrame) -> DataFrame:
    """The session's newest reading on every lap; 25 / 35 / dry where there is none."""
    plain = laps.drop("air_temperature", "track_temperature", "rainfall")
    joined = salted_lookup(plain, latest_weather(weather), ["session_key"], ["driver_number", "lap_number"])
    return joined.withColumns(weather_columns())


def asof_weather(laps: DataFrame, weather: DataFrame) -> DataFrame:
    """The newest reading at or before each lap, null before the first.

    Both feeds are put into one time order per session, and the last reading is
    carried forward; a reading at the very time of a lap counts.
    """
    reading = F.struct("air_temperature", "track_temperature", "rainfall")
    plain = laps.drop("air_temperature", "track_temperature", "rainfall")
    both = weather.select(
        "session_key", c("date").alias("event_time"), F.lit(0).alias("_kind"), "event_id", reading.alias("_reading")
    ).unionByName(plain.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    timed = series(both, ["session_key"], ["event_time", "_kind", "event_id", "driver_number"])
    carried = with_running(timed, lasts={"_weather": c("_reading")})
    return carried.where(c("_kind") == 1).select(
        *plain.columns,
        c("_weather.air_temperature").alias("air_temperature"),
        c("_weather.track_temperature").alias("track_temperature"),
        c("_weather.rainfall").alias("rainfall"),
    )


# dimensions -----------------------------------------------------------------


def join_driver_grid(df: DataFrame) -> DataFrame:
    """Name, team and nationality from the 22-row grid."""
    grid = driver_grid(df.sparkSession).withColumnRenamed("team", "_team")
    return (
        df.join(F.broadcast(grid), "driver_number", "left")
        .withColumns(
            {
                "driver_name": F.coalesce("name", F.concat(F.lit("Driver #"), c("driver_number").cast("string"))),
                "team": F.coalesce("_team", F.lit("Unknown")),
            }
        )
        .drop("name", "_team")
    )


def join_team_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("team_score", lookup(c("team"), TEAM_STRENGTH, DEFAULT_STRENGTH))


def join_circuit(df: DataFrame) -> DataFrame:
    return df.withColumn("circuit_key", lookup(c("country_name"), COUNTRY_CIRCUIT, ""))


# scores ---------------------------------------------------------------------


def attach_scores(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by key; rows without one get probability and confidence 0.

    Copies of a score are folded first, on the partitioning the join needs.
    """
    keys = [*DRIVER, "lap_number"]
    both = F.struct("pitstop_probability", "confidence")
    one = scores.groupBy(*keys).agg(F.max(both).alias("_s")).select(*keys, "_s.*")
    return features.join(one, keys, "left").fillna(0.0, ["pitstop_probability", "confidence"])


def latest_session_predictions(predictions: DataFrame) -> DataFrame:
    """Predictions of the session that was scored last."""
    newest = predictions.agg(F.max_by("session_key", F.struct("ts", "session_key")).alias("session_key"))
    return predictions.where(c("session_key") == newest.scalar())


def prediction_vs_actual(predictions: DataFrame, pit: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Predicted stops against stops made in the next three laps, per session."""
    labelled = label_pit_within_3(predictions, pit)
    said = c("pitstop_probability") > threshold
    made = c("pitstop_within_3_laps") == 1
    return labelled.groupBy("session_key").agg(
        F.count_if(said & made).alias("hits"),
        F.count_if(said & ~made).alias("false_alarms"),
        F.count_if(~said & made).alias("misses"),
        F.count_if(~said & ~made).alias("correct_rejections"),
    )
