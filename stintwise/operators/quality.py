"""Validation, defaults, typing and flat projections of prediction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions.scoring import ALERT_ABOVE, pit_alert_tag
from stintwise.schemas import RAW_FEATURES

c = F.col


# columns --------------------------------------------------------------------


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The frame itself, or an error that names what is missing.  Reads no data."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def default_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Absent columns are added with their default; nulls of present ones are left alone."""
    return df.withColumns({n: F.lit(v) for n, v in defaults.items() if n not in df.columns})


def fill_features(df: DataFrame, names: list[str]) -> DataFrame:
    return df.fillna(0, names)


def conform_schema(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` in its order and types; values that do not fit become null, absent ones null."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(
        *[
            (c(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in fields
        ]
    )


# rows -----------------------------------------------------------------------


def filter_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.where(c("session_type").isin("Race", "Qualifying", "Sprint"))


def drop_empty_drivers(drivers: DataFrame, laps: DataFrame) -> DataFrame:
    """Drivers that have at least one lap."""
    keys = ["session_key", "driver_number"]
    return drivers.join(laps.select(*keys).distinct(), keys, "left_semi")


def validate_feature_arrays(df: DataFrame, size: int = 7) -> tuple[DataFrame, DataFrame]:
    """Rows with exactly ``size`` features, and the others with the reason."""
    fits = F.coalesce(F.size("features"), F.lit(-1)) == size
    reason = F.concat(F.lit("expected exactly "), F.lit(size), F.lit(" feature values, got "), F.coalesce(F.size("features").cast("string"), F.lit("none")))
    return df.where(fits), df.where(~fits).withColumn("error", reason)


def numeric_sessions(df: DataFrame, folder: str = "folder") -> DataFrame:
    """Sessions of log folders named ``..._<digits>``; other folders are skipped."""
    tail = F.element_at(F.split(c(folder), "_"), -1)
    return df.where(tail.rlike("^[0-9]+$")).withColumn("session_key", tail)


def cap_sessions(sessions: DataFrame, n: int) -> DataFrame:
    return sessions.orderBy("date_start", "session_key").limit(n)


# alerts ---------------------------------------------------------------------


def pit_alerts(df: DataFrame, threshold: float = ALERT_ABOVE) -> DataFrame:
    """Rows above the alert threshold with the message to send."""
    payload = F.to_json(
        F.struct(
            c("driver_name").alias("driver"),
            "team",
            "pitstop_probability",
            "tyre_compound",
            "tyre_age",
            "session_key",
            "commentary",
        )
    )
    subject = F.concat(c("driver_name"), F.lit(" is likely to stop soon"))
    return df.where(c("pitstop_probability") > threshold).select(
        "session_key",
        "driver_number",
        "lap_number",
        subject.alias("subject"),
        payload.alias("payload"),
    )


def tag_pit_alerts(df: DataFrame) -> DataFrame:
    return df.withColumn("tag", pit_alert_tag(c("pitstop_probability")))


def tag_training_runs(df: DataFrame) -> DataFrame:
    approved = F.coalesce("approved", F.lit(False))
    return df.withColumn("tag", F.when(approved, "model_approved").otherwise("model_rejected"))


# nested predictions ---------------------------------------------------------


def _feature(i: int, default: float | None = None) -> Column:
    x = F.get("features", F.lit(i))
    return x if default is None else F.coalesce(x, F.lit(default))


def format_prediction(df: DataFrame, *further: Column | str) -> DataFrame:
    """Flat prediction of the read API, with its defaults, and ``further`` columns."""
    zero, none = F.lit(0), F.lit(0.0)
    return df.select(
        "session_key",
        "driver_number",
        "driver_name",
        "team",
        "tyre_compound",
        _feature(0).alias("tyre_age"),
        F.coalesce("lap_number", zero).alias("lap_number"),
        F.coalesce("prediction.pitstop_probability", none).alias("pitstop_probability"),
        F.coalesce("prediction.confidence", none).alias("confidence"),
        F.coalesce("win_probability", none).alias("win_probability"),
        F.coalesce("pits_completed", zero).alias("pits_completed"),
        "last_pit_duration",
        "last_pit_lap",
        F.coalesce("drs_active", F.lit(False)).alias("drs_active"),
        F.coalesce("speed", none).alias("speed"),
        _feature(2, 0.0).alias("gap_to_leader"),
        *further,
    )


def prediction_events(df: DataFrame) -> DataFrame:
    """Flat 21-column event of each prediction; probabilities to 4 decimals, commentary to 4095 characters."""
    zero, none, blank = F.lit(0), F.lit(0.0), F.lit("")

    def to4(name: str) -> Column:
        return F.round(F.coalesce(name, none), 4)

    return df.select(
        F.lit("PitstopPrediction").alias("event_type"),
        "session_key",
        F.coalesce("driver_number", zero).alias("driver_number"),
        F.coalesce("driver_name", blank).alias("driver_name"),
        F.coalesce("team", blank).alias("team"),
        F.coalesce("tyre_compound", F.lit("UNKNOWN")).alias("tyre_compound"),
        _feature(0, 0.0).alias("tyre_age"),
        F.coalesce("lap_number", zero).alias("lap_number"),
        F.coalesce("pits_completed", zero).alias("pits_completed"),
        F.coalesce("last_pit_duration", none).alias("last_pit_duration"),
        F.coalesce("last_pit_lap", zero).alias("last_pit_lap"),
        F.coalesce("drs_active", F.lit(False)).alias("drs_active"),
        F.coalesce("speed", none).alias("speed"),
        F.coalesce("throttle", zero).alias("throttle"),
        F.coalesce("brake", zero).alias("brake"),
        F.coalesce("gear", zero).alias("gear"),
        to4("prediction.pitstop_probability").alias("pitstop_probability"),
        to4("prediction.confidence").alias("confidence"),
        to4("win_probability").alias("win_probability"),
        "safety_car_active",
        F.substring(F.coalesce("commentary", blank), 1, 4095).alias("commentary"),
    )


def features_to_columns(df: DataFrame) -> DataFrame:
    """The first seven features as columns; null when the array is shorter than seven."""
    full = F.size("features") >= 7
    return df.withColumns({n: F.when(full, _feature(i)) for i, n in enumerate(RAW_FEATURES)})


def cycle_summary(df: DataFrame, valid: Column, cycle: list[str]) -> DataFrame:
    """Per cycle: rows that could be scored, rows that failed, and whether nothing could be scored."""
    return df.groupBy(*cycle).agg(
        F.count_if(valid).alias("predictions_count"),
        F.count_if(~valid).alias("errors_count"),
        (F.count_if(valid) == 0).alias("stale"),
    )


def merge_live_and_catchup(live: DataFrame, catchup: DataFrame) -> DataFrame:
    """Both feeds of the same cycles without double counting; the live record wins."""
    keys = ["session_key", "driver_number", "ts"]
    both = live.withColumn("_order", F.lit(0)).unionByName(catchup.withColumn("_order", F.lit(1)))
    rest = [x for x in live.columns if x not in keys]
    return (
        both.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), c("_order")).alias("_r"))
        .select(*keys, "_r.*")
    )


def union_sessions(frames: list[DataFrame]) -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
