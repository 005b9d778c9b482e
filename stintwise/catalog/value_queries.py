"""Queries of projections, filters, defaults and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise import schemas
from stintwise.catalog.join_queries import STRATEGY
from stintwise.catalog.registry import query
from stintwise.catalog.tables import Tables
from stintwise.functions import parsing as P
from stintwise.functions import scoring as S
from stintwise.ml import encoding
from stintwise.operators import quality as Q
from stintwise.plans.pitstop import build_pitstop_features

c = F.col
DRIVER = ["session_key", "driver_number"]
KEY = [*DRIVER, "lap_number"]
LAPS = "session_key, driver_number, lap_number"


# filters --------------------------------------------------------------------


@query("SELECT session_key, session_type, country_name FROM f_sessions WHERE session_type IN ('Race', 'Qualifying', 'Sprint')")
def filter_sessions(t: Tables) -> DataFrame:
    return Q.filter_sessions(t.sessions).drop("date_start")


@query(
    """SELECT DISTINCT session_key, driver_number FROM f_base b WHERE EXISTS (SELECT 1 FROM f_laps l
    WHERE l.session_key = b.session_key AND l.driver_number = b.driver_number AND l.rainfall AND l.k % 24 = 0)"""
)
def drop_empty_drivers(t: Tables) -> DataFrame:
    """Only wet laps are taken as recorded, so some drivers have none."""
    drivers = t.feed.select(*DRIVER).distinct()
    return Q.drop_empty_drivers(drivers, t.laps.where("rainfall AND k % 24 = 0"))


@query(
    """SELECT session_key, driver_number, lap_number, driver_name || ' is likely to stop soon' AS subject,
    json_object('driver', driver_name, 'team', team, 'pitstop_probability', pitstop_probability, 'tyre_compound', tyre_compound,
      'tyre_age', tyre_age, 'session_key', session_key, 'commentary', commentary)::VARCHAR AS payload FROM f_predictions WHERE pitstop_probability > 0.85"""
)
def pit_alerts(t: Tables) -> DataFrame:
    return Q.pit_alerts(t.predictions)


@query(
    f"""SELECT {LAPS}, n_features, CASE WHEN n_features = 7 THEN NULL ELSE 'expected exactly 7 feature values, got ' || COALESCE(CAST(n_features AS VARCHAR(12)), 'none') END AS error FROM f_nested"""
)
def validate_feature_arrays(t: Tables) -> DataFrame:
    valid, rejected = Q.validate_feature_arrays(t.nested_predictions)
    columns = [*KEY, F.size("features").alias("n_features")]
    return valid.select(*columns, F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select(*columns, "error")
    )


@query(
    """SELECT CAST(session_key AS VARCHAR) AS session_key, COUNT(*) AS n FROM f_base WHERE k % 5 <> 0 GROUP BY session_key"""
)
def numeric_sessions(t: Tables) -> DataFrame:
    folder = F.when(c("k") % 5 == 0, "session_latest").otherwise(F.concat(F.lit("session_"), c("session_key").cast("string")))
    folders = t.feed.select(folder.alias("folder"))
    return Q.numeric_sessions(folders).groupBy("session_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT session_key, session_type FROM f_sessions ORDER BY date_start, session_key LIMIT 4")
def cap_sessions(t: Tables) -> DataFrame:
    return Q.cap_sessions(t.sessions, 4).select("session_key", "session_type")


@query(
    """SELECT session_key, lap_number, CAST(SUM(CASE WHEN duration_sector_1 IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS predictions_count,
    CAST(SUM(CASE WHEN duration_sector_1 IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS errors_count,
    SUM(CASE WHEN duration_sector_1 IS NULL THEN 0 ELSE 1 END) = 0 AS stale FROM f_laps GROUP BY session_key, lap_number"""
)
def cycle_summary(t: Tables) -> DataFrame:
    return Q.cycle_summary(t.laps, c("duration_sector_1").isNotNull(), ["session_key", "lap_number"])


# columns --------------------------------------------------------------------


@query(f"SELECT {LAPS}, duration_sector_1 FROM f_laps")
def require_columns(t: Tables) -> DataFrame:
    return Q.require_columns(t.laps, [*KEY, "duration_sector_1", "gap_raw"]).select(*KEY, "duration_sector_1")


@query("SELECT session_key, driver_number, grid_position AS current_position, 0 AS gap_to_leader, 0.5E0 AS lap_fraction, 0 AS safety_car_active FROM f_grid")
def default_columns(t: Tables) -> DataFrame:
    given = t.grid.select(*DRIVER, c("grid_position").alias("current_position"))
    defaults = {"current_position": 10.0, "gap_to_leader": 0, "lap_fraction": 0.5, "safety_car_active": 0}
    return Q.default_columns(given, defaults)


@query(
    f"""SELECT {LAPS}, COALESCE(duration_sector_1, 0) AS duration_sector_1, COALESCE(TRY_CAST(replace(gap_raw, '+', '') AS DOUBLE), 0) AS gap FROM f_laps"""
)
def fill_features(t: Tables) -> DataFrame:
    rows = t.laps.select(*KEY, "duration_sector_1", P.parse_gap_or_null(c("gap_raw")).alias("gap"))
    return Q.fill_features(rows, ["duration_sector_1", "gap"])


@query(
    f"""SELECT {LAPS}, driver_name, team, tyre_compound, f0 AS tyre_age, COALESCE(p, 0) AS pitstop_probability, COALESCE(conf, 0) AS confidence,
    win_probability, pits_completed, last_pit_duration, last_pit_lap, COALESCE(drs_active, FALSE) AS drs_active, speed, f2 AS gap_to_leader FROM f_nested"""
)
def format_prediction(t: Tables) -> DataFrame:
    return Q.format_prediction(t.nested_predictions)


@query(
    f"""SELECT 'PitstopPrediction' AS event_type, {LAPS}, driver_name, team, tyre_compound, f0 AS tyre_age, pits_completed, COALESCE(last_pit_duration, 0) AS last_pit_duration,
    COALESCE(last_pit_lap, 0) AS last_pit_lap, COALESCE(drs_active, FALSE) AS drs_active, speed, throttle, brake, gear, COALESCE(p, 0) AS pitstop_probability,
    COALESCE(conf, 0) AS confidence, win_probability, safety_car_active, repeat(commentary, 600)[1:4095] AS commentary FROM f_nested""",
    digits="win_probability pitstop_probability confidence",
)
def prediction_events(t: Tables) -> DataFrame:
    """Commentary is repeated to beyond the length limit."""
    return Q.prediction_events(t.nested_predictions.withColumn("commentary", F.repeat("commentary", F.lit(600))))


@query(
    f"SELECT {LAPS}, "
    + ", ".join(f"CASE WHEN n_features >= 7 THEN f{i} END AS {n}" for i, n in enumerate(schemas.RAW_FEATURES))
    + " FROM f_nested"
)
def features_to_columns(t: Tables) -> DataFrame:
    return Q.features_to_columns(t.nested_predictions.select(*KEY, "features")).drop("features")


@query(
    """SELECT CAST(ts AS TIMESTAMP) AS event_time, driver_number, driver_name, team, tyre_compound, CAST(NULL AS VARCHAR) AS recommendation,
    CASE WHEN pitstop_probability >= 0.7 THEN 'HIGH' WHEN pitstop_probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band,
    CAST(pitstop_probability AS FLOAT) AS pitstop_probability, CAST(confidence AS FLOAT) AS confidence, CAST(tyre_age AS FLOAT) AS tyre_age,
    stint_number, CAST(gap_to_leader AS FLOAT) AS gap_to_leader, CAST(NULL AS FLOAT) AS air_temperature, CAST(NULL AS FLOAT) AS track_temperature,
    CAST(NULL AS INT) AS rainfall, CAST(NULL AS FLOAT) AS sector_delta, session_key, safety_car_active FROM f_predictions"""
)
def conform_schema(t: Tables) -> DataFrame:
    rows = t.predictions.withColumns(
        {
            "event_time": c("ts"),
            "risk_band": S.risk_band(c("pitstop_probability")),
            "driver_number": c("driver_number").cast("string"),
        }
    )
    return Q.conform_schema(rows, schemas.PREDICTION_INDEX)


# set operations -------------------------------------------------------------


@query(
    f"""SELECT {LAPS}, CASE WHEN session_key % 2 = 0 THEN lap_duration END AS lap_duration FROM f_laps"""
)
def union_sessions(t: Tables) -> DataFrame:
    """Odd sessions lack a column."""
    even = t.laps.where("session_key % 2 = 0").select("lap_duration", *KEY)
    odd = t.laps.where("session_key % 2 = 1").select(*KEY)
    return Q.union_sessions([even, odd]).select(*KEY, "lap_duration")


@query(
    "SELECT session_key, driver_number, ts, CASE WHEN throttle % 3 = 0 THEN 'catchup' ELSE 'live' END AS feed FROM f_predictions"
)
def merge_live_and_catchup(t: Tables) -> DataFrame:
    rows = t.predictions.select(*DRIVER, "ts", "throttle")
    live = rows.where("throttle % 3 <> 0").withColumn("feed", F.lit("live")).drop("throttle")
    catchup = rows.where("throttle % 5 <> 1 OR throttle % 3 = 0").withColumn("feed", F.lit("catchup")).drop("throttle")
    return Q.merge_live_and_catchup(live, catchup)


# scalar expressions ---------------------------------------------------------


@query(f"SELECT {LAPS}, COALESCE(TRY_CAST(replace(gap_raw, '+', '') AS DOUBLE), 0) AS gap FROM f_laps")
def parse_gap(t: Tables) -> DataFrame:
    return t.laps.select(*KEY, P.parse_gap(c("gap_raw")).alias("gap"))


@query(f"SELECT {LAPS}, CASE WHEN rainfall THEN 1 ELSE 0 END AS rainfall FROM f_laps")
def rain_flag(t: Tables) -> DataFrame:
    return t.laps.select(*KEY, P.rain_flag(c("rainfall")).alias("rainfall"))


@query("SELECT event_id, drs >= 10 AS drs_active FROM f_car_data")
def drs_active(t: Tables) -> DataFrame:
    return t.car_data.select("event_id", P.drs_active(c("drs")).alias("drs_active"))


@query(
    """SELECT event_id, ABS(p_xgb - 0.5) * 2 AS confidence, CASE WHEN p_xgb > 0.7 THEN 'PIT' ELSE 'STAY' END AS recommendation FROM f_scores""",
    digits="confidence",
)
def score_outputs(t: Tables) -> DataFrame:
    p = c("p_xgb")
    return t.scores.select(
        "event_id", S.confidence(p).alias("confidence"), S.recommendation(p).alias("recommendation")
    )


@query(
    f"SELECT {LAPS}, CASE WHEN pitstop_probability >= 0.7 THEN 'HIGH' WHEN pitstop_probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band FROM f_predictions"
)
def risk_band(t: Tables) -> DataFrame:
    return t.predictions.select(*KEY, S.risk_band(c("pitstop_probability")).alias("risk_band"))


@query(
    f"""SELECT {LAPS}, CASE WHEN FLOOR(pitstop_probability * 100 + 0.5) >= 70 THEN 'pit_soon' WHEN FLOOR(pitstop_probability * 100 + 0.5) >= 45 THEN 'watch'
    ELSE 'safe' END AS band FROM f_predictions"""
)
def ui_band(t: Tables) -> DataFrame:
    return t.predictions.select(*KEY, S.ui_band(c("pitstop_probability")).alias("band"))


@query(f"SELECT {LAPS}, CASE WHEN pitstop_probability >= 0.7 THEN 'pit_alert' END AS tag FROM f_predictions")
def pit_alert_tag(t: Tables) -> DataFrame:
    return Q.tag_pit_alerts(t.predictions).select(*KEY, "tag")


@query(
    """SELECT event_id, date_trunc('second', event_time) - CASE WHEN k % 3 = 2 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS ts FROM f_base"""
)
def parse_ts(t: Tables) -> DataFrame:
    """Times as text with a UTC mark, without any, or two hours ahead of UTC."""
    text = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(c("k") % 3 == 0, "Z").when(c("k") % 3 == 1, "").otherwise("+02:00")
    return t.feed.select("event_id", P.parse_ts(F.concat(text, zone)).alias("ts"))


@query(f"SELECT {LAPS}, lap_number / CAST(total_laps AS DOUBLE) AS lap_fraction FROM f_raw", digits="lap_fraction")
def lap_fraction(t: Tables) -> DataFrame:
    return t.raw_laps.select(*KEY, S.lap_fraction(c("lap_number"), c("total_laps")).alias("lap_fraction"))


@query(
    f"SELECT {LAPS}, 1 / (COALESCE(TRY_CAST(replace(gap_raw, '+', '') AS DOUBLE), 20) + 1) AS score FROM f_laps",
    digits="score",
)
def field_compression(t: Tables) -> DataFrame:
    return t.laps.select(*KEY, S.field_compression(P.parse_gap_or_null(c("gap_raw"))).alias("score"))


@query(
    """SELECT session_key, driver_number, code AS circuit_type_encoded FROM f_grid JOIN (SELECT circuit_type,
    CAST(ROW_NUMBER() OVER (ORDER BY circuit_type) - 1 AS INT) AS code FROM (SELECT DISTINCT circuit_type FROM f_grid) d) e USING (circuit_type)"""
)
def label_encode(t: Tables) -> DataFrame:
    return encoding.label_encode(t.grid, "circuit_type", "circuit_type_encoded").select(*DRIVER, "circuit_type_encoded")


@query(f"SELECT session_key, driver_number, {STRATEGY} AS tyre_strategy_encoded FROM f_grid")
def encode_tyre_strategy(t: Tables) -> DataFrame:
    return encoding.encode_tyre_strategy(t.grid).select(*DRIVER, "tyre_strategy_encoded")


@query(f"SELECT {LAPS}, COALESCE(p, 0) * 100 AS pit_pct FROM f_nested", digits="pit_pct")
def as_percent(t: Tables) -> DataFrame:
    return t.nested_predictions.select(*KEY, P.as_percent(c("prediction.pitstop_probability")).alias("pit_pct"))


@query(
    """SELECT session_key, CASE WHEN session_key % 3 = 1 THEN 'model_approved' ELSE 'model_rejected' END AS tag FROM f_sessions"""
)
def tag_training_runs(t: Tables) -> DataFrame:
    approved = F.when(c("session_key") % 3 == 1, True).when(c("session_key") % 3 == 2, False)
    return Q.tag_training_runs(t.sessions.withColumn("approved", approved)).select("session_key", "tag")


@query(
    """SELECT event_id, p, ABS(p - 0.5) * 2 AS confidence, CASE WHEN p > 0.7 THEN 'PIT' ELSE 'STAY' END AS recommendation
    FROM (SELECT event_id, 1 / (1 + EXP(-(0.9E0 * (p_xgb - 0.5E0) / 0.29E0 + 0.4E0 * (p_lgb - 0.4E0) / 0.3E0 - 0.2E0))) AS p FROM f_scores) x""",
    digits="p confidence",
)
def stack_score(t: Tables) -> DataFrame:
    p = S.stack_probability(c("p_xgb"), c("p_lgb"), S.StackParams())
    return t.scores.select(
        "event_id",
        p.alias("p"),
        S.confidence(p).alias("confidence"),
        S.recommendation(p).alias("recommendation"),
    )


@query(
    """SELECT session_key, driver_number, grid_position, qualifying_delta_to_pole, pit_count, avg_stint_length, code AS circuit_type_encoded,
    CASE team WHEN 'McLaren' THEN 0.95E0 WHEN 'Ferrari' THEN 0.9E0 WHEN 'Red Bull' THEN 0.88E0 WHEN 'Mercedes' THEN 0.85E0 WHEN 'Williams' THEN 0.65E0
      WHEN 'Aston Martin' THEN 0.7E0 WHEN 'Alpine' THEN 0.6E0 WHEN 'Haas' THEN 0.55E0 WHEN 'Racing Bulls' THEN 0.62E0 WHEN 'Cadillac' THEN 0.45E0
      ELSE 0.5E0 END AS team_performance_score, """
    + STRATEGY
    + """ AS tyre_strategy_encoded, weather_impact_score, grid_position AS current_position, 0 AS gap_to_leader, 0.5E0 AS lap_fraction, 0 AS safety_car_active
    FROM f_grid JOIN (SELECT circuit_type, CAST(ROW_NUMBER() OVER (ORDER BY circuit_type) - 1 AS INT) AS code
      FROM (SELECT DISTINCT circuit_type FROM f_grid) d) e USING (circuit_type)""",
    digits="avg_stint_length",
)
def encode_position_features(t: Tables) -> DataFrame:
    return encoding.encode_position_features(t.grid).select(*DRIVER, *schemas.POSITION_FEATURES)


@query(
    """SELECT session_key, lap_number, lap_number / CAST(total_laps AS DOUBLE) AS lap_fraction, code AS circuit_id_encoded, rainfall, COALESCE(gap_variance, 0) AS gap_variance,
    incident_count_last_5_laps, yellow_flag_count, 0 AS delta_to_backmarker, 1 / 21.0E0 AS field_compression_score
    FROM (SELECT session_key, lap_number, STDDEV_SAMP(TRY_CAST(replace(gap_to_leader, '+', '') AS DOUBLE)) AS gap_variance, MAX(CASE WHEN rainfall THEN 1 ELSE 0 END) AS rainfall,
        MAX(yellow_flag_count) AS yellow_flag_count, MAX(circuit_id) AS circuit_id, MAX(total_laps) AS total_laps, CAST(COALESCE(SUM(SUM(CASE WHEN had_incident THEN 1 ELSE 0 END))
        OVER (PARTITION BY session_key ORDER BY lap_number RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS INT) AS incident_count_last_5_laps
      FROM f_raw GROUP BY session_key, lap_number) g
    JOIN (SELECT circuit_id, CAST(ROW_NUMBER() OVER (ORDER BY circuit_id) - 1 AS INT) AS code FROM (SELECT DISTINCT circuit_id FROM f_raw) d) e USING (circuit_id)""",
    digits="gap_variance lap_fraction field_compression_score",
    places=8,
)
def encode_safety_car_features(t: Tables) -> DataFrame:
    from stintwise.plans.safety_car import build_safety_car_features

    rows = build_safety_car_features(t.raw_laps.withColumn("safety_car_within_5_laps", F.lit(0)))
    encoded = encoding.encode_safety_car_features(rows)
    return encoded.select("session_key", *schemas.SAFETY_CAR_FEATURES)


@query(
    """SELECT driver_number, event_time, tyre_age, stint_number FROM (SELECT driver_number, event_time,
      COALESCE(lap_number - MAX(pit_lap) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS tyre_age,
      1 + CAST(SUM(did_pit) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stint_number,
      ROW_NUMBER() OVER (PARTITION BY driver_number ORDER BY event_time DESC) AS rn FROM f_raw) x WHERE rn = 1"""
)
def latest_race_features(t: Tables) -> DataFrame:
    """Newest record of every driver out of the batch features."""
    from stintwise.operators.snapshots import features_as_of

    rows = build_pitstop_features(t.raw_laps).select("driver_number", "event_time", "tyre_age", "stint_number")
    return features_as_of(rows, ["driver_number"])
