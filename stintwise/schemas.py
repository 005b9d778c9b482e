"""Explicit schemas (as DDL text) and column lists."""

from __future__ import annotations


def ddl(text: str) -> str:
    """Schema text in one line; readers take it as it is."""
    return " ".join(text.split())


LAP = "lap_number int, date_start timestamp, duration_sector_1 double, lap_duration double"
STINT = "stint_number int, lap_start int, lap_end int, compound string"
INTERVAL = "lap_number int, gap_to_leader string, date timestamp"
POSITION = "date timestamp, x double, y double"
PIT = "lap_number int, pit_duration double, pit_out_lap boolean"

#: Raw session document: session-wide arrays and one entry per driver.
SESSION_DOCUMENT = ddl(
    f"""session_key bigint, year int,
    weather array<struct<date timestamp, air_temperature double, track_temperature double, rainfall boolean>>,
    race_control array<struct<date timestamp, flag string, message string, lap_number int>>,
    drivers map<string, struct<
        laps array<struct<{LAP}>>, stints array<struct<{STINT}>>, intervals array<struct<{INTERVAL}>>,
        position array<struct<{POSITION}>>, pit array<struct<{PIT}>>>>,
    _corrupt_record string"""
)

RAW_LAPS = ddl(
    """session_key bigint, driver_number int, lap_number int, event_time timestamp_ntz, duration_sector_1 double,
    lap_duration double, did_pit int, pit_lap int, gap_to_leader string, air_temperature double,
    track_temperature double, rainfall boolean, had_incident boolean, yellow_flag_count int, tyre_compound string"""
)

TRAINING_ROWS = ddl(
    """session_key bigint, driver_number int, lap_number int, event_time timestamp_ntz, tyre_age int,
    stint_number int, tyre_compound string, gap_to_leader double, air_temperature double,
    track_temperature double, rainfall int, sector_delta double, lap_duration double, did_pit int,
    pitstop_within_3_laps int, safety_car_within_5_laps int, total_laps bigint"""
)

PREDICTION = """driver_number int, driver_name string, team string, session_key bigint, tyre_compound string,
    lap_number int, pits_completed int, last_pit_duration double, last_pit_lap int, drs_active boolean,
    speed double, throttle int, brake int, gear int, features array<double>, feature_names array<string>,
    prediction struct<pitstop_probability double, confidence double, recommendation string,
        base_models struct<xgboost double, lightgbm double>>,
    safety_car_active boolean, timestamp string, win_probability double"""

#: One document per scoring cycle of a session.
INFERENCE_LOG = ddl(
    f"""session_key bigint, country_name string, timestamp string, predictions array<struct<{PREDICTION}>>,
    errors array<struct<driver_number int, error string, batch boolean>>, safety_car_active boolean,
    race_finished boolean, processing_time_ms bigint, commentary string"""
)

#: Typed event index: conformed by ``operators.quality.conform_schema``.
PREDICTION_INDEX = ddl(
    """event_time timestamp_ntz, driver_number int, driver_name string, team string, tyre_compound string,
    recommendation string, risk_band string, pitstop_probability float, confidence float, tyre_age float,
    stint_number int, gap_to_leader float, air_temperature float, track_temperature float, rainfall int,
    sector_delta float, session_key bigint, safety_car_active boolean"""
)

#: Evaluation records of every model kind, read with one union schema.
TRAINING_RUN = ddl(
    """model string, auc double, accuracy double, threshold double, auc_threshold double, approved boolean,
    rmse double, rmse_threshold double, f1_score double, f1_threshold double, xgb_auc double, lgb_auc double,
    n_train bigint, n_val bigint, n_samples bigint, positive_rate double, n_features int, model_uri string,
    endpoint string, deployed_at string"""
)

METRIC_POINT = ddl(
    "event_id bigint, ts timestamp_ntz, function_name string, metric_name string, metric_value double"
)

RACE_FEATURES = ddl(
    """driver_number bigint, event_time timestamp_ntz, tyre_age double, stint_number bigint, gap_to_leader double,
    air_temperature double, track_temperature double, rainfall bigint, sector_delta double"""
)

EVENTS = ddl("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")

# Model inputs, in the order the models were trained on.
RAW_FEATURES = [
    "tyre_age",
    "stint_number",
    "gap_to_leader",
    "air_temperature",
    "track_temperature",
    "rainfall",
    "sector_delta",
]
DERIVED_FEATURES = ["tyre_age_sq", "heat_deg_interaction", "wet_stint", "abs_sector_delta"]
ROLLING_FEATURES = ["deg_rate", "gap_trend", "rolling_sector_delta_5", "tyre_stress_index"]
COMPOUND_FEATURES = ["compound_soft", "compound_medium", "compound_hard"]
#: The 18-value model input, in model order.
MODEL_FEATURES = RAW_FEATURES + DERIVED_FEATURES + ROLLING_FEATURES + COMPOUND_FEATURES
#: The first 11 are the input of the smaller model.
BASE_FEATURES = RAW_FEATURES + DERIVED_FEATURES
TARGET = "pitstop_within_3_laps"

# Inputs of the position and safety-car models, in model order.
POSITION_FEATURES = [
    "grid_position",
    "qualifying_delta_to_pole",
    "pit_count",
    "avg_stint_length",
    "circuit_type_encoded",
    "team_performance_score",
    "tyre_strategy_encoded",
    "weather_impact_score",
    "current_position",
    "gap_to_leader",
    "lap_fraction",
    "safety_car_active",
]
SAFETY_CAR_FEATURES = [
    "lap_number",
    "lap_fraction",
    "circuit_id_encoded",
    "rainfall",
    "gap_variance",
    "incident_count_last_5_laps",
    "yellow_flag_count",
    "delta_to_backmarker",
    "field_compression_score",
]
