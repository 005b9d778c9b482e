"""Queries of the joins between telemetry tables and the plans built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise import dimensions as dim
from stintwise.catalog.registry import query
from stintwise.catalog.tables import Tables
from stintwise.operators import joins as J
from stintwise.operators import ranking as R
from stintwise.operators.snapshots import features_as_of as as_of
from stintwise.plans import history, position, safety_car

c = F.col
KEY = ["session_key", "driver_number", "lap_number"]
LAPS = "session_key, driver_number, lap_number"
ON_LAP = "USING (session_key, driver_number, lap_number)"


def _case(column: str, pairs: list[tuple], default: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in pairs)
    return f"CASE {column} {whens} ELSE {default} END"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


GRID_NAME = _case("driver_number", [(n, _text(name)) for n, name, _, _ in dim.DRIVER_GRID], "'Driver #' || CAST(driver_number AS VARCHAR)")
GRID_TEAM = _case("driver_number", [(n, _text(team)) for n, _, team, _ in dim.DRIVER_GRID], "'Unknown'")
TEAM_SCORE = _case("team", [(_text(k), f"CAST({v} AS DOUBLE)") for k, v in dim.TEAM_STRENGTH.items()], f"CAST({dim.DEFAULT_STRENGTH} AS DOUBLE)")
CIRCUIT = _case("country_name", [(_text(k), _text(v)) for k, v in dim.COUNTRY_CIRCUIT.items()], "''")
STRATEGY = _case("tyre_strategy", [(_text(k), v) for k, v in dim.TYRE_STRATEGY_CODE.items()], str(dim.DEFAULT_STRATEGY_CODE))


# laps and their neighbours --------------------------------------------------

GAP_STATS = """SELECT session_key, lap_number, STDDEV_SAMP(TRY_CAST(replace(gap_to_leader, '+', '') AS DOUBLE)) AS gap_variance,
    COUNT(*) AS cars_on_track FROM f_raw GROUP BY session_key, lap_number"""


@query(GAP_STATS, digits="gap_variance", places=8)
def gap_stats(t: Tables) -> DataFrame:
    return J.gap_stats(t.raw_laps)


@query(
    f"SELECT {LAPS}, gap_variance, cars_on_track FROM f_raw JOIN ({GAP_STATS}) g USING (session_key, lap_number)",
    digits="gap_variance",
    places=8,
)
def join_gap_stats(t: Tables) -> DataFrame:
    return J.join_gap_stats(t.raw_laps).select(*KEY, "gap_variance", "cars_on_track")


@query(
    f"""SELECT {LAPS}, GREATEST(0, lap_number - COALESCE(lap_start, 1)) AS tyre_age, COALESCE(stint_number, 1) AS stint_number,
    CASE WHEN lap_start IS NULL THEN 'UNKNOWN' ELSE compound END AS tyre_compound
    FROM (SELECT l.session_key, l.driver_number, l.lap_number, s.lap_start, s.stint_number, s.compound,
            ROW_NUMBER() OVER (PARTITION BY l.session_key, l.driver_number, l.lap_number ORDER BY s.stint_number) AS rn
          FROM f_laps l LEFT JOIN (SELECT * FROM f_stints WHERE stint_number % 4 <> 2) s
          ON s.session_key = l.session_key AND s.driver_number = l.driver_number
          AND l.lap_number >= s.lap_start AND (s.lap_end IS NULL OR l.lap_number <= s.lap_end + 2)) x WHERE rn = 1"""
)
def join_stint_for_lap(t: Tables) -> DataFrame:
    """With gaps and overlaps between the stints, so defaults and the first-match rule both count."""
    stints = t.stints.where("stint_number % 4 <> 2").withColumn("lap_end", c("lap_end") + 2)
    return J.join_stint_for_lap(t.laps.select(*KEY), stints).select(
        *KEY, "tyre_age", "stint_number", "tyre_compound"
    )


@query(
    f"""SELECT {LAPS}, COALESCE(TRY_CAST(replace(g, '+', '') AS DOUBLE), 0) AS gap_to_leader
    FROM f_laps LEFT JOIN (SELECT {LAPS}, MAX_BY(gap_to_leader, date) AS g FROM f_intervals
      WHERE gap_to_leader IS NOT NULL GROUP BY {LAPS}) i {ON_LAP}"""
)
def join_interval_by_lap(t: Tables) -> DataFrame:
    return J.join_interval_by_lap(t.laps.select(*KEY), t.intervals).select(*KEY, "gap_to_leader")


@query(
    f"""SELECT {LAPS}, CASE WHEN p.lap IS NULL THEN 0 ELSE 1 END AS did_pit FROM f_laps
    LEFT JOIN (SELECT DISTINCT {LAPS}, 1 AS lap FROM f_pit) p {ON_LAP}"""
)
def flag_did_pit(t: Tables) -> DataFrame:
    return J.flag_did_pit(t.laps.select(*KEY), t.pit)


@query(
    f"""SELECT {LAPS}, CASE WHEN EXISTS (SELECT 1 FROM f_pit p WHERE p.session_key = l.session_key AND p.driver_number = l.driver_number
      AND p.lap_number BETWEEN l.lap_number + 1 AND l.lap_number + 3) THEN 1 ELSE 0 END AS pitstop_within_3_laps FROM f_laps l"""
)
def label_pit_within_3(t: Tables) -> DataFrame:
    return J.label_pit_within_3(t.laps.select(*KEY), t.pit)


SC_WITHIN_5 = """CASE WHEN EXISTS (SELECT 1 FROM f_race_control r WHERE r.session_key = l.session_key AND upper(r.message) LIKE '%SAFETY CAR%'
      AND r.lap_number BETWEEN l.lap_number + 1 - 4 AND l.lap_number + 5) THEN 1 ELSE 0 END"""


@query(f"SELECT {LAPS}, {SC_WITHIN_5} AS safety_car_within_5_laps FROM f_laps l")
def label_sc_within_5(t: Tables) -> DataFrame:
    return J.label_sc_within_5(t.laps.select(*KEY), t.race_control)


LATEST_WEATHER = """SELECT session_key, ARG_MAX(air_temperature, date) AS air_temperature, ARG_MAX(track_temperature, date) AS track_temperature,
    ARG_MAX(CASE WHEN rainfall THEN 1 ELSE 0 END, date) AS rainfall FROM f_weather GROUP BY session_key"""


@query(
    f"""SELECT {LAPS}, COALESCE(w.air_temperature, 25) AS air_temperature, COALESCE(w.track_temperature, 35) AS track_temperature,
    COALESCE(w.rainfall, 0) AS rainfall FROM (SELECT {LAPS} FROM f_laps) l
    LEFT JOIN (SELECT * FROM ({LATEST_WEATHER}) x WHERE session_key % 3 <> 0) w USING (session_key)"""
)
def join_latest_weather(t: Tables) -> DataFrame:
    """Weather of every third session is left out, so the defaults count."""
    return J.join_latest_weather(t.laps.select(*KEY), t.weather.where("session_key % 3 <> 0"))


@query(
    f"""SELECT {LAPS}, w.air_temperature, w.track_temperature, CAST(w.rainfall AS INT) AS rainfall
    FROM (SELECT {LAPS}, event_time FROM f_laps) l ASOF LEFT JOIN f_weather w ON l.session_key = w.session_key AND l.event_time >= w.date""".replace(
        f"SELECT {LAPS}, w.", "SELECT l.session_key, l.driver_number, l.lap_number, w."
    )
)
def asof_weather(t: Tables) -> DataFrame:
    rows = J.asof_weather(t.laps.select(*KEY, "event_time"), t.weather)
    return rows.withColumn("rainfall", c("rainfall").cast("int")).drop("event_time")


@query(f"SELECT DISTINCT session_key, driver_number, {GRID_NAME} AS driver_name, {GRID_TEAM} AS team FROM f_base")
def join_driver_grid(t: Tables) -> DataFrame:
    drivers = t.feed.select("session_key", "driver_number").distinct()
    return J.join_driver_grid(drivers).drop("nationality")


@query(f"SELECT session_key, driver_number, {TEAM_SCORE} AS team_score FROM f_grid")
def join_team_scores(t: Tables) -> DataFrame:
    return J.join_team_scores(t.grid).select("session_key", "driver_number", "team_score")


@query(f"SELECT session_key, country_name, {CIRCUIT} AS circuit_key FROM f_sessions")
def join_circuit(t: Tables) -> DataFrame:
    return J.join_circuit(t.sessions).select("session_key", "country_name", "circuit_key")


@query(
    f"""SELECT {LAPS}, duration_sector_1, COALESCE(p.pitstop_probability, 0) AS pitstop_probability, COALESCE(p.confidence, 0) AS confidence
    FROM f_laps LEFT JOIN (SELECT {LAPS}, pitstop_probability, confidence FROM f_predictions WHERE throttle % 7 <> 3) p {ON_LAP}"""
)
def attach_scores(t: Tables) -> DataFrame:
    return J.attach_scores(t.laps.select(*KEY, "duration_sector_1"), t.predictions.where("throttle % 7 <> 3"))


@query(
    f"""SELECT {LAPS}, pitstop_probability FROM f_predictions
    WHERE session_key = (SELECT session_key FROM f_predictions ORDER BY ts DESC, session_key DESC LIMIT 1)"""
)
def latest_session_predictions(t: Tables) -> DataFrame:
    return J.latest_session_predictions(t.predictions).select(*KEY, "pitstop_probability")


@query(
    """SELECT session_key, CAST(SUM(CASE WHEN p > 0.7 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits,
    CAST(SUM(CASE WHEN p > 0.7 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms,
    CAST(SUM(CASE WHEN p <= 0.7 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS misses,
    CAST(SUM(CASE WHEN p <= 0.7 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS correct_rejections
    FROM (SELECT l.session_key, l.pitstop_probability AS p, CASE WHEN EXISTS (SELECT 1 FROM f_pit q WHERE q.session_key = l.session_key
      AND q.driver_number = l.driver_number AND q.lap_number BETWEEN l.lap_number + 1 AND l.lap_number + 3) THEN 1 ELSE 0 END AS y
      FROM f_predictions l) x GROUP BY session_key"""
)
def prediction_vs_actual(t: Tables) -> DataFrame:
    return J.prediction_vs_actual(t.predictions, t.pit)


# plans ----------------------------------------------------------------------

INCIDENTS = """SELECT session_key, lap_number, CAST(COALESCE(SUM(n) OVER (PARTITION BY session_key ORDER BY lap_number
    RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS INT) AS incident_count_last_5_laps
    FROM (SELECT session_key, lap_number, SUM(CASE WHEN had_incident THEN 1 ELSE 0 END) AS n FROM f_raw GROUP BY session_key, lap_number) x"""


@query(INCIDENTS)
def incidents_last_5(t: Tables) -> DataFrame:
    return safety_car.incidents_last_5(t.raw_laps)


@query(
    f"""SELECT session_key, lap_number, gap_variance, cars_on_track, rainfall, incident_count_last_5_laps, yellow_flag_count, circuit_id, total_laps,
    safety_car_within_5_laps FROM ({GAP_STATS}) g JOIN ({INCIDENTS}) i USING (session_key, lap_number)
    JOIN (SELECT session_key, lap_number, MAX(CASE WHEN rainfall THEN 1 ELSE 0 END) AS rainfall, MAX(yellow_flag_count) AS yellow_flag_count,
      MAX(circuit_id) AS circuit_id, MAX(total_laps) AS total_laps, MAX({SC_WITHIN_5}) AS safety_car_within_5_laps
      FROM f_raw l GROUP BY session_key, lap_number) m USING (session_key, lap_number)""",
    digits="gap_variance",
    places=8,
)
def build_safety_car_features(t: Tables) -> DataFrame:
    return safety_car.build_safety_car_features(J.label_sc_within_5(t.raw_laps, t.race_control))


@query(
    """SELECT session_key, driver_number, grid_position, qualifying_delta_to_pole, pit_count, avg_stint_length, circuit_type, team, tyre_strategy,
    weather_impact_score, final_position FROM f_grid WHERE final_position IS NOT NULL""",
    digits="avg_stint_length",
)
def build_position_features(t: Tables) -> DataFrame:
    return position.build_position_features(t.grid)


@query(
    f"""SELECT l.session_key, l.driver_number, l.lap_number, l.event_time, GREATEST(0, l.lap_number - COALESCE(s.lap_start, 1)) AS tyre_age,
    COALESCE(s.stint_number, 1) AS stint_number, CASE WHEN s.lap_start IS NULL THEN 'UNKNOWN' ELSE s.compound END AS tyre_compound,
    COALESCE(TRY_CAST(replace(i.g, '+', '') AS DOUBLE), 0) AS gap_to_leader, COALESCE(w.air_temperature, 25) AS air_temperature,
    COALESCE(w.track_temperature, 35) AS track_temperature, COALESCE(w.rainfall, 0) AS rainfall, l.sector_delta, l.lap_duration,
    CASE WHEN p.hit IS NULL THEN 0 ELSE 1 END AS did_pit,
    CASE WHEN EXISTS (SELECT 1 FROM f_pit q WHERE q.session_key = l.session_key AND q.driver_number = l.driver_number
      AND q.lap_number BETWEEN l.lap_number + 1 AND l.lap_number + 3) THEN 1 ELSE 0 END AS pitstop_within_3_laps,
    {SC_WITHIN_5} AS safety_car_within_5_laps, n.total_laps
    FROM (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number) > 3 THEN COALESCE(duration_sector_1
        - AVG(duration_sector_1) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
        ELSE 0 END AS sector_delta FROM f_laps) l
    LEFT JOIN f_stints s ON s.session_key = l.session_key AND s.driver_number = l.driver_number
      AND l.lap_number >= s.lap_start AND (s.lap_end IS NULL OR l.lap_number <= s.lap_end)
    LEFT JOIN (SELECT {LAPS}, gap_to_leader AS g FROM f_intervals) i ON i.session_key = l.session_key AND i.driver_number = l.driver_number AND i.lap_number = l.lap_number
    LEFT JOIN ({LATEST_WEATHER}) w ON w.session_key = l.session_key
    LEFT JOIN (SELECT DISTINCT {LAPS}, 1 AS hit FROM f_pit) p ON p.session_key = l.session_key AND p.driver_number = l.driver_number AND p.lap_number = l.lap_number
    JOIN (SELECT session_key, driver_number, COUNT(*) AS total_laps FROM f_laps GROUP BY session_key, driver_number) n
      ON n.session_key = l.session_key AND n.driver_number = l.driver_number""",
    digits="sector_delta",
)
def build_training_rows(t: Tables) -> DataFrame:
    t = t.stored()
    return history.build_training_rows(
        t.laps, t.stints, t.intervals, t.pit, t.weather, t.race_control, places=None
    )


# shares and positions -------------------------------------------------------

POSITION = "ROW_NUMBER() OVER (PARTITION BY session_key, lap_number ORDER BY gap_to_leader, driver_number)"


@query(f"SELECT {LAPS}, CAST({POSITION} AS INT) AS live_position FROM f_predictions")
def live_position(t: Tables) -> DataFrame:
    return R.live_position(t.predictions.select(*KEY, "gap_to_leader")).drop("gap_to_leader")


@query(
    f"""SELECT {LAPS}, raw / COALESCE(NULLIF(SUM(raw) OVER (PARTITION BY session_key, lap_number), 0), 1) AS win_probability
    FROM (SELECT {LAPS}, CASE WHEN safety_car_active THEN ps * 0.55E0 + ts * 0.25E0 + ys * 0.15E0 + st * 0.05E0
        ELSE ps * 0.40E0 + gs * 0.25E0 + ts * 0.20E0 + ys * 0.10E0 + st * 0.05E0 END AS raw
      FROM (SELECT {LAPS}, safety_car_active, CAST(COUNT(*) OVER (PARTITION BY session_key, lap_number) - {POSITION} + 1 AS DOUBLE)
            / COUNT(*) OVER (PARTITION BY session_key, lap_number) AS ps, GREATEST(0, 1 - gap_to_leader / 120) AS gs, GREATEST(0, 1 - tyre_age / 50.0E0) AS ys,
            {TEAM_SCORE} AS ts, 1 - pitstop_probability AS st FROM f_predictions) a) b""",
    digits="win_probability",
)
def win_probability(t: Tables) -> DataFrame:
    return R.win_probability(t.predictions.drop("win_probability"), places=None).select(*KEY, "win_probability")


@query(
    f"""SELECT {LAPS}, s / SUM(s) OVER (PARTITION BY session_key, lap_number) AS win_probability
    FROM (SELECT {LAPS}, GREATEST(0.1E0, 23 - speed / 20) AS s FROM f_predictions) x""",
    digits="win_probability",
)
def win_from_position(t: Tables) -> DataFrame:
    rows = t.predictions.select(*KEY, (c("speed") / 20).alias("predicted_position"))
    return R.win_from_position(rows, places=None).drop("predicted_position")


@query(
    """SELECT driver_number, session_key, lap_number, event_time, duration_sector_1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY driver_number
    ORDER BY event_time DESC) AS rn FROM f_laps WHERE event_time <= TIMESTAMP '2024-01-20 12:00:00') x WHERE rn = 1"""
)
def features_as_of(t: Tables) -> DataFrame:
    at = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    rows = t.laps.select("driver_number", "session_key", "lap_number", "event_time", "duration_sector_1")
    return as_of(rows, ["driver_number"], at)
