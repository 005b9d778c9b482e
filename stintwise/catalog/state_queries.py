"""Queries of latest state, live features, session flags and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.catalog.join_queries import GRID_NAME, GRID_TEAM, LATEST_WEATHER
from stintwise.catalog.registry import query
from stintwise.catalog.tables import Tables
from stintwise.operators import state as S
from stintwise.plans import dashboards as D
from stintwise.schemas import MODEL_FEATURES

c = F.col
DRIVER = ["session_key", "driver_number"]
DK = "session_key, driver_number"


@query(
    f"""SELECT {DK}, CAST((lap_number - 1) // 16 AS INT) AS part, COUNT(*) AS n, STRING_AGG(CAST(lap_number AS VARCHAR), ',' ORDER BY lap_number) AS laps
    FROM f_laps GROUP BY {DK}, CAST((lap_number - 1) // 16 AS INT)"""
)
def group_by_driver(t: Tables) -> DataFrame:
    grouped = S.group_by_driver(t.laps.select(*DRIVER, "lap_number", "lap_duration"), rows_per_part=16)
    return grouped.select(
        *DRIVER,
        "part",
        F.size("records").cast("bigint").alias("n"),
        F.array_join(F.transform("records", lambda r: r["lap_number"].cast("string")), ",").alias("laps"),
    )


@query(
    f"""SELECT {DK}, event_id, date, speed, throttle, brake, drs, n_gear FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {DK}
    ORDER BY date DESC, event_id DESC) AS rn FROM f_car_data) x WHERE rn = 1"""
)
def latest_per_driver(t: Tables) -> DataFrame:
    return S.latest_per_driver(t.car_data)


@query(f"SELECT {DK}, lap_number, pit_duration, pit_out_lap FROM f_pit WHERE NOT pit_out_lap")
def completed_pits(t: Tables) -> DataFrame:
    return S.completed_pits(t.pit)


@query(
    f"""SELECT {DK}, COUNT(*) AS pits_completed, ARG_MAX(pit_duration, lap_number) AS last_pit_duration, MAX(lap_number) AS last_pit_lap
    FROM f_pit WHERE NOT pit_out_lap GROUP BY {DK}"""
)
def pit_summary(t: Tables) -> DataFrame:
    return S.pit_summary(t.pit)


@query(f"SELECT {DK}, COUNT(*) AS total_laps FROM f_laps GROUP BY {DK}")
def total_laps(t: Tables) -> DataFrame:
    return S.total_laps(t.laps)


@query("SELECT session_key, MAX(lap_number) AS current_lap FROM f_predictions GROUP BY session_key")
def current_lap(t: Tables) -> DataFrame:
    return S.current_lap(t.predictions)


SC_STATE = """SELECT session_key, COALESCE((SELECT CASE WHEN flag IN ('SC', 'VSC') OR upper(message) LIKE '%SAFETY CAR%' THEN TRUE ELSE FALSE END
      FROM f_race_control r WHERE r.session_key = s.session_key AND (COALESCE(flag, '') IN ('SC', 'VSC', 'GREEN') OR upper(message) LIKE '%SAFETY CAR%'
        OR upper(message) LIKE '%GREEN FLAG%') ORDER BY date DESC, event_id DESC LIMIT 1), FALSE) AS safety_car_active
    FROM (SELECT DISTINCT session_key FROM f_race_control) s"""


@query(SC_STATE)
def safety_car_active(t: Tables) -> DataFrame:
    return S.safety_car_active(t.race_control)


FINISHED = """SELECT session_key, BOOL_OR(COALESCE(flag, '') = 'CHEQUERED' OR upper(message) LIKE '%CHEQUERED%') AS race_finished
    FROM f_race_control GROUP BY session_key"""


@query(FINISHED)
def race_finished(t: Tables) -> DataFrame:
    return S.race_finished(t.race_control)


@query(
    """SELECT session_key, driver_number, lap_number FROM f_laps LEFT JOIN (SELECT session_key, MIN(date) AS finish FROM f_race_control
      WHERE flag = 'CHEQUERED' OR upper(message) LIKE '%CHEQUERED%' GROUP BY session_key) USING (session_key) WHERE finish IS NULL OR event_time < finish"""
)
def stop_on_finish(t: Tables) -> DataFrame:
    return S.stop_on_finish(t.laps, t.race_control, time="event_time").select(*DRIVER, "lap_number")


@query(
    """SELECT session_key, driver_number, stint_number, lap_start, compound FROM f_stints WHERE session_key % 2 = 0
    UNION ALL SELECT session_key, driver_number, stint_number, lap_start, compound FROM f_stints WHERE session_key % 2 = 1 AND stint_number < 3"""
)
def stints_with_fallback(t: Tables) -> DataFrame:
    """Odd sessions have lost their feed; their cache holds the first two stints, that of even ones all."""
    now = t.stints.where("session_key % 2 = 0")
    cached = t.stints.where("session_key % 2 = 0 OR stint_number < 3")
    return S.stints_with_fallback(now, cached).drop("lap_end")


@query(
    """SELECT session_key, driver_number, lap_number, pitstop_probability, FALSE AS stale FROM f_predictions WHERE session_key % 3 <> 0 AND lap_number % 2 = 0
    UNION ALL SELECT session_key, driver_number, lap_number, pitstop_probability, TRUE AS stale FROM f_predictions WHERE session_key % 3 = 0 AND lap_number % 2 = 1"""
)
def last_good_predictions(t: Tables) -> DataFrame:
    rows = t.predictions.select(*DRIVER, "lap_number", "pitstop_probability")
    now = rows.where("session_key % 3 <> 0 AND lap_number % 2 = 0")
    return S.last_good_predictions(now, rows.where("lap_number % 2 = 1"))


@query(
    f"""SELECT {DK}, lap_number, tyre_compound, pitstop_probability FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {DK} ORDER BY ts DESC) AS rn
    FROM f_predictions WHERE ts >= (SELECT MAX(ts) FROM f_predictions) - INTERVAL 1440 MINUTE) x WHERE rn = 1"""
)
def latest_in_window(t: Tables) -> DataFrame:
    return D.latest_in_window(t.predictions, 1440).select(
        *DRIVER, "lap_number", "tyre_compound", "pitstop_probability"
    )


STATE_SQL = f"""SELECT n.session_key, n.driver_number, n.lap_number, n.laps_recorded, COALESCE(s.stint_number, 1) AS stint_number,
    CASE WHEN s.lap_start IS NULL THEN 'UNKNOWN' ELSE s.compound END AS tyre_compound, COALESCE(TRY_CAST(replace(g.gap, '+', '') AS DOUBLE), 0) AS gap_to_leader,
    COALESCE(p.pits_completed, 0) AS pits_completed, p.last_pit_duration, p.last_pit_lap, COALESCE(w.air_temperature, 25) AS air_temperature,
    COALESCE(w.track_temperature, 35) AS track_temperature, COALESCE(w.rainfall, 0) AS rainfall, COALESCE(c.speed, 0) AS speed,
    COALESCE(c.throttle, 0) AS throttle, COALESCE(c.brake, 0) AS brake, COALESCE(c.n_gear, 0) AS gear, COALESCE(c.drs, 0) >= 10 AS drs_active,
    s.lap_start, s.lap_end
    FROM (SELECT {DK}, MAX(lap_number) AS lap_number, COUNT(*) AS laps_recorded FROM f_laps GROUP BY {DK}) n
    LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY {DK} ORDER BY stint_number DESC) AS rn FROM f_stints) s
      ON s.rn = 1 AND s.session_key = n.session_key AND s.driver_number = n.driver_number
    LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY {DK} ORDER BY date DESC) AS rn, gap_to_leader AS gap FROM f_intervals) g
      ON g.rn = 1 AND g.session_key = n.session_key AND g.driver_number = n.driver_number
    LEFT JOIN (SELECT {DK}, COUNT(*) AS pits_completed, ARG_MAX(pit_duration, lap_number) AS last_pit_duration, MAX(lap_number) AS last_pit_lap
      FROM f_pit WHERE NOT pit_out_lap GROUP BY {DK}) p ON p.session_key = n.session_key AND p.driver_number = n.driver_number
    LEFT JOIN ({LATEST_WEATHER}) w ON w.session_key = n.session_key
    LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY {DK} ORDER BY date DESC) AS rn FROM f_car_data) c
      ON c.rn = 1 AND c.session_key = n.session_key AND c.driver_number = n.driver_number"""

_STATE_COLUMNS = [
    "lap_number", "laps_recorded", "stint_number", "tyre_compound", "gap_to_leader", "pits_completed", "last_pit_duration",
    "last_pit_lap", "air_temperature", "track_temperature", "rainfall", "speed", "throttle", "brake", "gear", "drs_active",
]


@query(f"SELECT {DK}, {', '.join(_STATE_COLUMNS)} FROM ({STATE_SQL}) x")
def driver_state(t: Tables) -> DataFrame:
    t = t.stored()
    state = S.driver_state(t.laps, t.stints, t.intervals, t.weather, t.pit, t.car_data)
    return state.select(*DRIVER, *_STATE_COLUMNS)


_W = f"PARTITION BY {DK} ORDER BY lap_number"
LIVE = f"""SELECT x.session_key, x.driver_number, x.lap_number, tyre_compound, pits_completed, last_pit_duration, last_pit_lap, drs_active, speed, throttle, brake, gear,
    {GRID_NAME.replace("driver_number", "x.driver_number")} AS driver_name, {GRID_TEAM.replace("driver_number", "x.driver_number")} AS team,
    age AS tyre_age, stint_number, gap_to_leader, air_temperature, track_temperature, rainfall, sector_delta,
    CAST(age * age AS DOUBLE) AS tyre_age_sq, track_temperature * age / 100 AS heat_deg_interaction, CAST(rainfall * stint_number AS DOUBLE) AS wet_stint,
    ABS(sector_delta) AS abs_sector_delta, deg_rate, COALESCE(gap_trend, 0) AS gap_trend, rolling_sector_delta_5, age * rolling_sector_delta_5 / 100 AS tyre_stress_index,
    CASE WHEN upper(tyre_compound) = 'SOFT' THEN 1 ELSE 0 END AS compound_soft, CASE WHEN upper(tyre_compound) = 'MEDIUM' THEN 1 ELSE 0 END AS compound_medium,
    CASE WHEN upper(tyre_compound) = 'HARD' THEN 1 ELSE 0 END AS compound_hard
    FROM (SELECT z.*, CAST(CASE WHEN COALESCE(lap_end, 0) <> 0 THEN lap_end - lap_start ELSE lap_number - COALESCE(lap_start, 0) + 1 END AS INT) AS age
          FROM ({STATE_SQL}) z) x
    JOIN (SELECT {DK}, lap_number, COALESCE(s1 - AVG(s1) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS sector_delta,
        COALESCE(s1 - AVG(s1) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) - CASE WHEN ROW_NUMBER() OVER ({_W}) = 1 THEN 0
          ELSE COALESCE(LAG(s1) OVER ({_W}), 0) - COALESCE(AVG(s1) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), 0) END AS deg_rate,
        COALESCE(AVG(step) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS rolling_sector_delta_5
      FROM (SELECT *, duration_sector_1 AS s1, ABS(duration_sector_1 - LAG(duration_sector_1) OVER ({_W})) AS step FROM f_laps) a) d
      ON d.session_key = x.session_key AND d.driver_number = x.driver_number AND d.lap_number = x.lap_number
    LEFT JOIN (SELECT {DK}, MAX(CASE WHEN rn = 1 THEN v END) - MAX(CASE WHEN rn = 4 THEN v END) AS gap_trend
      FROM (SELECT {DK}, TRY_CAST(COALESCE(replace(gap_to_leader, '+', ''), '0') AS DOUBLE) AS v,
              ROW_NUMBER() OVER (PARTITION BY {DK} ORDER BY date DESC) AS rn FROM f_intervals) i GROUP BY {DK}) gt
      ON gt.session_key = x.session_key AND gt.driver_number = x.driver_number"""

_LIVE_COLUMNS = [
    "lap_number", "driver_name", "team", "tyre_compound", "pits_completed", "last_pit_duration", "last_pit_lap",
    "drs_active", "speed", "throttle", "brake", "gear", *MODEL_FEATURES,
]


@query(
    LIVE,
    digits="sector_delta heat_deg_interaction abs_sector_delta deg_rate gap_trend rolling_sector_delta_5 tyre_stress_index",
)
def live_features(t: Tables) -> DataFrame:
    t = t.stored()
    rows = S.live_features(t.laps, t.stints, t.intervals, t.weather, t.pit, t.car_data)
    return rows.select(*DRIVER, *_LIVE_COLUMNS)
