"""SQL text of the derived tables, used as CTEs by the oracle queries."""

from __future__ import annotations

import re

VIEWS = {
    "f_base": """
SELECT CAST(floor(user_id/22.0) AS BIGINT)+9000 AS session_key, CAST(user_id AS INT) AS driver_number,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS lap_number,
       event_id, ts AS event_time, event_type, value, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k
FROM events
""",
    "f_laps": """
SELECT session_key, driver_number, lap_number, event_time,
       CASE WHEN event_type='signup' AND k % 10 = 0 THEN NULL ELSE 28.0E0 + (value % 10)/4 END AS duration_sector_1,
       90.0E0 + (value % 10) AS lap_duration,
       CASE WHEN event_type='purchase' AND k % 5 = 0 THEN 1 ELSE 0 END AS did_pit,
       CASE WHEN event_type='purchase' AND k % 5 = 0 THEN lap_number END AS pit_lap,
       CASE WHEN k = 0 THEN NULL WHEN k = 99 THEN '+1 LAP'
            WHEN k % 2 = 0 THEN '+' || CAST(value AS VARCHAR(32)) ELSE CAST(value AS VARCHAR(32)) END AS gap_raw,
       18.0E0 + k % 22 AS air_temperature, 30.0E0 + k % 30 AS track_temperature, (k % 12 = 0) AS rainfall,
       (event_type='error' AND k < 10) AS had_incident,
       CASE WHEN event_type='error' AND k >= 40 AND k < 98 THEN 1 ELSE 0 END AS yellow_flag_count, k, value
FROM f_base
""",
    "f_stints": """
SELECT session_key, driver_number, stint_number, MIN(lap_number) AS lap_start,
       CASE WHEN stint_number = MAX(ms) THEN NULL ELSE MAX(lap_number) END AS lap_end,
       CASE (driver_number + stint_number) % 5 WHEN 0 THEN 'SOFT' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'hard' WHEN 3 THEN 'INTERMEDIATE' END AS compound
FROM (SELECT *, MAX(stint_number) OVER (PARTITION BY session_key, driver_number) AS ms
      FROM (SELECT session_key, driver_number, lap_number,
                   CAST(1 + SUM(did_pit) OVER (PARTITION BY session_key, driver_number ORDER BY lap_number
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS stint_number FROM f_laps) a) b
GROUP BY session_key, driver_number, stint_number
""",
    "f_race_control": """
SELECT session_key, event_id, event_time AS date, lap_number,
       CASE WHEN k < 5 THEN 'SC' WHEN k < 8 THEN 'VSC' WHEN k < 10 THEN NULL WHEN k < 40 THEN 'GREEN' WHEN k < 98 THEN 'YELLOW' ELSE 'CHEQUERED' END AS flag,
       CASE WHEN k < 5 THEN 'Safety Car deployed' WHEN k < 8 THEN 'VSC deployed' WHEN k < 10 THEN 'Virtual Safety Car ending'
            WHEN k < 40 THEN 'Green flag' WHEN k < 98 THEN 'Yellow in sector ' || CAST(k % 20 AS VARCHAR(8)) ELSE 'Chequered flag' END AS message
FROM f_base WHERE event_type='error'
""",
    "f_weather": """
SELECT session_key, event_id, event_time AS date, 18.0E0 + k % 22 AS air_temperature, 30.0E0 + k % 30 AS track_temperature, (k % 12 = 0) AS rainfall
FROM f_base WHERE event_type='view'
""",
    "f_car_data": """
SELECT session_key, driver_number, event_id, event_time AS date, value AS speed, k AS throttle, 100 - k AS brake, k % 15 AS drs, k % 9 AS n_gear
FROM f_base WHERE event_type='click'
""",
    "f_pit": """
SELECT session_key, driver_number, lap_number, 18.0E0 + k / 4.0E0 AS pit_duration, (k % 15 = 0) AS pit_out_lap
FROM f_base WHERE event_type='purchase' AND k % 5 = 0
""",
    "f_scores": """
SELECT event_id, session_key, driver_number, lap_number, event_time, k/100.0E0 AS p_xgb, (value % 50)/50 AS p_lgb FROM f_base
""",
    "f_predictions": """
SELECT l.session_key, l.driver_number, 'Driver #' || CAST(l.driver_number AS VARCHAR(12)) AS driver_name,
       CASE l.driver_number % 12 WHEN 0 THEN 'McLaren' WHEN 1 THEN 'Ferrari' WHEN 2 THEN 'Red Bull' WHEN 3 THEN 'Mercedes' WHEN 4 THEN 'Williams' WHEN 5 THEN 'Aston Martin'
            WHEN 6 THEN 'Alpine' WHEN 7 THEN 'Haas' WHEN 8 THEN 'Racing Bulls' WHEN 9 THEN 'Audi' WHEN 10 THEN 'Cadillac' ELSE 'Unknown' END AS team,
       COALESCE(s.compound,'UNKNOWN') AS tyre_compound, l.lap_number - s.lap_start AS tyre_age, s.stint_number, s.stint_number - 1 AS pits_completed,
       l.lap_number, l.event_time AS ts, CAST(COALESCE(TRY_CAST(replace(l.gap_raw,'+','') AS DOUBLE), 0) AS DOUBLE) AS gap_to_leader, l.value AS speed, l.k AS throttle,
       (l.k % 15 >= 10) AS drs_active, (l.k < 3) AS safety_car_active, p.p AS pitstop_probability, ROUND(ABS(p.p - 0.5E0) * 2, 4) AS confidence,
       (l.value % 100) / 1000 AS win_probability, CASE WHEN l.k % 3 = 0 THEN '' ELSE 'note ' || CAST(p.event_id AS VARCHAR(12)) END AS commentary
FROM f_laps l
JOIN (SELECT session_key, driver_number, lap_number, event_id, ROUND(1/(1+EXP(-(0.9E0*(p_xgb-0.5E0)/0.29E0 + 0.4E0*(p_lgb-0.4E0)/0.3E0 - 0.2E0))), 4) AS p FROM f_scores) p
  ON p.session_key = l.session_key AND p.driver_number = l.driver_number AND p.lap_number = l.lap_number
JOIN f_stints s ON s.session_key = l.session_key AND s.driver_number = l.driver_number AND l.lap_number >= s.lap_start AND (s.lap_end IS NULL OR l.lap_number <= s.lap_end)
""",
    "f_logs": """
SELECT event_id, event_time AS ts, 'fn-' || CAST(driver_number % 4 AS VARCHAR(4)) AS function_name,
       CASE WHEN k % 10 = 0 THEN 'START RequestId: r' || CAST(event_id AS VARCHAR(12))
            WHEN k % 10 = 1 THEN '[ERROR] failure ' || CAST(k AS VARCHAR(4))
            WHEN k % 10 = 2 THEN '{"k": ' || CAST(k AS VARCHAR(4)) || '}'
            WHEN k % 10 = 3 THEN 'ModelLatency:' || CAST(value AS VARCHAR(32))
            ELSE 'REPORT RequestId: r' || CAST(event_id AS VARCHAR(12)) || ' Duration: ' || CAST(value AS VARCHAR(32)) || ' ms  Billed Duration: ' || CAST(CAST(ceil(value) AS INT) AS VARCHAR(12))
                 || ' ms Memory Size: 512 MB Max Memory Used: ' || CAST(50 + k AS VARCHAR(4)) || ' MB' || CASE WHEN k % 10 = 9 THEN ' Init Duration: 432.1 ms' ELSE '' END END AS message
FROM f_base
""",
    "f_metric_points": """
SELECT event_id, event_time AS ts, 'fn-' || CAST(driver_number % 4 AS VARCHAR(4)) AS function_name,
       CASE event_type WHEN 'view' THEN 'Duration' WHEN 'click' THEN 'Invocations' WHEN 'error' THEN 'Errors' WHEN 'purchase' THEN 'ModelLatency' ELSE 'PredictionConfidence' END AS metric_name,
       CASE WHEN event_type = 'signup' THEN k / 100.0E0 ELSE value END AS metric_value
FROM f_base
""",
    "f_raw": """
SELECT l.session_key, l.driver_number, l.lap_number, l.event_time, l.duration_sector_1, l.lap_duration, l.did_pit, l.pit_lap,
       l.gap_raw AS gap_to_leader, l.air_temperature, l.track_temperature, l.rainfall, l.had_incident, l.yellow_flag_count,
       s.compound AS tyre_compound, 'circuit_' || CAST(l.session_key % 5 AS VARCHAR) AS circuit_id,
       CAST(57 + l.session_key % 3 AS INT) AS total_laps
FROM f_laps l
JOIN f_stints s ON s.session_key = l.session_key AND s.driver_number = l.driver_number AND l.lap_number BETWEEN s.lap_start AND COALESCE(s.lap_end, 1000000000)
""",
    "f_intervals": """
SELECT session_key, driver_number, lap_number, gap_raw AS gap_to_leader, event_time AS date FROM f_laps WHERE k % 4 <> 1
""",
    "f_grid": """
SELECT session_key, driver_number, CAST(driver_number % 22 + 1 AS DOUBLE) AS grid_position, top_k / 64.0E0 AS qualifying_delta_to_pole,
       CAST(pits AS INT) AS pit_count, CAST(laps AS DOUBLE) / (pits + 1) AS avg_stint_length,
       CASE session_key % 3 WHEN 0 THEN 'street' WHEN 1 THEN 'permanent' ELSE 'hybrid' END AS circuit_type,
       CASE driver_number % 12 WHEN 0 THEN 'McLaren' WHEN 1 THEN 'Ferrari' WHEN 2 THEN 'Red Bull' WHEN 3 THEN 'Mercedes' WHEN 4 THEN 'Williams' WHEN 5 THEN 'Aston Martin'
            WHEN 6 THEN 'Alpine' WHEN 7 THEN 'Haas' WHEN 8 THEN 'Racing Bulls' WHEN 9 THEN 'Audi' WHEN 10 THEN 'Cadillac' ELSE 'Unknown' END AS team,
       CASE driver_number % 6 WHEN 0 THEN 'SOFT-MEDIUM' WHEN 1 THEN 'SOFT-HARD' WHEN 2 THEN 'MEDIUM-HARD' WHEN 3 THEN 'ONE-STOP' WHEN 4 THEN 'TWO-STOP' END AS tyre_strategy,
       top_k / 128.0E0 AS weather_impact_score,
       CASE WHEN driver_number % 11 <> 0 THEN CAST((driver_number * 7) % 22 + 1 AS INT) END AS final_position
FROM (SELECT session_key, driver_number, COUNT(*) AS laps, SUM(CASE WHEN event_type='purchase' AND k % 5 = 0 THEN 1 ELSE 0 END) AS pits, MAX(k) AS top_k
      FROM f_base GROUP BY session_key, driver_number) g
""",
    "f_sessions": """
SELECT session_key, CASE session_key % 5 WHEN 0 THEN 'Race' WHEN 1 THEN 'Qualifying' WHEN 2 THEN 'Sprint' ELSE 'Practice' END AS session_type,
       date_start, CASE session_key % 4 WHEN 0 THEN 'Japan' WHEN 1 THEN 'Italy' WHEN 2 THEN 'Nowhere' ELSE 'Monaco' END AS country_name
FROM (SELECT session_key, MIN(event_time) AS date_start FROM f_base GROUP BY session_key) g
""",
    "f_nested": """
SELECT session_key, driver_number, driver_name, team, tyre_compound, lap_number, ts, pits_completed,
       CASE WHEN pits_completed > 0 THEN speed END AS last_pit_duration, CASE WHEN pits_completed > 0 THEN lap_number - tyre_age END AS last_pit_lap,
       CASE WHEN throttle % 4 <> 0 THEN drs_active END AS drs_active, speed, throttle, 100 - throttle AS brake, throttle % 9 AS gear,
       3 + throttle % 9 AS n_features, CAST(tyre_age AS DOUBLE) AS f0, CAST(stint_number AS DOUBLE) AS f1, gap_to_leader AS f2, 18.0E0 + throttle % 22 AS f3,
       30.0E0 + throttle % 30 AS f4, CASE WHEN throttle % 12 = 0 THEN 1.0E0 ELSE 0.0E0 END AS f5, speed AS f6,
       CASE WHEN throttle % 7 <> 0 THEN pitstop_probability END AS p, CASE WHEN throttle % 7 <> 0 THEN confidence END AS conf,
       (speed % 100) / 100 AS win_probability, safety_car_active, commentary
FROM f_predictions
""",
    "f_log": """
SELECT session_key, lap_number, CASE session_key % 4 WHEN 0 THEN 'Japan' WHEN 1 THEN 'Italy' WHEN 2 THEN 'Nowhere' ELSE 'Monaco' END AS country_name,
       strftime(MAX(ts), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, MAX(commentary) AS commentary
FROM f_nested GROUP BY session_key, lap_number
""",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it names, and those they name, as leading CTEs."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                need(VIEWS[name])
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in wanted)
    return f"WITH {ctes}\n{sql}"
