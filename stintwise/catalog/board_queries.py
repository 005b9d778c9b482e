"""Queries of dashboards, serving reads, logs and alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.catalog.join_queries import CIRCUIT
from stintwise.catalog.registry import query
from stintwise.catalog.tables import Tables
from stintwise.operators import alarms as A
from stintwise.operators import logs as L
from stintwise.operators.state import latest_per_driver
from stintwise.plans import dashboards as D
from stintwise.plans import serving as S

c = F.col
DRIVER = ["session_key", "driver_number"]
NEWEST = "(SELECT MAX(ts) FROM f_predictions)"


def _since(minutes: int) -> str:
    return f"(SELECT * FROM f_predictions WHERE ts >= {NEWEST} - INTERVAL {minutes} MINUTE)"


def _latest(minutes: int, by: str, columns: str, where: str = "TRUE") -> str:
    return f"""SELECT {columns} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY ts DESC, session_key DESC, driver_number DESC) AS rn
    FROM {_since(minutes)} w WHERE {where}) x WHERE rn = 1"""


# single values --------------------------------------------------------------


@query(f"SELECT MAX(lap_number) AS lap FROM {_since(10)} w")
def max_lap(t: Tables) -> DataFrame:
    return D.max_lap(t.predictions)


@query(_latest(10, "1", "safety_car_active AS safety_car"))
def latest_safety_car(t: Tables) -> DataFrame:
    return D.latest_safety_car(t.predictions)


@query("SELECT COUNT(DISTINCT driver_number) AS drivers FROM f_predictions")
def drivers_tracked(t: Tables) -> DataFrame:
    return D.drivers_tracked(t.predictions, minutes=None)


@query(f"SELECT COUNT(DISTINCT driver_number) AS drivers FROM {_since(10)} w")
def unique_drivers(t: Tables) -> DataFrame:
    return D.drivers_tracked(t.predictions, minutes=10)


@query(_latest(10, "1", "session_key"))
def latest_session_key(t: Tables) -> DataFrame:
    return D.latest_session_key(t.predictions)


@query(_latest(30, "1", "commentary", "commentary <> ''"))
def latest_commentary(t: Tables) -> DataFrame:
    return D.latest_commentary(t.predictions)


@query(
    """SELECT session_key, lap_number, AVG(confidence) AS avg_confidence, COUNT(CASE WHEN confidence > 0.85 THEN 1 END) AS high_confidence_count
    FROM f_predictions GROUP BY session_key, lap_number""",
    digits="avg_confidence",
)
def confidence_metrics(t: Tables) -> DataFrame:
    return D.confidence_metrics(t.predictions, ["session_key", "lap_number"])


@query(
    "SELECT AVG(confidence) AS avg_confidence, MAX(pitstop_probability) AS highest_probability, COUNT(*) AS predictions FROM f_predictions",
    digits="avg_confidence",
)
def confidence_summary(t: Tables) -> DataFrame:
    return D.confidence_summary(t.predictions)


@query("SELECT MAX(CAST(safety_car_active AS INT)) AS safety_car FROM f_predictions")
def sc_flag_max(t: Tables) -> DataFrame:
    return D.sc_flag_max(t.predictions)


# latest per driver ----------------------------------------------------------


def _facet(minutes: int, value: str, name: str) -> str:
    return _latest(minutes, "driver_name", f"driver_name, {value} AS {name}") + f" ORDER BY {name} DESC, driver_name LIMIT 22"


@query(_facet(30, "pitstop_probability * 100", "pit_pct"), digits="pit_pct")
def latest_pit_percent(t: Tables) -> DataFrame:
    return D.latest_pit_percent(t.predictions)


@query(_facet(30, "win_probability * 100", "win_pct"), digits="win_pct")
def latest_win_percent(t: Tables) -> DataFrame:
    return D.latest_win_percent(t.predictions)


@query(_facet(10, "speed", "speed"))
def latest_speed(t: Tables) -> DataFrame:
    return D.latest_speed(t.predictions)


@query(_facet(30, "tyre_age", "tyre_age"))
def latest_tyre_age(t: Tables) -> DataFrame:
    return D.latest_tyre_age(t.predictions)


@query(_facet(30, "pits_completed", "pit_stops"))
def latest_stop_count(t: Tables) -> DataFrame:
    return D.latest_stop_count(t.predictions)


@query(
    _latest(
        30,
        "driver_number",
        """driver_number, driver_name AS driver, team, tyre_compound AS tyre, tyre_age, pits_completed AS stops, CASE WHEN pits_completed > 0 THEN speed END AS last_stop,
        pitstop_probability * 100 AS pit_pct, win_probability * 100 AS win_pct, lap_number AS lap, speed, drs_active AS drs""",
    )
    + " ORDER BY driver_number LIMIT 22",
    digits="pit_pct win_pct",
)
def full_standings(t: Tables) -> DataFrame:
    rows = t.predictions.withColumn("last_pit_duration", F.when(c("pits_completed") > 0, c("speed")))
    return D.full_standings(rows)


@query(
    _latest(
        30,
        "driver_number",
        "driver_number, driver_name AS driver, team, pitstop_probability * 100 AS pit_pct, tyre_compound AS tyre, tyre_age",
        "pitstop_probability > 0.7",
    )
    + " ORDER BY pit_pct DESC, driver_number LIMIT 22",
    digits="pit_pct",
)
def dashboard_alerts(t: Tables) -> DataFrame:
    return D.dashboard_alerts(t.predictions)


@query(
    _latest(
        120,
        "driver_number",
        "driver_number, tyre_compound, tyre_age, pitstop_probability, win_probability",
        f"session_key = (SELECT session_key FROM {_since(120)} s ORDER BY ts DESC, session_key DESC LIMIT 1)",
    )
)
def tyre_status(t: Tables) -> DataFrame:
    return D.tyre_status(t.predictions)


# distributions --------------------------------------------------------------


@query(
    "SELECT driver_name, MAX(pitstop_probability) AS max_pit_probability FROM f_predictions GROUP BY driver_name ORDER BY 2 DESC, 1 LIMIT 22"
)
def max_pit_by_driver(t: Tables) -> DataFrame:
    return D.max_pit_by_driver(t.predictions)


@query(
    "SELECT driver_name, MAX(pitstop_probability) AS max_pit_probability FROM f_predictions GROUP BY driver_name ORDER BY 2 DESC, 1 LIMIT 10"
)
def top_pit_candidates(t: Tables) -> DataFrame:
    return D.max_pit_by_driver(t.predictions, 10)


BAND = "CASE WHEN pitstop_probability >= 0.7 THEN 'HIGH' WHEN pitstop_probability >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"SELECT {BAND} AS risk_band, COUNT(*) AS n FROM f_predictions GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def risk_band_counts(t: Tables) -> DataFrame:
    return D.risk_band_counts(t.predictions)


@query("SELECT tyre_compound, COUNT(*) AS n FROM f_predictions GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def compound_counts(t: Tables) -> DataFrame:
    return D.compound_counts(t.predictions)


@query("SELECT CAST(tyre_age // 2 * 2 AS BIGINT) AS tyre_age_bin, COUNT(*) AS n FROM f_predictions GROUP BY 1")
def tyre_age_histogram(t: Tables) -> DataFrame:
    return D.tyre_age_histogram(t.predictions)


@query(
    "SELECT CAST(tyre_age // 2 * 2 AS BIGINT) AS tyre_age_bin, AVG(pitstop_probability) AS avg_probability FROM f_predictions GROUP BY 1",
    digits="avg_probability",
)
def prob_by_tyre_age(t: Tables) -> DataFrame:
    return D.prob_by_tyre_age(t.predictions)


@query(
    f"""SELECT driver_name, team, tyre_compound, {BAND} AS risk_band, MAX(pitstop_probability) AS pit_probability, MAX(confidence) AS confidence,
    MAX(tyre_age) AS tyre_age FROM f_predictions GROUP BY 1, 2, 3, 4"""
)
def driver_strategy_table(t: Tables) -> DataFrame:
    return D.driver_strategy_table(t.predictions)


# time series ----------------------------------------------------------------


def _series(value: str, columns: str, n: int | None, size: str = "hour", source: str = "f_predictions") -> str:
    top = (
        f"WHERE driver_name IN (SELECT driver_name FROM (SELECT driver_name, AVG({value}) AS s FROM {source} a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}) b)"
        if n
        else ""
    )
    return f"SELECT date_trunc('{size}', ts) AS bucket, driver_name, {columns} FROM {source} r {top} GROUP BY 1, 2"


@query(
    _series("pitstop_probability", "AVG(pitstop_probability) AS avg_probability, MAX(pitstop_probability) AS max_probability", 5),
    digits="avg_probability",
)
def prob_timeline_top5(t: Tables) -> DataFrame:
    return D.prob_timeline_top5(t.predictions)


@query(_series("gap_to_leader", "AVG(gap_to_leader) AS avg_gap", 5), digits="avg_gap")
def gap_timeline_top5(t: Tables) -> DataFrame:
    return D.gap_timeline_top5(t.predictions)


@query(
    "SELECT date_trunc('hour', ts) AS bucket, AVG(confidence) AS avg_confidence, MIN(confidence) AS min_confidence FROM f_predictions GROUP BY 1",
    digits="avg_confidence",
)
def confidence_timeline(t: Tables) -> DataFrame:
    return D.confidence_timeline(t.predictions)


@query(
    _series("pitstop_probability", "AVG(pitstop_probability) AS avg_probability", 10, "minute"), digits="avg_probability"
)
def prob_per_minute_top10(t: Tables) -> DataFrame:
    return D.prob_per_minute_top10(t.predictions)


@query(_series("1", "AVG(pitstop_probability) AS avg_probability", None, "minute"), digits="avg_probability")
def prob_timeseries_1m(t: Tables) -> DataFrame:
    return D.prob_timeseries_1m(t.predictions)


@query(_series("1", "AVG(win_probability) AS avg_win_probability", None, "minute"), digits="avg_win_probability")
def win_timeseries_1m(t: Tables) -> DataFrame:
    return D.win_timeseries_1m(t.predictions)


@query(
    _series("pitstop_probability", "AVG(pitstop_probability) * 100 AS pit_pct", 10, "minute", _since(120)), digits="pit_pct"
)
def pit_percent_timeseries_top10(t: Tables) -> DataFrame:
    return D.pit_percent_timeseries_top10(t.predictions)


@query(_series("win_probability", "AVG(win_probability) * 100 AS win_pct", 10, "minute", _since(120)), digits="win_pct")
def win_percent_timeseries_top10(t: Tables) -> DataFrame:
    return D.win_percent_timeseries_top10(t.predictions)


# function metrics -----------------------------------------------------------


def _metric(metric: str, columns: str, minutes: int | None = None, by: str = "bucket, function_name") -> str:
    recent = f"AND ts >= (SELECT MAX(ts) FROM f_metric_points) - INTERVAL {minutes} MINUTE" if minutes else ""
    return f"""SELECT {by}, {columns} FROM (SELECT *, date_trunc('hour', ts) AS bucket FROM f_metric_points WHERE metric_name = '{metric}'
    AND function_name LIKE 'fn-%' {recent}) x GROUP BY {by}"""


@query(_metric("Invocations", "SUM(metric_value) AS invocations"), digits="invocations", places=6)
def invocations_timeseries(t: Tables) -> DataFrame:
    return D.invocations_timeseries(t.metric_points)


@query(_metric("Errors", "SUM(metric_value) AS errors, SUM(metric_value) > 0 AS has_errors"), digits="errors", places=6)
def errors_timeseries(t: Tables) -> DataFrame:
    return D.errors_timeseries(t.metric_points)


@query(_metric("Duration", "QUANTILE_CONT(metric_value, 0.99) AS p99_duration"), digits="p99_duration", places=6)
def duration_p99(t: Tables) -> DataFrame:
    return D.duration_p99(t.metric_points)


@query(_metric("ModelLatency", "SUM(metric_value) AS model_latency", by="bucket"), digits="model_latency", places=6)
def model_latency_timeseries(t: Tables) -> DataFrame:
    return D.model_latency_timeseries(t.metric_points)


@query(_metric("Invocations", "SUM(metric_value) AS invocations", 1440), digits="invocations", places=6)
def recent_invocations(t: Tables) -> DataFrame:
    return D.invocations_timeseries(D.since(t.metric_points, 1440))


@query(
    _metric("Errors", "SUM(metric_value) AS errors, SUM(metric_value) > 0 AS has_errors", 1440), digits="errors", places=6
)
def recent_errors(t: Tables) -> DataFrame:
    return D.errors_timeseries(D.since(t.metric_points, 1440))


@query(_metric("Duration", "QUANTILE_CONT(metric_value, 0.99) AS p99_duration", 1440), digits="p99_duration", places=6)
def recent_duration_p99(t: Tables) -> DataFrame:
    return D.duration_p99(D.since(t.metric_points, 1440))


@query(_metric("ModelLatency", "SUM(metric_value) AS model_latency", 1440, "bucket"), digits="model_latency", places=6)
def recent_model_latency(t: Tables) -> DataFrame:
    return D.model_latency_timeseries(D.since(t.metric_points, 1440))


# logs -----------------------------------------------------------------------


@query("SELECT event_id, function_name, message FROM f_logs WHERE NOT regexp_matches(message, '^(START|END) RequestId')")
def drop_noise_logs(t: Tables) -> DataFrame:
    return L.drop_noise_logs(t.logs).drop("ts")


def _num(label: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract(message, '{label}: ([0-9.]+)', 1), '') AS DOUBLE)"


@query(
    f"""SELECT event_id, function_name, CASE WHEN r THEN 'REPORT' WHEN e THEN 'ERROR' WHEN j THEN 'INFO' WHEN m THEN 'METRIC' END AS log_level,
    CASE WHEN r AND message LIKE '%Init Duration%' THEN 'cold_start' WHEN r THEN 'function_report' WHEN e THEN 'function_error' WHEN j THEN 'structured_log'
      WHEN m THEN 'model_latency' END AS tag, CASE WHEN r THEN regexp_extract(message, 'RequestId: ([^ ]+)', 1) END AS request_id,
    CASE WHEN r THEN {_num("r[0-9]+ Duration")} END AS duration_ms, CASE WHEN r THEN {_num("Billed Duration")} END AS billed_duration_ms,
    CASE WHEN r THEN CAST({_num("Memory Size")} AS INT) END AS memory_size_mb, CASE WHEN r THEN CAST({_num("Max Memory Used")} AS INT) END AS memory_used_mb,
    CASE WHEN r THEN {_num("Init Duration")} END AS init_duration_ms, CASE WHEN e THEN regexp_extract(message, '^.ERROR. (.*)$', 1) END AS error_message,
    CASE WHEN j THEN regexp_extract(message, '([0-9]+)', 1) END AS k, CASE WHEN m THEN CAST(replace(message, 'ModelLatency:', '') AS DOUBLE) / 1000 END AS model_latency_ms
    FROM (SELECT *, message LIKE 'REPORT%' AS r, message LIKE '[ERROR]%' AS e, message LIKE '{{%' AS j, message LIKE 'ModelLatency%' AS m
      FROM f_logs WHERE message NOT LIKE 'START%') x""",
    digits="model_latency_ms",
)
def parse_report_lines(t: Tables) -> DataFrame:
    return L.parse_report_lines(t.logs).withColumn("k", c("parsed")["k"]).drop("parsed", "ts")


@query(
    "SELECT event_id, metric_name, CASE WHEN metric_name = 'ModelLatency' THEN metric_value / 1000 END AS metric_value_ms FROM f_metric_points",
    digits="metric_value_ms",
)
def latency_to_ms(t: Tables) -> DataFrame:
    return L.latency_to_ms(t.metric_points).select("event_id", "metric_name", "metric_value_ms")


# alarms ---------------------------------------------------------------------


def _alarm(metric: str, stat: str, seconds: int, test: str, periods: int, keys: str = "function_name") -> str:
    """Periods of the alarm by a self-join over the last ``periods`` period numbers."""
    per = f"""SELECT {keys}, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) AS p, {stat} AS value FROM f_metric_points
      WHERE metric_name = '{metric}' GROUP BY {keys}, 2"""
    return f"""SELECT a.{keys}, TIMESTAMP '1970-01-01' + to_seconds(a.p * {seconds}) AS period_start, ANY_VALUE(a.value) AS value, BOOL_AND(a.value {test}) AS breaching,
    SUM(CASE WHEN b.value {test} THEN 1 ELSE 0 END) = {periods} AS alarm FROM ({per}) a JOIN ({per}) b ON a.{keys} = b.{keys}
    AND b.p BETWEEN a.p - {periods - 1} AND a.p GROUP BY a.{keys}, a.p"""


@query(_alarm("PredictionConfidence", "AVG(metric_value)", 14400, "< 0.65", 10, "metric_name"), digits="value")
def drift_alarm(t: Tables) -> DataFrame:
    """Four-hour periods, since the events are minutes apart."""
    return A.drift_alarm(t.metric_points, seconds=14400)


@query(_alarm("Errors", "SUM(metric_value)", 300, "> 5", 1), digits="value", places=6)
def error_alarm(t: Tables) -> DataFrame:
    return A.error_alarm(t.metric_points)


@query(_alarm("ModelLatency", "QUANTILE_CONT(metric_value, 0.99)", 3600, "> 100", 3), digits="value", places=6)
def latency_alarm(t: Tables) -> DataFrame:
    return A.latency_alarm(t.metric_points, seconds=3600, threshold=100.0)


@query(_alarm("Invocations", "AVG(metric_value)", 300, "> 0", 1), digits="value")
def delivery_alarm(t: Tables) -> DataFrame:
    return A.delivery_alarm(t.metric_points, metric="Invocations")


@query(_alarm("Duration", "MAX(metric_value)", 86400, "> 300", 1))
def billing_alarm(t: Tables) -> DataFrame:
    return A.billing_alarm(t.metric_points, metric="Duration", threshold=300.0)


# serving --------------------------------------------------------------------

SHOWN = """driver_number, driver_name, team, tyre_compound, f0 AS tyre_age, lap_number, COALESCE(p, 0) AS pitstop_probability, COALESCE(conf, 0) AS confidence,
    win_probability, pits_completed, last_pit_duration, last_pit_lap, COALESCE(drs_active, FALSE) AS drs_active, speed, f2 AS gap_to_leader"""


@query(
    f"""SELECT session_key, {SHOWN} FROM f_nested WHERE session_key = 9003 AND lap_number =
    (SELECT lap_number FROM f_log WHERE session_key = 9003 ORDER BY timestamp DESC LIMIT 1)"""
)
def session_predictions(t: Tables) -> DataFrame:
    return S.session_predictions(t.inference_log, 9003)


@query(
    f"""SELECT n.session_key, {SHOWN}, country_name, {CIRCUIT} AS circuit_key, timestamp AS prediction_time FROM f_nested n
    JOIN (SELECT session_key, lap_number AS lap, country_name, timestamp FROM f_log ORDER BY timestamp DESC, session_key DESC LIMIT 1) g
    ON n.session_key = g.session_key AND n.lap_number = g.lap"""
)
def latest_snapshot(t: Tables) -> DataFrame:
    return S.latest_snapshot(t.inference_log)


@query(
    """SELECT session_key, timestamp, commentary, country_name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_key ORDER BY timestamp DESC) AS rn
    FROM f_log) x WHERE rn = 1"""
)
def latest_log_per_session(t: Tables) -> DataFrame:
    return S.latest_log_per_session(t.inference_log).select("session_key", "timestamp", "commentary", "country_name")


@query("SELECT DISTINCT CAST(session_key AS VARCHAR) AS session_key FROM f_log")
def list_sessions(t: Tables) -> DataFrame:
    return S.list_sessions(t.inference_log)


@query(
    f"""SELECT n.session_key, {SHOWN} FROM f_nested n JOIN (SELECT session_key, lap_number AS lap FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_key
    ORDER BY timestamp DESC) AS rn FROM f_log) x WHERE rn = 1 AND session_key IN
      (SELECT session_key FROM (SELECT DISTINCT session_key FROM f_log) d ORDER BY CAST(session_key AS VARCHAR) DESC LIMIT 10)) g
    ON n.session_key = g.session_key AND n.lap_number = g.lap"""
)
def session_history(t: Tables) -> DataFrame:
    return S.session_history(t.inference_log)


@query(
    """SELECT session_key, session_type, date_start, country_name FROM f_sessions WHERE date_start <= TIMESTAMP '2024-01-01 00:30:00'
    ORDER BY date_start DESC, session_key DESC LIMIT 1"""
)
def latest_started_session(t: Tables) -> DataFrame:
    return S.latest_started_session(t.sessions, F.lit("2024-01-01 00:30:00").cast("timestamp_ntz"))


@query(
    """SELECT session_key, driver_number, gap_raw, position FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY session_key ORDER BY
      CASE WHEN gap_raw IS NULL OR TRY_CAST(replace(gap_raw, '+', '') AS DOUBLE) = 0 THEN -1 ELSE COALESCE(TRY_CAST(replace(gap_raw, '+', '') AS DOUBLE), 999) END,
      driver_number) AS INT) AS position
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_key, driver_number ORDER BY lap_number DESC) AS rn FROM f_laps) a WHERE rn = 1) b WHERE position <= 5"""
)
def standings_top5(t: Tables) -> DataFrame:
    newest = latest_per_driver(t.laps.select(*DRIVER, "gap_raw", c("lap_number").alias("date")))
    return S.standings_top5(newest, gap="gap_raw").drop("date")


LATEST_EACH = """(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_key, driver_number ORDER BY ts DESC) AS rn FROM f_predictions) a WHERE rn = 1)"""


def _newest(t: Tables) -> DataFrame:
    return latest_per_driver(t.predictions.withColumnRenamed("ts", "date"))


@query(
    f"""SELECT session_key, driver_number, pitstop_probability, rank FROM (SELECT session_key, driver_number, pitstop_probability,
    CAST(ROW_NUMBER() OVER (PARTITION BY session_key ORDER BY pitstop_probability DESC, driver_number) AS INT) AS rank FROM {LATEST_EACH} b) x WHERE rank <= 3"""
)
def pit_candidates_top3(t: Tables) -> DataFrame:
    return S.pit_candidates_top3(_newest(t)).select(*DRIVER, "pitstop_probability", "rank")


@query(
    f"""SELECT session_key, position, driver_name, team, CASE WHEN position > 1 THEN gap_to_leader END AS gap, tyre_compound, pits_completed
    FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY session_key ORDER BY win_probability DESC, driver_number) AS INT) AS position FROM {LATEST_EACH} b) x
    WHERE position <= 3"""
)
def podium(t: Tables) -> DataFrame:
    return S.podium(_newest(t))
