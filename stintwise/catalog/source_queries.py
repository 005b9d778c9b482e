"""Queries that go through a source, a sink or a stream.

Each writes tables derived from the events to a fresh shared folder and reads
them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise import schemas
from stintwise.catalog.board_queries import SHOWN
from stintwise.catalog.join_queries import TEAM_SCORE
from stintwise.catalog.registry import query
from stintwise.catalog.state_queries import FINISHED, LIVE, SC_STATE
from stintwise.catalog.tables import Tables
from stintwise.functions.parsing import parse_gap, rain_flag
from stintwise.operators.quality import format_prediction
from stintwise.session import shared_dir, written
from stintwise.sources import readers as R
from stintwise.sources import writers as W
from stintwise.streaming import enrichment, rollups, state
from stintwise.streaming import feeds

c = F.col
DRIVER = ["session_key", "driver_number"]
KEY = [*DRIVER, "lap_number"]
LAPS = "session_key, driver_number, lap_number"


def _dir(t: Tables, name: str) -> str:
    return shared_dir(t.spark, name)


RAW_COLUMNS = "session_key, driver_number, lap_number, event_time, duration_sector_1, did_pit, gap_to_leader, rainfall, tyre_compound"


@query(f"SELECT {RAW_COLUMNS} FROM f_raw")
def scan_raw_laps(t: Tables) -> DataFrame:
    path = _dir(t, "raw-laps")
    t.raw_laps.select(*[n.split()[0] for n in schemas.RAW_LAPS.split(", ")]).write.parquet(path)
    return R.scan_raw_laps(t.spark, f"{path}/*.parquet").select(*RAW_COLUMNS.split(", "))


def _documents(t: Tables) -> DataFrame:
    path = _dir(t, "documents")
    t.session_documents.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return R.read_session_documents(t.spark, path)


@query(f"SELECT {LAPS}, event_time AS date_start, duration_sector_1, lap_duration FROM f_laps")
def flatten_session(t: Tables) -> DataFrame:
    return _plain(R.flatten_session(_documents(t), "laps"), "date_start")


@query("SELECT session_key, driver_number, event_time AS date, value AS x, CAST(k AS DOUBLE) AS y FROM f_base WHERE event_type = 'signup'")
def flatten_session_position(t: Tables) -> DataFrame:
    return _plain(R.flatten_session(_documents(t), "position"), "date")


@query("SELECT session_key, driver_number, stint_number, lap_start, lap_end, compound FROM f_stints")
def flatten_session_stints(t: Tables) -> DataFrame:
    return R.flatten_session(_documents(t), "stints")


@query(f"SELECT {LAPS}, gap_to_leader, date FROM f_intervals")
def flatten_session_intervals(t: Tables) -> DataFrame:
    return _plain(R.flatten_session(_documents(t), "intervals"), "date")


@query(f"SELECT {LAPS}, pit_duration, pit_out_lap FROM f_pit")
def flatten_session_pit(t: Tables) -> DataFrame:
    return R.flatten_session(_documents(t), "pit")


@query("SELECT session_key, date, air_temperature, track_temperature, rainfall FROM f_weather")
def flatten_session_weather(t: Tables) -> DataFrame:
    return _plain(R.flatten_session(_documents(t), "weather"), "date")


@query("SELECT session_key, date, flag, message, lap_number FROM f_race_control")
def flatten_session_race_control(t: Tables) -> DataFrame:
    return _plain(R.flatten_session(_documents(t), "race_control"), "date")


@query(f"SELECT {LAPS}, lap_duration, rainfall FROM (SELECT {LAPS}, lap_duration, CASE WHEN rainfall THEN 1 ELSE 0 END AS rainfall FROM f_raw) x")
def load_training(t: Tables) -> DataFrame:
    """Even sessions come as Parquet, odd ones as CSV."""
    root = _dir(t, "training")
    rows = t.raw_laps.withColumn("rainfall", rain_flag(c("rainfall")))
    names = [*KEY, "lap_duration", "rainfall"]
    rows.where("session_key % 2 = 0").select(*names).write.parquet(f"{root}/columnar")
    W.export_csv(rows.where("session_key % 2 = 1").select(*names), f"{root}/text")
    schema = "session_key bigint, driver_number int, lap_number int, lap_duration double, rainfall int"
    return R.load_training(t.spark, root, schema)


@query(f"SELECT {LAPS}, lap_duration, did_pit FROM f_raw")
def write_features(t: Tables) -> DataFrame:
    path = W.write_features(t.raw_laps.select(*KEY, "lap_duration", "did_pit"), _dir(t, "features"))
    return t.spark.read.schema(
        "driver_number int, lap_number int, lap_duration double, did_pit int, session_key bigint"
    ).parquet(path)


@query(f"SELECT {LAPS}, lap_duration, gap_to_leader FROM f_raw")
def export_csv(t: Tables) -> DataFrame:
    path = W.export_csv(t.raw_laps.select(*KEY, "lap_duration", "gap_to_leader"), _dir(t, "csv"))
    schema = "session_key bigint, driver_number int, lap_number int, lap_duration double, gap_to_leader string"
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query(f"SELECT {LAPS}, lap_duration FROM f_laps")
def write_raw_session(t: Tables) -> DataFrame:
    path = W.write_raw_session(t.session_documents, _dir(t, "raw-sessions"))
    return R.flatten_session(R.read_session_documents(t.spark, path), "laps").select(*KEY, "lap_duration")


def _log(t: Tables) -> str:
    return W.write_inference_log(t.inference_log, _dir(t, "log"))


@query(
    f"SELECT n.session_key, {SHOWN}, n.commentary IS NOT NULL AS noted FROM f_nested n"
)
def read_inference_log(t: Tables) -> DataFrame:
    rows = R.read_inference_log(t.spark, _log(t))
    return format_prediction(rows).join(
        rows.select(*KEY, c("commentary").isNotNull().alias("noted")), KEY
    )


@query("SELECT session_key, timestamp, country_name, commentary FROM f_log")
def write_inference_log(t: Tables) -> DataFrame:
    rows = t.spark.read.schema(schemas.INFERENCE_LOG).json(_log(t))
    return rows.select("session_key", "timestamp", "country_name", "commentary")


@query("SELECT event_id, function_name, message FROM f_logs")
def log_delivery(t: Tables) -> DataFrame:
    """Log lines delivered as GZIP JSON by a stream."""
    source, target = _dir(t, "lines"), _dir(t, "delivered")
    t.logs.write.parquet(source)
    schema = "event_id bigint, ts timestamp_ntz, function_name string, message string"
    lines = feeds.incremental_files(t.spark, source, schema, "parquet", "*.parquet", bytes_per_batch=5 * 1024 * 1024)
    feeds.log_delivery(lines, target, f"{target}-checkpoint", seconds=None).awaitTermination()
    return t.spark.read.schema(schema).json(target).drop("ts")


@query("SELECT event_id, function_name, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM f_logs")
def incremental_files(t: Tables) -> DataFrame:
    """Two runs over one folder; the second sees only what came after the first."""
    source, target = _dir(t, "arrivals"), _dir(t, "caught-up")
    schema = "event_id bigint, function_name string"
    for run in (1, 2):
        t.logs.where(c("event_id") % 2 == run - 1).select("event_id", "function_name").write.mode("append").json(source)
        stream = feeds.incremental_files(t.spark, source, schema, "json", "*.json")

        def save(batch: DataFrame, batch_id: int, run: int = run) -> None:
            batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{target}/part={run}-{batch_id}")

        feeds.on_new_raw(stream, save, f"{target}-checkpoint").awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "function_name", "run")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, driver_name, COUNT(*) AS n FROM f_predictions GROUP BY 1, 2")
def write_daily(t: Tables) -> DataFrame:
    path = W.write_daily(t.predictions.select("ts", "driver_name"), _dir(t, "daily"))
    rows = t.spark.read.schema("ts timestamp_ntz, driver_name string, dt string").parquet(path)
    return rows.groupBy("dt", "driver_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CAST(driver_number AS BIGINT) AS driver_number, event_time, CAST(k AS DOUBLE) AS tyre_age, COALESCE(TRY_CAST(replace(gap_raw, '+', '') AS DOUBLE), 0) AS gap_to_leader
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY driver_number ORDER BY event_time DESC) AS rn FROM f_laps WHERE event_time <= TIMESTAMP '2024-01-18') x WHERE rn = 1"""
)
def feature_store_append(t: Tables) -> DataFrame:
    """Two appends, then a read as of a day."""
    path = _dir(t, "store")
    rows = t.laps.select(
        "driver_number",
        "event_time",
        c("k").alias("tyre_age"),
        F.lit(1).alias("stint_number"),
        parse_gap(c("gap_raw")).alias("gap_to_leader"),
        "air_temperature",
        "track_temperature",
        rain_flag(c("rainfall")).alias("rainfall"),
        F.coalesce("duration_sector_1", F.lit(0.0)).alias("sector_delta"),
        "lap_number",
    )
    for part in ("lap_number % 2 = 0", "lap_number % 2 = 1"):
        W.feature_store_append(rows.where(part), path)
    at = F.lit("2024-01-18 00:00:00").cast("timestamp_ntz")
    return R.read_features_as_of(t.spark, path, at).select("driver_number", "event_time", "tyre_age", "gap_to_leader")


@query(
    "SELECT session_key, 0.8E0 + session_key % 10 / 100.0E0 AS auc, session_key % 10 >= 2 AS approved FROM f_sessions", digits="auc"
)
def read_training_runs(t: Tables) -> DataFrame:
    path = _dir(t, "runs")
    auc = 0.8 + c("session_key") % 10 / 100.0
    runs = t.sessions.select(
        auc.alias("auc"),
        F.lit(0.82).alias("auc_threshold"),
        (c("session_key") % 10 >= 2).alias("approved"),
        c("session_key").cast("string").alias("model_uri"),
    )
    runs.write.json(path)
    return R.read_training_runs(t.spark, path).select(
        c("model_uri").cast("bigint").alias("session_key"), "auc", "approved"
    )


@query("SELECT message, COUNT(*) AS n FROM f_logs GROUP BY message")
def read_function_logs(t: Tables) -> DataFrame:
    path = _dir(t, "text-logs")
    t.logs.select("message").write.text(path)
    return R.read_function_logs(t.spark, path).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ts, function_name, metric_name, metric_value FROM f_metric_points")
def read_metric_points(t: Tables) -> DataFrame:
    path = W.write_records(t.metric_points, _dir(t, "metrics"))
    return R.read_metric_points(t.spark, path)


@query(
    "SELECT session_key, driver_number, stint_number, lap_start FROM f_stints WHERE session_key % 2 = 0 OR stint_number < 3"
)
def save_stint_cache(t: Tables) -> DataFrame:
    """A full save of early stints, then a save of even sessions only; odd ones keep the first."""
    path = _dir(t, "stints")
    W.save_stint_cache(t.stints.where("stint_number < 3"), path)
    W.save_stint_cache(t.stints.where("session_key % 2 = 0"), path)
    return R.load_stint_cache(t.spark, path).select(
        c("session_key").cast("bigint").alias("session_key"), "driver_number", "stint_number", "lap_start"
    )


# streams --------------------------------------------------------------------


def _stream(t: Tables) -> Tables:
    """The same tables over the events as a stream; times are instants, as watermarks need."""
    events = (
        t.spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    ).withColumn("ts", c("ts").cast("timestamp"))
    return Tables(t.spark, t.dir, events=events)


def _state(t: Tables, stream: DataFrame, keys: list[str], name: str, mode: str = "update") -> DataFrame:
    path = _dir(t, name)
    feeds.state_table(stream, path, f"{path}-checkpoint", mode=mode, keys=keys).awaitTermination()
    return feeds.read_state(t.spark, path, keys)


def _plain(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, c(name).cast("timestamp_ntz"))


@query(
    """SELECT session_key, driver_number, date, speed, throttle, drs FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_key, driver_number ORDER BY date DESC) AS rn
    FROM f_car_data) x WHERE rn = 1"""
)
def car_state(t: Tables) -> DataFrame:
    state = _state(t, feeds.car_state(_stream(t).car_data), DRIVER, "cars")
    return _plain(state, "date").select(*DRIVER, "date", "speed", "throttle", "drs")


@query(
    """SELECT session_key, driver_number, date, x, y FROM (SELECT session_key, driver_number, event_time AS date, value AS x, CAST(k AS DOUBLE) AS y,
    ROW_NUMBER() OVER (PARTITION BY session_key, driver_number ORDER BY event_time DESC) AS rn FROM f_base WHERE event_type = 'signup') a WHERE rn = 1
    AND date >= (SELECT MAX(event_time) FROM f_base WHERE event_type = 'signup') - INTERVAL 3 DAY"""
)
def live_positions(t: Tables) -> DataFrame:
    """Recency of three days here, since the events are minutes apart."""
    state = _state(t, feeds.live_positions(_stream(t).positions), DRIVER, "positions")
    return _plain(feeds.recent(state, 3 * 86400), "date")


@query(
    """SELECT session_key, date, air_temperature, date < TIMESTAMP '2024-01-30 12:00:00' AS stale FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_key
    ORDER BY date DESC) AS rn FROM f_weather) x WHERE rn = 1"""
)
def weather_state(t: Tables) -> DataFrame:
    state = _plain(_state(t, feeds.weather_state(_stream(t).weather), ["session_key"], "weather"), "date")
    now = F.lit("2024-01-30 12:05:00").cast("timestamp_ntz")
    return feeds.with_staleness(state, now).select("session_key", "date", "air_temperature", "stale")


@query("SELECT event_id, driver_number, p FROM (SELECT event_id, driver_number, p_xgb AS p FROM f_scores) x WHERE p > 0.85")
def alert_stream(t: Tables) -> DataFrame:
    rows = _stream(t).feed.select("event_id", "driver_number", (c("k") / 100.0).alias("pitstop_probability"))
    path = _dir(t, "alerts")
    feeds.state_table(feeds.alert_stream(rows), path, f"{path}-checkpoint", mode="append").awaitTermination()
    return t.spark.read.parquet(path).select("event_id", "driver_number", c("pitstop_probability").alias("p"))


@query(
    """SELECT date_trunc('minute', event_time) AS bucket, 'Driver #' || CAST(driver_number AS VARCHAR) AS driver_name, AVG(p_xgb) AS avg_p
    FROM f_scores GROUP BY 1, 2""",
    digits="avg_p",
)
def minute_averages(t: Tables) -> DataFrame:
    """Update mode, so minutes the watermark has not closed are there too."""
    rows = _stream(t).feed.select(
        c("event_time").alias("ts"),
        F.concat(F.lit("Driver #"), c("driver_number").cast("string")).alias("driver_name"),
        (c("k") / 100.0).alias("p"),
    )
    averages = feeds.minute_averages(rows, "p", "avg_p", "40 days")
    return _plain(_state(t, averages, ["bucket", "driver_name"], "minutes"), "bucket")


@query("SELECT DISTINCT driver_number, event_type FROM f_base")
def without_repeats(t: Tables) -> DataFrame:
    rows = _stream(t).feed.select("driver_number", "event_type", "event_time")
    first = feeds.without_repeats(rows, ["driver_number", "event_type"], "event_time", "40 days")
    path = _dir(t, "firsts")
    feeds.state_table(first, path, f"{path}-checkpoint", mode="append").awaitTermination()
    return t.spark.read.parquet(path).select("driver_number", "event_type")


@query("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")
def on_new_raw(t: Tables) -> DataFrame:
    """Arrival of new raw files starts a count of what arrived."""
    path = _dir(t, "arrived")

    def count(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    feeds.on_new_raw(_stream(t).events, count, f"{path}-checkpoint").awaitTermination()
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


def _tables_of(t: Tables):
    def build(feed: DataFrame) -> dict[str, DataFrame]:
        found = Tables(t.spark, t.dir, feed=feed).stored()
        found.laps_in_stints = written(found.laps_in_stints, "cycle-stints")
        return {n: getattr(found, n) if n != "laps" else found.laps.withColumn("gap_to_leader", c("gap_raw")) for n in enrichment.FEEDS}

    return build


def _base_scores(features: DataFrame) -> DataFrame:
    """Stand-in base models: fixed logistic formulas over the live features."""
    first = 1.0 / (1.0 + F.exp(-(c("tyre_age") - 10.0) / 5.0))
    second = 1.0 / (1.0 + F.exp(-(c("gap_to_leader") - 100.0) / 50.0))
    return features.withColumns({"p_xgb": first, "p_lgb": second})


_P = "1 / (1 + EXP(-(0.9E0 * (1 / (1 + EXP(-(tyre_age - 10.0E0) / 5)) - 0.5E0) / 0.29E0 + 0.4E0 * (1 / (1 + EXP(-(gap_to_leader - 100) / 50)) - 0.4E0) / 0.3E0 - 0.2E0)))"
_CYCLE = f"""SELECT l.session_key, l.driver_number, lap_number, driver_name, team, tyre_age, gap_to_leader, round({_P}, 4) AS pitstop_probability,
    COALESCE(safety_car_active, FALSE) AS sc FROM ({LIVE}) l LEFT JOIN ({SC_STATE}) f ON f.session_key = l.session_key"""


@query(
    f"""SELECT {LAPS}, driver_name, team, tyre_age, pitstop_probability, FALSE AS stale, round(raw / SUM(raw) OVER (PARTITION BY session_key), 4) AS win_probability
    FROM (SELECT *, CASE WHEN sc THEN ps * 0.55E0 + ts * 0.25E0 + ys * 0.15E0 + (1 - pitstop_probability) * 0.05E0
        ELSE ps * 0.40E0 + gs * 0.25E0 + ts * 0.20E0 + ys * 0.10E0 + (1 - pitstop_probability) * 0.05E0 END AS raw
      FROM (SELECT *, (COUNT(*) OVER (PARTITION BY session_key) - ROW_NUMBER() OVER (PARTITION BY session_key ORDER BY gap_to_leader, driver_number) + 1)
              / CAST(COUNT(*) OVER (PARTITION BY session_key) AS DOUBLE) AS ps,
            GREATEST(0, 1 - gap_to_leader / 120) AS gs, GREATEST(0, 1 - tyre_age / 50.0E0) AS ys, {TEAM_SCORE} AS ts FROM ({_CYCLE}) x) y) z"""
)
def run_enrichment(t: Tables) -> DataFrame:
    """All events as one micro-batch through the whole cycle; predictions read back."""
    feed = Tables.to_feed(t.spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.dir))
    root = _dir(t, "enrichment")
    enrichment.run_enrichment(feed, _tables_of(t), _base_scores, root, seconds=None).awaitTermination()
    rows = t.spark.read.parquet(enrichment.EnrichmentPaths(root).predictions)
    return rows.select(*KEY, "driver_name", "team", "tyre_age", "pitstop_probability", "win_probability", "stale")


@query(
    f"""SELECT session_key, CAST(COUNT(*) AS BIGINT) AS drivers, CAST(COUNT(CASE WHEN pitstop_probability > 0.85 THEN 1 END) AS BIGINT) AS alerts, MAX(lap_number) AS current_lap,
    'scored' AS status, MAX(CASE WHEN sc THEN 1 ELSE 0 END) = 1 AS safety_car_active, MAX(CASE WHEN race_finished THEN 1 ELSE 0 END) = 1 AS race_finished
    FROM ({_CYCLE}) x LEFT JOIN ({FINISHED}) f USING (session_key) GROUP BY session_key"""
)
def enrichment_log(t: Tables) -> DataFrame:
    """What each cycle served, session by session: the events arrive as one micro-batch."""
    feed = Tables.to_feed(t.spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.dir))
    root = _dir(t, "enrichment-log")
    enrichment.run_enrichment(feed, _tables_of(t), _base_scores, root, seconds=None).awaitTermination()
    rows = t.spark.read.parquet(enrichment.EnrichmentPaths(root).cycles)
    return rows.select("session_key", "drivers", "alerts", "current_lap", "status", "safety_car_active", "race_finished")


# streams with state ---------------------------------------------------------


def _streamed(t: Tables, df: DataFrame, name: str) -> DataFrame:
    path = _dir(t, name)
    feeds.state_table(df, path, f"{path}-checkpoint", mode="append").awaitTermination()
    return t.spark.read.parquet(path).drop("batch")


@query(
    """SELECT l.session_key, l.driver_number, l.event_id, w.air_temperature, w.track_temperature FROM (SELECT * FROM f_base WHERE event_type = 'purchase') l
    ASOF LEFT JOIN f_weather w ON l.session_key = w.session_key AND l.event_time >= w.date
    WHERE l.event_time < (SELECT MAX(event_time) FROM f_base WHERE event_type IN ('purchase', 'view')) - INTERVAL 1 DAY"""
)
def asof_weather_stream(t: Tables) -> DataFrame:
    """Purchases as laps and the weather as two streams; what the watermark, a day behind, has closed."""
    state.with_keyed_state(t.spark)
    live = _stream(t)
    laps = live.feed.where("event_type = 'purchase'").select(*DRIVER, "event_id", "event_time")
    values = ["air_temperature", "track_temperature"]
    joined = state.asof_stream(laps, _stream(t).weather, "session_key", "date", "event_id", values, "1 day")
    return _streamed(t, joined, "asof").select(*DRIVER, "event_id", *values)


_QUARTERS = """SELECT function_name, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS p, AVG(metric_value) AS value FROM f_metric_points
    WHERE metric_name = 'Duration' GROUP BY 1, 2"""


@query(
    f"""WITH near AS (SELECT *, LAG(p) OVER w AS bp, LAG(alarm) OVER w AS was, LEAD(p) OVER w AS np FROM (SELECT a.function_name, a.p, ANY_VALUE(a.value) AS value,
      SUM(CASE WHEN b.value > 50 THEN 1 ELSE 0 END) = 2 AS alarm FROM ({_QUARTERS}) a JOIN ({_QUARTERS}) b ON a.function_name = b.function_name AND b.p BETWEEN a.p - 1 AND a.p
      GROUP BY a.function_name, a.p) x WINDOW w AS (PARTITION BY function_name ORDER BY p)),
    turned AS (SELECT function_name, p, CASE WHEN alarm THEN 'ALARM' ELSE 'OK' END AS state, value FROM near
      WHERE alarm <> COALESCE(was AND bp = p - 1, FALSE)
      UNION ALL SELECT function_name, p + 1, 'OK', NULL FROM near WHERE alarm AND (np IS NULL OR np <> p + 1))
    SELECT function_name, TIMESTAMP '1970-01-01' + to_seconds(p * 21600) AS period_start, state, value FROM turned
    WHERE (p + 1) * 21600 <= (SELECT epoch(MAX(ts)) FROM f_metric_points WHERE metric_name = 'Duration') - 86400""",
    digits="value",
    places=6,
)
def alarm_transitions(t: Tables) -> DataFrame:
    """Mean duration above 50 in two quarters of a day in a row: when the alarm goes on and off, as a stream."""
    state.with_keyed_state(t.spark)
    turned = state.alarm_stream(_stream(t).metric_points, "Duration", "avg", 21600, ">", 50.0, 2, delay="1 day")
    return _plain(_streamed(t, turned, "alarms"), "period_start").select("function_name", "period_start", "state", "value")


def _rollup(t: Tables) -> DataFrame:
    path = _dir(t, "rollup")
    rollups.keep_rollup(_stream(t).metric_points, rollups.point_partials, path, f"{path}-checkpoint").awaitTermination()
    return rollups.read_rollup(t.spark, path)


@query(
    """SELECT date_trunc('hour', ts) AS bucket, function_name, SUM(metric_value) AS invocations FROM f_metric_points WHERE metric_name = 'Invocations' GROUP BY 1, 2""",
    digits="invocations",
    places=6,
)
def rollup_invocations(t: Tables) -> DataFrame:
    """Hourly sums from minute partials."""
    return _plain(rollups.metric_totals(_rollup(t), "Invocations", "invocations"), "bucket")


@query(
    """SELECT date_trunc('day', ts) AS bucket, function_name, COUNT(metric_value) AS n, TRUE AS near FROM f_metric_points WHERE metric_name = 'Duration' GROUP BY 1, 2"""
)
def rollup_p99(t: Tables) -> DataFrame:
    """Daily p99 from merged sketches; ``near``: its rank among the day's values is within 3 % of 0.99."""
    found = rollups.metric_percentile(_rollup(t), "Duration", 0.99, "p99", "day")
    points = t.metric_points.where("metric_name = 'Duration'").withColumn("bucket", F.date_trunc("day", c("ts").cast("timestamp")))
    upto, below = F.count_if(c("metric_value") <= c("p99")), F.count_if(c("metric_value") < c("p99"))
    ranked = points.join(found, ["bucket", "function_name"]).groupBy("bucket", "function_name").agg(F.count("metric_value").alias("n"), upto.alias("upto"), below.alias("below"))
    near = (c("upto") / c("n") >= 0.96) & (c("below") <= c("n") * 0.99 + c("n") * 0.03)
    return _plain(ranked.select("bucket", "function_name", "n", near.alias("near")), "bucket")


_DAY = "SELECT DISTINCT driver_number FROM f_base WHERE date_trunc('minute', event_time) >= TIMESTAMP '{0}' AND date_trunc('minute', event_time) < TIMESTAMP '{1}'"
_LATER, _SOONER = _DAY.format("2024-01-21", "2024-01-22"), _DAY.format("2024-01-20", "2024-01-21")


@query(
    f"""SELECT (SELECT COUNT(*) FROM ({_LATER}) a) AS seen, (SELECT COUNT(*) FROM ({_SOONER}) b) AS before, (SELECT COUNT(*) FROM ({_SOONER} EXCEPT {_LATER}) x) AS lost"""
)
def drivers_lost(t: Tables) -> DataFrame:
    """Drivers of one day, of the day before, and those who did not come back, from sketches by minute."""
    path = _dir(t, "drivers")
    rows = _stream(t).feed.select(c("event_time").alias("ts"), "driver_number", (c("k") / 100.0).alias("pitstop_probability"))
    rollups.keep_rollup(rows, rollups.driver_partials, path, f"{path}-checkpoint").awaitTermination()
    return rollups.drivers_lost(rollups.read_rollup(t.spark, path), 1440, F.lit("2024-01-22").cast("timestamp"))
