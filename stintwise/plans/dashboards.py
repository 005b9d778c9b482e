"""Dashboard queries over the prediction log and the metric points.

The log is aggregated before it is ordered or cut: latest values are ``max_by``
aggregates, time series group by bucket, and a "top n" first ranks the drivers
on their own aggregate and then keeps the rows of those few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.functions.parsing import as_percent
from stintwise.functions.scoring import risk_band
from stintwise.operators.logs import has_errors
from stintwise.operators.quantiles import exact_percentile
from stintwise.operators.snapshots import newest_by_key

c = F.col
DRIVER = "driver_name"


def since(df: DataFrame, minutes: int, now: Column | None = None) -> DataFrame:
    """Rows of the last ``minutes`` before ``now``, by default the newest row's time.

    On a log in day folders (``dt``, as ``write_daily`` lays it out) a given
    ``now`` also picks the folders, so older days are not read.  Without ``now``
    the newest time has to be found first, which reads the times of the whole log.
    """
    end = df.agg(F.max("ts")).scalar() if now is None else now
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    recent = df.where(c("ts") >= start)
    return recent.where(c("dt") >= F.to_date(start)) if now is not None and "dt" in df.columns else recent


def latest(df: DataFrame, columns: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Newest value of each column per key, or overall, where equal times go by session and driver."""
    if by:
        named = df.select("ts", *by, *[x.alias(n) for n, x in columns.items() if n not in by])
        return newest_by_key(named, by, "ts", [n for n in columns if n not in by])
    row = F.struct(*[x.alias(n) for n, x in columns.items()])
    return df.agg(F.max_by(row, F.struct("ts", "session_key", "driver_number")).alias("_r")).where("_r IS NOT NULL").select("_r.*")


def latest_in_window(df: DataFrame, minutes: int, now: Column | None = None) -> DataFrame:
    """Newest prediction of each driver within the trailing window."""
    return newest_by_key(since(df, minutes, now), ["session_key", "driver_number"], "ts")


def bucket(size: str) -> Column:
    return F.window("ts", size)["start"].alias("bucket")


def top_drivers(df: DataFrame, score: Column, n: int) -> DataFrame:
    ranked = df.groupBy(DRIVER).agg(score.alias("_score"))
    return ranked.orderBy(F.desc("_score"), DRIVER).limit(n).select(DRIVER)


def _of_top(df: DataFrame, score: Column, n: int) -> DataFrame:
    """Rows of the ``n`` best drivers; the broadcast side has at most ``n`` rows."""
    return df.join(F.broadcast(top_drivers(df, score, n)), DRIVER, "left_semi")


# single values --------------------------------------------------------------


def max_lap(df: DataFrame, minutes: int = 10, now: Column | None = None) -> DataFrame:
    return since(df, minutes, now).agg(F.max("lap_number").alias("lap"))


def latest_safety_car(df: DataFrame, minutes: int = 10, now: Column | None = None) -> DataFrame:
    return latest(since(df, minutes, now), {"safety_car": c("safety_car_active")})


def drivers_tracked(df: DataFrame, minutes: int | None = 10, now: Column | None = None, rsd: float | None = None) -> DataFrame:
    """Distinct drivers, exact, or estimated within ``rsd``."""
    rows = df if minutes is None else since(df, minutes, now)
    count = F.count_distinct("driver_number") if rsd is None else F.approx_count_distinct("driver_number", rsd)
    return rows.agg(count.alias("drivers"))


def latest_session_key(df: DataFrame, minutes: int = 10, now: Column | None = None) -> DataFrame:
    return latest(since(df, minutes, now), {"session_key": c("session_key")})


def latest_commentary(df: DataFrame, minutes: int = 30, now: Column | None = None) -> DataFrame:
    return latest(since(df, minutes, now).where(c("commentary") != ""), {"commentary": c("commentary")})


def confidence_metrics(df: DataFrame, cycle: list[str], above: float = 0.85) -> DataFrame:
    """Mean confidence and number of confident predictions of each scoring cycle."""
    return df.groupBy(*cycle).agg(
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(c("confidence") > above).alias("high_confidence_count"),
    )


def confidence_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("confidence").alias("avg_confidence"),
        F.max("pitstop_probability").alias("highest_probability"),
        F.count(F.lit(1)).alias("predictions"),
    )


def sc_flag_max(df: DataFrame) -> DataFrame:
    return df.agg(F.max(c("safety_car_active").cast("int")).alias("safety_car"))


# latest per driver ----------------------------------------------------------


def _latest_facet(df: DataFrame, value: Column, name: str, minutes: int, now: Column | None, n: int) -> DataFrame:
    return latest(since(df, minutes, now), {name: value}, [DRIVER]).orderBy(F.desc(name), DRIVER).limit(n)


def latest_pit_percent(df: DataFrame, minutes: int = 30, now: Column | None = None, n: int = 22) -> DataFrame:
    return _latest_facet(df, as_percent(c("pitstop_probability")), "pit_pct", minutes, now, n)


def latest_win_percent(df: DataFrame, minutes: int = 30, now: Column | None = None, n: int = 22) -> DataFrame:
    return _latest_facet(df, as_percent(c("win_probability")), "win_pct", minutes, now, n)


def latest_speed(df: DataFrame, minutes: int = 10, now: Column | None = None, n: int = 22) -> DataFrame:
    return _latest_facet(df, c("speed"), "speed", minutes, now, n)


def latest_tyre_age(df: DataFrame, minutes: int = 30, now: Column | None = None, n: int = 22) -> DataFrame:
    return _latest_facet(df, c("tyre_age"), "tyre_age", minutes, now, n)


def latest_stop_count(df: DataFrame, minutes: int = 30, now: Column | None = None, n: int = 22) -> DataFrame:
    return _latest_facet(df, c("pits_completed"), "pit_stops", minutes, now, n)


def full_standings(df: DataFrame, minutes: int = 30, now: Column | None = None, n: int = 22) -> DataFrame:
    columns = {
        "driver": c("driver_name"),
        "team": c("team"),
        "tyre": c("tyre_compound"),
        "tyre_age": c("tyre_age"),
        "stops": c("pits_completed"),
        "last_stop": c("last_pit_duration"),
        "pit_pct": as_percent(c("pitstop_probability")),
        "win_pct": as_percent(c("win_probability")),
        "lap": c("lap_number"),
        "speed": c("speed"),
        "drs": c("drs_active"),
    }
    return latest(since(df, minutes, now), columns, ["driver_number"]).orderBy("driver_number").limit(n)


def dashboard_alerts(df: DataFrame, minutes: int = 30, now: Column | None = None, threshold: float = 0.7, n: int = 22) -> DataFrame:
    columns = {
        "driver": c("driver_name"),
        "team": c("team"),
        "pit_pct": as_percent(c("pitstop_probability")),
        "tyre": c("tyre_compound"),
        "tyre_age": c("tyre_age"),
    }
    risky = since(df, minutes, now).where(c("pitstop_probability") > threshold)
    return latest(risky, columns, ["driver_number"]).orderBy(F.desc("pit_pct"), "driver_number").limit(n)


def tyre_status(df: DataFrame, minutes: int = 120, now: Column | None = None) -> DataFrame:
    """Newest tyre and odds of each driver of the session scored last."""
    recent = since(df, minutes, now)
    session = recent.agg(F.max_by("session_key", F.struct("ts", "session_key"))).scalar()
    columns = {n: c(n) for n in ("tyre_compound", "tyre_age", "pitstop_probability", "win_probability")}
    return latest(recent.where(c("session_key") == session), columns, ["driver_number"])


# distributions --------------------------------------------------------------


def max_pit_by_driver(df: DataFrame, n: int = 22) -> DataFrame:
    return (
        df.groupBy(DRIVER)
        .agg(F.max("pitstop_probability").alias("max_pit_probability"))
        .orderBy(F.desc("max_pit_probability"), DRIVER)
        .limit(n)
    )


def _counts(df: DataFrame, key: Column, name: str, n: int) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def risk_band_counts(df: DataFrame, n: int = 3) -> DataFrame:
    return _counts(df, risk_band(c("pitstop_probability")), "risk_band", n)


def compound_counts(df: DataFrame, n: int = 5) -> DataFrame:
    return _counts(df, c("tyre_compound"), "tyre_compound", n)


def age_bin(width: int = 2) -> Column:
    return (F.floor(c("tyre_age") / width) * width).alias("tyre_age_bin")


def tyre_age_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(age_bin()).agg(F.count(F.lit(1)).alias("n"))


def prob_by_tyre_age(df: DataFrame) -> DataFrame:
    return df.groupBy(age_bin()).agg(F.avg("pitstop_probability").alias("avg_probability"))


def driver_strategy_table(df: DataFrame) -> DataFrame:
    return df.groupBy(DRIVER, "team", "tyre_compound", risk_band(c("pitstop_probability")).alias("risk_band")).agg(
        F.max("pitstop_probability").alias("pit_probability"),
        F.max("confidence").alias("confidence"),
        F.max("tyre_age").alias("tyre_age"),
    )


# time series ----------------------------------------------------------------


def prob_timeline_top5(df: DataFrame, size: str = "1 hour") -> DataFrame:
    rows = _of_top(df, F.avg("pitstop_probability"), 5)
    return rows.groupBy(bucket(size), DRIVER).agg(
        F.avg("pitstop_probability").alias("avg_probability"), F.max("pitstop_probability").alias("max_probability")
    )


def gap_timeline_top5(df: DataFrame, size: str = "1 hour") -> DataFrame:
    rows = _of_top(df, F.avg("gap_to_leader"), 5)
    return rows.groupBy(bucket(size), DRIVER).agg(F.avg("gap_to_leader").alias("avg_gap"))


def confidence_timeline(df: DataFrame, size: str = "1 hour") -> DataFrame:
    return df.groupBy(bucket(size)).agg(
        F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence")
    )


def _per_minute(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.groupBy(bucket("1 minute"), DRIVER).agg(F.avg(value).alias(name))


def prob_per_minute_top10(df: DataFrame) -> DataFrame:
    return _per_minute(_of_top(df, F.avg("pitstop_probability"), 10), "pitstop_probability", "avg_probability")


def prob_timeseries_1m(df: DataFrame) -> DataFrame:
    return _per_minute(df, "pitstop_probability", "avg_probability")


def win_timeseries_1m(df: DataFrame) -> DataFrame:
    return _per_minute(df, "win_probability", "avg_win_probability")


def _percent_series(df: DataFrame, value: str, name: str, minutes: int, now: Column | None, n: int) -> DataFrame:
    recent = since(df, minutes, now)
    per = _per_minute(_of_top(recent, F.avg(value), n), value, name)
    return per.withColumn(name, as_percent(c(name)))


def pit_percent_timeseries_top10(df: DataFrame, minutes: int = 120, now: Column | None = None, n: int = 10) -> DataFrame:
    return _percent_series(df, "pitstop_probability", "pit_pct", minutes, now, n)


def win_percent_timeseries_top10(df: DataFrame, minutes: int = 120, now: Column | None = None, n: int = 10) -> DataFrame:
    return _percent_series(df, "win_probability", "win_pct", minutes, now, n)


# function metrics -----------------------------------------------------------


def _metric_rows(points: DataFrame, metric: str, prefix: str, size: str) -> DataFrame:
    wanted = points.where((c("metric_name") == metric) & c("function_name").like(f"{prefix}%"))
    return wanted.select(bucket(size), "function_name", "metric_value")


def invocations_timeseries(points: DataFrame, prefix: str = "fn-", size: str = "1 hour") -> DataFrame:
    rows = _metric_rows(points, "Invocations", prefix, size)
    return rows.groupBy("bucket", "function_name").agg(F.sum("metric_value").alias("invocations"))


def errors_timeseries(points: DataFrame, prefix: str = "fn-", size: str = "1 hour") -> DataFrame:
    rows = _metric_rows(points, "Errors", prefix, size)
    return has_errors(rows.groupBy("bucket", "function_name").agg(F.sum("metric_value").alias("errors")), "errors")


def duration_p99(points: DataFrame, prefix: str = "fn-", size: str = "1 hour") -> DataFrame:
    rows = _metric_rows(points, "Duration", prefix, size)
    return exact_percentile(rows, ["bucket", "function_name"], "metric_value", 0.99, "p99_duration")


def model_latency_timeseries(points: DataFrame, size: str = "1 hour") -> DataFrame:
    rows = _metric_rows(points, "ModelLatency", "", size)
    return rows.groupBy("bucket").agg(F.sum("metric_value").alias("model_latency"))
