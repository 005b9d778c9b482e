"""Read queries behind the race pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.operators.joins import join_circuit
from stintwise.operators.quality import format_prediction
from stintwise.operators.ranking import top_n

c = F.col


def explode_log(log: DataFrame, carry: list[str]) -> DataFrame:
    """One row per prediction of each logged cycle, with the named cycle columns beside it."""
    item = log.select(*carry, F.explode("predictions").alias("_p"))
    inner = [f.name for f in item.schema["_p"].dataType.fields if f.name not in carry]
    return item.select(*carry, *[c(f"_p.{n}").alias(n) for n in inner])


def latest_log_per_session(log: DataFrame) -> DataFrame:
    """Newest cycle of each session.

    The newest time is found first, on two narrow columns; the documents
    themselves are then only filtered, never shuffled through an aggregate.
    """
    newest = log.groupBy("session_key").agg(F.max("timestamp").alias("timestamp"))
    return log.join(newest, ["session_key", "timestamp"], "left_semi")


def session_predictions(log: DataFrame, session_key: int) -> DataFrame:
    """Newest predictions of one session, likeliest stop first."""
    one = log.where(c("session_key") == session_key)
    newest = one.where(c("timestamp") == one.agg(F.max("timestamp")).scalar())
    flat = format_prediction(explode_log(newest, ["session_key"]))
    return flat.orderBy(F.desc("pitstop_probability"), "driver_number")


def latest_snapshot(log: DataFrame) -> DataFrame:
    """Newest cycle over all sessions, likeliest winner first.

    One aggregate finds the document; of equal times the larger session counts.
    """
    document = F.max_by(F.struct(*log.columns), F.struct("timestamp", "session_key")).alias("_r")
    flat = join_circuit(explode_log(log.agg(document).select("_r.*"), ["session_key", "country_name", "timestamp"]))
    shown = format_prediction(flat, "country_name", "circuit_key", c("timestamp").alias("prediction_time"))
    return shown.orderBy(F.desc("win_probability"), "driver_number")


def list_sessions(log: DataFrame) -> DataFrame:
    """Session keys as text, last in text order first."""
    return log.select(c("session_key").cast("string").alias("session_key")).distinct().orderBy(F.desc("session_key"))


def session_history(log: DataFrame, n: int = 10) -> DataFrame:
    """Newest predictions of the ``n`` sessions that come first in the session list."""
    shown = list_sessions(log).limit(n).select(c("session_key").cast("bigint").alias("session_key"))
    kept = log.join(F.broadcast(shown), "session_key", "left_semi")
    return format_prediction(explode_log(latest_log_per_session(kept), ["session_key"]))


def latest_started_session(sessions: DataFrame, now: Column) -> DataFrame:
    """The last session that has started by ``now``; before the first start, the last one planned."""
    row = F.struct(*sessions.columns)
    at = F.struct("date_start", "session_key")
    picked = sessions.agg(
        F.max_by(row, F.when(c("date_start") <= now, at)).alias("_started"), F.max_by(row, at).alias("_last")
    )
    return picked.select(F.coalesce("_started", "_last").alias("_r")).select("_r.*")


def _gap_order(gap: Column) -> Column:
    """The leader (no gap or 0) first, unreadable gaps last."""
    seconds = F.replace(gap.cast("string"), F.lit("+"), F.lit("")).try_cast("double")
    leader = gap.isNull() | F.coalesce(seconds == 0, F.lit(False))
    return F.when(leader, F.lit(-1.0)).otherwise(F.coalesce(seconds, F.lit(999.0)))


def standings_top5(df: DataFrame, gap: str = "gap_to_leader") -> DataFrame:
    return top_n(df, ["session_key"], [_gap_order(c(gap)), c("driver_number")], 5, "position")


def pit_candidates_top3(df: DataFrame) -> DataFrame:
    order = [F.desc("pitstop_probability"), c("driver_number")]
    return top_n(df, ["session_key"], order, 3, "rank")


def podium(df: DataFrame) -> DataFrame:
    """Three likeliest winners of each session: place, driver, team, gap to the first, tyres and stops."""
    first3 = top_n(df, ["session_key"], [F.desc("win_probability"), c("driver_number")], 3, "position")
    gap = F.when(c("position") > 1, c("gap_to_leader"))
    return first3.select("session_key", "position", "driver_name", "team", gap.alias("gap"), "tyre_compound", "pits_completed")
