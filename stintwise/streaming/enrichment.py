"""The scoring cycle: every micro-batch updates its sessions and scores their drivers.

A batch is first added to the feed table.  Then only the sessions it touches are
read back (the feed is stored by groups of sessions, so the folders of other
groups are not opened), turned into live features, scored, ranked and written
out.  A session whose stint feed is empty is served from the cached stints.
Every folder is named after the batch and replaced as a whole, so a repeated
batch changes nothing; how many a batch makes does not depend on its sessions.
What a cycle writes for itself is removed with its end.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stintwise.functions.scoring import ALERT_ABOVE, StackParams, confidence, recommendation, stack_probability
from stintwise.operators.quality import pit_alerts
from stintwise.operators.ranking import win_probability
from stintwise.operators.state import (
    last_good_predictions,
    live_features,
    race_finished,
    safety_car_active,
    stints_with_fallback,
    stop_on_finish,
)
from stintwise.session import scratch, written
from stintwise.sources.writers import keep_sessions, newest_sessions, save_stint_cache

c = F.col
log = logging.getLogger(__name__)
FEEDS = ("laps", "stints", "intervals", "weather", "pit", "car_data", "race_control")
#: Folders of a feed batch at most; those of an existing feed can't be changed.
SESSION_GROUPS = 64


@dataclass(frozen=True)
class EnrichmentPaths:
    root: str

    @property
    def feed(self) -> str:
        return f"{self.root}/feed"

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions"

    @property
    def alerts(self) -> str:
        return f"{self.root}/alerts"

    @property
    def last_good(self) -> str:
        return f"{self.root}/last_good"

    @property
    def stints(self) -> str:
        return f"{self.root}/stints"

    @property
    def cycles(self) -> str:
        return f"{self.root}/cycles"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def score_drivers(
    tables: dict[str, DataFrame],
    base_scores: Callable[[DataFrame], DataFrame],
    params: StackParams = StackParams(),
) -> DataFrame:
    """Live features and stop probability of every driver of the given sessions.

    ``base_scores`` adds ``p_xgb`` and ``p_lgb``, by models or by expressions.
    """
    features = live_features(*[tables[n] for n in FEEDS if n != "race_control"])
    p = stack_probability(c("p_xgb"), c("p_lgb"), params)
    scored = base_scores(features).withColumn("_p", p).withColumns(
        {
            "pitstop_probability": F.round("_p", 4),
            "confidence": F.round(confidence(c("_p")), 4),
            "recommendation": recommendation(c("_p")),
        }
    )
    flags = safety_car_active(tables["race_control"])
    return scored.drop("_p").join(flags, "session_key", "left").fillna(False, ["safety_car_active"])


def run_enrichment(
    stream: DataFrame,
    to_tables: Callable[[DataFrame], dict[str, DataFrame]],
    base_scores: Callable[[DataFrame], DataFrame],
    root: str,
    params: StackParams = StackParams(),
    seconds: int | None = 60,
    stop_finished: bool = False,
    threshold: float = ALERT_ABOVE,
) -> StreamingQuery:
    """Start the cycle on a feed stream; ``seconds=None`` handles what is there and stops.

    When scoring fails, the sessions' last good predictions are served, marked
    stale.  Each cycle logs a row per session: ``scored``, ``stale``, or
    ``missing`` where there is nothing to serve.  Only scoring may fail so; any
    other error ends the stream.
    """
    paths = EnrichmentPaths(root)
    spark = stream.sparkSession

    def scored_or_none(tables: dict[str, DataFrame], batch_id: int) -> DataFrame | None:
        try:
            return written(score_drivers(tables, base_scores, params), "scored")
        except Exception:
            log.exception("scoring failed in batch %s", batch_id)
            return None

    def cycle(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark, "cycle"):
            run(batch, batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        group = F.pmod(F.xxhash64("session_key"), F.lit(SESSION_GROUPS)).cast("int")
        grouped = batch.withColumn("session_group", group).hint("rebalance", c("session_group"))
        grouped.write.mode("overwrite").partitionBy("session_group").parquet(f"{paths.feed}/batch={batch_id}")
        feed = spark.read.schema(f"{_ddl(batch)}, batch int, session_group int").parquet(paths.feed)
        own = feed.where(c("batch") == batch_id)
        touched = written(own.select("session_key").distinct(), "touched")
        groups = [r.session_group for r in own.select("session_group").distinct().collect()]  # SESSION_GROUPS at most
        near = feed.where(c("session_group").isin(groups)).drop("batch", "session_group")
        tables = to_tables(near.join(touched, "session_key", "left_semi"))
        now = written(tables["stints"], "stints")
        cached = newest_sessions(spark, paths.stints, batch_id)
        if cached is not None:
            known = cached.join(touched, "session_key", "left_semi").select(*now.columns)
            tables["stints"] = written(stints_with_fallback(now, known), "stints")
        save_stint_cache(now, paths.stints, batch_id)
        if stop_finished:
            tables["laps"] = stop_on_finish(tables["laps"], tables["race_control"])
        out = f"{paths.predictions}/batch={batch_id}"
        scored = scored_or_none(tables, batch_id)
        if scored is not None:
            shares = win_probability(scored, ["session_key"])
            shares.withColumn("stale", F.lit(False)).write.mode("overwrite").parquet(out)
        else:
            good = newest_sessions(spark, paths.last_good)
            if good is None:
                raise RuntimeError(f"scoring failed in batch {batch_id}, and no earlier predictions can be served")
            served = good.join(touched, "session_key", "left_semi").drop("stale")
            last_good_predictions(served.limit(0), served).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        keep_sessions(done.where("NOT stale"), paths.last_good, batch_id)
        pit_alerts(done.withColumn("commentary", F.lit("")), threshold).write.mode("overwrite").json(
            f"{paths.alerts}/batch={batch_id}"
        )
        _cycle_log(touched, done, tables["race_control"], threshold).write.mode("overwrite").parquet(
            f"{paths.cycles}/batch={batch_id}"
        )

    when = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return (
        stream.writeStream.foreachBatch(cycle)
        .option("checkpointLocation", paths.checkpoint)
        .trigger(**when)
        .start()
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _cycle_log(touched: DataFrame, done: DataFrame, race_control: DataFrame, threshold: float) -> DataFrame:
    """What a cycle served, a row per session it touched."""
    served = done.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("drivers"),
        F.count_if(c("pitstop_probability") > threshold).alias("alerts"),
        F.max("lap_number").alias("current_lap"),
        F.when(F.bool_or("stale"), "stale").otherwise("scored").alias("status"),
    )
    flags = safety_car_active(race_control).join(race_finished(race_control), "session_key")
    return (
        touched.join(served, "session_key", "left")
        .join(flags, "session_key", "left")
        .fillna({"drivers": 0, "alerts": 0, "status": "missing", "safety_car_active": False, "race_finished": False})
        .withColumn("logged_at", F.current_timestamp())
    )
