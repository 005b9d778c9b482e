"""Streams over files that arrive in steps."""

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from stintwise import schemas
from stintwise.catalog.source_queries import _base_scores, _tables_of
from stintwise.catalog.tables import Tables
from stintwise.sources.writers import keep_sessions, newest_sessions
from stintwise.streaming import enrichment, feeds

SF = "/root/testdata/sf0.001"
CAR = "session_key bigint, driver_number int, date timestamp, speed double"


def test_state_follows_new_files(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / n) for n in ("in", "state", "checkpoint"))
    t0 = datetime(2024, 1, 1)
    steps = [[(1, 4, t0, 200.0), (1, 5, t0, 210.0)], [(1, 4, t0 + timedelta(seconds=60), 300.0), (1, 5, t0 - timedelta(1), 1.0)]]
    for rows in steps:
        spark.createDataFrame(rows, CAR).coalesce(1).write.mode("append").parquet(source)
        stream = feeds.car_state(feeds.incremental_files(spark, source, CAR, "parquet", "*.parquet"))
        feeds.state_table(stream, state, checkpoint).awaitTermination()
    newest = feeds.read_state(spark, state, ["session_key", "driver_number"])
    assert {r.driver_number: r.speed for r in newest.collect()} == {4: 300.0, 5: 210.0}
    assert [r.driver_number for r in feeds.recent(newest, feeds.CAR_SECONDS).collect()] == [4]


def test_state_keeps_two_generations(spark, tmp_path):
    source, state, checkpoint = (str(tmp_path / n) for n in ("in", "state", "checkpoint"))
    t0 = datetime(2024, 1, 1)
    keys = ["session_key", "driver_number"]
    for step in range(7):
        spark.createDataFrame([(1, step, t0, float(step)), (1, 99, t0 + timedelta(seconds=step), float(step))], CAR).coalesce(1).write.mode("append").parquet(source)
        stream = feeds.car_state(feeds.incremental_files(spark, source, CAR, "parquet", "*.parquet"))
        feeds.state_table(stream, state, checkpoint, keys=keys, compact_every=2).awaitTermination()
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "state").glob("batch=*"))
    assert kept[0] >= 4 and len(kept) <= 4
    newest = {r.driver_number: r.speed for r in feeds.read_state(spark, state, keys).collect()}
    assert newest == {99: 6.0, **{k: float(k) for k in range(7)}}


def _events(spark):
    return spark.read.schema(schemas.EVENTS).parquet(f"{SF}/events.parquet")


def test_cycles_add_up_and_failures_serve_the_last_good(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    feed = Tables.to_feed(_events(spark))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feed.schema.fields)
    half = feed.count() // 2

    def run(part, scores):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = feeds.incremental_files(spark, source, schema, "parquet", "*.parquet")
        enrichment.run_enrichment(
            stream, _tables_of(Tables(spark, SF)), scores, root, seconds=None
        ).awaitTermination()

    def broken(df):
        raise RuntimeError("endpoint down")

    run(feed.where(F.col("event_id") < half), _base_scores)
    run(feed.where(F.col("event_id") >= half), _base_scores)
    out = spark.read.parquet(enrichment.EnrichmentPaths(root).predictions)
    last = out.where("batch = 1")
    drivers = feed.select("session_key", "driver_number").distinct().count()
    assert last.count() == drivers
    shares = last.groupBy("session_key").agg(F.sum("win_probability").alias("s")).collect()
    assert all(abs(r.s - 1) < 0.01 for r in shares)
    laps = {r.driver_number: r.lap_number for r in last.collect()}
    want = {r.driver_number: r["count"] for r in feed.groupBy("driver_number").count().collect()}
    assert laps == want

    run(feed.where("event_id < 20").withColumn("event_id", F.col("event_id") + 10**6), broken)
    stale = spark.read.parquet(enrichment.EnrichmentPaths(root).predictions).where("batch = 2")
    assert stale.count() > 0 and stale.where("NOT stale").count() == 0
    log = spark.read.parquet(enrichment.EnrichmentPaths(root).cycles)
    status = {r.batch: r.s for r in log.groupBy("batch").agg(F.collect_set("status").alias("s")).collect()}
    assert status == {0: ["scored"], 1: ["scored"], 2: ["stale"]}
    assert log.where("batch = 1").agg(F.sum("drivers")).first()[0] == drivers
    cached = spark.read.parquet(enrichment.EnrichmentPaths(root).stints)
    assert cached.select("session_key").distinct().count() == feed.select("session_key").distinct().count()


def test_a_cycle_makes_folders_for_groups_not_sessions(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    events = _events(spark).where("user_id < 22").withColumn("user_id", F.expr("user_id % 2 + 22 * (event_id % 90)"))
    Tables.to_feed(events).coalesce(1).write.parquet(source)
    feed = spark.read.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feed.schema.fields)
    stream = feeds.incremental_files(spark, source, schema, "parquet", "*.parquet")
    enrichment.run_enrichment(stream, _tables_of(Tables(spark, SF)), _base_scores, root, seconds=None).awaitTermination()
    sessions = feed.select("session_key").distinct().count()
    paths = enrichment.EnrichmentPaths(root)
    assert sessions > enrichment.SESSION_GROUPS
    assert spark.read.parquet(paths.last_good).select("session_key").distinct().count() == sessions
    for path, most in ((paths.feed, enrichment.SESSION_GROUPS + 1), (paths.stints, 1), (paths.last_good, 1)):
        assert sum(p.is_dir() for p in Path(path).rglob("*=*")) <= most, path


def test_sessions_are_kept_over_batches(spark, tmp_path):
    path, want = str(tmp_path / "kept"), {}
    assert newest_sessions(spark, path) is None
    for batch in range(8):
        rows = [(s, f"{batch}-{n}") for s in (batch % 3, 10 + batch) for n in range(batch % 2 + 1)]
        for _ in range(2 if batch in (3, 6) else 1):  # some batches are repeated
            keep_sessions(spark.createDataFrame(rows, "session_key bigint, v string"), path, batch, compact_every=3)
        want |= {s: sorted(v for k, v in rows if k == s) for s, _ in rows}
        got = {}
        for r in newest_sessions(spark, path).collect():
            got[r.session_key] = sorted([*got.get(r.session_key, []), r.v])
        assert got == want
    assert sorted(int(p.name.split("=")[1]) for p in Path(path).glob("batch=*")) == [3, 4, 5, 6, 7]
