"""Processors with state, against their batch forms."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintwise.operators.alarms import threshold_alarm
from stintwise.operators.joins import asof_weather
from stintwise.operators.snapshots import newest_by_key
from stintwise.streaming import state

T0 = datetime(2024, 1, 1)
CAR = "session_key bigint, driver_number int, date timestamp, speed double"


@pytest.fixture
def keyed(spark):
    state.with_keyed_state(spark)
    yield spark
    spark.conf.unset(state.PROVIDER_CONF)


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(df, name, checkpoint, mode):
    """Reads all there is; what came out, batch by batch, and the query."""
    out = f"{checkpoint}-out"

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = df.writeStream.outputMode(mode).queryName(name).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(out), q


def test_silent_keys_are_forgotten(keyed, tmp_path):
    rng = random.Random(1)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows = [(rng.randrange(2), rng.randrange(6), T0 + timedelta(seconds=rng.randrange(10_000)), float(k)) for k in range(300)]
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    for k in range(3):
        put(keyed, rows[k::3], CAR, source)
    latest = lambda: state.latest_for_a_while(stream_of(keyed, source, CAR), ["session_key", "driver_number"], "date", 3600, "3 hours")
    out, q = run(latest(), "ttl", checkpoint, "update")
    newest = newest_by_key(out, ["session_key", "driver_number"], "batch", ["date", "speed"])
    batch = newest_by_key(keyed.createDataFrame(rows, CAR), ["session_key", "driver_number"], "date")
    key = lambda r: (r.session_key, r.driver_number, r.date, r.speed)
    assert sorted(map(key, newest.collect())) == sorted(map(key, batch.collect()))
    held = q.recentProgress[-1].stateOperators[0].numRowsTotal
    assert held >= 12
    # Another key goes on for a day: the others are too old then, and gone.
    put(keyed, [(7, 7, T0 + timedelta(1), 1.0)], CAR, source)
    _, q = run(latest(), "ttl", checkpoint, "update")
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal <= 3 < held


LAP = "session_key bigint, driver_number int, lap_number int, event_time timestamp, event_id bigint"
WEATHER = "session_key bigint, date timestamp, event_id bigint, air_temperature double, track_temperature double, rainfall int"


def test_asof_of_two_streams_is_the_batch_join_on_closed_time(keyed, tmp_path):
    rng = random.Random(2)
    at = lambda k: T0 + timedelta(seconds=k)
    laps = [(k % 2, k % 5, k, at(rng.randrange(5_000)), 10_000 + k) for k in range(200)]
    weather = [(k % 2, at(rng.randrange(100, 5_000)), k, float(k), float(-k), k % 2) for k in range(60)]
    laps += [(1, 1, 999, weather[1][1], 99_999)]  # a reading at the very time of a lap counts
    # Later files reach at most 600 s back.
    chunks = 6
    for k in range(chunks):
        low, high = k * 5_000 // chunks, (k + 1) * 5_000 // chunks
        part = lambda t, low=low, high=high: low <= (t - T0).total_seconds() + ((t.second * 7) % 500) < high
        put(keyed, [r for r in laps if part(r[3])], LAP, str(tmp_path / "laps"))
        put(keyed, [r for r in weather if part(r[1])], WEATHER, str(tmp_path / "weather"))
    values = ["air_temperature", "track_temperature", "rainfall"]
    all_laps, all_weather = keyed.read.schema(LAP).parquet(str(tmp_path / "laps")), keyed.read.schema(WEATHER).parquet(str(tmp_path / "weather"))
    joined = state.asof_stream(
        stream_of(keyed, str(tmp_path / "laps"), LAP), stream_of(keyed, str(tmp_path / "weather"), WEATHER), "session_key", "date", "event_id", values, "20 minutes"
    )
    out, q = run(joined, "asof", str(tmp_path / "checkpoint"), "append")
    want = asof_weather(all_laps, all_weather.withColumn("event_id", F.col("event_id")))
    names = ["session_key", "driver_number", "lap_number", *values]
    closed = max(all_laps.agg(F.max("event_time")).first()[0], all_weather.agg(F.max("date")).first()[0]) - timedelta(minutes=20)
    due = want.where(F.col("event_time") < F.lit(closed))
    key = lambda r: tuple(repr(v) for v in r)
    assert sorted(map(key, out.select(names).collect())) == sorted(map(key, due.select(names).collect()))
    assert out.count() > 100
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal < 150  # old readings and laps are gone


POINT = "metric_name string, function_name string, ts timestamp, metric_value double"


@pytest.mark.parametrize(("stat", "limit", "periods"), [("avg", 0.5, 3), ("p99", 0.8, 2), ("sum", 1.2, 1)])
def test_alarm_transitions_are_those_of_the_batch(keyed, tmp_path, stat, limit, periods):
    rng = random.Random(3)
    rows = []
    for minute in range(0, 240):
        level = 0.3 if minute // 20 % 2 else 0.8
        for fn in ("a", "b"):
            if rng.random() < 0.75:  # some periods have no data
                rows += [("m", fn, T0 + timedelta(minutes=minute, seconds=rng.randrange(60)), level + rng.random() / 4) for _ in range(rng.randrange(1, 4))]
    rows += [("other", "a", T0, 9.0)]
    end = T0 + timedelta(minutes=400)
    shuffled = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(240)))
    for k in range(5):
        put(keyed, shuffled[k * len(rows) // 5 : (k + 1) * len(rows) // 5], POINT, str(tmp_path / "in"))
    put(keyed, [("m", "c", end, 0.0)], POINT, str(tmp_path / "in"))  # time goes on
    stream = stream_of(keyed, str(tmp_path / "in"), POINT)
    out, _ = run(state.alarm_stream(stream, "m", stat, 60, ">", limit, periods), f"alarm_{stat}", str(tmp_path / "checkpoint"), "append")
    points = keyed.read.schema(POINT).parquet(str(tmp_path / "in"))
    want = state.transitions(threshold_alarm(points.where("function_name <> 'c'"), "m", stat, 60, ">", limit, periods), 60)
    key = lambda r: (r.function_name, str(r.period_start), r.state, r.value and round(r.value, 9))
    got = sorted(map(key, out.collect()), key=str)
    assert got == sorted(map(key, want.collect()), key=str)
    assert {r[2] for r in got} == {"ALARM", "OK"} and any(r[3] is None for r in got)


class Held:
    """State of one key in memory, with what was asked of it."""

    def __init__(self):
        self.kept, self.timers, self.reads = {}, set(), 0

    def variable(self, name, schema):
        return Variable(self, name)

    getListState = getValueState = variable

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Variable:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held.kept

    def get(self):
        self.held.reads += 1
        return self.held.kept[self.name]

    def put(self, rows):
        self.held.kept[self.name] = rows

    update = put

    def appendList(self, rows):
        self.put([*self.held.kept.get(self.name, []), *rows])

    def clear(self):
        self.held.kept.pop(self.name, None)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_asof_wakes_once_for_all_laps_that_are_due():
    laps = T._parse_datatype_string("session_key bigint, event_time timestamp, event_id bigint")
    readings = T._parse_datatype_string("event_time timestamp, asof_order bigint, asof_air double")
    joined = state._AsOf(laps, readings, ["air"], T._parse_datatype_string("session_key bigint, event_time timestamp, event_id bigint, air double"))
    held = Held()
    joined.init(held)
    at = [T0 + timedelta(seconds=k) for k in range(400)]
    rows = pd.DataFrame({"session_key": 1, "event_time": at * 2, "event_id": [float(k) for k in range(400)] * 2})
    rows["asof_is_reading"] = [False] * 400 + [True] * 400
    rows["asof_order"] = [None] * 400 + [*range(400)]
    rows["asof_air"] = [None] * 400 + [None if k % 3 == 0 else float(k) for k in range(400)]
    joined.handleInputRows((1,), iter([rows.sample(frac=1, random_state=1)]), None)
    joined.handleInputRows((1,), iter([rows[:0]]), None)
    first = state._millis(T0)
    assert held.timers == {first + 1}
    out, reads = [], held.reads
    for upto in (first + 300_500, first + 500_000):
        (timer,) = held.timers
        held.timers.clear()
        out += [row for part in joined.handleExpiredTimer((1,), Clock(upto), None) for row in part.itertuples(index=False)]
        held.timers = {t for t in held.timers if t > timer}
    assert [(r.event_id, r.air) for r in out] == [(k, None if k % 3 == 0 else float(k)) for k in range(400)]
    assert not held.timers and held.reads - reads <= 8 and len(held.kept["readings"]) == 1
    # An earlier lap moves the timer.
    for k in (700, 600):
        joined.handleInputRows((1,), iter([rows[:1].assign(event_time=T0 + timedelta(seconds=k))]), None)
    assert held.timers == {first + 600_001}
