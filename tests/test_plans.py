"""What the physical plans must look like."""

import re

import pytest

from stintwise.catalog import all_queries
from stintwise.catalog.tables import Tables
from stintwise.operators.joins import DRIVER
from stintwise.operators.state import newest_rows
from stintwise.plans.pitstop import build_pitstop_features
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_build_exchanges_and_sorts_once(spark, tmp_path):
    path = str(tmp_path / "raw")
    Tables(spark, SF).raw_laps.write.parquet(path)
    text = plan(build_pitstop_features(spark.read.parquet(path)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"\bSort \[", text)) == 1


def test_feature_build_from_events_exchanges_once(spark):
    text = plan(build_pitstop_features(Tables(spark, SF).raw_laps))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(Tables(spark, SF).weather.select("session_key", "air_temperature"))
    assert "EqualTo(event_type,view)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "value" not in schema and "ts:" not in schema


def test_newest_rows_are_trimmed_before_the_exchange(spark, tmp_path):
    path = str(tmp_path / "laps")
    Tables(spark, SF).laps.write.parquet(path)
    text = plan(newest_rows(spark.read.parquet(path), DRIVER, [F.desc("lap_number")], 6))
    assert text.count("WindowGroupLimit") == 2


def test_newest_telemetry_needs_no_sort(spark):
    from stintwise.operators.state import latest_per_driver

    text = plan(latest_per_driver(Tables(spark, SF).car_data))
    assert "SortAggregate" not in text and "HashAggregate" in text


NAMES = [n for n, q in all_queries().items() if q.sql is not None]


@pytest.mark.parametrize("name", ["build_training_rows", "latest_session_predictions", "tyre_status", "asof_weather", "join_stint_for_lap", "driver_state"])
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(all_queries()[name].run(spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "EvalPython" not in text and "InPandas" not in text


def test_every_query_with_sql_has_an_oracle_text():
    for name in NAMES:
        assert "SELECT" in all_queries()[name].oracle()


def test_recent_windows_read_only_their_days(spark, tmp_path):
    from stintwise.plans.dashboards import full_standings, max_lap
    from stintwise.sources.writers import write_daily

    path = write_daily(Tables(spark, SF).predictions.withColumn("last_pit_duration", F.lit(None).cast("double")), str(tmp_path / "log"))
    log = spark.read.parquet(path)
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    for df in (max_lap(log, 10, now), full_standings(log, 30, now)):
        text = plan(df)
        assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+ >= 2024-01-15|PartitionFilters: \[[^\]]*\(dt#\d+ >= \d+\)", text), text
        assert len(re.findall(r"FileScan", text)) == 1


def test_snapshot_and_training_rows_exchange_little(spark):
    def exchanges(name):
        return len(re.findall(r"Exchange (?:hash|range|Single)", plan(all_queries()[name].build(Tables(spark, SF)))))

    assert exchanges("latest_snapshot") <= 14  # most of them make the log out of the events
    assert exchanges("join_stint_for_lap") <= 12


def test_a_repeated_batch_doubles_nothing(spark, tmp_path):
    from stintwise.sources import writers as W

    t = Tables(spark, SF)
    log = t.predictions.select("ts", "driver_name", "session_key")
    for write in (lambda p, b: W.write_daily(log, p, batch=b), lambda p, b: W.write_inference_log(log, p, batch=b)):
        path = str(tmp_path / f"t{id(write)}")
        for batch in ("a", "b", "b", "a"):
            write(path, batch)
        kind = "json" if list((tmp_path / path).rglob("*.json")) else "parquet"
        assert spark.read.format(kind).load(path).count() == 2 * log.count()
