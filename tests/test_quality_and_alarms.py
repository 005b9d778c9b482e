from datetime import datetime, timedelta

import pytest

from stintwise.dimensions import DRIVER_GRID, TEAM_STRENGTH
from stintwise.operators import alarms as A
from stintwise.operators import logs as L
from stintwise.operators import quality as Q
from stintwise.sources import readers as R


def test_grid():
    assert len(DRIVER_GRID) == 22 and len({n for n, *_ in DRIVER_GRID}) == 22
    assert {team for _, _, team, _ in DRIVER_GRID} == set(TEAM_STRENGTH)


def test_feature_arrays_of_wrong_length_are_rejected(spark):
    rows = [(1, [1.0] * 7), (2, [1.0, 2.0, 3.0]), (3, None), (4, [])]
    valid, rejected = Q.validate_feature_arrays(spark.createDataFrame(rows, "id int, features array<double>"))
    assert [r.id for r in valid.collect()] == [1]
    assert sorted(r.id for r in rejected.collect()) == [2, 3, 4]
    assert all("exactly 7" in r.error for r in rejected.collect())


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="gap_to_leader"):
        Q.require_columns(spark.range(1), ["id", "gap_to_leader"])


def test_conform_schema_nulls_what_does_not_fit(spark):
    df = spark.createDataFrame([("12", "x")], "driver_number string, gap string")
    r = Q.conform_schema(df, "driver_number int, gap float, extra long").collect()[0]
    assert (r.driver_number, r.gap, r.extra) == (12, None, None)


def test_log_lines(spark):
    lines = [
        "REPORT RequestId: abc-1\tDuration: 1234.56 ms\tBilled Duration: 1235 ms\tMemory Size: 256 MB\tMax Memory Used: 89 MB\tInit Duration: 432.1 ms",
        "REPORT RequestId: abc-2 Duration: 5.0 ms  Billed Duration: 6 ms Memory Size: 512 MB Max Memory Used: 90 MB",
        "[ERROR] failure at lap 3",
        '{"drivers": 22}',
        "ModelLatency:12345",
        "START RequestId: abc-1",
        "END RequestId: abc-1",
    ]
    rows = L.parse_report_lines(spark.createDataFrame([(x,) for x in lines], "message string")).collect()
    assert len(rows) == 5
    by_tag = {r.tag: r for r in rows}
    cold = by_tag["cold_start"]
    assert (cold.request_id, cold.duration_ms, cold.billed_duration_ms) == ("abc-1", 1234.56, 1235.0)
    assert (cold.memory_size_mb, cold.memory_used_mb, cold.init_duration_ms) == (256, 89, 432.1)
    assert by_tag["function_report"].init_duration_ms is None
    assert by_tag["function_error"].error_message == "failure at lap 3"
    assert by_tag["structured_log"].parsed == {"drivers": "22"}
    assert by_tag["model_latency"].model_latency_ms == pytest.approx(12.345)


def _confidence(spark, minutes):
    start = datetime(2024, 1, 1, 12)
    rows = [("PredictionConfidence", start + timedelta(minutes=m), v) for m, v in minutes]
    return spark.createDataFrame(rows, "metric_name string, ts timestamp_ntz, metric_value double")


@pytest.mark.parametrize(
    "minutes, alarms",
    [
        ([(m, 0.5) for m in range(10)], 1),
        ([(m, 0.5) for m in range(9)] + [(9, 0.9)], 0),
        ([(m, 0.5) for m in range(11) if m != 5], 0),
        ([(m, 0.5) for m in range(12)], 3),
    ],
)
def test_drift_needs_ten_breaching_minutes_in_a_row(spark, minutes, alarms):
    assert A.drift_alarm(_confidence(spark, minutes)).where("alarm").count() == alarms


def test_broken_document_is_kept_as_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"session_key": 1, "drivers": {"4": {"laps": [{"lap_number": 1}]}, "5": {"laps": []}}}\n{broken\n')
    docs = R.read_session_documents(spark, str(tmp_path))
    assert docs.cache().where("_corrupt_record IS NOT NULL").count() == 1
    laps = R.flatten_session(R.drop_drivers_without_laps(docs), "laps").collect()
    assert [(r.session_key, r.driver_number, r.lap_number) for r in laps] == [(1, 4, 1)]


def test_indented_document(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "session_key": 7,\n "weather": [{"air_temperature": 20.5}]\n}')
    docs = R.read_session_documents(spark, str(tmp_path), multi_line=True)
    assert R.flatten_session(docs, "weather").collect()[0].air_temperature == 20.5
