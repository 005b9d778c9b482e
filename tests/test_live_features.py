"""The hand-computed live example, and drivers without data."""

import pytest

from stintwise.operators import state as S
from stintwise.schemas import MODEL_FEATURES

LAP = "session_key bigint, driver_number int, lap_number int, duration_sector_1 double"


def tables(spark, wet=False):
    number = 44 if wet else 1
    s1 = [] if wet else [(9999, 1, n, x) for n, x in ((9, 28.1), (10, 28.3), (11, 28.2), (12, 29.5))]
    if wet:
        s1 = [(9999, 44, 1, None)]
    end, compound = (5, "INTERMEDIATE") if wet else (12, "MEDIUM")
    gap = None if wet else "5.3"
    reading = (9999, "2024-01-01 10:00:00", 30.0, 50.0, True) if wet else (9999, "2024-01-01 10:00:00", 28.5, 44.2, False)
    weather = spark.createDataFrame(
        [reading], "session_key bigint, date string, air_temperature double, track_temperature double, rainfall boolean"
    ).withColumn("date", _ts("date"))
    car = "session_key bigint, driver_number int, date timestamp, speed double, throttle int, brake int, drs int, n_gear int"
    return {
        "laps": spark.createDataFrame(s1, LAP),
        "stints": spark.createDataFrame(
            [(9999, number, 1, 1, end, compound)],
            "session_key bigint, driver_number int, stint_number int, lap_start int, lap_end int, compound string",
        ),
        "intervals": spark.createDataFrame(
            [(9999, number, 12, gap, "2024-01-01 10:00:00")],
            "session_key bigint, driver_number int, lap_number int, gap_to_leader string, date string",
        ).withColumn("date", _ts("date")),
        "weather": weather,
        "pit": spark.createDataFrame(
            [], "session_key bigint, driver_number int, lap_number int, pit_duration double, pit_out_lap boolean"
        ),
        "car_data": spark.createDataFrame([], car),
    }


def _ts(name):
    from pyspark.sql import functions as F

    return F.to_timestamp(name)


def test_example_driver(spark):
    rows = S.live_features(**tables(spark)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.tyre_age, r.stint_number, r.tyre_age_sq, r.rainfall, r.wet_stint) == (11, 1, 121.0, 0, 0.0)
    assert r.gap_to_leader == pytest.approx(5.3)
    assert (r.air_temperature, r.track_temperature) == (28.5, 44.2)
    assert r.sector_delta == pytest.approx(1.3)
    assert r.abs_sector_delta == pytest.approx(r.sector_delta)
    assert r.heat_deg_interaction == pytest.approx(44.2 * 11 / 100)
    # lap 11 against the mean of laps 9 and 10
    assert r.deg_rate == pytest.approx(1.3 - (28.2 - (28.1 + 28.3) / 2))
    assert r.rolling_sector_delta_5 == pytest.approx((0.2 + 0.1 + 1.3) / 3)
    assert (r.compound_soft, r.compound_medium, r.compound_hard) == (0, 1, 0)
    assert (r.driver_name, r.team, r.tyre_compound) == ("Lando Norris", "McLaren", "MEDIUM")
    assert (r.pits_completed, r.last_pit_duration, r.drs_active, r.gap_trend) == (0, None, False, 0.0)


def test_wet_driver_without_times(spark):
    r = S.live_features(**tables(spark, wet=True)).collect()[0]
    assert (r.rainfall, r.gap_to_leader, r.sector_delta, r.deg_rate) == (1, 0.0, 0.0, 0.0)
    assert (r.compound_soft, r.compound_medium, r.compound_hard) == (0, 0, 0)


def test_driver_without_laps_is_absent(spark):
    given = tables(spark)
    given["laps"] = given["laps"].where("driver_number = 99")
    assert S.live_features(**given).count() == 0


def test_feature_order():
    assert len(MODEL_FEATURES) == 18
    assert MODEL_FEATURES[:3] == ["tyre_age", "stint_number", "gap_to_leader"]


def test_feature_array(spark):
    r = S.feature_array(S.live_features(**tables(spark))).collect()[0]
    assert len(r.features) == 18
    assert r.features[0] == 11.0 and r.features[16] == 1.0
