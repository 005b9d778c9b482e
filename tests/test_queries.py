"""Queries against their SQL twins on the small tables.

``ALL_QUERIES=1`` runs every query; by default one or two of each family.
"""

import os

import pytest

from stintwise.catalog import all_queries
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
SAMPLE = """build_pitstop_features engineer_features derive_stints join_stint_for_lap asof_weather build_training_rows
build_safety_car_features win_probability live_features safety_car_active stints_with_fallback format_prediction
features_to_columns merge_live_and_catchup full_standings prob_timeline_top5 driver_strategy_table duration_p99
parse_report_lines drift_alarm latency_alarm latest_snapshot podium temporal_split auc classification_metrics
flatten_session load_training read_inference_log save_stint_cache feature_store_append car_state held_out_leafwise""".split()
NAMES = [n for n, q in all_queries().items() if q.sql] if os.environ.get("ALL_QUERIES") else SAMPLE
SPLIT = "build_pitstop_features asof_weather win_probability live_position temporal_split group_by_driver build_training_rows".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    q = all_queries()[name]
    assert differences(q.run(spark, SF).toPandas(), con.execute(q.oracle()).df()) is None


@pytest.mark.parametrize("name", SPLIT)
def test_same_as_sql_with_long_series(spark, con, long_series, name):
    q = all_queries()[name]
    assert differences(q.run(spark, SF).toPandas(), con.execute(q.oracle()).df()) is None
