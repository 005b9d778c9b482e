import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from stintwise.ml import metrics, models, splits
from stintwise.schemas import BASE_FEATURES


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(42)
    rows = []
    for i in range(800):
        y = int(rng.random() < 0.2)
        rows.append((9000, i % 22, i, y, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 4), rng.random()))
    return spark.createDataFrame(
        rows, "session_key bigint, driver_number int, lap_number int, pitstop_within_3_laps int, p_xgb double, p_lgb double"
    )


def test_auc_equals_the_evaluator(spark, scored):
    ours = metrics.auc(scored, "p_xgb", "pitstop_within_3_laps").collect()[0].auc
    judge = BinaryClassificationEvaluator(
        rawPredictionCol="p_xgb", labelCol="pitstop_within_3_laps", metricName="areaUnderROC", numBins=0
    )
    assert ours == pytest.approx(judge.evaluate(scored), abs=1e-9)


def test_stack_formula_equals_the_fitted_model(spark, scored):
    fitted = models.train_meta(scored)
    by_model = models.with_probability(fitted, scored, "p").select("lap_number", "p")
    by_formula = models.stack_score(scored, models.stack_params(fitted)).select("lap_number", "pitstop_probability")
    worst = by_model.join(by_formula, "lap_number").agg(F.max(F.abs(F.col("p") - F.col("pitstop_probability")))).collect()
    assert worst[0][0] <= 5.1e-5


def test_splits_do_not_depend_on_partitioning(spark, scored):
    keys = ["session_key", "driver_number", "lap_number"]
    one = splits.stratified_split(scored.repartition(1), "pitstop_within_3_laps", keys)
    many = splits.stratified_split(scored.repartition(7), "pitstop_within_3_laps", keys)
    assert one.exceptAll(many).count() == 0
    shares = one.groupBy("pitstop_within_3_laps").agg(F.avg((F.col("split") == "train").cast("int")).alias("t")).collect()
    assert all(abs(r.t - 0.8) < 0.08 for r in shares)


@pytest.mark.parametrize("n", [10, 11, 97])
def test_temporal_split_is_exact(spark, n):
    rows = [(i, i % 3) for i in range(n)]
    times = spark.createDataFrame(rows, "id int, g int").withColumn(
        "event_time", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=(F.col("g") * 5000).cast("decimal(18,6)")))
    )
    got = splits.temporal_split(times, ["event_time", "id"])
    assert got.where("split = 'train'").count() == int(n * 0.8)
    newest_train = got.where("split = 'train'").agg(F.max(F.struct("event_time", "id"))).collect()[0][0]
    oldest_rest = got.where("split <> 'train'").agg(F.min(F.struct("event_time", "id"))).collect()[0][0]
    assert newest_train < oldest_rest


def test_requests_get_eleven_inputs(spark):
    df = spark.createDataFrame([(1, [4.0, 2.0, 1.5, 25.0, 40.0, 1.0, -0.5]), (2, [1.0])], "id int, features array<double>")
    r = models.request_features(df).select("id", *BASE_FEATURES).collect()
    assert len(r) == 1
    assert (r[0].tyre_age_sq, r[0].heat_deg_interaction, r[0].wet_stint, r[0].abs_sector_delta) == (16.0, 1.6, 2.0, 0.5)


def test_gate(spark):
    one = spark.createDataFrame([(0.82,), (0.81,), (None,)], "auc double")
    assert [r.approved for r in metrics.approve(one, "auc", 0.82).collect()] == [True, False, False]
    rmse = spark.createDataFrame([(2.5,)], "rmse double")
    assert metrics.approve(rmse, "rmse", 2.5, lower_is_better=True).collect()[0].approved
