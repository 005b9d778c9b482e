"""Rollups kept by micro-batches against the log itself."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stintwise.streaming import rollups

T0 = datetime(2024, 1, 1)
POINT = "metric_name string, function_name string, ts timestamp, metric_value double"


def keep(spark, folder, path, checkpoint):
    stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(folder)
    rollups.keep_rollup(stream, rollups.point_partials, path, checkpoint).awaitTermination()
    return rollups.read_rollup(spark, path)


def test_dashboards_read_the_rollup_and_late_records_correct_it(spark, tmp_path):
    rng = random.Random(1)
    rows = [("Duration", f"fn-{k % 2}", T0 + timedelta(seconds=rng.randrange(4 * 3600)), rng.random() * 100) for k in range(4000)]
    rows.sort(key=lambda r: r[2] + timedelta(seconds=rng.randrange(300)))
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "rollup", "checkpoint"))
    for k in range(3):
        spark.createDataFrame(rows[k::1][k * 1300 : (k + 1) * 1300], POINT).coalesce(1).write.mode("append").parquet(folder)
    keep(spark, folder, path, checkpoint)
    late = [("Duration", "fn-0", T0 + timedelta(seconds=30), 1000.0), ("Duration", "fn-0", T0 + timedelta(seconds=31), 1.0)]
    spark.createDataFrame(late, POINT).coalesce(1).write.mode("append").parquet(folder)
    partials = keep(spark, folder, path, checkpoint)
    log = spark.read.schema(POINT).parquet(folder)

    want = {(r.b, r.function_name): (round(r.t, 6), r.n) for r in log.groupBy(F.date_trunc("hour", "ts").alias("b"), "function_name").agg(F.sum("metric_value").alias("t"), F.count("*").alias("n")).collect()}
    got = rollups.metric_totals(partials, "Duration", "t")
    assert {(r.bucket, r.function_name): round(r.t, 6) for r in got.collect()} == {k: v[0] for k, v in want.items()}
    assert folder not in got._jdf.queryExecution().toString()

    # The rank error of the merged sketches.
    values = {}
    for r in log.collect():
        values.setdefault((r.ts.replace(minute=0, second=0, microsecond=0), r.function_name), []).append(r.metric_value)
    for p in (0.5, 0.9, 0.99):
        for r in rollups.metric_percentile(partials, "Duration", p, "q").collect():
            own = values[r.bucket, r.function_name]
            assert abs(sum(v <= r.q for v in own) / len(own) - p) < 0.03

    fixed = rollups.corrections(spark, path).where("batch = 3").collect()
    assert [(r.function_name, r.minute, r.n_after - r.n_before, round(r.total_after - r.total_before, 6)) for r in fixed] == [("fn-0", T0, 2, 1001.0)]
    minute = log.where((F.col("function_name") == "fn-0") & (F.date_trunc("minute", "ts") == F.lit(T0))).agg(F.sum("metric_value"), F.count("*")).first()
    assert (round(fixed[0].total_after, 6), fixed[0].n_after) == (round(minute[0], 6), minute[1])


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "rollup", "checkpoint"))
    spark.createDataFrame([("Errors", "fn-1", T0, 2.0)], POINT).write.parquet(folder)
    keep(spark, folder, path, checkpoint)
    again = keep(spark, folder, path, f"{checkpoint}-lost")
    assert rollups.metric_totals(again, "Errors", "n").first().n == 2.0


def test_drivers_of_windows_from_sketches(spark):
    rng = random.Random(2)
    rows = [(T0 + timedelta(minutes=rng.randrange(120)), rng.randrange(3000), 0.5) for _ in range(6000)]
    df = spark.createDataFrame(rows, "ts timestamp, driver_number int, pitstop_probability double")
    found = rollups.drivers_lost(rollups.driver_partials(df), 60, F.lit(T0 + timedelta(minutes=120))).first()
    late, early = ({d for t, d, _ in rows if (t >= T0 + timedelta(minutes=60)) == k} for k in (True, False))
    assert (found.seen, found.before, found.lost) == (len(late), len(early), len(early - late))
    nobody = rollups.drivers_lost(rollups.driver_partials(df), 60, F.lit(T0 + timedelta(minutes=500))).first()
    assert tuple(nobody) == (0, 0, 0)
