"""Long series give the rows of plain windows: null keys, null orders and one-value bins included."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from stintwise.ml.metrics import auc, model_comparison
from stintwise.ml.splits import temporal_split
from stintwise.operators.joins import join_stint_for_lap
from stintwise.operators.quantiles import exact_percentile
from stintwise.operators.series import lap_series, long_keys, measuring_once, series, with_frames, with_position, with_running, with_totals
from stintwise.session import local_base

SCHEMA = "session_key long, driver_number int, lap_number int, at int, x double"


def rows():
    """Series of many sorts; ``at`` is unique, so the order has no ties."""
    rng = random.Random(1)
    out = []
    for session, driver, n in ((1, 1, 40), (1, 2, 3), (2, None, 25), (None, 3, 30), (3, 4, 50)):
        laps = [None if rng.random() < 0.1 else rng.randrange(400) for _ in range(n)]
        laps = [7] * n if session == 3 else laps  # one bin holds the whole series
        places = rng.sample(range(10_000), n)
        out += [(session, driver, lap, at, None if rng.random() < 0.2 else round(rng.random(), 3)) for lap, at in zip(laps, places, strict=True)]
    return out


def both(spark, run):
    """``run(series)`` with every series split, and with none."""
    df = spark.createDataFrame(rows(), SCHEMA)
    found = []
    for limit in (4, 10**6):
        s = series(df, ["session_key", "driver_number"], ["lap_number", "at"], max_rows=limit)
        assert s.split == (limit == 4)
        got = run(s)
        found.append(sorted([tuple(r) for r in got.select(sorted(got.columns)).collect()], key=repr))
    return found


@pytest.mark.parametrize(
    "run",
    [
        with_position,
        lambda s: with_running(s, {"n": F.lit(1)}, {"seen": F.when(F.col("x") < 0.5, F.col("at"))}),
        lambda s: with_totals(s, {"n": F.count(F.lit(1)), "top": F.max("x")}),
        lambda s: with_totals(s, {"n": F.count(F.lit(1))}, extra=("x",)),
        lambda s: with_frames(s, lambda df, w: df.withColumn("near", F.collect_list("at").over(w.rowsBetween(-2, 1))), 2, 1),
    ],
    ids=["position", "running", "totals", "totals_extra", "frames"],
)
def test_split_and_plain_give_the_same_rows(spark, run):
    split, plain = both(spark, run)
    assert len(plain) == len(rows())
    assert split == plain


def test_bins_are_bounded_by_rows(spark):
    df = spark.createDataFrame([(1, 1, 7, k, 0.0) for k in range(2000)], SCHEMA)
    binned = series(df, ["session_key"], ["lap_number", "at"], max_rows=100).binned()
    assert binned.groupBy("_bin").count().agg(F.max("count")).first()[0] <= 100


def test_random_orders_and_types(spark, long_series):
    """Orders of several columns of any type, ties broken by the last one, nulls among them."""
    rng = random.Random(11)
    schema = "k string, a int, b string, ts timestamp_ntz, d date, u long, x double"
    start = datetime.datetime(2024, 1, 1)
    data = []
    for n in range(400):
        at = start + datetime.timedelta(seconds=rng.randrange(50))
        maybe = lambda v: None if rng.random() < 0.1 else v
        data.append((maybe("hot") if n % 3 else f"k{n % 4}", maybe(rng.randrange(5)), maybe(rng.choice("pqr")), maybe(at), maybe(at.date()), n, rng.random()))
    df = spark.createDataFrame(data, schema)
    for order, limit in ((["a", "u"], 5), (["u", "a"], 7), (["ts", "b", "u"], 5), (["b", "d", "ts", "u"], 9)):
        found = []
        for most in (limit, 10**6):
            s = series(df, ["k"], order, max_rows=most)
            assert s.split == (most == limit)
            placed = with_running(s.replace(with_position(s)), {"sum": F.col("u")}, {"last": F.when(F.col("x") < 0.3, F.col("u"))})
            found.append(sorted(tuple(r) for r in placed.select("u", "position", "sum", F.coalesce("last", F.lit(-1))).collect()))
        assert found[0] == found[1], order


def test_new_rows_are_measured(spark, tmp_path):
    path = str(tmp_path / "laps")
    spark.createDataFrame([(1, 1, k, k, 0.0) for k in range(3)], SCHEMA).write.parquet(path)
    read = lambda: lap_series(spark.read.schema(SCHEMA).parquet(path)).hot
    spark.conf.set("stintwise.series.maxRows", "5")
    try:
        assert read() == []
        spark.createDataFrame([(1, 1, k, k, 0.0) for k in range(3, 100)], SCHEMA).write.mode("append").parquet(path)
        assert read() == [(1, 1)]
    finally:
        spark.conf.unset("stintwise.series.maxRows")


def test_measured_once_within_a_query(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, k, k, 0.0) for k in range(30)], SCHEMA)
    with measuring_once():
        first = long_keys(df, ["session_key"], 5)
        assert long_keys(df, ["session_key"], 5) is first
    assert long_keys(df, ["session_key"], 5) is not first


def test_percentile_split_as_spark(spark):
    df = spark.createDataFrame([(k % 2, float((k * 37) % 101) / 7) for k in range(300)] + [(0, None)], "g int, v double")
    spark.conf.set("stintwise.series.maxRows", "20")
    try:
        got = {r.g: r.p for r in exact_percentile(df, ["g"], "v", 0.99, "p").collect()}
    finally:
        spark.conf.unset("stintwise.series.maxRows")
    assert got == {r.g: r.p for r in df.groupBy("g").agg(F.percentile("v", 0.99).alias("p")).collect()}


@pytest.mark.parametrize("limit", ["2", "1000000"])
def test_temporal_split_keeps_all_rows(spark, limit):
    times = [f"2024-01-0{1 + k // 4} 0{k % 4}:00:00" for k in range(9)] + [None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "id int, t string").withColumn("t", F.to_timestamp("t"))
    spark.conf.set("stintwise.series.maxRows", limit)
    try:
        for share, train in ((0.8, 8), (1.0, 10), (0.0, 0), (0.35, 3)):
            got = {r.id: r.split for r in temporal_split(df, ["t", "id"], share).collect()}
            assert len(got) == 10 and [k for k in range(10) if got[k] == "train"] == list(range(train)), share
    finally:
        spark.conf.unset("stintwise.series.maxRows")


def test_auc_is_exact(spark):
    rng = random.Random(3)
    pairs = [(0.5 + rng.random() * 1e-6, rng.randrange(2)) for _ in range(300)] + [(0.25, 1), (0.25, 0), (0.75, 1)]
    wins = [(a > b) + (a == b) / 2 for a, y in pairs if y for b, z in pairs if not z]
    df = spark.createDataFrame([*pairs, (None, 1)], "p double, y int")
    assert abs(auc(df, "p", "y").first().auc - sum(wins) / len(wins)) < 1e-12
    got = model_comparison(df, {"a": "p"}, "y").first()
    assert got.model == "a" and abs(got.auc - sum(wins) / len(wins)) < 1e-12


def test_open_stint_has_no_last_lap_of_its_own(spark):
    laps = spark.createDataFrame([(1, 1, n) for n in (1, 9_999, 10_000, 40_000)] + [(1, 2, 5)], "session_key int, driver_number int, lap_number int")
    stints = spark.createDataFrame(
        [(1, 1, 1, 1, 9, "HARD"), (1, 1, 2, 10, None, "SOFT"), (1, 3, 1, 1, None, "SOFT")],
        "session_key int, driver_number int, stint_number int, lap_start int, lap_end int, compound string",
    )
    joined = join_stint_for_lap(laps, stints)
    got = {(r.driver_number, r.lap_number): (r.tyre_compound, r.stint_number, r.tyre_age) for r in joined.collect()}
    assert got == {(1, 1): ("HARD", 1, 0), (1, 9_999): ("SOFT", 2, 9_989), (1, 10_000): ("SOFT", 2, 9_990), (1, 40_000): ("SOFT", 2, 39_990), (2, 5): ("UNKNOWN", 1, 4)}


def test_scratch_folder_needs_a_shared_one_on_a_cluster():
    assert local_base("local[4]") == local_base("local[*]")
    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(ValueError):
            local_base(master)
