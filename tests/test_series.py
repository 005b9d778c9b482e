"""Split and plain plans against brute force in Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintwise.operators import series as S
from stintwise.operators.quantiles import exact_percentile


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for driver, laps in ((1, 120), (2, 3), (3, 5), (4, 17)):
        numbers = sorted(rng.sample(range(1, 400), laps))
        for lap in numbers:
            pit = rng.random() < 0.1
            out.append((9000, driver, lap, round(rng.uniform(20, 40), 3), int(pit), lap if pit else None))
    return out


def frame(spark, rows):
    schema = "session_key bigint, driver_number int, lap_number int, x double, did_pit int, pit_lap int"
    return spark.createDataFrame(rows, schema).repartition(4)


def expected(rows):
    out = {}
    names = ["session_key", "driver_number", "lap_number", "x", "did_pit", "pit_lap"]
    for (_, driver), g in pd.DataFrame(rows, columns=names).groupby(["session_key", "driver_number"]):
        g = g.sort_values("lap_number").reset_index(drop=True)
        for i, r in g.iterrows():
            earlier = g.loc[: i, "pit_lap"].dropna()
            near = list(g.loc[max(0, i - 3) : i - 1, "x"]) if i else []
            ahead = list(g.loc[i + 1 : i + 3, "did_pit"])
            out[(driver, int(r.lap_number))] = (
                i + 1,
                int(g.loc[:i, "did_pit"].sum()),
                int(earlier.iloc[-1]) if len(earlier) else None,
                round(sum(near) / len(near), 9) if near else None,
                max(ahead) if ahead else None,
                len(g),
            )
    return out


def computed(df):
    s = S.lap_series(df, block=16)
    placed = S.with_position(s)
    ran = S.with_running(s.replace(placed), {"pits": F.col("did_pit")}, {"last_pit": F.col("pit_lap")})

    def frames(d, w):
        return d.withColumns(
            {
                "near": F.round(F.avg("x").over(w.rowsBetween(-3, -1)), 9),
                "ahead": F.max("did_pit").over(w.rowsBetween(1, 3)),
            }
        )

    framed = S.with_frames(s.replace(ran), frames, 3, 3)
    full = S.with_totals(s.replace(framed), {"n": F.count(F.lit(1))})
    return {
        (r.driver_number, r.lap_number): (r.position, r.pits, r.last_pit, r.near, r.ahead, r.n) for r in full.collect()
    }


def test_plain_plan(spark, rows):
    df = frame(spark, rows)
    assert not S.lap_series(df).split
    assert computed(df) == expected(rows)


def test_split_plan(spark, rows, long_series):
    df = frame(spark, rows)
    assert sorted(S.lap_series(df).hot) == [(9000, 1), (9000, 4)]
    assert computed(df) == expected(rows)


def test_split_plan_when_keys_are_too_many_to_list(spark, rows, long_series, monkeypatch):
    monkeypatch.setattr(S, "MAX_LISTED_KEYS", 1)
    df = frame(spark, rows).withColumn("y", F.lit(1))
    assert S.lap_series(df).hot is None
    assert computed(df.drop("y").withColumn("x", F.col("x") + 0)) == expected(rows)


def test_split_plan_never_windows_over_a_whole_driver(spark, rows, long_series):
    df = frame(spark, rows)
    plan = S.with_position(S.lap_series(df))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "row_number()" in line:
            assert "_bin" in line


def test_exact_percentile_of_a_long_group(spark, long_series):
    rng = random.Random(3)
    values = [("a", round(rng.gauss(50, 20), 2)) for _ in range(300)] + [("b", 1.0), ("b", 2.0)]
    values += [("a", 50.0)] * 100
    df = spark.createDataFrame(values, "k string, v double")
    got = {r.k: r.p for r in exact_percentile(df, ["k"], "v", 0.99, "p").collect()}
    want = pd.DataFrame(values, columns=["k", "v"]).groupby("k").v.quantile(0.99)
    assert got["a"] == pytest.approx(want["a"], abs=1e-9)
    assert got["b"] == pytest.approx(want["b"], abs=1e-9)
