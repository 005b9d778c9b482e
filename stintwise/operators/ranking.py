"""Shares and positions within a scoring cycle (one session and lap)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.dimensions import DEFAULT_STRENGTH, TEAM_STRENGTH, lookup
from stintwise.operators.series import Series, series, with_position, with_totals

c = F.col
CYCLE = ["session_key", "lap_number"]


def _by_gap(df: DataFrame, cycle: list[str]) -> Series:
    return series(df, cycle, ["gap_to_leader", "driver_number"])


def live_position(df: DataFrame, cycle: list[str] = CYCLE) -> DataFrame:
    """Race position by gap; equal gaps by driver number."""
    ranked = with_position(_by_gap(df, cycle), "live_position")
    return ranked.withColumn("live_position", c("live_position").cast("int"))


def _share(s: Series, score: Column, name: str, places: int | None) -> DataFrame:
    """Score over its cycle's total; a total of 0 counts as 1."""
    scored = with_totals(s.replace(s.df.withColumn("_score", score)), {"_total": F.sum("_score")})
    share = c("_score") / F.coalesce(F.nullif(c("_total"), F.lit(0.0)), F.lit(1.0))
    return scored.withColumn(name, share if places is None else F.round(share, places)).drop("_score", "_total")


def win_probability(df: DataFrame, cycle: list[str] = CYCLE, places: int | None = 4) -> DataFrame:
    """Win share from position, gap, team, tyres and stop risk; a safety car shifts weight to position."""
    cars = _by_gap(df, cycle)
    ranked = cars.replace(with_position(cars, "live_position"))
    placed = with_totals(ranked, {"_cars": F.count(F.lit(1))}).withColumn(
        "live_position", c("live_position").cast("int")
    )
    zero = F.lit(0.0)
    position = (c("_cars") - c("live_position") + 1) / c("_cars")
    gap = F.greatest(zero, 1.0 - c("gap_to_leader") / 120.0)
    tyre = F.greatest(zero, 1.0 - c("tyre_age") / 50.0)
    team = lookup(c("team"), TEAM_STRENGTH, DEFAULT_STRENGTH)
    steady = 1.0 - F.coalesce("pitstop_probability", zero)
    score = F.when(
        c("safety_car_active"), position * 0.55 + team * 0.25 + tyre * 0.15 + steady * 0.05
    ).otherwise(position * 0.40 + gap * 0.25 + team * 0.20 + tyre * 0.10 + steady * 0.05)
    return _share(ranked.replace(placed), score, "win_probability", places).drop("_cars")


def win_from_position(df: DataFrame, cycle: list[str] = CYCLE, places: int | None = 4) -> DataFrame:
    """Win share from predicted finishing positions, which are shown to 1 decimal."""
    cars = series(df, cycle, ["driver_number"])
    shared = _share(cars, F.greatest(F.lit(0.1), 23.0 - c("predicted_position")), "win_probability", places)
    return shared if places is None else shared.withColumn("predicted_position", F.round("predicted_position", 1))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows of each key; trimmed in every task before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(c(rank) <= n)
