"""Deterministic train and validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.operators.series import series, with_position

c = F.col


def stable_bucket(keys: list[str], buckets: int, seed: int = 42) -> Column:
    """Bucket of a row by its key alone, the same on every run, partitioning and engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c(k).cast("string") for k in keys]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def stratified_split(df: DataFrame, label: str, keys: list[str], train: float = 0.8, seed: int = 42) -> DataFrame:
    """``split`` column; each class is cut by its own hash, so both parts keep the class balance."""
    place = stable_bucket([label, *keys], 10_000, seed)
    return df.withColumn("split", F.when(place < int(train * 10_000), "train").otherwise("validation"))


def assign_folds(df: DataFrame, label: str, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", stable_bucket([label, *keys], k, seed + 1).cast("int"))


def temporal_split(df: DataFrame, order: list[str], train: float = 0.8) -> DataFrame:
    """Exactly the first ``train`` share of rows in time order, without sorting all rows.

    Rows are counted per hour; only the hour that holds the cut is ordered row by
    row.  The one global window runs over the hours.  ``order`` starts with the
    time; rows without a time come last.
    """
    seconds = F.unix_seconds(c(order[0]).cast("timestamp"))
    hour = F.floor(seconds / 3600)
    hourly = df.groupBy(hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    over_hours = Window.orderBy(c("_hour").asc_nulls_last())
    running = hourly.select(
        "_hour",
        (F.sum("_n").over(over_hours) - c("_n")).alias("_before"),
        F.sum("_n").over(over_hours).alias("_upto"),
        F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(train)).alias("_target"),
    )
    cut = running.where((c("_before") <= c("_target")) & (c("_target") < c("_upto")))
    # Null where every row is in the first share.
    found = cut.select(F.struct("_hour", (c("_target") - c("_before")).alias("_quota")).alias("_cut")).scalar()
    timed = df.withColumn("_hour", hour).withColumn("_cut", found)
    here = c("_hour").eqNullSafe(c("_cut._hour")) & c("_cut").isNotNull()
    early = c("_cut").isNull() | F.coalesce(c("_hour") < c("_cut._hour"), c("_hour").isNotNull() & c("_cut._hour").isNull())
    outside = timed.where(~here).withColumn("split", F.when(early, "train").otherwise("validation"))
    inside = with_position(series(timed.where(here), ["_hour"], order), "_place")
    ranked = inside.withColumn("split", F.when(c("_place") <= c("_cut._quota"), "train").otherwise("validation"))
    return outside.unionByName(ranked.drop("_place")).drop("_hour", "_cut")
