"""Exact quantiles that do not gather a hot group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.operators.series import series, with_running

c = F.col


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Interpolated percentile of ``value`` per key.

    Spark's own aggregate holds the distinct values of a group in memory, which is
    fine up to the series limit.  Beyond it, equal values are counted first, and
    ranks come from running counts over value bins.
    """
    rows = df.where(c(value).isNotNull()).select(*keys, value)
    found = series(rows, keys, [value])
    if not found.split:
        return rows.groupBy(*keys).agg(F.percentile(value, p).alias(name))
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = with_running(found.replace(counted), sums={"_upto": c("_n")})
    rank = (c("_total") - 1) * F.lit(p)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    low, high = F.floor(rank), F.ceil(rank)
    # As Spark's percentile weighs its two neighbours.
    between = (F.ceil("_rank") - c("_rank")) * c("_low") + (c("_rank") - F.floor("_rank")) * c("_high")
    return (
        upto.join(totals, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(c("_upto") > low, c(value))).alias("_low"),
            F.min(F.when(c("_upto") > high, c(value))).alias("_high"),
            F.first(rank).alias("_rank"),
        )
        .select(*keys, F.when(c("_low") == c("_high"), c("_low")).otherwise(between).alias(name))
    )
