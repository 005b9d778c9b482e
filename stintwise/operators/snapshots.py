"""Newest row of each key, as an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types Spark can update in place in a hash aggregate.
IN_PLACE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def newest_by_key(df: DataFrame, keys: list[str], at: str, names: list[str] | None = None) -> DataFrame:
    """Columns of each key's row with the largest ``at``.

    Fixed-width columns are aggregated one by one: that stays a hash aggregate,
    so a large feed shrinks to one row per key in each task without a sort.  With
    text among them the row is aggregated whole, which sorts by key.
    """
    names = names if names is not None else [x for x in df.columns if x not in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    if all(isinstance(types[n], IN_PLACE) for n in [*names, at]):
        return df.groupBy(*keys).agg(*[F.max_by(n, at).alias(n) for n in names]).select(*keys, *names)
    row = F.max_by(F.struct(*names), F.col(at)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r.{n}").alias(n) for n in names])


def features_as_of(df: DataFrame, keys: list[str], at: Column | None = None, time: str = "event_time") -> DataFrame:
    """Newest record of each key, at or before ``at`` when given."""
    return newest_by_key(df if at is None else df.where(F.col(time) <= at), keys, time)
