"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.catalog.tables import Tables
from stintwise.catalog.views import with_views
from stintwise.operators.series import measuring_once


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        with measuring_once():
            df = self.build(Tables(spark, sf_dir))
        return df.withColumns({n: F.round(n, d) for n, d in self.digits.items()}) if self.digits else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.digits:
            return with_views(self.sql)
        rounded = ", ".join(f"round({n}, {d}) AS {n}" for n, d in self.digits.items())
        return with_views(f"SELECT * REPLACE ({rounded}) FROM ({self.sql}) q")


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None, digits: str = "", places: int = 10):
    """Register a query.  ``digits`` names float columns whose last bits depend on summation order."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = Query(key, fn, sql, {n: places for n in digits.split()})
        return fn

    return register
