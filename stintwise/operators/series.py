"""Ordered per-series computations that survive a hot series.

A series is the rows of one key (usually one driver in one session) in a given
order.  A plain window puts a whole series into one task, which is right while
series are short.  Where a single key may hold a large share of the table, the
operators here split it:

* the rows of long series are dealt out by ranges of key and whole order, at
  boundaries that Spark samples (``repartitionByRange``), so a range, or *bin*,
  holds about as many rows as any other whatever the order consists of, and all
  rows of a bin come before those of the next; every window runs per bin;
* what a bin needs from earlier bins (row counts, running sums, last known
  values) is aggregated per bin first, so only those small totals are ordered
  in one place, and joined back on ``(key, bin)``;
* short frames (``rowsBetween(-8, 3)`` and the like) get the few neighbouring
  rows copied across a cut.

Whether long series exist is measured with one narrow aggregate per input.  A
measurement is remembered only within ``measuring_once()``, which a caller puts
around the building of one query, so that data which arrive later (another run,
the next micro-batch) are measured anew.  Without long series, each operator is
the plain window: one exchange.  Both ways give the same rows, those with null
keys and null orders included: nulls come first, as in a plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stintwise.session import written

MAX_ROWS_CONF = "stintwise.series.maxRows"
DEFAULT_MAX_ROWS = 1_000_000
#: Long keys beyond this many are not listed; then every series is binned.
MAX_LISTED_KEYS = 10_000

#: Ranges that long series are dealt out to, at most.
MAX_RANGES_CONF = "stintwise.series.maxRanges"
DEFAULT_MAX_RANGES = 20_000

_remembered: ContextVar[dict[tuple, list | None] | None] = ContextVar("remembered", default=None)


@contextmanager
def measuring_once() -> Iterator[None]:
    """Within this block, what one plan's long keys are is measured once."""
    token = _remembered.set({})
    try:
        yield
    finally:
        _remembered.reset(token)


def max_series_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS)))


def long_keys(df: DataFrame, keys: list[str], max_rows: int) -> list | None:
    """Keys with more than ``max_rows`` rows; ``None`` when there are too many to list.

    The driver receives at most ``MAX_LISTED_KEYS`` + 1 keys, never table rows.
    """
    known = _remembered.get()
    token = (df.semanticHash(), tuple(keys), max_rows)
    if known is not None and token in known:
        return known[token]
    found = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > max_rows)
        .select(*keys)
        .limit(MAX_LISTED_KEYS + 1)
        .collect()
    )
    hot = None if len(found) > MAX_LISTED_KEYS else [tuple(r) for r in found]
    if known is not None:
        known[token] = hot
    return hot


def _join_on(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which null keys match null keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    return left.join(renamed, same, "left").drop(*[f"_r_{k}" for k in on])


@dataclass(frozen=True)
class Series:
    """Rows of ``df`` per ``keys`` in ``order``; ``hot`` lists the keys with more than ``max_rows``, or is None if they are too many."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    max_rows: int
    hot: list | None
    #: Rows of a range into which long series are cut; half of ``max_rows`` by default.
    block: int | None = None

    @property
    def split(self) -> bool:
        return self.hot is None or len(self.hot) > 0

    def window(self, extra: tuple[str, ...] = ()) -> WindowSpec:
        return Window.partitionBy(*self.keys, *extra).orderBy(*self.order)

    def binned(self) -> DataFrame:
        """``df`` with ``_bin``: the number of its range for each row of a long series, 0 for all others.

        Ranges are written down, since a plan that runs twice may draw other boundaries.
        """
        if self.hot is None:
            long, short = self.df, None
        else:
            types = {f.name: f.dataType for f in self.df.schema.fields}
            ddl = ", ".join(f"`{k}` {types[k].simpleString()}" for k in self.keys)
            listed = self.df.sparkSession.createDataFrame(self.hot, ddl).withColumn("_long", F.lit(True))
            marked = _join_on(self.df, F.broadcast(listed), self.keys)
            long = marked.where("_long").drop("_long")
            short = marked.where("_long IS NULL").drop("_long").withColumn("_bin", F.lit(0).cast("long"))
        most = int(long.sparkSession.conf.get(MAX_RANGES_CONF, str(DEFAULT_MAX_RANGES)))
        n = long.count()
        ranges = min(most, max(2, -(-n // self.block) if self.block else -(-2 * n // self.max_rows)))
        dealt = long.repartitionByRange(ranges, *self.keys, *self.order)
        cut = written(dealt.withColumn("_bin", F.spark_partition_id().cast("long")), "long-series")
        return cut if short is None else cut.unionByName(short)

    def replace(self, df: DataFrame) -> Series:
        return Series(df, self.keys, self.order, self.max_rows, self.hot, self.block)


def series(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    max_rows: int | None = None,
    measure: DataFrame | None = None,
    block: int | None = None,
) -> Series:
    """``measure`` is a narrower or cheaper frame with the same rows per key, used only to look for long series."""
    limit = max_rows or max_series_rows(df)
    hot = long_keys(measure if measure is not None else df, keys, limit)
    return Series(df, list(keys), list(order), limit, hot, block)


def short_lap_series(df: DataFrame) -> Series:
    """Laps already cut to a few per driver, so there is nothing to measure."""
    keys = ["session_key", "driver_number"]
    return Series(df, keys, ["lap_number"], max_series_rows(df), [])


def lap_series(df: DataFrame, measure: DataFrame | None = None, block: int | None = None) -> Series:
    """Laps of a driver in a session."""
    return series(df, ["session_key", "driver_number"], ["lap_number"], measure=measure, block=block)


def _earlier(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)


def with_position(s: Series, name: str = "position") -> DataFrame:
    """Dense 1-based position of every row in its series."""
    if not s.split:
        return s.df.withColumn(name, F.row_number().over(s.window()).cast("long"))
    rows = s.binned()
    starts = (
        rows.groupBy(*s.keys, "_bin")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(_earlier(s.keys)), F.lit(0)))
        .drop("_n")
    )
    local = rows.withColumn("_local", F.row_number().over(s.window(("_bin",))))
    return (
        _join_on(local, starts, [*s.keys, "_bin"])
        .withColumn(name, (F.col("_local") + F.col("_start")).cast("long"))
        .drop("_bin", "_local", "_start")
    )


def with_running(
    s: Series,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums and last non-null values up to and including each row."""
    sums, lasts = sums or {}, lasts or {}
    whole = (Window.unboundedPreceding, Window.currentRow)
    if not s.split:
        frame = s.window().rowsBetween(*whole)
        return s.df.select(
            "*",
            *[F.sum(c).over(frame).alias(n) for n, c in sums.items()],
            *[F.last(c, ignorenulls=True).over(frame).alias(n) for n, c in lasts.items()],
        )
    rows = s.binned()
    at = F.struct(*s.order)
    totals = rows.groupBy(*s.keys, "_bin").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_t_{n}") for n, c in lasts.items()],
    )
    carry = totals.select(
        *s.keys,
        "_bin",
        *[F.sum(f"_t_{n}").over(_earlier(s.keys)).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(_earlier(s.keys)).alias(f"_c_{n}") for n in lasts],
    )
    frame = s.window(("_bin",)).rowsBetween(*whole)
    local = rows.select(
        "*",
        *[F.sum(c).over(frame).alias(f"_l_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(frame).alias(f"_l_{n}") for n, c in lasts.items()],
    )
    joined = _join_on(local, carry, [*s.keys, "_bin"])
    both = {
        n: F.when(
            F.col(f"_c_{n}").isNotNull() | F.col(f"_l_{n}").isNotNull(),
            F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.col(f"_l_{n}"), F.lit(0)),
        )
        for n in sums
    }
    both |= {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in lasts}
    return joined.select(*s.df.columns, *[c.alias(n) for n, c in both.items()])


def with_totals(s: Series, totals: dict[str, Column], extra: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates of each row's key (and ``extra`` columns) beside the row.

    Short series aggregate in a window over the partitioning their other windows
    use; with a long one, totals are pre-aggregated and joined.
    """
    keys = [*s.keys, *extra]
    if not s.split:
        w = Window.partitionBy(*keys)
        return s.df.select("*", *[a.over(w).alias(n) for n, a in totals.items()])
    found = s.df.groupBy(*keys).agg(*[a.alias(n) for n, a in totals.items()])
    return _join_on(s.df, found, keys).select(*s.df.columns, *totals)


def with_frames(
    s: Series, build: Callable[[DataFrame, WindowSpec], DataFrame], before: int, after: int = 0
) -> DataFrame:
    """Apply ``build(rows, window)``, whose frames reach at most ``before``/``after`` rows.

    ``build`` adds columns by window functions over the given window.  ``before``
    and ``after`` count every row a result depends on, through nested frames too.
    """
    if not s.split:
        return build(s.df, s.window())
    size = max(s.max_rows, before, after)
    placed = with_position(s, "_pos")
    offset = F.pmod(F.col("_pos") - 1, F.lit(size))
    home = F.floor((F.col("_pos") - 1) / size).cast("long")
    copies = F.filter(
        F.array(
            home,
            F.when(offset >= size - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        ),
        lambda x: x.isNotNull(),
    )
    spread = placed.withColumn("_home", home).withColumn("_seg", F.explode(copies))
    built = build(spread, s.window(("_seg",)))
    return built.where(F.col("_seg") == F.col("_home")).drop("_seg", "_home", "_pos")
