"""State that forgets, waits and alarms: processors for ``transformWithState``.

* :func:`latest_for_a_while` keeps the newest record of a key for a time to live;
* :func:`asof_stream` joins each lap with the newest reading at or before it, of
  two streams, once the watermark says that no earlier record can come;
* :func:`alarm_stream` keeps an alarm per series and emits what it turns to, and
  when; timers close periods in which nothing came.

State stores must keep keys of their own per variable:
``spark.sql.streaming.stateStore.providerClass`` has to name the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from stintwise.operators.alarms import COMPARE, period_start

c = F.col
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """The session with a state store that these processors can use."""
    spark.conf.set(PROVIDER_CONF, PROVIDER)
    return spark


def _values(column: pd.Series, kind: T.DataType) -> list:
    """Pandas values as state values: nulls as None, times as Python's, whole numbers whole."""
    known = column[column.notna()]
    if isinstance(kind, T.IntegralType):
        known = known.astype("int64")
    found = [v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in known.tolist()]
    if len(found) == len(column):
        return found
    rest = iter(found)
    return [next(rest) if there else None for there in column.notna()]


def _rows(part: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    return list(zip(*[_values(part[f.name], f.dataType) for f in schema.fields], strict=True))


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names, dtype=object)


def _utc(time: datetime) -> datetime:
    return time if time.tzinfo else time.replace(tzinfo=UTC)


def _millis(time: datetime) -> int:
    """Milliseconds since 1970, rounded up: a watermark beyond it is beyond the time."""
    return -(-((_utc(time) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)) // 1000)


def _select(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([schema[n] for n in names])


# newest record of a key, for a while ----------------------------------------


class _Latest(StatefulProcessor):
    def __init__(self, schema: T.StructType, time: str, ttl_ms: int):
        self.schema, self.at, self.ttl_ms = schema, schema.names.index(time), ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = best = tuple(self.latest.get()) if self.latest.exists() else None
        for part in rows:
            if part.empty:
                continue
            for row in _rows(part, self.schema):
                if best is None or _utc(row[self.at]) > _utc(best[self.at]):
                    best = row
        if best != before:
            self.latest.update(best)
            self.handle.registerTimer(_millis(best[self.at]) + self.ttl_ms)
            yield _frame([best], self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer of a record that a newer one has replaced says nothing.
        if self.latest.exists() and _millis(self.latest.get()[self.at]) + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def latest_for_a_while(stream: DataFrame, keys: list[str], time: str, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Newest record of each key whenever it changes; a key is forgotten when its record is ``seconds`` old.

    The age is counted by the watermark, ``delay`` behind the newest record of
    all keys, so a replay forgets what the first run forgot.  Records older than
    the one kept change nothing; records without a time, or behind the
    watermark, are passed over.  Update mode.
    """
    timed = stream.where(c(time).isNotNull()).withWatermark(time, delay)
    schema = stream.schema
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Latest(schema, time, seconds * 1000), outputStructType=schema, outputMode="Update", timeMode="EventTime"
    )


# as-of join of two streams ----------------------------------------------------


class _AsOf(StatefulProcessor):
    """Waiting laps and the readings that they, or later ones, may need."""

    def __init__(self, laps: T.StructType, readings: T.StructType, values: list[str], out: T.StructType):
        self.laps_schema, self.readings_schema, self.values, self.out = laps, readings, values, out

    def init(self, handle) -> None:
        self.handle = handle
        self.laps = handle.getListState("laps", self.laps_schema)
        self.readings = handle.getListState("readings", self.readings_schema)
        self.timer = handle.getValueState("timer", "at long")
        self.at = self.laps_schema.names.index("event_time")

    def _wake(self, first_ms: int) -> None:
        """One timer a key: it goes off with the first lap that waits, and all that are due come out with it."""
        if self.timer.exists():
            (set_for,) = self.timer.get()
            if set_for <= first_ms + 1:
                return
            self.handle.deleteTimer(set_for)
        self.timer.update((first_ms + 1,))
        self.handle.registerTimer(first_ms + 1)

    def _closed(self, watermark_ms: int) -> Iterator[pd.DataFrame]:
        waiting = [(_utc(x[self.at]), tuple(x)) for x in self.laps.get()] if self.laps.exists() else []
        timed = [(_millis(t), t, x) for t, x in waiting]
        due = sorted(((t, x) for ms, t, x in timed if ms < watermark_ms), key=lambda x: x[0])
        later = [(ms, x) for ms, _, x in timed if ms >= watermark_ms]
        readings = [tuple(x) for x in self.readings.get()] if self.readings.exists() else []
        readings.sort(key=lambda r: (_utc(r[0]), r[1]))
        times = [_utc(r[0]) for r in readings]
        rows, known = [], 0
        for t, lap in due:
            while known < len(times) and times[known] <= t:
                known += 1
            rows.append((*lap, *(readings[known - 1][2:] if known else (None,) * len(self.values))))
        if due:
            self._put(self.laps, [x for _, x in later])
        if later:
            self._wake(min(ms for ms, _ in later))
        # Of the readings that no lap before the watermark needs any more, only the newest may serve a later one.
        old = sum(_millis(t) < watermark_ms for t in times)
        if old > 1:
            self._put(self.readings, readings[old - 1 :])
        if rows:
            yield _frame(rows, self.out)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if part.empty:
                continue
            is_reading = part["asof_is_reading"].astype(bool)
            readings, laps = part[is_reading], part[~is_reading]
            if len(readings):
                self.readings.appendList(_rows(readings, self.readings_schema))
            if len(laps):
                new = _rows(laps, self.laps_schema)
                self.laps.appendList(new)
                earliest = min(_millis(r[self.at]) for r in new)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        return self._closed(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def asof_stream(laps: DataFrame, readings: DataFrame, key: str, time: str, order: str, values: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each lap with the newest reading at or before its ``event_time``, null before the first; append mode.

    ``readings`` are ordered by ``time``, then ``order``.  A lap comes out when
    the watermark, ``delay`` behind the newest record of either stream, has
    passed it; records behind the watermark are dropped.  Of the readings that
    the watermark has passed only the newest is kept.
    """
    kept = [n for n in laps.columns if n not in values]
    plain = laps.select(*kept)
    lap_schema = plain.schema
    reading = readings.select(key, c(time).alias("event_time"), c(order).cast("long").alias("asof_order"), *[c(v).alias(f"asof_{v}") for v in values])
    both = plain.withColumn("asof_is_reading", F.lit(False)).unionByName(reading.withColumn("asof_is_reading", F.lit(True)), allowMissingColumns=True)
    reading_schema = _select(both.schema, ["event_time", "asof_order", *[f"asof_{v}" for v in values]])
    out = T.StructType([*lap_schema.fields, *[T.StructField(v, readings.schema[v].dataType) for v in values]])
    return (
        both.where(c("event_time").isNotNull())
        .withWatermark("event_time", delay)
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=_AsOf(lap_schema, reading_schema, values, out), outputStructType=out, outputMode="Append", timeMode="EventTime"
        )
    )


# alarms -----------------------------------------------------------------------

_TRANSITION = "period_start timestamp, state string, value double"


class _Alarm(StatefulProcessor):
    """Open periods with what their statistic needs, the last closed period, breaches in a row, and the state."""

    def __init__(self, stat: str, seconds: int, compare: str, threshold: float, periods: int, keys: list[str], out: T.StructType):
        self.stat, self.seconds, self.compare, self.threshold, self.periods = stat, seconds, compare, threshold, periods
        self.keys, self.out = keys, out

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "period long", "total double, n long, low double, high double, held array<double>")
        self.past = handle.getValueState("past", "period long, breaches int, alarm boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if part.empty:
                continue
            for period, values in part.groupby("alarm_period")["metric_value"]:
                period, values = int(period), values.dropna()
                if values.empty:
                    continue
                total, n, low, high, held = self.open.getValue((period,)) if self.open.containsKey((period,)) else (0.0, 0, float("inf"), float("-inf"), [])
                kept = [*held, *values.tolist()] if self.stat.startswith("p") else []
                now = (total + float(values.sum()), n + len(values), min(low, float(values.min())), max(high, float(values.max())), kept)
                self.open.updateValue((period,), now)
                self.handle.registerTimer((period + 1) * self.seconds * 1000)
        return iter(())

    def _value(self, total: float, n: int, low: float, high: float, held: list[float]) -> float:
        if self.stat.startswith("p"):
            return float(pd.Series(list(held)).quantile(float(self.stat[1:]) / 100))
        return {"sum": total, "avg": total / n, "min": low, "max": high}[self.stat]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The period that ends at the timer is closed, with data or without."""
        end = expiredTimerInfo.getExpiryTimeInMs()
        period = end // (self.seconds * 1000) - 1
        last, breaches, alarm = self.past.get() if self.past.exists() else (None, 0, False)
        if last is not None and period <= last:
            return
        names, value = key if isinstance(key, tuple) else (key,), None
        if last is not None and period > last + 1:
            # Time has passed an empty period at once with this one.
            if alarm:
                yield self._turned(names, last + 1, "OK", None)
            breaches, alarm = 0, False
        if self.open.containsKey((period,)):
            value = self._value(*self.open.getValue((period,)))
            self.open.removeKey((period,))
        breaches = min(breaches + 1, self.periods) if value is not None and COMPARE[self.compare](value, self.threshold) else 0
        now = breaches == self.periods
        self.past.update((period, breaches, now))
        if breaches:
            self.handle.registerTimer(end + self.seconds * 1000)  # the next period may be empty
        if now != alarm:
            yield self._turned(names, period, "ALARM" if now else "OK", value)

    def _turned(self, names: tuple, period: int, to: str, value: float | None) -> pd.DataFrame:
        start = datetime.fromtimestamp(period * self.seconds, UTC).replace(tzinfo=None)
        return _frame([(*names, start, to, value)], self.out)

    def close(self) -> None:
        pass


def alarm_stream(
    points: DataFrame, metric: str, stat: str, seconds: int, compare: str, threshold: float, periods: int = 1,
    keys: tuple[str, ...] = ("function_name",), delay: str = "10 minutes",
) -> DataFrame:
    """``keys, period_start, state, value`` whenever an alarm turns to ALARM or back to OK; append mode.

    An alarm is on after ``periods`` calendar periods in a row that have data and
    breach.  It goes off with the first that does not breach or has no data
    (``value`` is null then).  A period closes when the watermark has passed its
    end; points behind the watermark are dropped.  For ``sum``, ``avg``, ``min``
    and ``max`` an open period keeps four numbers, for a percentile its values.
    """
    names = list(keys)
    chosen = points.where((c("metric_name") == metric) & c("ts").isNotNull()).select(*names, "ts", "metric_value")
    numbered = chosen.withWatermark("ts", delay).withColumn("alarm_period", F.floor(F.unix_seconds("ts") / seconds))
    out = T.StructType([*[points.schema[k] for k in names], *T._parse_datatype_string(_TRANSITION).fields])
    return numbered.groupBy(*names).transformWithStateInPandas(
        statefulProcessor=_Alarm(stat, seconds, compare, threshold, periods, names, out), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def transitions(alarms: DataFrame, seconds: int, keys: tuple[str, ...] = ("function_name",)) -> DataFrame:
    """The same of the periods that :func:`stintwise.operators.alarms.threshold_alarm` lists.

    An alarm that is still on in a series' last period ends with the period behind it.
    """
    names = list(keys)
    number = F.floor(F.unix_seconds(c("period_start").cast("timestamp")) / seconds)
    order = Window.partitionBy(*names).orderBy("_period")
    near = alarms.withColumn("_period", number).withColumns(
        {"_before": F.lag("_period").over(order), "_was": F.coalesce(F.lag("alarm").over(order), F.lit(False)), "_next": F.lead("_period").over(order)}
    )
    was = c("_was") & (c("_before") == c("_period") - 1)
    turned = near.where(c("alarm") != was).select(*names, "period_start", F.when(c("alarm"), "ALARM").otherwise("OK").alias("state"), "value")
    gone = near.where(c("alarm") & ((c("_next") != c("_period") + 1) | c("_next").isNull())).select(
        *names, period_start(c("_period") + 1, seconds).alias("period_start"), F.lit("OK").alias("state"), F.lit(None).cast("double").alias("value")
    )
    return turned.unionByName(gone)


