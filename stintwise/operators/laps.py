"""Per-lap window features of a driver's race.

Every function takes rows with ``session_key, driver_number, lap_number`` and
returns them with columns added.  The three families (batch, training, live)
define the same feature differently and are kept apart by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from stintwise.functions.features import derived, known, tyre_stress
from stintwise.functions.parsing import compound_flags, rain_flag
from stintwise.operators.series import Series, lap_series, with_frames, with_running

c = F.col


def _framed(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int = 0,
    measured: Series | None = None,
) -> DataFrame:
    return with_frames(measured or lap_series(df), lambda rows, w: rows.withColumns(columns(w)), before, after)


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


# running features -----------------------------------------------------------


def pit_count_so_far() -> Column:
    return F.when(c("did_pit") == 1, 1).otherwise(0)


def tyre_age_etl(df: DataFrame) -> DataFrame:
    """Laps since the last stop up to this lap; 0 in the first stint."""
    rows = with_running(lap_series(df), lasts={"_last_pit": c("pit_lap")})
    return rows.withColumn("tyre_age", F.coalesce(c("lap_number") - c("_last_pit"), F.lit(0))).drop("_last_pit")


def stint_number(df: DataFrame) -> DataFrame:
    rows = with_running(lap_series(df), sums={"_pits": pit_count_so_far()})
    return rows.withColumn("stint_number", (c("_pits") + 1).cast("int")).drop("_pits")


def derive_stints(df: DataFrame) -> DataFrame:
    """Stint table from laps: first and last lap of each; the last stint stays open.

    ``max`` over a driver's stints runs on the aggregated stints, not on laps.
    """
    stints = (
        stint_number(df)
        .groupBy("session_key", "driver_number", "stint_number")
        .agg(F.min("lap_number").alias("lap_start"), F.max("lap_number").alias("_last_lap"))
    )
    newest = stints.groupBy("session_key", "driver_number").agg(F.max("stint_number").alias("_newest"))
    return stints.join(newest, ["session_key", "driver_number"]).select(
        "session_key",
        "driver_number",
        "stint_number",
        "lap_start",
        F.when(c("stint_number") != c("_newest"), c("_last_lap")).alias("lap_end"),
    )


# pace features --------------------------------------------------------------


def prior_mean(x: Column, w: WindowSpec, laps: int) -> Column:
    return F.avg(x).over(w.rowsBetween(-laps, -1))


def sector_delta_etl(df: DataFrame) -> DataFrame:
    """First-sector time against the mean of the three laps before."""
    s1 = c("duration_sector_1")
    return _framed(df, lambda w: {"sector_delta": zero_if_null(s1 - prior_mean(s1, w, 3))}, 3)


def sector_delta_history(df: DataFrame, places: int | None = 3, measured: Series | None = None) -> DataFrame:
    """As above, but only from the fourth lap on and with zero times ignored, to 3 decimals."""
    s1 = known(c("duration_sector_1"))

    def delta(w: WindowSpec) -> dict[str, Column]:
        from_fourth = F.lag("lap_number", 3).over(w).isNotNull()
        x = F.when(from_fourth, zero_if_null(s1 - prior_mean(s1, w, 3))).otherwise(F.lit(0.0))
        return {"sector_delta": x if places is None else F.round(x, places)}

    return _framed(df, delta, 3, measured=measured)


def _live_delta(w: WindowSpec) -> Column:
    s1 = known(c("duration_sector_1"))
    return zero_if_null(s1 - prior_mean(s1, w, 3))


def sector_delta_live(df: DataFrame) -> DataFrame:
    """Evaluated at each lap as if it were the newest: the last four laps count."""
    return _framed(df, lambda w: {"sector_delta": _live_delta(w)}, 3)


def deg_rate(df: DataFrame) -> DataFrame:
    """Lap-over-lap change of ``sector_delta``."""
    return _framed(
        df, lambda w: {"deg_rate": zero_if_null(c("sector_delta") - F.lag("sector_delta", 1).over(w))}, 1
    )


def _live_deg_rate(w: WindowSpec) -> Column:
    """Change against the lap before, whose mean covers the other two laps at most.

    A missing time of the lap before counts as 0, and a mean over no laps is 0.
    The first lap has no lap before.
    """
    s1 = known(c("duration_sector_1"))
    earlier = zero_if_null(F.avg(s1).over(w.rowsBetween(-3, -2)))
    before = F.when(
        F.lag("lap_number", 1).over(w).isNotNull(),
        zero_if_null(F.lag("duration_sector_1", 1).over(w)) - earlier,
    ).otherwise(F.lit(0.0))
    return _live_delta(w) - before


def deg_rate_live(df: DataFrame) -> DataFrame:
    return _framed(df, lambda w: {"deg_rate": _live_deg_rate(w)}, 3)


def gap_trend(df: DataFrame, gap: str = "gap_to_leader") -> DataFrame:
    """Change of the gap over three laps; negative when closing in."""
    return _framed(df, lambda w: {"gap_trend": zero_if_null(c(gap) - F.lag(gap, 3).over(w))}, 3)


def rolling_delta_excl(df: DataFrame) -> DataFrame:
    """Mean size of the pace change over the five laps before this one."""
    return _framed(
        df,
        lambda w: {"rolling_sector_delta_5": zero_if_null(prior_mean(F.abs("sector_delta"), w, 5))},
        5,
    )


def rolling_delta_incl(df: DataFrame) -> DataFrame:
    """Mean over this lap and up to four before it."""
    return _framed(
        df,
        lambda w: {"rolling_sector_delta_5": F.avg(F.abs("sector_delta")).over(w.rowsBetween(-4, 0))},
        4,
    )


def _live_step(w: WindowSpec) -> Column:
    s1 = known(c("duration_sector_1"))
    return F.abs(s1 - F.lag(s1, 1).over(w))


def rolling_delta_live(df: DataFrame) -> DataFrame:
    """Mean lap-to-lap step of the first sector over the newest six laps."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        stepped = rows.withColumn("_step", _live_step(w))
        mean = zero_if_null(F.avg("_step").over(w.rowsBetween(-4, 0)))
        return stepped.withColumn("rolling_sector_delta_5", mean).drop("_step")

    return with_frames(lap_series(df), build, 5)


def pitstop_within_3_laps(df: DataFrame) -> DataFrame:
    """1 when a stop follows within the driver's next three laps."""
    return _framed(
        df,
        lambda w: {
            "pitstop_within_3_laps": F.coalesce(F.max("did_pit").over(w.rowsBetween(1, 3)), F.lit(0)).cast("int")
        },
        0,
        3,
    )


# expression features --------------------------------------------------------


def derived_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        derived(c("tyre_age"), c("stint_number"), c("track_temperature"), c("rainfall"), c("sector_delta"))
    )


def tyre_stress_index(df: DataFrame) -> DataFrame:
    return df.withColumn("tyre_stress_index", tyre_stress(c("tyre_age"), c("rolling_sector_delta_5")))


def compound_one_hot(df: DataFrame) -> DataFrame:
    return df.withColumns(compound_flags(c("tyre_compound")))


def rain_as_number(df: DataFrame) -> DataFrame:
    return df.withColumn("rainfall", rain_flag(c("rainfall")))


# live features --------------------------------------------------------------


def live_pace(df: DataFrame, measured: Series | None = None) -> DataFrame:
    """All live pace features at every lap, from one sort of the laps."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        first = rows.withColumns(
            {"sector_delta": _live_delta(w), "deg_rate": _live_deg_rate(w), "_step": _live_step(w)}
        )
        mean = zero_if_null(F.avg("_step").over(w.rowsBetween(-4, 0)))
        return first.withColumn("rolling_sector_delta_5", mean).drop("_step")

    return with_frames(measured or lap_series(df), build, 5)
