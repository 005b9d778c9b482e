"""Queries of the per-lap window features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.catalog.registry import query
from stintwise.catalog.tables import Tables
from stintwise.functions.parsing import parse_gap_or_null, rain_flag
from stintwise.operators import laps as L
from stintwise.plans import pitstop

c = F.col
KEY = ["session_key", "driver_number", "lap_number"]
W = "PARTITION BY session_key, driver_number ORDER BY lap_number"


def _pick(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*KEY, *names)


@query(
    f"""SELECT session_key, driver_number, lap_number,
    COALESCE(lap_number - MAX(pit_lap) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS tyre_age FROM f_laps"""
)
def tyre_age_etl(t: Tables) -> DataFrame:
    return _pick(L.tyre_age_etl(t.laps), "tyre_age")


@query(
    f"""SELECT session_key, driver_number, lap_number,
    CAST(1 + SUM(did_pit) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS stint_number FROM f_laps"""
)
def stint_number(t: Tables) -> DataFrame:
    return _pick(L.stint_number(t.laps), "stint_number")


@query("SELECT session_key, driver_number, stint_number, lap_start, lap_end FROM f_stints")
def derive_stints(t: Tables) -> DataFrame:
    return L.derive_stints(t.laps)


@query(
    f"""SELECT session_key, driver_number, lap_number, COALESCE(duration_sector_1
    - AVG(duration_sector_1) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS sector_delta FROM f_laps""",
    digits="sector_delta",
)
def sector_delta_etl(t: Tables) -> DataFrame:
    return _pick(L.sector_delta_etl(t.laps), "sector_delta")


@query(
    f"""SELECT session_key, driver_number, lap_number, CASE WHEN ROW_NUMBER() OVER ({W}) > 3 THEN
    COALESCE(NULLIF(duration_sector_1, 0) - AVG(NULLIF(duration_sector_1, 0)) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
    ELSE 0 END AS sector_delta FROM f_laps""",
    digits="sector_delta",
)
def sector_delta_history(t: Tables) -> DataFrame:
    """Compared before the last rounding to 3 decimals, where engines differ on exact halves."""
    return _pick(L.sector_delta_history(t.laps, places=None), "sector_delta")


@query(
    f"""SELECT session_key, driver_number, lap_number, COALESCE(NULLIF(duration_sector_1, 0)
    - AVG(NULLIF(duration_sector_1, 0)) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS sector_delta FROM f_laps""",
    digits="sector_delta",
)
def sector_delta_live(t: Tables) -> DataFrame:
    return _pick(L.sector_delta_live(t.laps), "sector_delta")


@query(
    f"""SELECT session_key, driver_number, lap_number, COALESCE(MAX(did_pit) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0)
    AS pitstop_within_3_laps FROM f_laps"""
)
def pitstop_within_3_laps(t: Tables) -> DataFrame:
    return _pick(L.pitstop_within_3_laps(t.laps), "pitstop_within_3_laps")


@query(
    """SELECT session_key, driver_number, lap_number, CAST(age * age AS DOUBLE) AS tyre_age_sq,
    track_temperature * age / 100 AS heat_deg_interaction, CAST(CASE WHEN rainfall THEN 1 + age % 3 ELSE 0 END AS DOUBLE) AS wet_stint,
    ABS(delta) AS abs_sector_delta
    FROM (SELECT *, lap_number % 40 AS age, lap_duration - 95 AS delta FROM f_laps) x""",
    digits="heat_deg_interaction abs_sector_delta",
)
def derived_features(t: Tables) -> DataFrame:
    rows = t.laps.select(
        *KEY,
        (c("lap_number") % 40).alias("tyre_age"),
        (1 + (c("lap_number") % 40) % 3).alias("stint_number"),
        "track_temperature",
        rain_flag(c("rainfall")).alias("rainfall"),
        (c("lap_duration") - 95).alias("sector_delta"),
    )
    return _pick(
        L.derived_features(rows), "tyre_age_sq", "heat_deg_interaction", "wet_stint", "abs_sector_delta"
    )


def _delta_rows(t: Tables) -> DataFrame:
    return t.laps.withColumn("sector_delta", c("lap_duration") - 95)


@query(
    f"""SELECT session_key, driver_number, lap_number, COALESCE((lap_duration - 95) - LAG(lap_duration - 95) OVER ({W}), 0) AS deg_rate FROM f_laps""",
    digits="deg_rate",
)
def deg_rate(t: Tables) -> DataFrame:
    return _pick(L.deg_rate(_delta_rows(t)), "deg_rate")


@query(
    f"""SELECT session_key, driver_number, lap_number,
    COALESCE(s - AVG(s) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
    - CASE WHEN ROW_NUMBER() OVER ({W}) = 1 THEN 0 ELSE COALESCE(LAG(duration_sector_1) OVER ({W}), 0)
      - COALESCE(AVG(s) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 2 PRECEDING), 0) END AS deg_rate
    FROM (SELECT *, NULLIF(duration_sector_1, 0) AS s FROM f_laps) x""",
    digits="deg_rate",
)
def deg_rate_live(t: Tables) -> DataFrame:
    return _pick(L.deg_rate_live(t.laps), "deg_rate")


@query(
    f"""SELECT session_key, driver_number, lap_number, COALESCE(g - LAG(g, 3) OVER ({W}), 0) AS gap_trend
    FROM (SELECT *, TRY_CAST(replace(gap_raw, '+', '') AS DOUBLE) AS g FROM f_laps) x""",
    digits="gap_trend",
)
def gap_trend(t: Tables) -> DataFrame:
    return _pick(L.gap_trend(t.laps.withColumn("gap_to_leader", parse_gap_or_null(c("gap_raw")))), "gap_trend")


@query(
    f"""SELECT session_key, driver_number, lap_number,
    COALESCE(AVG(ABS(lap_duration - 95)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS rolling_sector_delta_5 FROM f_laps""",
    digits="rolling_sector_delta_5",
)
def rolling_delta_excl(t: Tables) -> DataFrame:
    return _pick(L.rolling_delta_excl(_delta_rows(t)), "rolling_sector_delta_5")


@query(
    f"""SELECT session_key, driver_number, lap_number,
    AVG(ABS(lap_duration - 95)) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_sector_delta_5 FROM f_laps""",
    digits="rolling_sector_delta_5",
)
def rolling_delta_incl(t: Tables) -> DataFrame:
    return _pick(L.rolling_delta_incl(_delta_rows(t)), "rolling_sector_delta_5")


@query(
    f"""SELECT session_key, driver_number, lap_number,
    COALESCE(AVG(step) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS rolling_sector_delta_5
    FROM (SELECT *, ABS(NULLIF(duration_sector_1, 0) - LAG(NULLIF(duration_sector_1, 0)) OVER ({W})) AS step FROM f_laps) x""",
    digits="rolling_sector_delta_5",
)
def rolling_delta_live(t: Tables) -> DataFrame:
    return _pick(L.rolling_delta_live(t.laps), "rolling_sector_delta_5")


@query(
    """SELECT session_key, driver_number, lap_number, (lap_number % 40) * (lap_duration - 90) / 100 AS tyre_stress_index FROM f_laps""",
    digits="tyre_stress_index",
)
def tyre_stress(t: Tables) -> DataFrame:
    rows = t.laps.withColumns(
        {"tyre_age": c("lap_number") % 40, "rolling_sector_delta_5": c("lap_duration") - 90}
    )
    return _pick(L.tyre_stress_index(rows), "tyre_stress_index")


@query(
    """SELECT session_key, driver_number, stint_number, CASE WHEN upper(compound) = 'SOFT' THEN 1 ELSE 0 END AS compound_soft,
    CASE WHEN upper(compound) = 'MEDIUM' THEN 1 ELSE 0 END AS compound_medium,
    CASE WHEN upper(compound) = 'HARD' THEN 1 ELSE 0 END AS compound_hard FROM f_stints"""
)
def compound_one_hot(t: Tables) -> DataFrame:
    stints = t.stints.withColumnRenamed("compound", "tyre_compound")
    return L.compound_one_hot(stints).select(
        "session_key", "driver_number", "stint_number", "compound_soft", "compound_medium", "compound_hard"
    )


F16_SQL = f"""SELECT session_key, driver_number, lap_number, tyre_age, stint_number, gap_to_leader, air_temperature, track_temperature, rainfall,
    sector_delta, CAST(tyre_age * tyre_age AS DOUBLE) AS tyre_age_sq, track_temperature * tyre_age / 100 AS heat_deg_interaction,
    CAST(rainfall * stint_number AS DOUBLE) AS wet_stint, ABS(sector_delta) AS abs_sector_delta,
    COALESCE(sector_delta - prev_delta, 0) AS deg_rate, gap_trend, roll AS rolling_sector_delta_5, tyre_age * roll / 100 AS tyre_stress_index,
    CASE WHEN upper(tyre_compound) = 'SOFT' THEN 1 ELSE 0 END AS compound_soft,
    CASE WHEN upper(tyre_compound) = 'MEDIUM' THEN 1 ELSE 0 END AS compound_medium,
    CASE WHEN upper(tyre_compound) = 'HARD' THEN 1 ELSE 0 END AS compound_hard, pitstop_within_3_laps, tyre_compound, event_time
    FROM (SELECT *, LAG(sector_delta) OVER ({W}) AS prev_delta,
            COALESCE(AVG(ABS(sector_delta)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS roll
      FROM (SELECT session_key, driver_number, lap_number, event_time, tyre_compound, gap_to_leader, air_temperature, track_temperature,
              CASE WHEN rainfall THEN 1 ELSE 0 END AS rainfall,
              COALESCE(lap_number - MAX(pit_lap) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS tyre_age,
              CAST(1 + SUM(did_pit) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS stint_number,
              COALESCE(duration_sector_1 - AVG(duration_sector_1) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS sector_delta,
              COALESCE(gap_to_leader - LAG(gap_to_leader, 3) OVER ({W}), 0) AS gap_trend,
              COALESCE(MAX(did_pit) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS pitstop_within_3_laps
            FROM (SELECT * REPLACE (TRY_CAST(replace(gap_to_leader, '+', '') AS DOUBLE) AS gap_to_leader) FROM f_raw) r) a) b"""


@query(
    F16_SQL,
    digits="sector_delta heat_deg_interaction abs_sector_delta deg_rate gap_trend rolling_sector_delta_5 tyre_stress_index",
)
def build_pitstop_features(t: Tables) -> DataFrame:
    return pitstop.build_pitstop_features(t.raw_laps)


@query(
    F16_SQL,
    digits="sector_delta heat_deg_interaction abs_sector_delta deg_rate gap_trend rolling_sector_delta_5 tyre_stress_index",
)
def project_pitstop_features(t: Tables) -> DataFrame:
    """The 24 columns of the feature table from a wider frame."""
    wider = pitstop.build_pitstop_features(t.raw_laps).withColumn("further", F.lit(1))
    return pitstop.project_pitstop_features(wider)


@query(
    f"""SELECT session_key, driver_number, lap_number, COALESCE(d - LAG(d) OVER ({W}), 0) AS deg_rate,
    COALESCE(g - LAG(g, 3) OVER ({W}), 0) AS gap_trend, AVG(ABS(d)) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling_sector_delta_5,
    age * AVG(ABS(d)) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 100 AS tyre_stress_index,
    CAST(age * age AS DOUBLE) AS tyre_age_sq, track_temperature * age / 100 AS heat_deg_interaction,
    CASE WHEN upper(tyre_compound) = 'SOFT' THEN 1 ELSE 0 END AS compound_soft,
    CASE WHEN upper(tyre_compound) = 'MEDIUM' THEN 1 ELSE 0 END AS compound_medium,
    CASE WHEN upper(tyre_compound) = 'HARD' THEN 1 ELSE 0 END AS compound_hard
    FROM (SELECT *, lap_number % 40 AS age, lap_duration - 95 AS d, COALESCE(TRY_CAST(replace(gap_to_leader, '+', '') AS DOUBLE), 0) AS g FROM f_raw) x""",
    digits="deg_rate gap_trend rolling_sector_delta_5 tyre_stress_index heat_deg_interaction",
)
def engineer_features(t: Tables) -> DataFrame:
    rows = t.raw_laps.select(
        *KEY,
        (c("lap_number") % 40).alias("tyre_age"),
        (c("lap_number") % 3 + 1).alias("stint_number"),
        F.coalesce(parse_gap_or_null(c("gap_to_leader")), F.lit(0.0)).alias("gap_to_leader"),
        "track_temperature",
        rain_flag(c("rainfall")).alias("rainfall"),
        (c("lap_duration") - 95).alias("sector_delta"),
        "tyre_compound",
    )
    return _pick(
        pitstop.engineer_features(rows),
        "deg_rate",
        "gap_trend",
        "rolling_sector_delta_5",
        "tyre_stress_index",
        "tyre_age_sq",
        "heat_deg_interaction",
        "compound_soft",
        "compound_medium",
        "compound_hard",
    )
