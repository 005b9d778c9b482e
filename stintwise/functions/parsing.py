"""Text and value parsing as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_gap(gap: Column) -> Column:
    """Seconds behind the leader; null and text such as ``+1 LAP`` count as 0."""
    return F.coalesce(F.replace(gap.cast("string"), F.lit("+"), F.lit("")).try_cast("double"), F.lit(0.0))


def parse_gap_or_null(gap: Column) -> Column:
    return F.replace(gap.cast("string"), F.lit("+"), F.lit("")).try_cast("double")


def rain_flag(rainfall: Column) -> Column:
    return F.when(rainfall, 1).otherwise(0)


def drs_active(drs: Column) -> Column:
    """Codes from 10 on mean that the flap is open; a missing sample is closed."""
    return F.coalesce(drs, F.lit(0)) >= 10


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to a UTC wall-clock timestamp."""
    zoned = F.when(text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.to_utc_timestamp(F.try_to_timestamp(zoned), F.current_timezone()).cast("timestamp_ntz")


def as_percent(share: Column) -> Column:
    return F.coalesce(share, F.lit(0.0)) * 100


def compound_flags(compound: Column) -> dict[str, Column]:
    """One-hot flags of the three dry compounds, whatever the case."""
    name = F.upper(F.coalesce(compound, F.lit("UNKNOWN")))
    return {
        f"compound_{kind.lower()}": F.when(name == kind, 1).otherwise(0) for kind in ("SOFT", "MEDIUM", "HARD")
    }
