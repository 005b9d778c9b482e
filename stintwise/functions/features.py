"""Per-lap feature formulas shared by the batch, training and live variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived(
    tyre_age: Column, stint_number: Column, track_temperature: Column, rainfall: Column, sector_delta: Column
) -> dict[str, Column]:
    """Square of tyre age, heat and rain interactions and the size of the pace change."""
    return {
        "tyre_age_sq": (tyre_age * tyre_age).cast("double"),
        "heat_deg_interaction": track_temperature * tyre_age / 100.0,
        "wet_stint": (rainfall * stint_number).cast("double"),
        "abs_sector_delta": F.abs(sector_delta),
    }


def tyre_stress(tyre_age: Column, rolling_delta: Column) -> Column:
    return tyre_age * rolling_delta / 100.0


def known(x: Column) -> Column:
    """A sector time of 0 is a missing one."""
    return F.nullif(x, F.lit(0.0))
