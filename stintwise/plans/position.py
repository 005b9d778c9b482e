"""Race-result feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

COLUMNS = {
    "session_key": "bigint",
    "driver_number": "int",
    "grid_position": "double",
    "qualifying_delta_to_pole": "double",
    "pit_count": "int",
    "avg_stint_length": "double",
    "circuit_type": "string",
    "team": "string",
    "tyre_strategy": "string",
    "weather_impact_score": "double",
    "final_position": "int",
}


def build_position_features(results: DataFrame) -> DataFrame:
    """Typed columns of the finishers; a missing column is an error the caller may skip the table on."""
    typed = results.selectExpr(*[f"CAST({name} AS {kind}) AS {name}" for name, kind in COLUMNS.items()])
    return typed.where("final_position IS NOT NULL")
