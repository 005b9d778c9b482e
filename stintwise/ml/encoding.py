"""Encoding of categories and defaults for the position and safety-car models."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.dimensions import DEFAULT_STRATEGY_CODE, DEFAULT_STRENGTH, TEAM_STRENGTH, TYRE_STRATEGY_CODE, lookup
from stintwise.functions.scoring import field_compression, lap_fraction
from stintwise.operators.quality import default_columns, fill_features
from stintwise.schemas import POSITION_FEATURES, SAFETY_CAR_FEATURES

c = F.col


def label_encode(df: DataFrame, column: str, output: str) -> DataFrame:
    """Alphabetical index of each category."""
    indexer = StringIndexer(
        inputCol=column, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    encoded = indexer.fit(df.select(column)).transform(df)
    return encoded.withColumn(output, c(output).cast("int"))


def encode_tyre_strategy(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "tyre_strategy_encoded", lookup(c("tyre_strategy"), TYRE_STRATEGY_CODE, DEFAULT_STRATEGY_CODE)
    )


def encode_position_features(df: DataFrame) -> DataFrame:
    """The 12 inputs of the position model; live values default where they are not recorded."""
    known = default_columns(df, {"circuit_type": "street", "tyre_strategy": "TWO-STOP", "team": "McLaren"})
    coded = encode_tyre_strategy(label_encode(known, "circuit_type", "circuit_type_encoded")).withColumn(
        "team_performance_score", lookup(c("team"), TEAM_STRENGTH, DEFAULT_STRENGTH)
    )
    if "current_position" not in df.columns:
        position = c("grid_position") if "grid_position" in df.columns else F.lit(10.0)
        coded = coded.withColumn("current_position", position)
    coded = default_columns(coded, {"gap_to_leader": 0, "lap_fraction": 0.5, "safety_car_active": 0})
    full = default_columns(coded, dict.fromkeys(POSITION_FEATURES, 0))
    return fill_features(full, POSITION_FEATURES)


def encode_safety_car_features(df: DataFrame) -> DataFrame:
    """The 9 inputs of the safety-car model; an unknown gap variance counts as 0."""
    known = default_columns(df, {"circuit_id": "shanghai", "total_laps": 57, "gap_variance": 0.0})
    coded = label_encode(known, "circuit_id", "circuit_id_encoded").withColumn(
        "lap_fraction", lap_fraction(c("lap_number"), c("total_laps"))
    )
    if "field_compression_score" not in df.columns:
        gap = c("gap_to_leader") if "gap_to_leader" in df.columns else F.lit(None).cast("double")
        coded = coded.withColumn("field_compression_score", field_compression(gap))
    full = default_columns(coded, dict.fromkeys(SAFETY_CAR_FEATURES, 0))
    return fill_features(full, SAFETY_CAR_FEATURES)
