"""Scores, bands and shares as native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALERT_ABOVE = 0.85
PIT_ABOVE = 0.70
TAG_FROM = 0.70


@dataclass(frozen=True)
class StackParams:
    """Scaler and logistic weights over two base-model probabilities."""

    mean: tuple[float, float] = (0.5, 0.4)
    scale: tuple[float, float] = (0.29, 0.3)
    coef: tuple[float, float] = (0.9, 0.4)
    intercept: float = -0.2


def stack_probability(first: Column, second: Column, params: StackParams) -> Column:
    logit = F.lit(params.intercept)
    for p, mean, scale, coef in zip((first, second), params.mean, params.scale, params.coef, strict=True):
        logit = logit + F.lit(coef) * (p - F.lit(mean)) / F.lit(scale)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def confidence(probability: Column) -> Column:
    """Distance from a coin toss, scaled to 0..1."""
    return F.abs(probability - 0.5) * 2


def recommendation(probability: Column) -> Column:
    return F.when(probability > PIT_ABOVE, "PIT").otherwise("STAY")


def risk_band(probability: Column) -> Column:
    return F.when(probability >= 0.70, "HIGH").when(probability >= 0.40, "MEDIUM").otherwise("LOW")


def ui_band(probability: Column) -> Column:
    percent = F.floor(probability * 100 + 0.5)
    return F.when(percent >= 70, "pit_soon").when(percent >= 45, "watch").otherwise("safe")


def pit_alert_tag(probability: Column) -> Column:
    """Null where no tag applies; here the threshold itself counts."""
    return F.when(probability >= TAG_FROM, "pit_alert")


def lap_fraction(lap: Column, total: Column) -> Column:
    return lap / F.coalesce(total, F.lit(57)).cast("double")


def field_compression(gap: Column) -> Column:
    return 1.0 / (F.coalesce(gap, F.lit(20.0)) + 1)
