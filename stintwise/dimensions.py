"""The driver grid, team strengths, circuits and tyre strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values, as published for the 2026 season: number, name, team, nationality.
DRIVER_GRID = [
    (1, "Lando Norris", "McLaren", "British"),
    (4, "Oscar Piastri", "McLaren", "Australian"),
    (16, "Charles Leclerc", "Ferrari", "Monegasque"),
    (44, "Lewis Hamilton", "Ferrari", "British"),
    (63, "George Russell", "Mercedes", "British"),
    (12, "Kimi Antonelli", "Mercedes", "Italian"),
    (3, "Max Verstappen", "Red Bull", "Dutch"),
    (6, "Isack Hadjar", "Red Bull", "French"),
    (55, "Carlos Sainz", "Williams", "Spanish"),
    (23, "Alexander Albon", "Williams", "Thai"),
    (14, "Fernando Alonso", "Aston Martin", "Spanish"),
    (18, "Lance Stroll", "Aston Martin", "Canadian"),
    (10, "Pierre Gasly", "Alpine", "French"),
    (43, "Franco Colapinto", "Alpine", "Argentine"),
    (31, "Esteban Ocon", "Haas", "French"),
    (87, "Oliver Bearman", "Haas", "British"),
    (30, "Liam Lawson", "Racing Bulls", "N. Zealander"),
    (41, "Arvid Lindblad", "Racing Bulls", "British"),
    (27, "Nico Hulkenberg", "Audi", "German"),
    (5, "Gabriel Bortoleto", "Audi", "Brazilian"),
    (11, "Sergio Perez", "Cadillac", "Mexican"),
    (77, "Valtteri Bottas", "Cadillac", "Finnish"),
]

# Strength of each team, and of a team not listed.
TEAM_STRENGTH = {
    "McLaren": 0.95,
    "Ferrari": 0.90,
    "Red Bull": 0.88,
    "Mercedes": 0.85,
    "Williams": 0.65,
    "Aston Martin": 0.70,
    "Alpine": 0.60,
    "Haas": 0.55,
    "Racing Bulls": 0.62,
    "Audi": 0.50,
    "Cadillac": 0.45,
}
DEFAULT_STRENGTH = 0.50

# Circuit key of each country (or city, where a country has several).
COUNTRY_CIRCUIT = {
    "Australia": "10",
    "Japan": "46",
    "China": "49",
    "Bahrain": "63",
    "Saudi Arabia": "149",
    "United States": "9",
    "Miami": "151",
    "Las Vegas": "152",
    "Monaco": "22",
    "Spain": "15",
    "Canada": "23",
    "Austria": "19",
    "Great Britain": "2",
    "Hungary": "4",
    "Belgium": "7",
    "Netherlands": "55",
    "Italy": "39",
    "Azerbaijan": "144",
    "Singapore": "61",
    "Mexico": "65",
    "Brazil": "14",
    "Qatar": "150",
    "United Arab Emirates": "70",
}

# Code of each tyre strategy; anything else counts as two stops.
TYRE_STRATEGY_CODE = {
    "SOFT-MEDIUM": 0,
    "SOFT-HARD": 1,
    "MEDIUM-HARD": 2,
    "ONE-STOP": 3,
    "TWO-STOP": 4,
}
DEFAULT_STRATEGY_CODE = 4


def driver_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DRIVER_GRID, "driver_number int, name string, team string, nationality string")


def team_strength(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEAM_STRENGTH.items()), "team string, strength double")


def country_circuit(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COUNTRY_CIRCUIT.items()), "country_name string, circuit_key string")


def lookup(column: Column, mapping: dict, default) -> Column:
    """Value of a small fixed mapping, as one literal map in the expression."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), column), F.lit(default))
