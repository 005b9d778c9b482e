"""Scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise import schemas
from stintwise.operators.snapshots import features_as_of
from stintwise.plans.serving import explode_log

c = F.col


def scan_raw_laps(spark: SparkSession, path: str) -> DataFrame:
    """Raw laps of all files a glob names."""
    return spark.read.schema(schemas.RAW_LAPS).parquet(path)


def read_session_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw session documents; a broken one is kept as text in ``_corrupt_record``.

    ``multi_line`` is for files that hold one indented document each; such a file is one task's work.
    """
    return (
        spark.read.schema(schemas.SESSION_DOCUMENT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("multiLine", multi_line)
        .json(path)
    )


def flatten_session(documents: DataFrame, table: str) -> DataFrame:
    """Rows of one table of the documents: per driver (laps, stints, intervals, position, pit) or per session."""
    if table in ("weather", "race_control"):
        return documents.select("session_key", F.inline(table))
    per_driver = documents.select("session_key", F.explode("drivers").alias("number", "_d"))
    return per_driver.select(
        "session_key", c("number").cast("int").alias("driver_number"), F.inline(c(f"_d.{table}"))
    )


def drop_drivers_without_laps(documents: DataFrame) -> DataFrame:
    """Documents whose driver map holds only drivers with laps."""
    kept = F.map_filter("drivers", lambda _, d: F.coalesce(F.size(d["laps"]), F.lit(0)) > 0)
    return documents.withColumn("drivers", kept)


def load_training(spark: SparkSession, folder: str, schema: str = schemas.TRAINING_ROWS) -> DataFrame:
    """All CSV and Parquet files of a folder as one frame."""
    columnar = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    text = (
        spark.read.schema(schema)
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", True)
        .option("header", True)
        .option("enforceSchema", False)
    )
    return columnar.parquet(folder).unionByName(text.csv(folder), allowMissingColumns=True)


def read_inference_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per prediction of the logged cycles.  Only the fields used are parsed from the documents."""
    log = spark.read.schema(schemas.INFERENCE_LOG).json(path)
    return explode_log(log, ["session_key", "country_name", "timestamp", "commentary"])


def read_training_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records of all models and pipelines; metrics a model lacks are null."""
    return spark.read.schema(schemas.TRAINING_RUN).option("recursiveFileLookup", True).json(path)


def read_function_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with the file they came from."""
    return spark.read.text(path).select(c("value").alias("message"), c("_metadata.file_path").alias("source"))


def read_metric_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRIC_POINT).json(path)


def read_features_as_of(spark: SparkSession, path: str, at: Column | None = None) -> DataFrame:
    """Newest stored features of each driver, or the newest by a given time."""
    rows = spark.read.schema(schemas.RACE_FEATURES).parquet(path)
    return features_as_of(rows, ["driver_number"], at)


def load_stint_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
