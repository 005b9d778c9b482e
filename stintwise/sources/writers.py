"""Sinks.

Partitioned tables are rebalanced by their folder key first: without it every
task would leave a small file in every folder.  A rebalance, unlike a plain
repartition by key, lets Spark split the partition of a hot key again.

Sinks that add to a table take the ``batch`` they belong to: its rows go to
folders of that batch, which a repeated job replaces instead of doubling them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.session import remove

c = F.col


def _folders(df: DataFrame, *keys: str) -> DataFrame:
    return df.hint("rebalance", *[c(k) for k in keys])


def _added(rows: DataFrame, path: str, kind: str, folders: list[str], batch: str | int | None) -> str:
    if batch is None:
        rows.write.mode("append").format(kind).partitionBy(*folders).save(path)
    else:
        own = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        own.format(kind).partitionBy(*folders, "batch").save(path)
    return path


def write_features(df: DataFrame, path: str) -> str:
    """Feature table, replaced as a whole, one folder per session."""
    _folders(df, "session_key").write.mode("overwrite").partitionBy("session_key").parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_raw_session(documents: DataFrame, path: str, batch: str | int | None = None) -> str:
    return _added(_folders(documents, "year", "session_key"), path, "json", ["year", "session_key"], batch)


def write_inference_log(log: DataFrame, path: str, batch: str | int | None = None) -> str:
    """Cycle documents under their session's folder."""
    return _added(_folders(log, "session_key"), path, "json", ["session_key"], batch)


def write_daily(df: DataFrame, path: str, ts: str = "ts", batch: str | int | None = None) -> str:
    """One folder per day of ``ts``."""
    dated = df.withColumn("dt", F.to_date(ts))
    return _added(_folders(dated, "dt"), path, "parquet", ["dt"], batch)


def feature_store_append(df: DataFrame, path: str, batch: str | int | None = None) -> str:
    """Append records keyed by driver and event time; history is never rewritten."""
    columns = ["driver_number", "event_time", "tyre_age", "stint_number", "gap_to_leader"]
    columns += ["air_temperature", "track_temperature", "rainfall", "sector_delta"]
    whole = {"driver_number", "stint_number", "rainfall"}
    typed = [
        c(n) if n == "event_time" else c(n).cast("bigint" if n in whole else "double").alias(n) for n in columns
    ]
    return _added(df.select(*typed), path, "parquet", [], batch)


def newest_sessions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows that :func:`keep_sessions` last wrote of each session, by batches ``before`` one, or nothing before the first."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return _newest(rows if before is None else rows.where(c("batch") < before)).drop("batch")


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("session_key").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["session_key", "batch"], "left_semi")


def keep_sessions(rows: DataFrame, path: str, batch: int, compact_every: int = 50) -> str:
    """Replace the rows of the sessions present; other sessions keep theirs.

    Each batch has one folder, however many sessions it holds; a repeated batch
    replaces it.  Every ``compact_every``-th holds the newest rows of all
    sessions, and what lies before the last such folder but one is removed.
    """
    spark, own = rows.sparkSession, f"{path}/batch={batch}"
    whole = batch > 0 and batch % compact_every == 0
    earlier = spark.read.parquet(path).where(c("batch") < batch) if whole else None
    if earlier is not None:
        rows = _newest(earlier.unionByName(rows.withColumn("batch", F.lit(batch)))).drop("batch")
    rows.hint("rebalance").write.mode("overwrite").parquet(own)
    if earlier is not None:
        for r in earlier.where(c("batch") < batch - compact_every).select("batch").distinct().collect():  # two generations at most
            remove(spark, f"{path}/batch={r.batch}")
    return path


def save_stint_cache(stints: DataFrame, path: str, batch: int | None = None) -> str:
    """Replace the cached stints of the sessions present; sessions without stints keep theirs.

    With ``batch`` they are kept by :func:`keep_sessions`, else in a folder per session.
    """
    if batch is not None:
        return keep_sessions(stints, path, batch)
    (
        _folders(stints, "session_key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_key")
        .parquet(path)
    )
    return path


def write_records(df: DataFrame, path: str, batch: str | int | None = None) -> str:
    """JSON lines that keep times to the microsecond."""
    times = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    text = {n: F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for n in times}
    return _added(df.withColumns(text) if text else df, path, "json", [], batch)
