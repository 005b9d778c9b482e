"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by a hash of their text, so that equal texts are
neighbours, and the order is cut where the running size crosses each shard's
share.  The order is never produced in one place:

1. a size-weighted sample of keys gives quantile splitters, hence key ranges of
   about equal size;
2. ranges beyond ``rows_per_task`` records are subdivided by key; a key that
   alone holds more than ``tolerance`` of a shard, or more than
   ``rows_per_task`` records, is a range of its own, subdivided by ``doc_id``;
3. sizes are summed within each range, and only the range totals are summed
   over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.session import written

DRAWS_PER_RANGE = 100


def _unit(*columns: str) -> Column:
    """A draw in [0, 1) that depends on the row alone, so that a task run again draws the same."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of keys, drawn with a chance in proportion to size: ``ranges - 1`` at most."""
    drawn = rows.filter(_unit("key", "doc_id") < F.col("size") * (ranges * DRAWS_PER_RANGE / total))
    found = drawn.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("at")).first()
    return sorted(set(found["at"] or []))


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    ranges_per_shard: int = 16,
    rows_per_task: int = 1_000_000,
    tolerance: float = 0.01,
) -> DataFrame:
    """A row per document: ``doc_id, size, text_crc32, shard, slot``; shards hold nearly equal bytes.

    ``size`` is the text's bytes in UTF-8 plus 1; a null text counts as empty.
    A record belongs to the shard in which its middle byte falls, so a shard is
    off its share by half a record at either end.  Equal texts share a shard
    unless together they exceed ``tolerance`` of a shard: then they are cut as
    any other records.  ``slot`` numbers a shard's records from 0 without gaps.
    Repeated rows are records of their own; a null ``doc_id`` sorts first; an
    empty table gives no rows; further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    splitters = _splitters(rows, total, shards * ranges_per_shard)

    limit = total * tolerance / shards
    hot = (
        rows.groupBy("key")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("copies"))
        .filter(((F.col("bytes") > limit) & (F.col("copies") > 1)) | (F.col("copies") > rows_per_task))
        # Copies that fill less than `limit` stay together, however many they are.
        .select("key", F.lit(True).alias("hot"), (F.col("bytes") <= limit).alias("together"))
    )
    # A hot key holds over `limit` bytes or `rows_per_task` records: there are shards / tolerance + rows / rows_per_task of them at most.
    marked = rows.join(F.broadcast(hot), "key", "left").withColumns(
        {"hot": F.coalesce("hot", F.lit(False)), "together": F.coalesce("together", F.lit(True))}
    )
    at = F.array(*[F.lit(x) for x in splitters]) if splitters else F.array().cast("array<long>")
    ranged = marked.withColumns(
        {"range": F.size(F.filter(at, lambda x: x <= F.col("key"))), "own": F.when(F.col("hot"), F.col("key"))}
    )

    span = ["range", "hot", "own"]
    counts = ranged.groupBy(*span).agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
    # A row for each range, and for each hot key.
    cut = counts.withColumn("parts", F.ceil(F.col("rows") / rows_per_task)).drop("rows")
    width = F.col("high").cast("double") - F.col("low") + 1
    place = F.when(F.col("hot"), _unit("doc_id")).otherwise((F.col("key").cast("double") - F.col("low")) / width)
    cut = cut.withColumnsRenamed({"range": "in_range", "hot": "is_hot", "own": "of_key"})
    same = (F.col("range") == F.col("in_range")) & (F.col("hot") == F.col("is_hot")) & F.col("own").eqNullSafe(F.col("of_key"))
    cells = ranged.join(F.broadcast(cut), same).withColumn("part", F.least(F.floor(place * F.col("parts")), F.col("parts") - 1))

    cell = [*span, "part"]
    order = Window.partitionBy(*cell).orderBy("key", "doc_id")
    within = cells.select(
        "doc_id", "size", "text_crc32", "key", "together", *cell,
        (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"),
        (F.row_number().over(order) - 1).cast("long").alias("nth"),
    )
    copies = Window.partitionBy(*cell, "key")
    middle_of_key = F.min("before").over(copies) + F.sum("size").over(copies) / 2
    totals = cells.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *cell,
        "bytes",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_at"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_at"),
    )
    # The parts of a hot key follow each other: its middle comes from their totals.
    parts = Window.partitionBy(*span)
    offsets = offsets.withColumn("key_middle", F.min("bytes_at").over(parts) + F.sum("bytes").over(parts) / 2)
    offsets = offsets.drop("bytes").withColumnsRenamed({"own": "of_key"})
    same = [F.col(f"w.{n}") == F.col(f"o.{n}") for n in ("range", "hot", "part")]
    joined = within.withColumn("middle", middle_of_key).alias("w").join(offsets.alias("o"), [*same, F.col("own").eqNullSafe(F.col("of_key"))])
    middle = (
        F.when(F.col("w.hot") & F.col("together"), F.col("key_middle"))
        .when(F.col("w.hot"), F.col("bytes_at") + F.col("before") + F.col("size") / 2)
        .otherwise(F.col("bytes_at") + F.col("middle"))
    )
    placed = written(
        joined.select(
            "doc_id", "size", "text_crc32", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int").alias("shard"),
            (F.col("rows_at") + F.col("nth")).alias("nth"),
        ),
        "shard-placed",
    )
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot")
    )
