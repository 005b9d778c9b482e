"""A bit filter of fixed size: a membership test that may err towards yes, never towards no."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def bit_table(df: DataFrame, hashed: str, bits: int = BITS) -> DataFrame:
    """The filter as a table ``word, bits`` of ``2**bits / 64`` rows at most."""
    place = F.shiftrightunsigned(F.col(hashed), 64 - bits)
    packed = (
        df.filter(F.col(hashed).isNotNull())
        .select(place.alias("place"))
        .selectExpr("shiftright(place, 6) AS word", "shiftleft(1L, cast(place & 63 AS int)) AS bit")
    )
    return packed.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def bit_filter(df: DataFrame, hashed: str, bits: int = BITS) -> np.ndarray:
    """``2**bits`` bits, each set if the top bits of a 64-bit hash in column ``hashed`` point at it.

    What reaches the driver is ``2**bits / 64`` rows at most, whatever the table's size.
    """
    found = bit_table(df, hashed, bits).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def with_flag(df: DataFrame, table: DataFrame, hashed: str, name: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``name``: whether its hash may be among those that ``table``, a :func:`bit_table`, was made of.

    The table has a fixed most size, so it is broadcast; no row of ``df`` moves.
    """
    place = F.shiftrightunsigned(F.col(hashed), 64 - bits)
    marked = df.withColumn("__place", place).withColumn("__word", F.shiftright("__place", 6))
    known = marked.join(F.broadcast(table.withColumnsRenamed({"word": "__word", "bits": "__bits"})), "__word", "left")
    bit = F.expr("coalesce(shiftright(__bits, cast(__place & 63 AS int)) & 1, 0) = 1")
    return known.withColumn(name, bit).drop("__word", "__bits", "__place")


def may_hold(filter_bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be among those the filter was made of."""
    bits = len(filter_bits).bit_length() + 5
    place = hashed.view(np.uint64) >> np.uint64(64 - bits)
    word = filter_bits.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)]
    return (word >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
