"""Removing listed rows from a table of documents without moving the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.bits import bit_table, with_flag
from stintwise.session import written

NO_ID = (1 << 63) - 1


def record(text: Column | str = "text") -> Column:
    """What tells rows of one ``doc_id`` apart: a hash of the text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def sample_rows(df: DataFrame, draw: Column, most: int) -> DataFrame:
    """All rows if there are ``most`` at most, else those with the smallest draws: ``most`` give or take its square root.

    ``draw`` is a 64-bit hash of the row, so a task run again draws the same.
    No rows are ordered, and none move.
    """
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.shiftrightunsigned(draw, 11) < F.lit(int(most / n * (1 << 53))))


def _keyed(df: DataFrame, record_column: Column) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    keyed = df.withColumns({"__doc": doc, "__record": record_column})
    return keyed.withColumn("__key", F.xxhash64("__doc", "__record"))


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` and ``record`` are in ``gone``, and those of ``once`` only once.

    A bit filter tells apart the rows that are certainly in neither table: they
    stay where they are, and only the others are shuffled for the exact join.
    Null ids match null ids; an empty ``gone`` changes nothing.
    """
    keys = [_keyed(x.select("doc_id", "record"), F.col("record")).select("__doc", "__record", "__key") for x in (gone, once) if x is not None]
    listed = keys[0] if once is None else keys[0].unionByName(keys[1])
    marked = with_flag(_keyed(docs, record()), written(bit_table(listed, "__key"), "listed-bits"), "__key", "__listed")
    rest = marked.filter("__listed").join(keys[0].select("__doc", "__record"), ["__doc", "__record"], "left_anti")
    if once is not None:
        rest = rest.dropDuplicates(["__doc", "__record"])
    return marked.filter("NOT __listed").select(*docs.columns).unionByName(rest.select(*docs.columns))
