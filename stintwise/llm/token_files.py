"""Token counts of flat token files that have no index.

A file is nothing but token ids end to end, each document closed by an
end-of-document id.  Spark reads it in blocks (splits of
``spark.sql.files.maxPartitionBytes``), cut at the bytes of that id wherever
they stand.  A block does not know where in the file its first piece begins, so
not which of these places are whole tokens: it numbers its places for every
possible alignment at once, by running sums.  A prefix scan over the blocks'
sizes, then over the last boundary and the number of boundaries that each has
for its alignment, stitches the blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stintwise.session import written

_encoders: dict[int, object] = {}


def _encoder(ranks, pattern: str):
    """The tokenizer of this Python worker."""
    import tiktoken

    key = len(ranks.value)
    if key not in _encoders:
        _encoders[key] = tiktoken.Encoding("tokens", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
    return _encoders[key]


def write_token_files(docs: DataFrame, path: str, ranks_path: str, pattern: str, eod: int, dtype: str = "<u2", docs_per_file: int = 20_000) -> None:
    """Writes each text of ``docs(text)`` as token ids, closed by ``eod``, to flat files under ``path``.

    A null text counts as empty.  Files hold the documents of one task in its
    order, ``docs_per_file`` at most; only Spark's writer touches ``path``.
    """
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if eod in set(ranks.values()) or eod > np.iinfo(dtype).max or max(ranks.values()) > np.iinfo(dtype).max:
        raise ValueError(f"{eod} must be free and all ids must fit {dtype}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(start, 256).to_pylist()
                raw = [np.array(encoder.encode_ordinary(t or ""), dtype).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["ids"])

    # The text writer copies bytes as they are; its line separator is the end-of-document id.
    end = np.array([eod], dtype).tobytes().decode("latin-1")
    lines = docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    lines.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", docs_per_file).text(path)


_PLACES = "file string, block long, file_size long, place long, before long, nth long"


def _running(size: int, eod_bytes: int):
    """Each piece's end as a place in its block.

    ``before`` is the end of the piece before it on the same alignment (-1: none
    in the block), ``nth`` how many the block has before it on that alignment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        last, count = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            keys, lengths = (batch.column(k).to_numpy() for k in (2, 4))
            edges = np.flatnonzero(np.diff(keys)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != now:
                    now, at = keys[a], 0
                    last, count = np.full(size, -1, np.int64), np.zeros(size, np.int64)
                ends = at + np.cumsum(lengths[a:b] + eod_bytes)
                place = ends - eod_bytes
                at = int(ends[-1])
                before, nth = np.empty(b - a, np.int64), np.empty(b - a, np.int64)
                for r in range(size):
                    own = np.flatnonzero(place % size == r)
                    if len(own):
                        before[own] = np.append(last[r], place[own[:-1]])
                        nth[own] = count[r] + np.arange(len(own))
                        last[r], count[r] = place[own[-1]], count[r] + len(own)
                part = batch.slice(a, b - a)
                columns = [part.column(0), part.column(1), part.column(3), pa.array(place), pa.array(before), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "file_size", "place", "before", "nth"])

    return run


def _places_in_splits(spark: SparkSession, path: str, end: bytes, size: int) -> DataFrame:
    """The places where ``end`` stands in each split of the files, whole files never being in one task."""
    lines = (
        spark.read.option("lineSep", end.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("key"), F.col("_metadata.file_size").alias("file_size"),
            F.octet_length("value").cast("long").alias("length"),
        )
    )
    return lines.mapInArrow(_running(size, len(end)), _PLACES)


def _places_in_files(spark: SparkSession, path: str, end: bytes, dtype: str) -> DataFrame:
    """The same of whole files, a block each, for ids whose bytes may overlap themselves."""
    size, eod = np.dtype(dtype).itemsize, int(np.frombuffer(end, dtype)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                place = np.flatnonzero(np.frombuffer(raw[: len(raw) // size * size], dtype) == eod) * size
                place = np.append(place, len(raw))  # as a line that ends with the file
                n = len(place)
                columns = [pa.array([file] * n), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, len(raw))),
                           pa.array(place), pa.array(np.append(-1, place[:-1])), pa.array(np.arange(n))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "file_size", "place", "before", "nth"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, _PLACES)


def count_tokens(spark: SparkSession, path: str, eod: int, dtype: str = "<u2") -> DataFrame:
    """``file, nth, start, n_tokens, closed`` of every document in the flat token files under ``path``.

    ``nth`` counts a file's documents from 0, ``start`` is the first token's
    place in the file, ``n_tokens`` is without the closing id.  Tokens behind
    the last boundary are a document that is not ``closed``; empty documents
    count; a file without tokens has none.  Documents do not run over files.
    A file that ends within a token is an error.  Files of any size are cut into
    splits.  Only an id whose bytes begin as they end (0, say) could overlap its
    own neighbours: files with such an id are read whole, as binary files, and
    must be under 2 GB each.
    """
    end = np.array([eod], dtype).tobytes()
    size = len(end)
    overlaps = any(end[:k] == end[-k:] for k in range(1, size))
    found = _places_in_files(spark, path, end, dtype) if overlaps else _places_in_splits(spark, path, end, size)
    places = written(found, "token-places")

    block = ["file", "block"]
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the blocks of a file
    sizes = places.groupBy(*block, "file_size").agg((F.max("place") + size).alias("bytes"))
    starts = sizes.select(*block, "file_size", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("at"))
    partial = F.raise_error(F.concat(F.lit("a file ends within a token: "), "file"))
    starts = starts.withColumn("at", F.when(F.col("file_size") % size == 0, F.col("at")).otherwise(partial))
    # Of the block's places those that are whole tokens, and ids: the last piece of a file may end without one.
    aligned = (F.col("at") + F.col("place")) % size == 0
    is_id = F.col("at") + F.col("place") + size <= F.col("file_size")
    ids = places.join(starts.drop("file_size"), block).filter(aligned & is_id)
    summary = ids.groupBy(*block, "at").agg(F.max("place").alias("last"), F.count("*").alias("n"))
    all_blocks = starts.join(summary.drop("at"), block, "left")
    stitched = all_blocks.select(
        *block,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("nth_from"),
        F.coalesce(F.max(F.col("at") + F.col("last")).over(earlier) + size, F.lit(0)).alias("open_at"),  # where the document that enters began
    )
    begin = F.when(F.col("before") < 0, F.col("open_at")).otherwise(F.col("at") + F.col("before") + size)
    closed = ids.join(stitched, block).select(
        "file", (F.col("nth_from") + F.col("nth")).alias("nth"), (begin / size).cast("long").alias("start"),
        ((F.col("at") + F.col("place") - begin) / size).cast("long").alias("n_tokens"), F.lit(True).alias("closed"),
    )
    whole = all_blocks.groupBy("file", "file_size").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("nth"), F.coalesce(F.max(F.col("at") + F.col("last")) + size, F.lit(0)).alias("begin")
    )
    left = whole.filter(F.col("begin") < F.col("file_size")).select(
        "file", "nth", (F.col("begin") / size).cast("long").alias("start"),
        ((F.col("file_size") - F.col("begin")) / size).cast("long").alias("n_tokens"), F.lit(False).alias("closed"),
    )
    return closed.unionByName(left)
