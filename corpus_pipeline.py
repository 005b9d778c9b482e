"""The corpus pipeline: toxic documents, repeated lines, near duplicates and benchmark leaks go, the rest is encoded.

Each stage works on the table that the one before wrote and, but for the last,
returns the columns of its input.  Rows without a ``doc_id`` pass; rows that
share ``doc_id`` and text are one document.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.llm.leaks import decontaminate
from stintwise.llm.line_dedup import dedup_lines
from stintwise.llm.near_dup import near_duplicates
from stintwise.llm.pieces import encode_decode
from stintwise.llm.queries import PIECE_MODEL
from stintwise.llm.rows import without
from stintwise.llm.toxicity import score, train_on_labels
from stintwise.session import remove, shared_dir, writing_to, written

TOXIC_FROM = 0.3
SIMILAR_PERCENT = 80
#: Bytes of the batches that pass between Spark and Python.  Spark's own bound is 64 MB: a task's texts are then one batch,
#: which the executor and the worker hold at the same time, each beside its copies.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC_FROM`` by a model of the labelled ones."""
    machine = train_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, machine, docs.columns, "toxicity").filter(F.col("toxicity") < TOXIC_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; ``n_chars`` follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = dedup_lines(docs, carry=others)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    found = written(near_duplicates(docs, SIMILAR_PERCENT), "pipeline-near")
    again = found.filter("doc_id IS NOT NULL").groupBy("doc_id", "record").count().filter("count > 1")
    return without(docs, found.filter("NOT kept"), once=again)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither word by word nor with other numbers and names."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, written(found.filter("contaminated").select("doc_id", "record"), "pipeline-leaks"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, intact``: the piece ids of each text, and whether they decode to it."""
    coded = encode_decode(docs, public_tokenizers.path(PIECE_MODEL), keep_text=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("intact")
    )


_left_behind: list[str] = []


def _clear(spark: SparkSession) -> None:
    while _left_behind:
        remove(spark, _left_behind.pop())


def _stage(step):
    """``step`` with a folder of its own for what it writes on the way.

    Its result is a plan over that folder, so the folder can go only when the
    result has been written: the next stage, which starts from the written
    table, removes it.
    """

    @wraps(step)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark)
        spark.conf.set(BATCH_CONF, BATCH_BYTES)  # for good: the result is planned when the caller writes it
        _left_behind.append(shared_dir(spark, step.__name__))
        with writing_to(_left_behind[-1]):
            return step(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("line_dedup", _stage(drop_repeated_lines)),
    ("near_dedup", _stage(drop_near_duplicates)),
    ("decontamination", _stage(drop_leaks)),
    ("piece_coding", _stage(encode)),
]

#: Training, edit distances and token ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus; runs one at a time in a driver."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    _clear(spark)
    return docs
