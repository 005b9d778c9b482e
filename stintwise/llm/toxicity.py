"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct words and word beginnings, hashed into ``2**22``
buckets.  A bounded sample of labelled texts selects the buckets that tell the
labels apart best and trains the machine on them: a weight per bucket, and a
factor vector per bucket whose products weigh pairs of terms, so that two terms
may count together what neither counts alone.  The model has a fixed size and
is broadcast; every text is scored in one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.llm.rows import sample_rows
from stintwise.llm.words import LOWER, NOT_LETTERS, Hasher, Texts, give_back, mix, slices, spans
from stintwise.session import written

BUCKET_BITS = 22
#: Lengths in bytes of the word beginnings that are terms besides whole words.
BEGINNINGS = (4, 5, 6)
#: Texts are read so many bytes at a time, or a text at a time.
_READ = 1 << 18


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the training; about ``max_rows`` labelled texts are learnt from at most."""

    max_rows: int = 12_000
    terms: int = 512
    factors: int = 8
    rounds: int = 200
    rate: float = 0.05
    decay: float = 1e-4
    least_texts: int = 2


@dataclass(frozen=True)
class Machine:
    """A trained machine: ``place[bucket]`` is the row of a selected bucket, or -1."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def places(self) -> np.ndarray:
        place = np.full(1 << BUCKET_BITS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        return place


def term_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the terms of some texts, repeated as they occur.

    Letters are folded from A-Z, and from the capitals of the Latin-1 block.
    """
    buf = LOWER[texts.buf]
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        buf[1:][capital] += 0x20
    starts, ends, row = spans(texts, buf, NOT_LETTERS)
    hashed = Hasher(buf)
    kinds = [(row, hashed(starts, ends))]
    for n in BEGINNINGS:
        long = ends - starts >= n
        kinds.append((row[long], mix(hashed(starts[long], starts[long] + n) + np.uint64(n))))
    rows = np.concatenate([r for r, _ in kinds])
    return rows, (np.concatenate([h for _, h in kinds]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct buckets of each labelled text."""
    for batch in batches:
        for texts in slices(batch.column(1), _READ):
            rows, buckets = term_buckets(texts)
            distinct = np.unique(rows * (1 << BUCKET_BITS) + buckets)
            at = np.searchsorted(distinct >> BUCKET_BITS, np.arange(texts.rows + 1))
            own = (distinct & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
            found = [own[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.start, texts.rows), pa.array(found, pa.binary())], ["label", "buckets"]
            )


def fit(labels: np.ndarray, lists: list[np.ndarray], training: Training) -> Machine:
    """Trains on texts given as their distinct buckets, by gradient descent with adaptive steps.

    Without texts of both labels the machine scores every text alike.
    """
    n, positive = len(labels), int(labels.sum())
    if not 0 < positive < n:
        rate = (positive + 0.5) / (n + 1)
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, training.factors)), float(np.log(rate / (1 - rate))))
    inside = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for own, y in zip(lists, labels, strict=True):
        if y in (0, 1):
            inside[y, own] += 1  # a text's buckets are distinct
    total = inside.sum(0, dtype=np.int32)
    some = np.flatnonzero((total >= training.least_texts) & (total != n))
    total, toxic = total[some], inside[1, some]
    del inside
    expected = total * (positive / n)
    apart = (toxic - expected) ** 2 / np.maximum(expected * (1 - total / n), 1e-9)
    best = np.sort(np.argsort(-apart, kind="stable")[: training.terms])
    buckets = some[best[apart[best] > 0]]
    x = np.zeros((n, len(buckets)), np.float32)
    for k, own in enumerate(lists):
        at = np.searchsorted(buckets, own)
        hit = (at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == own) if len(buckets) else np.zeros(len(own), bool)
        x[k, at[hit]] = 1
    y = labels.astype(np.float32)
    draws = np.random.default_rng(5)
    weights = np.zeros(len(buckets), np.float32)
    factors = (0.01 * draws.standard_normal((len(buckets), training.factors))).astype(np.float32)
    bias = np.float32(np.log(positive / (n - positive)))
    state = [np.full_like(v, 1e-6) for v in (weights, factors)] + [np.float32(1e-6)]
    for _ in range(training.rounds):
        sums = x @ factors
        margin = bias + x @ weights + 0.5 * ((sums**2).sum(1) - x @ (factors**2).sum(1))
        wrong = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        per_term = x.T @ wrong
        slopes = [
            per_term + training.decay * weights,
            x.T @ (wrong[:, None] * sums) - factors * per_term[:, None] + training.decay * factors,
            wrong.sum(),
        ]
        state = [s + g * g for s, g in zip(state, slopes, strict=True)]
        steps = [training.rate * 2 * g / np.sqrt(s) for s, g in zip(state, slopes, strict=True)]
        weights, factors, bias = weights - steps[0], factors - steps[1], bias - steps[2]
    return Machine(buckets, weights.astype(np.float64), factors.astype(np.float64), float(bias))


def train(labelled: DataFrame, training: Training = Training()) -> Machine:  # noqa: B008
    """A machine from ``labelled(label, text)``, which one task sees as a whole: its size must be bounded."""
    rows = labelled.select(F.col("label").cast("int").alias("label"), "text")
    lists = rows.mapInArrow(_term_lists, "label int, buckets binary")

    def fitted(given: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(b, np.int32) for b in given["buckets"]]
        model = fit(given["label"].to_numpy(), own, training)
        parts = [model.buckets.astype(np.int64), model.weights, model.factors]
        give_back()
        return pd.DataFrame([[*(v.tobytes() for v in parts), model.bias]], columns=["buckets", "weights", "factors", "bias"])

    schema = "buckets binary, weights binary, factors binary, bias double"
    found = lists.groupBy().applyInPandas(fitted, schema).first()
    if found is None:
        return fit(np.empty(0, int), [], training)
    return Machine(
        np.frombuffer(found.buckets, np.int64),
        np.frombuffer(found.weights),
        np.frombuffer(found.factors).reshape(-1, training.factors),
        found.bias,
    )


def score(docs: DataFrame, machine: Machine, keep: list[str | Column], name: str = "score") -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` and its score, from 0 to 1; a null text scores as the empty one."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    kept = docs.select(*keep)
    rows = docs.select(*keep, *([] if "text" in kept.columns else ["text"]))
    at, width = rows.columns.index("text"), len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        place = m.places()
        for batch in batches:
            margins = np.full(batch.num_rows, m.bias)
            for texts in slices(batch.column(at), _READ):
                row, bucket = term_buckets(texts)
                found = place[bucket]
                hit = found >= 0
                distinct = np.unique(row[hit] * len(place) + found[hit])
                row, term = distinct // len(place), distinct % len(place)
                per_row = lambda v, row=row, n=texts.rows: np.bincount(row, v, n).astype(float)
                margin = per_row(m.weights[term])
                for f in m.factors.T:
                    margin += 0.5 * (per_row(f[term]) ** 2 - per_row(f[term] ** 2))
                margins[texts.start : texts.stop] += margin
            scores = pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], scores], [*batch.schema.names[:width], name])

    return rows.mapInArrow(run, kept.schema.add(name, "double"))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from; a row without an id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Machine:  # noqa: B008
    """A machine from the rows of ``docs`` that ``labels(doc_id, toxic)`` marks and that are not held out.

    Of contradicting labels of one id the larger counts, of several texts the
    one that sorts first.  Beyond ``max_rows`` labelled ids, those with the
    smallest hashes are learnt from; they are chosen before any text is read,
    and only their texts move.
    """
    marks = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).distinct().join(marks, "doc_id")
    chosen = sample_rows(written(known, "labelled-ids"), F.xxhash64("doc_id"), training.max_rows)
    # About `max_rows` ids at most.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return train(texts, training)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, training: Training = Training()) -> DataFrame:  # noqa: B008
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Labels are learnt only from rows that are not held out.  Repeated rows give
    repeated results; empty and null texts get the score of a text without
    terms; an empty table gives no rows; further columns are not read.
    """
    machine = train_on_labels(docs, labels, training)
    scored = score(docs, machine, [F.col("doc_id").cast("long").alias("doc_id")])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
