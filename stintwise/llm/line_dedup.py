"""Line deduplication by a deletion-neighbourhood join over words.

Two lines are duplicates if at most one word has to be inserted, deleted or
replaced to turn one into the other; lines under ``near_words`` words must be
equal.  The earliest line stays.  Unless told otherwise, equal lines of every
length but blank ones go, and one word may differ in lines of four or more.

1. Every line becomes a hash of its word sequence.  Equal lines keep their
   earliest place.
2. Of lines within one edit, either the first or the second half is untouched,
   so only distinct lines that share a half with another need their variants.
3. Those emit every variant with one word deleted, as a hashed key.  Lines with
   the same variant from the same place differ in that one word; a line equal
   to a variant lacks that one word.  The earliest place per key is an
   aggregate, so a key that very many lines share never gathers them.
4. Each line is verified against the earliest partner by edit distance.

Which halves and variants two lines share is counted on bare hashes first; bit
filters of fixed size carry the answer to the tasks that read the texts, and
what a filter lets through too much, later steps sort out.  Documents that lose
no line are not moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.bits import bit_filter, bit_table, may_hold, with_flag
from stintwise.llm.rows import NO_ID, record
from stintwise.llm.words import Texts, mix, slices, words
from stintwise.session import written

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LENGTH, _SIDE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (_BASE, _BASE_INVERSE)
            )
        return cls.up, cls.down


class Lines:
    """The lines with words of some texts: row, number within the text, words, and hashes of parts."""

    def __init__(self, texts: Texts):
        found = words(texts)
        breaks = np.flatnonzero(texts.buf == 0x0A)
        line = np.searchsorted(breaks, found.starts)
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (found.row[1:] != found.row[:-1])
        self.first = np.flatnonzero(new)
        self.n = np.diff(np.append(self.first, len(line)))
        self.row = found.row[self.first]
        self.number = line[self.first] - np.searchsorted(breaks, texts.at[self.row])
        self.word_hash = found.hash
        self.up, self.down = _Powers.of(int(self.n.max(initial=0)) + 2)
        within = np.arange(len(line)) - np.repeat(self.first, self.n)
        self.sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(found.hash * self.up[within], out=self.sums[1:])

    def __len__(self) -> int:
        return len(self.first)

    def _of(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix(total + n.astype(np.uint64) * _LENGTH)

    def whole(self) -> np.ndarray:
        return self._of(self.sums[self.first + self.n] - self.sums[self.first], self.n)

    def halves(self) -> np.ndarray:
        """Four keys a line: both halves, cut for partners of its own length or more, and of one word less."""
        out = []
        for length in (self.n, self.n - 1):
            half = length // 2
            rest = length - half
            tail = self.first + self.n - rest
            front = self.sums[self.first + half] - self.sums[self.first]
            back = (self.sums[self.first + self.n] - self.sums[tail]) * self.down[self.n - rest]
            out += [self._of(front, length), self._of(back + _SIDE, length)]
        return np.stack(out, axis=1)

    def variants(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of each chosen line: the line, the word's place, and the hash of the line without it."""
        line = np.repeat(chosen, self.n[chosen])
        place = np.arange(len(line)) - np.repeat(np.cumsum(self.n[chosen]) - self.n[chosen], self.n[chosen])
        first, at, end = self.first[line], self.first[line] + place, self.first[line] + self.n[line]
        total = (self.sums[at] - self.sums[first]) + (self.sums[end] - self.sums[at + 1]) * _BASE_INVERSE
        return line, place, self._of(total, self.n[line] - 1)


_LINE_ROW = "doc long, record long, number int, line long, lines int"
_VARIANT_ROW = "key long, at int, n int, line long, doc long, record long, number int, words binary"


def _ids(batch: pa.RecordBatch, texts: Texts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = [batch.column(k).slice(texts.start, texts.rows).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)]
    return cut[0][rows], cut[1][rows]


def _lines(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                lines = Lines(texts)
                keep = lines.n >= least_words
                doc, record = _ids(batch, texts, lines.row)
                of_row = np.bincount(lines.row[keep], minlength=texts.rows).astype(np.int32)[lines.row]
                columns = [doc, record, lines.number.astype(np.int32), lines.whole().view(np.int64), of_row]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["doc", "record", "number", "line", "lines"])

    return run


def _halves(near_words: int):
    """The halves of long lines, each with its line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                lines = Lines(texts)
                long = lines.n >= near_words
                key, line = lines.halves()[long].view(np.int64), lines.whole().view(np.int64)[long]
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(line, 4))], ["key", "line"])

    return run


def _variants(halves, near_words: int, shared=None):
    """Long lines that share a half, as rows of two kinds: deletion variants (``at`` is the deleted word), and the line (-1).

    Without ``shared`` only keys and lines, to count which keys lines share; with it whole rows of those keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                lines = Lines(texts)
                mate = may_hold(halves.value, lines.halves().reshape(-1)).reshape(-1, 4).any(axis=1)
                chosen = np.flatnonzero((lines.n >= near_words) & mate)
                whole = lines.whole().view(np.int64)
                line, at, key = lines.variants(chosen)
                line = np.concatenate([line, chosen])
                at = np.concatenate([at, np.full(len(chosen), -1)]).astype(np.int32)
                key = np.concatenate([key.view(np.int64), whole[chosen]])
                if shared is None:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(whole[line])], ["key", "line"])
                    continue
                hit = may_hold(shared.value, key)
                # Whoever has a shared variant is itself needed, to be verified.
                needed = np.zeros(len(lines), bool)
                needed[line[hit]] = True
                hit |= (at < 0) & needed[line]
                line, at, key = line[hit], at[hit], key[hit]
                doc, record = _ids(batch, texts, lines.row)
                raw = [
                    lines.word_hash[lines.first[k] : lines.first[k] + lines.n[k]].tobytes() if a < 0 else None
                    for k, a in zip(line, at, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(at), pa.array(lines.n[line].astype(np.int32)), pa.array(whole[line]), pa.array(doc[line]),
                     pa.array(record[line]), pa.array(lines.number[line].astype(np.int32)), pa.array(raw, pa.binary())],
                    ["key", "at", "n", "line", "doc", "record", "number", "words"],
                )

    return run


def _shared_keys(keys: DataFrame) -> np.ndarray:
    """A bit filter of the keys that at least two different lines have."""
    ends = keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"))
    return bit_filter(ends.filter("low < high"), "key")


def within_one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one word inserted, deleted or replaced, or none, turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = len(a)
    front = np.flatnonzero(a != b[:n])
    if not len(front):
        return True
    same = int(front[0])
    back = np.flatnonzero(a[::-1] != b[len(b) - n :][::-1])
    tail = int(back[0]) if len(back) else n
    return same + tail >= len(b) - 1


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine, theirs = batch.column(3), batch.column(4)
        same = [
            within_one_edit(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
            for x, y in zip(mine, theirs, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(batch.columns[:3], ["doc", "record", "number"]).filter(pa.array(same, pa.bool_()))


def _rewrite(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts, dropped = [], [], []
            for text, kept in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, kept = (text or "").split("\n"), set(kept or ())
                stay = [x for k, x in enumerate(lines) if k in kept or len(x.encode().split()) < least_words]
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
                out.append(text if len(stay) == len(lines) else "\n".join(stay))
            columns = [pa.array(out, pa.string()), pa.array(counts, pa.int32()), pa.array(dropped, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[3:]], ["doc_id", "text", "n_lines", "n_dropped", *batch.schema.names[3:]])

    return run


def dedup_lines(docs: DataFrame, near_words: int = 4, least_words: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` and the columns ``carry`` of each row, without lines that occur earlier.

    Lines end with a newline and are compared as sequences of words, A-Z
    folded.  Lines under ``least_words`` words, blank ones included, always
    stay.  "Earlier" is by ``doc_id`` (null last), then by text hash, then by
    line.  A line goes if any earlier line is a duplicate, gone or not.
    Repeated rows (same ``doc_id`` and text) are one record and treated alike.
    A null text stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    doc, own_record = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), record()
    rows = docs.select(doc.alias("doc"), own_record.alias("record"), "text")
    lines = written(rows.mapInArrow(_lines(least_words), _LINE_ROW), "lines")
    place = F.struct("doc", "record", "number")
    firsts = lines.groupBy("line").agg(F.min(place).alias("at")).select("at.*")

    halves = share(_shared_keys(rows.mapInArrow(_halves(near_words), "key long, line long")))
    shared = share(_shared_keys(rows.mapInArrow(_variants(halves, near_words), "key long, line long")))
    variants = written(rows.mapInArrow(_variants(halves, near_words, shared), _VARIANT_ROW), "line-variants")
    own = F.col("at") < 0
    per_place = variants.groupBy("key", "n", "at").agg(F.min(place).alias("first"))
    # A line and its variants of one key: for a line those one word longer, for a variant the line one word shorter.
    whole = per_place.filter(own).select("key", F.col("first").alias("whole"))
    longer = per_place.filter(~own).groupBy("key").agg(F.min("first").alias("longer"))
    replaced = per_place.filter(~own).select("key", "n", "at", "first").join(whole, "key", "left")
    by_variant = (
        variants.filter(~own)
        .join(replaced, ["key", "n", "at"])
        .select("doc", "record", "number", F.least("first", F.coalesce("whole", "first")).alias("partner"))
    )
    by_line = variants.filter(own).join(longer, "key").select("doc", "record", "number", F.col("longer").alias("partner"))
    earliest = by_variant.unionByName(by_line).filter(F.col("partner") < place).groupBy("doc", "record", "number").agg(F.min("partner").alias("partner"))

    texts = variants.filter(own).select("doc", "record", "number", "words").dropDuplicates(["doc", "record", "number"])
    theirs = texts.select(place.alias("partner"), F.col("words").alias("their_words"))
    pairs = earliest.join(theirs, "partner").join(texts, ["doc", "record", "number"])
    near = pairs.select("doc", "record", "number", "words", "their_words").mapInArrow(_verified, "doc long, record long, number int")
    kept = written(
        firsts.join(near, ["doc", "record", "number"], "left_anti")
        .groupBy("doc", "record")
        .agg(F.collect_list("number").alias("stay")),  # of one document's own lines
        "kept-lines",
    )
    every = lines.select("doc", "record", "lines").distinct()  # a row per document already within a task
    losing = every.join(kept, ["doc", "record"], "left").filter(F.coalesce(F.size("stay"), F.lit(0)) < F.col("lines"))
    losing = written(bit_table(losing.select(F.xxhash64("doc", "record").alias("hashed")), "hashed"), "losing-bits")
    names = [f"__{c}" for c in carry]
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", doc.alias("doc"), own_record.alias("record"),
        *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
    ).withColumn("hashed", F.xxhash64("doc", "record"))
    marked = with_flag(marked, losing, "hashed", "loses")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    untouched = marked.filter("NOT loses").select("doc_id", "text", n_lines.alias("n_lines"), F.lit(0).alias("n_dropped"), *names)
    cut = marked.filter("loses").join(kept, ["doc", "record"], "left").select("doc_id", "text", "stay", *names)
    schema = untouched.schema
    result = untouched.unionByName(cut.mapInArrow(_rewrite(least_words), schema))
    return result.withColumnsRenamed(dict(zip(names, carry, strict=True)))
