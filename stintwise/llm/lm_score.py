"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of the training texts are quantised on a log scale: a
count of level ``q`` puts the keys ``(n-gram, 1) ... (n-gram, q)`` into one bit
filter.  A count is read back by probing level after level until the first miss,
so an n-gram that was put in is never read too low, and one that was not is read
as present with a small chance.  A pair is looked up only if its first word is
in the filter.  Probabilities of pairs are smoothed with those of words, those
of words over all words.

The filter grows with the corpus.  Up to ``most_bytes`` it is broadcast and
texts are scored where they are read.  Beyond that, texts are kept in blocks,
and the distinct n-grams of a block go to the part of the filter that has them.
What comes back is a byte for each, in an order that the block knows: the same
levels, the same scores.

Beside it stand exact word counts: those of the most frequent words, a bounded
list, are known to every task; only the other tokens meet their counts in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintwise.llm.words import Texts, mix, slices, unmix, words
from stintwise.session import written

#: What words and pairs become: words are odd keys, pairs even ones.  The end of a text is a word, and stands before the next text's first.
END = int(mix(np.array([0x243F6A8885A308D3], np.uint64))[0]) | 1
_FIRST, _SECOND, _LEVEL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_ONE = np.uint64(1)
_MOST_LEVELS = 64
#: Words of 64 bits in a segment of the filter.
SEGMENT = 1 << 14
#: Segments that a task holds at once when n-grams come to the filter, and bytes of text whose n-grams come together.
PART = 32
BLOCK_BYTES = 4 << 20
#: What stands behind the parts that answer a block: the block itself.
_BLOCK = (1 << 63) - 1
_LEVELS = np.arange(_MOST_LEVELS, dtype=np.uint64) * _LEVEL
#: Fixed value: what is added to each count of the base score.
ADDED = 0.1


@dataclass(frozen=True)
class Model:
    """How counts are held and smoothed.

    A count ``c`` has level ``1 + floor(log(c) / log(base))``.  Pairs seen less
    often than ``least_pairs`` are not held.  The filter has ``bits_per_key``
    bits for each key.  ``weight`` is how many sightings of its first word the
    words' distribution counts for when a pair is judged.
    """

    base: float = 1.5
    least_pairs: int = 2
    bits_per_key: int = 16
    weight: float = 1000.0
    most_bytes: int = 256 << 20
    most_frequent: int = 300_000
    buffered: int = 4_000_000

    def levels(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.steps(), counts, "right")

    def steps(self) -> np.ndarray:
        """The least count of each level, without levels that no count has."""
        found = sorted({math.ceil(self.base**k - 1e-9) for k in range(400) if self.base**k < 1 << 62})
        return np.array(found[: _MOST_LEVELS - 1], np.float64)

    def counts(self) -> np.ndarray:
        """What a level stands for: nothing, or the middle of its counts."""
        steps = self.steps()
        return np.concatenate([[0.0], (steps[:-1] + steps[1:] - 1) / 2, steps[-1:]])


@dataclass
class Tokens:
    """Words and ends of some texts: row, key of the word, of the one before it, and of both."""

    row: np.ndarray
    key: np.ndarray
    before: np.ndarray
    pair: np.ndarray


def tokens(texts: Texts) -> Tokens:
    found = words(texts)
    rows = np.arange(texts.rows)
    ends = np.searchsorted(found.row, rows, "right") + rows
    key = np.empty(len(found.hash) + texts.rows, np.uint64)
    inner = np.ones(len(key), bool)
    inner[ends] = False
    row = np.empty(len(key), np.int64)
    key[inner], key[ends] = found.hash | _ONE, np.uint64(END)
    row[inner], row[ends] = found.row, rows
    before = np.empty_like(key)
    before[1:] = key[:-1]
    before[:1] = np.uint64(END)
    return Tokens(row, key, before, mix(before * _FIRST + key * _SECOND) & ~_ONE)


def _sum_counts(most: int):
    """Counts of n-grams, summed over as many tokens as ``most`` allows before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            for texts in slices(batch.column(0)):
                t = tokens(texts)
                waiting += [t.key, t.pair]
                if sum(map(len, waiting)) >= most:
                    yield summed()
        if waiting:
            yield summed()

    return run


def _is_word(key: str = "key") -> Column:
    return F.col(key).bitwiseAND(F.lit(1)) == 1


def count_ngrams(texts: DataFrame, model: Model) -> DataFrame:
    """``key, n``: all words, and the pairs seen often enough, of ``texts(text)``."""
    counted = texts.select("text").mapInArrow(_sum_counts(model.buffered), "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n")).filter(_is_word() | (F.col("n") >= model.least_pairs))


def _scaled(hashed: np.ndarray, size: int) -> np.ndarray:
    """Numbers from 0 to ``size - 1`` from the upper halves of hashes."""
    return ((hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def _by_segment(keys: np.ndarray) -> np.ndarray:
    """Another number for each key; their order is that of the segments."""
    return mix(keys ^ _FIRST)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """The segment that has all levels of a key."""
    return _scaled(_by_segment(keys), segments)


def _places(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key at a level, within its segment, and the bits it sets there."""
    h = mix(keys + _LEVELS[level])
    bits = np.zeros(len(h), np.uint64)
    for k in range(4):
        bits |= _ONE << (h >> np.uint64(6 * k) & np.uint64(63))
    return _scaled(h, SEGMENT), bits


@dataclass(frozen=True)
class LogFilter:
    """The filter as a table ``segment, words`` (segments without bits may be missing), and how many segments are read at once."""

    table: DataFrame
    segments: int
    at_once: int

    @property
    def groups(self) -> int:
        return -(-self.segments // self.at_once)

    def load(self, nth: int) -> np.ndarray:
        """The words of a group of segments on the driver."""
        first = nth * self.at_once
        last = min(first + self.at_once, self.segments) - 1
        found = self.table.filter(F.col("segment").between(first, last)).toArrow()
        out = np.zeros((last + 1 - first, SEGMENT), np.uint64)
        for segment, raw in zip(found.column("segment").to_pylist(), found.column("words"), strict=True):
            out[segment - first] = np.frombuffer(raw.as_buffer(), np.uint64)
        return out.reshape(-1)


def _set_bits(model: Model, segments: int):
    """The bits of each n-gram at its levels, as the place of a word in the whole filter, and bits of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            level, segment = model.levels(batch.column(1).to_numpy()), segment_of(key, segments)
            for k in range(1, int(level.max(initial=0)) + 1):
                own = level >= k
                place, bits = _places(key[own], k)
                yield pa.RecordBatch.from_arrays([pa.array(segment[own] * SEGMENT + place), pa.array(bits.view(np.int64))], ["place", "bits"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments whose bits meet in this task."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        place, bits = (batch.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(place)
        place, bits = place[order], bits[order].view(np.uint64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        place, bits = place[first], np.bitwise_or.reduceat(bits, first) if len(first) else bits
        segment = place // SEGMENT
        for s in np.unique(segment).tolist():
            a, b = np.searchsorted(segment, [s, s + 1])
            found.setdefault(s, np.zeros(SEGMENT, np.uint64))[place[a:b] - s * SEGMENT] |= bits[a:b]
    for s, words_ in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([words_.tobytes()], pa.binary())], ["segment", "words"])


def build_filter(ngrams: DataFrame, model: Model) -> LogFilter:
    """The filter of ``ngrams(key, n)``: as many segments as its keys need."""
    steps = F.array(*[F.lit(float(s)) for s in model.steps()])
    keys = ngrams.agg(F.sum(F.size(F.filter(steps, lambda s: s <= F.col("n"))))).first()[0] or 0
    segments = max(1, -(-keys * model.bits_per_key // (64 * SEGMENT)))
    bits = ngrams.select("key", "n").mapInArrow(_set_bits(model, segments), "place long, bits long")
    by_segment = bits.repartition(F.floor(F.col("place") / SEGMENT))
    table = written(by_segment.mapInArrow(_packed, "segment long, words binary"), "log-filter")
    return LogFilter(table, segments, max(1, model.most_bytes // (8 * SEGMENT)))


def read_levels(filter_words: np.ndarray, keys: np.ndarray, segments: int, first: int = 0) -> np.ndarray:
    """The level of each key: probed from 1 on until the first miss.  ``filter_words`` begins with segment ``first``."""
    out = np.zeros(len(keys), np.int8)
    start = (segment_of(keys, segments) - first) * SEGMENT
    alive = np.arange(len(keys))
    for k in range(1, _MOST_LEVELS):
        place, bits = _places(keys[alive], k)
        alive = alive[filter_words[start[alive] + place] & bits == bits]
        if not len(alive):
            break
        out[alive] = k
    return out


@dataclass(frozen=True)
class Totals:
    """All training tokens, and the distinct ones among them."""

    tokens: int
    distinct: int

    @property
    def spread(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)


def _chances(word: np.ndarray, before: np.ndarray, pair: np.ndarray, totals: Totals, model: Model) -> np.ndarray:
    """The probability of tokens from the counts that the filter gives."""
    alone = (word + ADDED) / totals.spread
    return (np.minimum(pair, before) + model.weight * alone) / (before + model.weight)


_TALLY = "doc_id long, held_out boolean, rid long, n_tokens long, n_known long, base double, score double, rare array<long>"


def _exact(frequent: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are frequent ones, and the counts of those."""
    listed, counts = frequent
    if not len(listed):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
    known = listed[at] == keys
    return known, np.where(known, counts[at], 0)


def _scores(t: Tokens, rows: int, word: np.ndarray, pairs, totals: Totals, model: Model) -> np.ndarray:
    """Scores of texts from the levels of their words; ``pairs`` has those of the pairs at some places."""
    before = np.empty_like(word)
    before[1:], before[:1] = word[:-1], word[-1:]  # the last word is an end
    pair = np.zeros(len(word), np.int8)
    both = np.flatnonzero((word > 0) & (before > 0))
    pair[both] = pairs(both)
    counts = model.counts()
    return np.bincount(t.row, np.log10(_chances(counts[word], counts[before], counts[pair], totals, model)), rows)


def _told(batch: pa.RecordBatch, t: Tokens, here: np.ndarray, exact: np.ndarray, score: np.ndarray, totals: Totals) -> pa.RecordBatch:
    """What one pass tells of each text; words whose exact count is not known here are listed in ``rare``."""
    rows = batch.num_rows
    add = lambda x: np.bincount(t.row, x, rows)
    base = add(np.where(here, np.log10((exact + ADDED) / totals.spread), 0.0))
    left = np.flatnonzero(~here)
    ends = np.searchsorted(t.row[left], np.arange(rows + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column(2), batch.column(3), batch.column(0), pa.array(np.bincount(t.row, minlength=rows)),
         pa.array(add(here.astype(float)).astype(np.int64)), pa.array(base), pa.array(score),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(t.key[left].view(np.int64)))],
        ["doc_id", "held_out", "rid", "n_tokens", "n_known", "base", "score", "rare"],
    )


def _tally(frequent, filter_words, segments: int, totals: Totals, model: Model):
    """Scores of the texts of ``rid, text, doc_id, held_out`` where they are, by the whole filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                t = tokens(texts)
                keys, nth = np.unique(t.key, return_inverse=True)
                known, exact = _exact(frequent.value, keys)
                word = read_levels(filter_words.value, keys, segments)[nth]
                pairs = lambda at, t=t: read_levels(filter_words.value, t.pair[at], segments)
                score = _scores(t, texts.rows, word, pairs, totals, model)
                yield _told(batch.slice(texts.start, texts.rows), t, known[nth], exact[nth], score, totals)

    return run


def _blocks(most: int):
    """Rows with texts as blocks: the first row's number, and the rows as compressed Arrow data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for own in waiting:
                    stream.write_batch(own)
            first = waiting[0].column(0).slice(0, 1)
            waiting.clear()
            return pa.RecordBatch.from_arrays([first, pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

        for batch in batches:
            for texts in slices(batch.column(1)):
                waiting.append(batch.slice(texts.start, texts.rows))
                size += len(texts.buf)
                if size >= most:
                    yield block()
                    size = 0
        if waiting:
            yield block()

    return run


def _read_block(raw: pa.Buffer) -> list[tuple[pa.RecordBatch, Tokens]]:
    with pa.ipc.open_stream(raw) as stream:
        return [(batch.slice(texts.start, texts.rows), tokens(texts)) for batch in stream for texts in slices(batch.column(1))]


def _close(numbers: np.ndarray) -> bytes:
    """Rising numbers as their gaps, all lowest bytes first: between near ones the highest bytes are zeros, which compress."""
    return np.diff(numbers, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _open(raw: pa.Buffer) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8")
    return np.cumsum(gaps.reshape(-1), dtype=np.uint64)


def _ask(segments: int, at_once: int):
    """The distinct n-grams of each block, by the part of the filter that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                numbers = np.sort(_by_segment(np.concatenate([x for _, t in _read_block(raw.as_buffer()) for x in (t.key, t.pair)])))
                numbers = numbers[np.append(True, numbers[1:] != numbers[:-1])]
                part = _scaled(numbers, segments) // at_once
                first = np.flatnonzero(np.diff(part, prepend=-1))
                data = pa.array([_close(own) for own in np.split(numbers, first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.full(len(first), block)), data], ["part", "block", "data"])

    return run


def _answer(segments: int, at_once: int):
    """The levels that blocks ask for, a byte each.  A part's segments, numbered below 0, come before its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, np.empty(0, np.uint64)
        for batch in batches:
            part, block = (batch.column(k).to_numpy() for k in (0, 1))
            raw = [x.as_buffer() for x in batch.column(2)]
            edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if part[a] != now:
                    now, held = int(part[a]), np.zeros(at_once * SEGMENT, np.uint64)
                asks = a + int((block[a:b] < 0).sum())
                for k in range(a, asks):
                    start = (int(block[k]) + at_once) * SEGMENT
                    held[start : start + SEGMENT] = np.frombuffer(raw[k], np.uint64)
                if asks < b:
                    asked = [_open(x) for x in raw[asks:b]]
                    level = read_levels(held, unmix(np.concatenate(asked)) ^ _FIRST, segments, now * at_once)
                    data = pa.array([x.tobytes() for x in np.split(level, np.cumsum([len(x) for x in asked[:-1]]))], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(asks, b - asks), batch.column(1).slice(asks, b - asks), data], ["part", "block", "data"])

    return run


def _tally_blocks(frequent, totals: Totals, model: Model):
    """As :func:`_tally`, from blocks that come behind the answers of all parts, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[np.ndarray] = []
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if part != _BLOCK:
                    levels.append(np.frombuffer(raw.as_buffer(), np.int8))
                    continue
                found = _read_block(raw.as_buffer())
                keys, nth = np.unique(np.concatenate([t.key for _, t in found]), return_inverse=True)
                known, exact = _exact(frequent.value, keys)
                place = np.unique(_by_segment(np.concatenate([keys, *[t.pair for _, t in found]])), return_inverse=True)[1]
                level = np.concatenate(levels)[place]
                levels.clear()
                pair = level[len(keys) :]
                start = 0
                for rows, t in found:
                    own, of_pairs = nth[start : start + len(t.key)], pair[start : start + len(t.key)]
                    score = _scores(t, rows.num_rows, level[own], of_pairs.take, totals, model)
                    yield _told(rows, t, known[own], exact[own], score, totals)
                    start += len(t.key)

    return run


def _by_parts(rows: DataFrame, held: LogFilter, frequent, totals: Totals, model: Model) -> DataFrame:
    """What :func:`_tally` tells, with a filter beyond one broadcast: it moves by parts, and so does what blocks of texts ask for."""
    segments, at_once = held.segments, min(held.at_once, PART)
    blocks = written(rows.mapInArrow(_blocks(BLOCK_BYTES), "block long, rows binary"), "lm-blocks")  # read twice, so the numbers must stay
    row = "part long, block long, data binary"
    own = held.table.select(F.floor(F.col("segment") / at_once).alias("part"), (F.col("segment") % at_once - at_once).alias("block"), F.col("words").alias("data"))
    asked = own.unionByName(blocks.mapInArrow(_ask(segments, at_once), row)).repartition("part").sortWithinPartitions("part", "block")
    levels = written(asked.mapInArrow(_answer(segments, at_once), row), "lm-levels")
    last = blocks.select(F.lit(_BLOCK).cast("long").alias("part"), "block", F.col("rows").alias("data"))
    return levels.unionByName(last).repartition("block").sortWithinPartitions("block", "part").mapInArrow(_tally_blocks(frequent, totals, model), _TALLY)


@contextmanager
def _sparing(spark: SparkSession) -> Iterator[None]:
    """Within the block, what is written leaves no shuffle files behind, and Python gets few megabytes of texts at a time."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK_BYTES)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def lm_scores(docs: DataFrame, held_out: Column | str, model: Model = Model()) -> DataFrame:  # noqa: B008
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs(doc_id, text)``.

    The model learns from the rows for which ``held_out``, a column or SQL, is false.  Words are
    what stands between spaces, A-Z in lower case; each text has an end as its
    last token, so null and empty texts have one token.  ``n_known`` counts
    tokens that occur in training, ``train_tokens`` all tokens there;
    ``base_score`` sums log10 of the words' smoothed exact frequencies,
    ``score`` is the log10 probability of the text by the model.  Words are
    told apart by 63-bit hashes.  Repeated rows give repeated results; a null
    ``doc_id`` gets a result of its own; an empty table gives no rows; without
    training texts all words are unseen.  Further columns are not read.
    """
    with _sparing(docs.sparkSession):
        told, seen, totals = _told_of_all(docs, held_out, model)
    rest = (
        told.select("rid", F.explode("rare").alias("key"))
        .join(seen, "key", "left")
        .groupBy("rid")
        .agg(F.count("n").alias("known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + ADDED) / totals.spread)).alias("more"))
    )
    return (
        told.drop("rare")
        .join(rest, "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
            F.lit(totals.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )


def _told_of_all(docs: DataFrame, held_out: Column | str, model: Model) -> tuple[DataFrame, DataFrame, Totals]:
    """What is told of each text, the exact counts of words, and their totals."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.expr(held_out) if isinstance(held_out, str) else held_out).alias("held_out"), "text")
    ngrams = written(count_ngrams(rows.filter("NOT held_out"), model), "lm-ngrams")
    seen = ngrams.filter(_is_word())
    all_words = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    totals = Totals(int(all_words[0]), int(all_words[1]))

    # Frequent words: the lowest count step above which there are few enough.
    by_step = seen.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().collect()  # a row per eighth of an octave
    least, many = 1 << 10, 0
    for r in sorted(by_step, key=lambda r: -r.step):
        if many + r["count"] > model.most_frequent:
            break
        least, many = r.step, many + r["count"]
    frequent = seen.filter(F.floor(F.log2("n") * 8) >= least).select("key", "n").toArrow()
    keys = frequent.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    listed = keys[order], frequent.column("n").to_numpy().astype(np.float64)[order]
    shared = spark.sparkContext.broadcast(listed)

    held = build_filter(ngrams, model)
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "text", "doc_id", "held_out")
    if held.groups == 1:
        told = numbered.mapInArrow(_tally(shared, spark.sparkContext.broadcast(held.load(0)), held.segments, totals, model), _TALLY)
    else:
        told = _by_parts(numbered, held, shared, totals, model)
    return written(told, "lm-tally"), seen, totals
