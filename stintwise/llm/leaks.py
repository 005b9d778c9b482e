"""Benchmark decontamination by template canonicalisation.

Documents and benchmark items become sequences of template tokens: numbers,
names and units turn into typed placeholders, other words stay.  Windows of
template tokens are hash-joined, so a question asked anew with other numbers or
names still meets its original.  Texts are read in three ways: capitals that
open a sentence as words, the same as names, and all tokens as they are.
Matches that lie on one alignment of document and item, or on neighbouring ones
(a word more or less shifts what follows), are counted together, and the values
behind the placeholders must agree: wherever the item repeats a value, the
document must repeat one too.  Items are grouped into classes of one form, so a
form that very many items share is matched once.

Tasks that read documents pass on only windows that a bit filter of fixed size,
made of the benchmark's windows, lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm.bits import bit_filter, may_hold
from stintwise.llm.rows import NO_ID, record
from stintwise.llm.words import LOWER, Hasher, Texts, mix, slices, spans, windows
from stintwise.session import written

# Words that are units after a number.
UNITS = (
    "km m cm mm mi mile miles ft feet foot inch inches yd yard yards kg g mg lb lbs oz ton tons tonnes l ml litre litres liter liters "
    "s sec second seconds ms min minute minutes h hour hours day days week weeks month months year years "
    "mph kmh degrees percent dollar dollars usd eur euro euros cent cents pound pounds"
).split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))

_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
#: Bytes after which a capital is no sign of a name.
_ENDS = np.zeros(256, np.int32)
_ENDS[[ord(c) for c in '.!?:;"\n']] = 1
_POINTS, _NAME_MARKS = np.zeros(256, bool), np.zeros(256, bool)
_POINTS[[ord(c) for c in ".,/:"]] = True
_NAME_MARKS[[ord(c) for c in " -'"]] = True
#: Texts are read so many bytes at a time, or a text at a time.
_READ = 1 << 18


def _unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in UNITS]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(Hasher(np.frombuffer(b"".join(raw), np.uint8))(np.concatenate([[0], ends[:-1]]), ends))


_UNIT_HASHES = _unit_hashes()

#: The ways to read a text.
WORDS, OPENING_NAMES, LITERAL = range(3)
#: Alignments that differ by half as many tokens, or less, are counted together too.
NEIGHBOURS = 16


class Tokens:
    """The tokens of some texts as they stand: spans, rows, hashes of their values, and what the ways to read them need."""

    def __init__(self, texts: Texts):
        raw = texts.buf
        self.starts, self.ends, self.row = starts, ends, row = spans(texts, raw, _NOT_ALNUM)
        self.hashed = Hasher(LOWER[raw])
        self.value = self.hashed(starts, ends)
        n = len(starts)
        self.first = first = np.ones(n, bool)
        first[1:] = row[1:] != row[:-1]
        gap_from = np.zeros(n, np.int64)
        gap_from[1:] = ends[:-1]
        gap_from[first] = texts.at[row[first]]
        marks = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_ENDS[raw], out=marks[1:])
        self.opens = first | (marks[starts] > marks[gap_from])
        head = raw[starts]
        second = raw[np.minimum(starts + 1, max(len(raw) - 1, 0))] if n else head
        self.number = _DIGIT[head]
        self.capital = ((head >= 0x41) & (head <= 0x5A) | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)) & ~self.number
        # What stands between two parts of one number ("1,250.5", "1 000", "3/4", "12:30") or name ("Ada Lovelace", "Ada-Marie", "O'Neil").
        near = ~first & (starts - gap_from == 1)
        between = raw[np.maximum(starts - 1, 0)] if n else head
        # A space parts thousands: up to three digits, then three.
        digits = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(_DIGIT[raw], out=digits[1:])
        size = np.where(digits[ends] - digits[starts] == ends - starts, ends - starts, 0)
        group = (between == 0x20) & (size == 3)
        group[1:] &= (size[:-1] > 0) & (size[:-1] <= 3)
        self.joins_numbers = near & (_POINTS[between] | group)
        self.joins_names = near & _NAME_MARKS[between]
        follows = np.zeros(n, bool)
        follows[1:] = self.number[:-1] & ~first[1:]
        self.unit = follows & ~self.number & np.isin(self.value, _UNIT_HASHES)


class Templates:
    """Template tokens, read in one way: row, canonical hash, hash of the value itself, and whether it is a placeholder."""

    def __init__(self, t: Tokens, way: int = WORDS):
        n = len(t.starts)
        if way == LITERAL:
            self.row, self.value, self.token, self.slot = t.row, t.value, t.value, np.zeros(n, bool)
            return
        number, unit = t.number, t.unit
        name = (t.capital if way == OPENING_NAMES else t.capital & ~t.opens) & ~unit
        joined = np.zeros(n, bool)
        joined[1:] = number[1:] & number[:-1] & t.joins_numbers[1:] | name[1:] & name[:-1] & t.joins_names[1:]
        lead = np.flatnonzero(~joined)
        stop = np.append(lead[1:], n) - 1
        self.row = t.row[lead]
        self.value = t.hashed(t.starts[lead], t.ends[stop]) if n else t.value
        canonical = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, t.value)))
        self.token = canonical[lead]
        self.slot = (number | name | unit)[lead]


_WINDOW = "doc long, record long, way int, at int, window long, slots array<long>"


def _emit(sizes: list[int], least_plain: float, wanted=None):
    """The windows of each text.

    For documents those that ``wanted`` lets through, with the values behind
    their placeholders.  Without it (for items) those of the longest size that
    the text has; what stands for a value is the place of its first occurrence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2), _READ):
                own = [batch.column(k).slice(texts.start, texts.rows).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)]
                tokens = Tokens(texts)
                for way in (WORDS, OPENING_NAMES, LITERAL):
                    t = Templates(tokens, way)
                    begin = np.searchsorted(t.row, np.arange(texts.rows + 1))
                    count, place = np.diff(begin)[t.row], np.arange(len(t.row)) - begin[t.row]
                    literal = np.concatenate([[0], np.cumsum(~t.slot)])
                    values = t.value.view(np.int64) if wanted else _first_places(t, place)
                    for size in sizes:
                        n = len(t.row) - size + 1
                        if n <= 0:
                            continue
                        key = mix(windows(t.token, size) + np.uint64(size + (way << 32))).view(np.int64)
                        inside = t.row[:n] == t.row[size - 1 :]
                        if way != LITERAL:
                            # A short template needs as many words as a long one, or it fits any text.
                            inside &= literal[size:] - literal[:n] >= least_plain * sizes[-1]
                        inside &= may_hold(wanted.value, key) if wanted else np.minimum(count[:n], sizes[-1]) == size
                        at = np.flatnonzero(inside)
                        slots = [values[a : a + size][t.slot[a : a + size]] for a in at]
                        ends = np.concatenate([[0], np.cumsum([len(s) for s in slots], dtype=np.int64)]).astype(np.int32)
                        flat = np.concatenate(slots) if slots else np.empty(0, np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[0][t.row[at]]), pa.array(own[1][t.row[at]]), pa.array(np.full(len(at), way, np.int32)),
                             pa.array(place[at].astype(np.int32)), pa.array(key[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                            ["doc", "record", "way", "at", "window", "slots"],
                        )

    return run


def _first_places(t: Templates, place: np.ndarray) -> np.ndarray:
    """For each token the place in its text where its value occurs first."""
    order = np.lexsort((place, t.value, t.row))
    new = np.ones(len(order), bool)
    new[1:] = (t.value[order][1:] != t.value[order][:-1]) | (t.row[order][1:] != t.row[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = place[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column(2), _READ):
            tokens = Tokens(texts)
            for way in (WORDS, OPENING_NAMES, LITERAL):
                counts = np.bincount(Templates(tokens, way).row, minlength=texts.rows)
                yield pa.RecordBatch.from_arrays([pa.array(counts.astype(np.int32))], ["tokens"])


def _classes(asked: DataFrame) -> DataFrame:
    """``item_id, item_record, kind, class``: items of one class have the same windows, and repeat values at the same places.

    ``kind`` 0 is the class by templates, 1 the one by literal tokens.
    """
    shape = F.sort_array(F.collect_list(F.struct("way", "at", "window", "slots")))  # of one item
    kind = F.when(F.col("way") == LITERAL, 1).otherwise(0).alias("kind")
    return asked.groupBy("item_id", "item_record", kind).agg(F.xxhash64(shape).alias("class"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    coverage: float = 0.5,
    consistency: float = 0.9,
    least_plain: float = 0.5,
) -> DataFrame:
    """``doc_id, record, contaminated, item_id, coverage, consistency, verbatim, n_items`` per row of ``docs(doc_id, text)``.

    ``record`` is the text's hash, which tells rows of one ``doc_id`` apart.
    A document is contaminated if, read in one way, on one alignment with a
    benchmark item ``(item_id, text)`` or on neighbouring ones, it holds at
    least ``coverage`` of the item's windows of ``window`` tokens, and at least
    ``consistency`` of the item's slot values there stand for one value each.
    Of template windows, those with fewer words than ``least_plain`` of
    ``window`` do not count; windows of tokens as they are count always.  An
    item shorter than ``window`` tokens is one window of its own length.
    ``item_id`` is the best such item: by coverage, by consistency, one found
    word by word before others, then the smallest id.  ``verbatim`` is the share
    of its literal windows that the document holds anywhere, and ``n_items`` how
    many items match; items of one id but with different texts are items of
    their own.  Clean rows have ``n_items`` 0 and nulls.  Null and empty texts
    are clean; a null ``item_id`` takes no part; repeated rows, of documents or
    items, change nothing for the others; a null ``doc_id`` gets its own
    result; an empty table of documents gives no rows, an empty benchmark
    leaves all clean.  Further columns are not read.

    Items that differ only in their values are one class, and documents are
    matched with classes.  A document and a class meet only if they share one of
    the class's rarest windows, so many that whoever has ``coverage`` of all
    windows has one of them; a phrase that most classes have brings none together.
    """
    spark = docs.sparkSession
    none = F.lit(NO_ID)
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").selectExpr(
        "cast(item_id AS long) AS doc", "xxhash64(text) AS record", "text"
    )
    short = items.mapInArrow(_lengths, "tokens int").filter(f"tokens BETWEEN 1 AND {window - 1}").distinct()
    sizes = sorted(r.tokens for r in short.collect()) + [window]  # `window` numbers at most
    of_items = items.mapInArrow(_emit(sizes, least_plain), _WINDOW)
    asked = written(
        of_items.select(F.col("doc").alias("item_id"), F.col("record").alias("item_record"), "way", "at", "window", "slots").dropDuplicates(
            ["item_id", "item_record", "way", "at"]
        ),
        "benchmark-windows",
    )
    wanted = spark.sparkContext.broadcast(bit_filter(asked, "window"))
    members = written(_classes(asked), "benchmark-classes")
    by_template = members.filter("kind = 0").select("item_id", "item_record", F.col("class").alias("template"))
    by_words = members.filter("kind = 1").select("item_id", "item_record", F.col("class").alias("literal"))
    both = written(by_words.join(by_template, ["item_id", "item_record"], "left"), "benchmark-members")

    kind = F.when(F.col("way") == LITERAL, 1).otherwise(0)
    windows_of = (
        asked.withColumn("kind", kind).join(members, ["item_id", "item_record", "kind"]).select("class", "way", "at", "window", "slots").dropDuplicates(["class", "way", "at"])
    )
    spread = windows_of.groupBy("window").agg(F.countDistinct("class").alias("classes"))
    rarest = Window.partitionBy("class", "way").orderBy("classes", "window", "at")  # of one class
    windows_of = written(
        windows_of.join(spread, "window").withColumns({"nth": F.row_number().over(rarest), "windows": F.count("*").over(Window.partitionBy("class", "way"))}),
        "class-windows",
    )
    enough = F.ceil(F.col("windows") * coverage - 1e-9)
    telling = windows_of.filter(F.col("nth") <= F.col("windows") - enough + 1).select("class", "way", "window")

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc"), record().alias("record"), "text")
    found = rows.mapInArrow(_emit(sizes, least_plain, wanted), _WINDOW)
    met = written(found.select("doc", "record", "at", "window", "slots").dropDuplicates(["doc", "record", "at", "window"]), "document-windows")
    meeting = met.select("doc", "record", "window").join(telling, "window").select("doc", "record", "class", "way").distinct()
    pairs = (
        meeting.join(windows_of.withColumnRenamed("at", "asked_at").withColumnRenamed("slots", "asked"), ["class", "way"])
        .join(met, ["doc", "record", "window"])
        .select("doc", "record", "class", "way", "windows", (F.col("at") - F.col("asked_at")).alias("shift"), "asked_at", "asked", F.col("slots").alias("found"))
    )
    pairs = written(pairs, "template-matches")
    # Each shift by itself, and two overlapping ranges of shifts.
    near = [F.struct(F.lit(k).alias("of"), F.floor((F.col("shift") + k * NEIGHBOURS // 2) / NEIGHBOURS).cast("int").alias("at")) for k in (0, 1)]
    alone = F.struct(F.lit(-1).alias("of"), F.col("shift").alias("at"))
    aligned = ["doc", "record", "class", "way", "range"]
    ranged = pairs.withColumn("range", F.explode(F.array(alone, *near)))
    covered = (
        ranged.groupBy(*aligned)
        .agg((F.countDistinct("asked_at") / F.first("windows")).alias("coverage"))
        .filter(F.col("coverage") >= coverage)
    )
    slots = (
        ranged.filter(F.size("asked") > 0)
        .join(covered.select(*aligned), aligned, "left_semi")
        .select(*aligned, F.explode(F.arrays_zip("asked", "found")).alias("slot"))
        .select(*aligned, "slot.asked", "slot.found")
        .distinct()
    )
    agreeing = (
        slots.groupBy(*aligned, "asked")
        .agg(F.count("*").alias("values"))
        .groupBy(*aligned)
        .agg(F.avg((F.col("values") == 1).cast("double")).alias("consistency"))
    )
    judged = covered.join(agreeing, aligned, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).filter(F.col("consistency") >= consistency)
    literal = F.col("way") == LITERAL
    passed = written(
        judged.groupBy("doc", "record", "class", literal.alias("literal")).agg(F.max(F.struct("coverage", "consistency")).alias("share")), "template-passed"
    )

    # Templates count all their items; literal classes those whose template has not passed.
    of_template = both.filter("template IS NOT NULL").groupBy(F.col("template").alias("class")).agg(F.count("*").alias("n"), F.min(F.struct("item_id", "literal")).alias("least"))
    of_words = both.groupBy(F.col("literal").alias("class"), "template").agg(F.count("*").alias("n"), F.min(F.struct("item_id", "literal")).alias("least"))
    by_shape = passed.filter("NOT literal").join(of_template, "class").select("doc", "record", "share", "literal", "n", "least", F.col("class").alias("template"))
    in_words = passed.filter("literal").join(of_words, "class")
    counted = by_shape.select("doc", "record", "template", F.lit(True).alias("counted"))
    in_words = in_words.join(counted, ["doc", "record", "template"], "left").select(
        "doc", "record", "share", "literal", F.when(F.col("counted"), 0).otherwise(F.col("n")).alias("n"), "least"
    )
    best = (
        by_shape.drop("template")
        .unionByName(in_words)
        .groupBy("doc", "record")
        .agg(
            F.max(F.struct("share.coverage", "share.consistency", "literal", (-F.col("least.item_id")).alias("rank"), F.col("least.literal").alias("words"))).alias("best"),
            F.sum("n").alias("n_items"),
        )
    )
    best = written(best, "template-best")
    literal_windows = windows_of.filter(F.col("way") == LITERAL).select(F.col("class").alias("words"), "window", "windows")
    held = (
        best.select("doc", "record", "best.words")
        .join(literal_windows, "words")
        .join(met.select("doc", "record", "window").distinct(), ["doc", "record", "window"])
        .groupBy("doc", "record")
        .agg((F.count("*") / F.first("windows")).alias("verbatim"))
    )
    judgement = best.join(held, ["doc", "record"], "left")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), record().alias("record"))
    every = every.withColumn("doc", F.coalesce("doc_id", none))
    return every.join(judgement, ["doc", "record"], "left").select(
        "doc_id",
        "record",
        F.col("best").isNotNull().alias("contaminated"),
        (-F.col("best.rank")).alias("item_id"),
        "best.coverage",
        "best.consistency",
        F.when(F.col("best").isNotNull(), F.coalesce("verbatim", F.lit(0.0))).alias("verbatim"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )
