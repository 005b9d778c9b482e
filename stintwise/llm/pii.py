"""Personal data in texts, with DataFrame operations only.

Four patterns give the base spans.  Besides, generators with a high recall
propose candidates that may overlap:

* written-out mail addresses;
* written-out network addresses, with dots in brackets or as words;
* of every run of digit groups, each sequence of whole groups with 9 to 15
  digits as a phone number, and each with 13 to 19 digits that pass the check
  sum as a card number.  Whole runs of 13 to 19 digits that fail it are
  candidates too, to learn from only.

Boosted trees judge each candidate by its format and by the words and digits
around it; they learn from the base spans which formats and contexts personal
data has.  The marks by which the base patterns decide (an at sign, a plus) are
withheld from them, so they must go by the rest.  For each kind a threshold is
calibrated on candidates they have not seen.  All candidates of all texts take
part: three quarters teach the trees, the others calibrate.  Of candidates beyond it that
overlap, the better one stays; they are added to the base spans, which always
stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stintwise.session import written

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds.  Possessive groups and the look-behinds change no match; they keep long
# runs of characters from being tried again from every place.  `\\G` is where the match before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# What the generators propose.
SPELT_AT = r"\x20?[(\[{][aA][tT][)\]}]\x20?|\x20[aA][tT]\x20"
SPELT_DOT = r"\x20?[(\[{][dD][oO][tT][)\]}]\x20?|\x20[dD][oO][tT]\x20"
WRITTEN_ADDRESS = (
    rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|{SPELT_AT})[A-Za-z0-9-]++"
    rf"(?:(?:\.|{SPELT_DOT})[A-Za-z0-9-]++)++"
)
DIGIT_RUN = r"[+(]?[0-9](?:[\x20().\/-]{0,2}[0-9]){8,}+"
_DOT = r"(?:\x20?[(\[{](?:\.|[dD][oO][tT])[)\]}]\x20?|\x20?\.\x20?|\x20[dD][oO][tT]\x20)"
SPELT_IP = rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"
#: Digits of a phone and of a card number.
PHONE_DIGITS, CARD_DIGITS = (9, 15), (13, 19)
CONTEXT_WORDS = ("mail", "contact", "call", "phone", "tel", "card", "visa", "credit", "ip", "host", "server", "address", "from", "at")
NEAR = 24


@dataclass(frozen=True)
class Boosting:
    """Settings of the trees, and the precision that the thresholds keep."""

    rounds: int = 10
    depth: int = 3
    precision: float = 0.98
    seed: int = 10


#: Matches are placed so many at a time, so that texts with very many take time in proportion.
_BLOCK = 256


def match_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, found>>`` of a pattern's matches, in code points, from the left without overlaps."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string>>")

    def state(at: Column, spans: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), spans.alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), pair["hit"].alias("found"))
        return state(end, F.concat(acc["spans"], F.array(span)))

    def block(acc: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, state(acc["at"], none), step, lambda own: state(own["at"], F.concat(acc["spans"], own["spans"])))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    firsts = F.sequence(F.lit(1), F.size(hits), F.lit(_BLOCK))
    blocks = F.transform(firsts, lambda first: F.slice(pairs, first, F.lit(_BLOCK)))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(blocks, state(F.lit(0), none), block, lambda acc: acc["spans"])).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Whether the digits of a string pass the check sum of card numbers."""
    digits = F.split(F.reverse(_digits(found)), "")

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    values = F.transform(F.filter(digits, lambda c: c != ""), weighed)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(found: Column) -> Column:
    """All four parts at most 255, however many leading zeros they have."""

    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(found, r"\."), small)


def base_spans(text: Column) -> Column:
    """``array<struct<kind, start, end>>`` of the base kinds: kinds in their order, then by start."""

    def of(kind: str, pattern: str, sound, mark: str | None = None) -> Column:
        spans = F.filter(match_spans(text, pattern), lambda s: sound(s["found"]))
        kept = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
        return F.when(F.contains(text, F.lit(mark)), kept).otherwise(none) if mark else kept

    count = lambda found: F.length(_digits(found))
    return F.concat(
        of("email", EMAIL, lambda found: F.lit(True), "@"),
        of("ip", IP, _small_parts, "."),
        of("card", CARD, lambda found: count(found).between(13, 19) & luhn(found)),
        of("phone", PHONE, lambda found: count(found).between(9, 15), "+"),
    )


def _groups(found: Column) -> Column:
    """``array<struct<start, end, found>>`` of the digit groups of a run."""
    return match_spans(found, "[0-9]++")


def _sequences(run: Column) -> Column:
    """Each sequence of whole groups of a run that has as many digits as a phone or card number: two candidates at most."""
    groups = _groups(run["found"])

    def from_group(first: Column, i: Column) -> Column:
        # Nineteen groups have nineteen digits at least.
        later = F.slice(groups, i + 1, CARD_DIGITS[1])

        def upto(last: Column, j: Column) -> Column:
            return F.struct(
                first["start"].alias("a"), last["end"].alias("b"),
                F.aggregate(F.slice(later, F.lit(1), j + 1), F.lit(0), lambda n, g: n + F.length(g["found"])).alias("digits"),
            )

        return F.filter(F.transform(later, upto), lambda s: s["digits"].between(PHONE_DIGITS[0], CARD_DIGITS[1]))

    spans = F.flatten(F.transform(groups, from_group))

    def of_kind(kind: str, low: int, high: int) -> Column:
        def candidate(s: Column) -> Column:
            # A plus or bracket before the first group belongs to the number.
            begin = F.when(s["a"] == F.lit(1), F.lit(0)).otherwise(s["a"]) if kind == "phone" else s["a"]
            text = F.substr(run["found"], (begin + 1).cast("int"), (s["b"] - begin).cast("int"))
            return F.struct(F.lit(kind).alias("kind"), (run["start"] + begin).alias("start"), (run["start"] + s["b"]).alias("end"), text.alias("found"))

        found = F.transform(F.filter(spans, lambda s: s["digits"].between(low, high)), candidate)
        if kind == "phone":
            return found
        whole = lambda c: (c["start"] <= run["start"] + 1) & (c["end"] == run["end"])
        return F.filter(found, lambda c: luhn(c["found"]) | whole(c))

    return F.concat(of_kind("phone", *PHONE_DIGITS), of_kind("card", *CARD_DIGITS))


def _proposed(text: Column) -> Column:
    """``array<struct<kind, start, end, found, before, after>>`` of all generators, with what stands around each candidate."""

    def whole(kind: str, pattern: str, sound) -> Column:
        kept = F.filter(match_spans(text, pattern), lambda s: sound(s["found"]))
        return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    runs = match_spans(text, DIGIT_RUN)
    every = F.concat(
        whole("email", WRITTEN_ADDRESS, lambda found: F.lit(True)),
        whole("ip", SPELT_IP, lambda found: _small_parts(_plain(found))),
        F.flatten(F.transform(runs, _sequences)),
    )

    def with_context(s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"),
            F.lower(F.substr(text, (begin + 1).cast("int"), (s["start"] - begin).cast("int"))).alias("before"),
            F.lower(F.substr(text, (s["end"] + 1).cast("int"), F.lit(NEAR))).alias("after"),
        )

    return F.transform(every, with_context)


def _plain(found: Column) -> Column:
    """A written-out address with plain marks."""
    at = F.regexp_replace(found, SPELT_AT, "@")
    return F.regexp_replace(F.regexp_replace(at, SPELT_DOT, "."), _DOT, ".")


def _judged_by(candidates: DataFrame) -> DataFrame:
    """Candidates ``row, base, c`` with their features, whether they are a base span (``label``), touch one, and may be added (``sound``)."""
    spans = candidates.select("row", "base", "c.*")
    found = _plain(F.col("found"))  # formats as if written out
    count = F.length(_digits(found))
    flag = lambda c: c.cast("double")
    much = lambda pattern: F.length(F.regexp_replace(found, pattern, "")).cast("double")
    features = {
        **{f"f_{k}": flag(F.col("kind") == k) for k in KINDS},
        "f_digits": count.cast("double"),
        "f_length": F.length(F.regexp_replace(found, "[+@]", "")).cast("double"),
        "f_letters": much("[^A-Za-z]"),
        "f_dots": much(r"[^.]"),
        "f_gaps": much(r"[^\x20-]"),
        "f_slashes": much(r"[^\/]"),
        "f_brackets": flag(F.regexp_like(found, F.lit(r"[()\[\]{}]"))),
        "f_groups": F.size(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "f_longest": F.array_max(F.transform(F.regexp_extract_all(found, F.lit("[0-9]+"), F.lit(0)), F.length)).cast("double"),
        "f_digits_before": flag(F.regexp_like("before", F.lit(r"[0-9][\x20().\/+-]{0,2}$"))),
        "f_digits_after": flag(F.regexp_like("after", F.lit(r"^[\x20().\/-]{0,2}[0-9]"))),
        "f_joined": flag(F.regexp_like("before", F.lit(r"[a-z0-9=\x22'#_]$"))),
        "f_goes_on": flag(F.regexp_like("after", F.lit(r"^[a-z0-9\x22'#_]"))),
        **{f"f_near_{w}": flag(F.regexp_like("before", F.lit(rf"\b{w}"))) for w in CONTEXT_WORDS},
    }
    same = F.exists("base", lambda b: (b["kind"] == F.col("kind")) & (b["start"] == F.col("start")) & (b["end"] == F.col("end")))
    touches = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return spans.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in features.items()}).select(
        "row", "kind", "start", "end", same.cast("double").alias("label"), touches.alias("touches"),
        ((F.col("kind") != "card") | luhn(F.col("found"))).alias("sound"), *features,
    )


@dataclass(frozen=True)
class Judge:
    """Boosted trees over the features, and the least score of each kind."""

    model: object
    names: list[str]
    thresholds: dict[str, float]

    def scored(self, candidates: DataFrame) -> DataFrame:
        judged = VectorAssembler(inputCols=self.names, outputCol="features").transform(candidates)
        return self.model.transform(judged).withColumn("score", vector_to_array("probability")[1])


def train_judge(candidates: DataFrame, boosting: Boosting) -> Judge | None:
    """A judge learnt from three quarters of all candidates and calibrated on the others; None unless it has base spans and others to learn from."""
    names = [c for c in candidates.columns if c.startswith("f_")]
    draw = F.xxhash64("row", "start", "end", "kind", F.lit(boosting.seed))
    # What overlaps a base span without being one says nothing, and neither does a sound card number that
    # only its neighbours keep from being one: both are left out.
    unclear = F.col("touches") | (F.col("kind") == "card") & F.col("sound")
    clear = candidates.filter((F.col("label") == 1) | ~unclear).withColumn("draw", draw)
    learning = clear.filter(F.pmod("draw", F.lit(4)) != 0)
    if learning.select("label").distinct().count() < 2:
        return None
    judged = VectorAssembler(inputCols=names, outputCol="features")
    model = GBTClassifier(maxIter=boosting.rounds, maxDepth=boosting.depth, seed=boosting.seed).fit(judged.transform(learning))
    untold = Judge(model, names, {}).scored(clear.filter(F.pmod("draw", F.lit(4)) == 0))
    steps = untold.groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("step")).agg(F.sum("label").alias("right"), F.count("*").alias("all")).collect()
    thresholds = {}
    for kind in KINDS:
        threshold, right, every = 1.01, 0.0, 0
        for r in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):  # 101 rows a kind at most
            right, every = right + r.right, every + r["all"]
            if right >= boosting.precision * every:
                threshold = r.step / 100
        thresholds[kind] = threshold
    return Judge(model, names, thresholds)


def _better(one: Column, other: Column) -> Column:
    """Whether a candidate stays rather than another that overlaps it: by score, then length, then place, then kind."""
    rank = lambda s: F.struct(-s["score"], s["start"] - s["end"], s["start"], s["kind"])
    return rank(one) < rank(other)


def resolved(found: Column) -> Column:
    """Of overlapping candidates ``struct<score, start, end, kind>`` those that stay, best first."""
    ranked = F.array_sort(found, lambda a, b: F.when(_better(a, b), -1).when(_better(b, a), 1).otherwise(0))
    none = F.slice(ranked, F.lit(1), F.lit(0))

    def add(kept: Column, one: Column) -> Column:
        free = ~F.exists(kept, lambda k: (k["start"] < one["end"]) & (one["start"] < k["end"]))
        return F.when(free, F.concat(kept, F.array(one))).otherwise(kept)

    return F.aggregate(ranked, none, add)


def find_personal_data(docs: DataFrame, boosting: Boosting = Boosting()) -> DataFrame:  # noqa: B008
    """``doc_id, base, added`` per row of ``docs(doc_id, text)``: arrays of ``kind, start, end``.

    Positions count code points of the whole text, ends excluded.  ``base`` has
    the kinds in their order, then by start.  A null text counts as empty and
    has no spans.  Repeated rows give repeated results; a null ``doc_id`` gets
    a result of its own; an empty table gives no rows; further columns are not
    read.  Without candidates of both sorts to learn from, nothing is added.
    Added spans touch neither base spans nor each other.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # One reading of the texts gives the base spans and the candidates; the row number is written with them.
    read = rows.select("doc_id", base_spans(F.col("text")).alias("base"), _proposed(F.col("text")).alias("proposed"))
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    candidates = written(_judged_by(read.select("row", "base", F.explode("proposed").alias("c"))), "pii-candidates")
    judge = train_judge(candidates, boosting)
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    if judge is None:
        return read.select("doc_id", "base", none.alias("added"))
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in judge.thresholds.items()])
    beyond = judge.scored(candidates.filter(~F.col("touches") & F.col("sound"))).filter(F.col("score") >= least)
    per_row = beyond.groupBy("row").agg(F.collect_list(F.struct("score", "start", "end", "kind")).alias("found"))  # of one text
    kept = F.sort_array(F.transform(resolved(F.col("found")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    added = per_row.select("row", F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("added"))
    out = read.select("row", "doc_id", "base").join(added, "row", "left")
    return out.select("doc_id", "base", F.coalesce("added", none).alias("added"))
