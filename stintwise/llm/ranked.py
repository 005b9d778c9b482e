"""Ranked lexical search: short lists are summed first, long lists are skipped through document by document.

One pass turns every document into its number of terms and the occurrences of
the terms that items ask for; a term's weight needs the counts of the whole
table, so scores are made in a second pass over these narrow rows.  There, each
task inverts blocks of documents into posting lists.  For each item, the lists
that are short in the block are summed term by term into accumulators; these
are then one more sorted iterator with an upper bound, which goes along with the
long lists from document to document.  Windows of documents, and long lists
within a window, whose bounds cannot reach the k-th best score so far are not
read.  The best scores of a task go on from block to block, and only the ``k``
best of each task and item leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintwise.llm.rows import NO_ID
from stintwise.llm.words import Hasher, slices, words
from stintwise.session import written

# What a term is, and the constants of its score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, FLAT, LEAST_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 10, 90

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Searching:
    """``block_terms`` bounds the terms of the items searched for at once; further items take further passes.

    ``block_postings`` bounds the postings that a task holds, ``window`` is how
    many documents share a bound, and lists are short as long as together they
    have at most ``short_share`` of a block's documents.
    """

    k: int = 10
    block_terms: int = 1_000_000
    block_postings: int = 2_000_000
    window: int = 1024
    short_share: float = 0.125


class Vocabulary:
    """Terms by number; finds them among words of a slice, comparing all their bytes."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.ends = np.cumsum([0, *map(len, raw)])
        self.buf = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        hashes = Hasher(self.buf)(self.ends[:-1], self.ends[1:])
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        if (self.sorted[1:] == self.sorted[:-1]).any():
            raise ValueError("two terms have the same hash")

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        found = np.where(self.sorted[at] == hashes, self.order[at], -1)
        hit = np.flatnonzero(found >= 0)
        size = (ends - starts)[hit]
        own = self.ends[found[hit]]
        same = size == self.ends[found[hit] + 1] - own
        for n in np.unique(size[same]):
            rows = np.flatnonzero(same & (size == n))
            places = np.arange(n)
            same[rows] = (buf[starts[hit[rows]][:, None] + places] == self.buf[own[rows][:, None] + places]).all(1)
        found[hit[~same]] = -1
        return found


_FORWARD = "doc long, n long, terms array<int>, tfs array<int>"


def _forward(shared):
    """Per document: how many terms it has, and which of the vocabulary how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        many = len(vocabulary.order) + 1
        for batch in batches:
            for texts in slices(batch.column(1)):
                found = words(texts, separators=_BETWEEN)
                folded = np.where((texts.buf >= 0x41) & (texts.buf <= 0x5A), texts.buf + np.uint8(32), texts.buf)
                term = vocabulary.find(folded, found.starts, found.ends, found.hash)
                known = term >= 0
                pairs, tf = np.unique(found.row[known] * many + term[known], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(texts.rows + 1) * many).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % many, tf)]
                count = np.bincount(found.row, minlength=texts.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.start, texts.rows), pa.array(count.astype(np.int64)), *lists], ["doc", "n", "terms", "tfs"]
                )

    return run


class Best:
    """The best scores of one item so far, ties by document."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def needed(self) -> int:
        """What a document must reach to matter: the k-th best score, as it may win the tie."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        best = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[best], doc[best]


class Block:
    """Posting lists of some documents: ascending places of documents, and what each adds to a score."""

    def __init__(self, doc: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray, searching: Searching):
        order = np.argsort(term, kind="stable")
        self.doc, self.searching = doc, searching
        self.term, self.place, self.impact = term[order], owner[order], impact[order]
        self.edges = np.arange(0, len(doc) + searching.window, searching.window)
        self.read = 0

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Adds the documents that may be among the best for the terms of one item."""
        begin, end = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        by_size = np.argsort(end - begin, kind="stable")
        lists = [(self.place[a:b], self.impact[a:b]) for a, b in zip(begin[by_size], end[by_size], strict=True) if b > a]
        short = int(np.searchsorted(np.cumsum([len(p) for p, _ in lists]), self.searching.short_share * len(self.doc), "right"))
        if short > 1:
            place, impact = (np.concatenate(x) for x in zip(*lists[:short], strict=True))
            self.read += len(place)
            summed, at = np.unique(place, return_inverse=True)
            total = np.zeros(len(summed), np.int64)
            np.add.at(total, at, impact)
            lists = [(summed, total), *lists[short:]]
        if lists:
            self._along(lists, best)

    def _along(self, lists: list[tuple[np.ndarray, np.ndarray]], best: Best) -> None:
        cuts = np.stack([np.searchsorted(p, self.edges) for p, _ in lists])
        bounds = np.zeros((len(lists), len(self.edges) - 1), np.int64)
        for row, (_, impact), cut in zip(bounds, lists, cuts, strict=True):
            full = np.flatnonzero(cut[1:] > cut[:-1])
            row[full] = np.maximum.reduceat(impact, cut[full])
        whole = bounds.sum(0)
        for w in np.flatnonzero(whole):
            needed = best.needed
            if whole[w] < needed:
                continue
            weakest = np.argsort(bounds[:, w], kind="stable")
            below = np.cumsum(bounds[weakest, w])  # what the weakest lists add together at most
            optional = int(np.searchsorted(below, needed))  # lists that alone cannot make a document matter
            parts = [(lists[i][0][cuts[i, w] : cuts[i, w + 1]], lists[i][1][cuts[i, w] : cuts[i, w + 1]]) for i in weakest[optional:]]
            place, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            score = np.zeros(len(place), np.int64)
            np.add.at(score, at, np.concatenate([s for _, s in parts]))
            self.read += len(at)
            for nth in range(optional - 1, -1, -1):
                keep = score + below[nth] >= needed
                place, score = place[keep], score[keep]
                i = weakest[nth]
                own = lists[i][0][cuts[i, w] : cuts[i, w + 1]]
                if not len(place):
                    break
                if len(own):
                    at = np.minimum(np.searchsorted(own, place), len(own) - 1)
                    score = score + np.where(own[at] == place, lists[i][1][cuts[i, w] + at], 0)
                    self.read += len(place)
            reached = score >= needed
            if reached.any():
                best.add(score[reached], self.doc[place[reached]])


def _searched(items, weights, n_docs: int, n_terms: int, searching: Searching):
    """Each task's ``k`` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = items.value, weights.value
        best = [Best(searching.k) for _ in asked]
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def search() -> None:
            counts = np.concatenate([c for _, _, c, _, _ in waiting])
            doc, n, term, tf = (np.concatenate([part[i] for part in waiting]) for i in (0, 1, 3, 4))
            owner = np.repeat(np.arange(len(doc)), counts)
            length = LEAST_LENGTH + (LENGTH_SHARE * n * n_docs) // max(n_terms, 1)
            impact = weight[term] * ((SCALE * tf) // (FLAT * tf + 8 * length[owner]))
            block = Block(doc, owner, term, impact, searching)
            for terms, found in zip(asked, best, strict=True):
                block.search(terms, found)

        for batch in batches:
            lists = [batch.column(i) for i in (2, 3)]
            counts = np.diff(lists[0].offsets.to_numpy())
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), counts, term, tf))
            size += len(term)
            if size >= searching.block_postings:
                search()
                waiting, size = [], 0
        if size:
            search()
        for nth, found in enumerate(best):
            if len(found.doc):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.doc), nth)), pa.array(found.doc), pa.array(found.score)], ["item", "doc", "score"]
                )

    return run


def _rank_block(forward_of: DataFrame, asked: DataFrame, searching: Searching) -> DataFrame:
    """``item_id, doc, score``: the best of each task, for items with ``block_terms`` terms or so."""
    spark = forward_of.sparkSession
    found = asked.toArrow().to_pandas()
    names = sorted(found["term"].unique())
    number = {t: i for i, t in enumerate(names)}
    groups = found.assign(term=found["term"].map(number)).groupby(["item", "item_id"], dropna=False)["term"]
    items = [(key[1], np.sort(terms.to_numpy(np.int64))) for key, terms in groups]
    vocabulary = spark.sparkContext.broadcast(Vocabulary(names))
    forward = written(forward_of.mapInArrow(_forward(vocabulary), _FORWARD), "ranked-forward")
    totals = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row per term of the items
    weight = np.zeros(len(names), np.int64)
    for term, df in zip(held.column("term").to_pylist(), held.column("count").to_pylist(), strict=True):
        weight[term] = math.floor(1000 * math.log((2 * totals.docs + 2) / (2 * df + 1)))
    run = _searched(
        spark.sparkContext.broadcast([terms for _, terms in items]), spark.sparkContext.broadcast(weight), totals.docs, totals.terms, searching
    )
    out = forward.filter(F.size("terms") > 0).select("doc", "n", "terms", "tfs").mapInArrow(run, "item long, doc long, score long")
    ids = spark.createDataFrame([(i, None if key is None or key != key else int(key)) for i, (key, _) in enumerate(items)], "item long, item_id long")
    return out.join(F.broadcast(ids), "item").select("item", "item_id", "doc", "score")


def rank(docs: DataFrame, items: DataFrame, searching: Searching = Searching()) -> DataFrame:  # noqa: B008
    """``item_id, rank, doc_id, score``: the ``k`` best of all ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms, weights and scores are those of the module's constants; documents
    with score 0 are not listed.  Equal scores are ordered by ``doc_id``, null
    last.  Rows of documents that repeat are documents of their own; of items
    that repeat one counts, and items of one id but with different texts are
    items of their own, null ids too.  Null and empty texts have no terms: as
    documents they are never found, as items they find nothing.  Empty tables
    give no rows; further columns are not read.  Terms are found in whole
    texts, however long.
    """
    asked = (
        items.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .distinct()
        .select("item_id", F.xxhash64("item_id", "text").alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(TERM), F.lit(0)))).alias("term"))
    )
    asked = written(asked, "ranked-items")
    total = asked.count()
    if not total:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    blocks = 1 if total <= searching.block_terms else 2 * total // searching.block_terms + 1
    found = None
    for b in range(blocks):
        own = asked.filter(F.pmod("item", F.lit(blocks)) == b)
        part = _rank_block(rows, own, searching)
        if b:
            part = part.withColumn("item", F.col("item") + F.lit(b * (1 << 40)))
        found = part if found is None else found.unionByName(part)
    first = Window.partitionBy("item", "item_id").orderBy(F.desc("score"), "doc")
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= searching.k)
    return ranked.select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score")


RANK_SQL = """
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
    ), lengths AS (
        SELECT row_number() OVER () AS row_id, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0
    ), totals AS (
        SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM lengths
    ), asked AS (
        SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
    ), postings AS (
        SELECT row_id, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM lengths) AS u
        WHERE term IN (SELECT term FROM asked) GROUP BY row_id, doc_id, n, term
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
        FROM postings, totals GROUP BY term
    ), scored AS (
        SELECT a.item_id, a.text, p.row_id, p.doc_id,
            CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms)))) AS BIGINT) AS score
        FROM asked AS a JOIN postings AS p USING (term) JOIN weights USING (term), totals GROUP BY a.item_id, a.text, p.row_id, p.doc_id
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""
