import math
import re
from collections import Counter

import numpy as np
import pytest

from stintwise.llm import ranked
from stintwise.llm.ranked import Best, Block, Searching, Vocabulary, rank
from stintwise.llm.words import Hasher

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    full = sum(bool(c) for _, c in counted)
    every = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counted:
            n, score = sum(c.values()), 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * full + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * full // every)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def as_rows(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


ITEMS = [
    (1, "Plain words in a row"),
    (1, "Plain words in a row"),
    (1, "another text of item one: w17 and 40"),
    (2, None),
    (3, ""),
    (4, "é no such thing, ① PLAIN"),
    (None, "no id, w3 w4 w5"),
    (5, "zzz"),
]


def test_odd_rows(spark, documents, odd_pairs):
    items = spark.createDataFrame([(*x, "y") for x in ITEMS], "item_id long, text string, score string")
    assert as_rows(rank(documents(odd_pairs), items)) == brute(odd_pairs, ITEMS)


@pytest.mark.parametrize("searching", [Searching(), Searching(window=4, block_postings=150, short_share=0.3), Searching(k=3, block_terms=20, window=16)])
def test_many_documents_in_blocks(spark, documents, searching):
    rng = np.random.default_rng(12)
    vocabulary = [f"t{k}" for k in range(300)]
    chance = 1 / np.arange(1, 301)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=chance / chance.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(400)]
    docs += [(i, docs[5][1]) for i in range(400, 460)]  # a text that many ids share, hence ties
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(30)]
    found = rank(documents(docs), spark.createDataFrame(items, "item_id long, text string"), searching)
    assert as_rows(found) == brute(docs, items, searching.k)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rank(documents([(1, "a")]), none).count() == 0
    assert rank(documents([(1, "a")]).limit(0), some).count() == 0
    assert rank(documents([(1, None), (2, "")]), some).count() == 0


def test_long_lists_are_skipped():
    """With ten good documents known, lists that every document is in are read for few of them."""
    docs, window = 20_000, 500
    rng = np.random.default_rng(1)
    common = [np.arange(docs)] * 3
    rare = [np.sort(rng.choice(docs, 15, replace=False)) for _ in range(4)]
    place = np.concatenate([*common, *rare])
    term = np.repeat(np.arange(7), [len(x) for x in (*common, *rare)])
    impact = np.where(term < 3, rng.integers(1, 50, len(place)), 1000)
    block = Block(np.arange(docs), place, term, impact, Searching(window=window))
    best = Best(10)
    block.search(np.arange(7), best)
    score = np.zeros(docs, np.int64)
    np.add.at(score, place, impact)
    want = np.lexsort((np.arange(docs), -score))[:10]
    assert best.doc.tolist() == want.tolist() and best.score.tolist() == score[want].tolist()
    assert block.read < len(place) / 4


def test_vocabulary_compares_bytes(monkeypatch):
    v = Vocabulary(["ab", "abc", "é"])
    raw = np.frombuffer("ab abc é abd".encode(), np.uint8)
    starts, ends = np.array([0, 3, 7, 10]), np.array([2, 6, 9, 13])
    assert v.find(raw, starts, ends, Hasher(raw)(starts, ends)).tolist() == [0, 1, 2, -1]
    same = np.repeat(v.sorted[:1], 4)  # a hash of another word finds nothing
    assert sorted(v.find(raw, starts, ends, same).tolist())[:3] == [-1, -1, -1]
    assert ranked.TERM.startswith("[^")
