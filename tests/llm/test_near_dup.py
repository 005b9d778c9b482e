import random
import re

import numpy as np
import pytest

from stintwise.llm.graph import components
from stintwise.llm.near_dup import MISS, Forest, near_duplicates

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = SPLIT.findall(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(pairs, percent):
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(pairs)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both) and None not in (pairs[x][0], pairs[y][0]):
                root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [
        (i, len(sets[k]), None if i is None else least[find(k)] if sets[k] else i, i is None or not sets[k] or least[find(k)] == i)
        for k, (i, _) in enumerate(pairs)
    ]


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(400)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    boiler = prose(60)
    out = []
    for _ in range(40):
        base = prose(rng.randrange(20, 150))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += [" ".join([*boiler, *prose(rng.randrange(5, 60))]) for _ in range(60)]
    hot = prose(200)
    for _ in range(150):
        copy = list(hot)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        out.append("\n".join(copy))
    passage = prose(40)
    out += [" ".join([*prose(rng.randrange(0, 12)), *passage, *prose(rng.randrange(0, 6))]) for _ in range(120)]
    out += [out[3]] * 30 + ["A b"] * 3 + ["a B", "", "  "]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("percent", [85, 80, 60])
def test_same_components_as_brute_force(documents, percent):
    pairs = corpus()
    got = [tuple(r) for r in near_duplicates(documents(pairs, 7), percent).drop("record").collect()]
    assert order(got) == order(brute(pairs, percent))


def test_odd_rows(documents, odd_pairs):
    got = [tuple(r) for r in near_duplicates(documents(odd_pairs)).drop("record").collect()]
    assert order(got) == order(brute(odd_pairs, 80))
    assert near_duplicates(documents(odd_pairs).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {k: k for e in links for k in e}
    for _ in range(60):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {k for a, b in links if a != b for k in (a, b)}
    assert sorted(tuple(r) for r in got) == sorted((k, root[k]) for k in linked)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_pairs_at_the_threshold_share_a_label(percent):
    forest = Forest(percent)
    coarse = forest.chosen()[:, : forest.depth]
    assert len(np.unique(coarse)) == coarse.size and forest.chosen().max() < forest.places <= 1024
    assert (1 - (percent / 100) ** forest.depth) ** forest.trees <= MISS


@pytest.mark.parametrize("percent", [80, 85])
def test_simulated_pairs_share_a_label(percent):
    forest = Forest(percent)
    chosen, draws, missed = forest.chosen()[:, : forest.depth], np.random.default_rng(3), 0
    for _ in range(20):
        same = draws.random((20_000, chosen.max() + 1), dtype=np.float32) < percent / 100
        missed += np.count_nonzero(~same[:, chosen].all(axis=2).any(axis=1))
    assert missed <= 4
