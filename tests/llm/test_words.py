import random
import re

import numpy as np
import pyarrow as pa

from stintwise.llm.bits import bit_filter, may_hold
from stintwise.llm.words import shingle_sets, slices, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB cé\t\n Ü\x0b.") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, " "]
    column = pa.array(["skipped", *texts]).slice(1)
    seen = {}
    for part in slices(column, limit=200):
        found = words(part)
        for k in range(part.rows):
            own = found.row == k
            want = SPLIT.findall(lower(texts[part.start + k] or ""))
            raw = [part.buf[a:b].tobytes().decode() for a, b in zip(found.starts[own], found.ends[own], strict=True)]
            assert [lower(w) for w in raw] == want
            for w, h in zip(want, found.hash[own], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingle_sets_count_distinct_windows():
    texts = ["a b c d e f", "a b c d e a b c d e a b c d e", "A b", "a B", "a b c d e", None, "a b c"]
    sets = [s for part in slices(pa.array(texts), 8) for s in shingle_sets(part)]
    assert [len(s) for s in sets] == [2, 5, 1, 1, 1, 0, 1]
    assert sets[2][0] == sets[3][0] != sets[6][0]
    assert sets[4][0] in sets[0] and sets[4][0] in sets[1]


def test_bit_filter_never_misses(spark):
    df = spark.range(5000).selectExpr("xxhash64(id) AS h")
    held = np.array([r.h for r in df.collect()], np.int64)
    bits = bit_filter(df, "h", bits=18)
    assert may_hold(bits, held).all()
    other = np.array([r.h for r in spark.range(10_000, 15_000).selectExpr("xxhash64(id) AS h").collect()], np.int64)
    assert may_hold(bits, other).mean() < 0.05
