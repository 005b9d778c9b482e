import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.llm import lm_score
from stintwise.llm.lm_score import Model, build_filter, count_ngrams, lm_scores, read_levels
from stintwise.llm.words import mix, unmix
from stintwise.session import writing_to

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HELD_OUT = "crc32(coalesce(cast(doc_id AS string), '')) % 10 = 0"


def held_out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0


def tokens(text):
    return [*WORD.findall((text or "").translate(FOLD)), None]


def brute(pairs, model):
    """The contract's columns and the score with quantised counts of a table in place of the filter."""
    train = [tokens(t) for i, t in pairs if not held_out(i)]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([None, *t], t, strict=False))
    two = {p: n for p, n in two.items() if n >= model.least_pairs}
    n, v = sum(one.values()), len(one)
    values = model.counts()
    rough = lambda c: values[model.levels(np.array([c]))[0]] if c else 0.0
    out = []
    for i, text in pairs:
        t = tokens(text)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        score = 0.0
        for a, b in zip([None, *t], t, strict=False):
            before, word = rough(one[a]), rough(one[b])
            pair = min(rough(two.get((a, b), 0)), before) if before and word else 0.0
            score += math.log10((pair + model.weight * (word + 0.1) / (n + 0.1 * (v + 1))) / (before + model.weight))
        out.append((i, held_out(i), len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


def check(df, pairs, model, score_too=True):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    got = sorted([tuple(r) for r in df.collect()], key=key)
    want = sorted(brute(pairs, model), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    if score_too:
        assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-9)


#: So many bits that no probe errs on the small tables here.
ROOMY = {"bits_per_key": 4096, "weight": 20.0}


@pytest.mark.parametrize("model", [Model(**ROOMY), Model(**ROOMY, most_frequent=3, buffered=50), Model(**ROOMY, most_bytes=1 << 24, most_frequent=0)])
def test_same_as_tables_of_counts(spark, documents, odd_pairs, model):
    check(lm_scores(documents(odd_pairs), HELD_OUT, model), odd_pairs, model)


def some_texts(n=600):
    rng = np.random.default_rng(11)
    words = [f"Word{k}" for k in range(400)]
    chance = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 80)), p=chance / chance.sum())) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[3]) for i in range(200)]


def test_filter_beyond_one_broadcast_gives_the_same(spark, documents):
    docs = documents(some_texts())
    one = {r.doc_id: r for r in lm_scores(docs, HELD_OUT).collect()}
    many = {r.doc_id: r for r in lm_scores(docs, HELD_OUT, Model(most_bytes=1 << 17, most_frequent=20, bits_per_key=400)).collect()}
    roomy = {r.doc_id: r for r in lm_scores(docs, HELD_OUT, Model(bits_per_key=400)).collect()}
    assert all(many[i].score == pytest.approx(roomy[i].score, rel=1e-9) and many[i].n_known == one[i].n_known for i in one)
    check(lm_scores(docs, HELD_OUT), some_texts(), Model(), score_too=False)


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in (blocks.apply(k).name() for k in range(blocks.size())) if name.startswith("shuffle_")}


def test_filter_beyond_one_broadcast_needs_little_disk(spark, documents, tmp_path):
    """Texts of their own words: nearly each pair of words occurs once in its text, and goes to the filter."""
    rng = np.random.default_rng(12)
    texts = [" ".join(f"word{k}" for k in rng.zipf(1.3, 400) % 5000) for _ in range(1500)]
    docs = documents(list(enumerate(texts)))
    before = shuffle_files(spark)
    with writing_to(str(tmp_path)):
        lm_scores(docs, HELD_OUT, Model(most_bytes=1 << 17))
    kept = sum(f.stat().st_size for f in Path(tmp_path).rglob("*") if f.is_file())
    assert kept < sum(map(len, texts))
    assert shuffle_files(spark) <= before


@pytest.mark.parametrize("block", [200, 3000])
def test_blocks_of_any_size_and_parts_of_segments_give_the_same(spark, documents, odd_pairs, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_score, "PART", 3)
    pairs = [*some_texts(100), *odd_pairs]
    docs = documents(pairs)
    key = lambda r: (repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score)
    whole, parts = ([key(r) for r in lm_scores(docs, HELD_OUT, Model(bits_per_key=200, most_bytes=m, most_frequent=50)).collect()] for m in (1 << 28, 1 << 20))
    assert sorted(whole) == sorted(parts)


def test_numbers_of_keys():
    numbers = np.unique(mix(np.arange(70_000, dtype=np.uint64)))
    assert (lm_score._open(memoryview(lm_score._close(numbers))) == numbers).all()
    assert (np.sort(unmix(numbers)) == np.arange(70_000)).all()


def test_settings_are_given_back(spark, documents):
    keys = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k, None) for k in keys]
    lm_scores(documents([(1, "a b")]), HELD_OUT)
    assert [spark.conf.get(k, None) for k in keys] == before


def test_levels_are_never_too_low_and_seldom_too_high(spark, documents):
    model = Model()
    ngrams = count_ngrams(documents(some_texts()), model).cache()
    held = build_filter(ngrams, model)
    found = ngrams.toPandas()
    words = held.load(0)
    want = model.levels(found["n"].to_numpy())
    got = read_levels(words, found["key"].to_numpy(np.int64).view(np.uint64), held.segments)
    assert (got >= want).all()
    assert (got > want).mean() < 0.05
    others = np.random.default_rng(5).integers(1, 1 << 63, 200_000).astype(np.uint64)
    assert (read_levels(words, others, held.segments) > 0).mean() < 0.02


def test_filter_at_its_intended_load(spark):
    """As many keys as make several segments full: what the false-positive share is at 16 bits a key."""
    keys = spark.range(400_000).select(F.xxhash64("id").alias("key"), F.lit(1).cast("long").alias("n"))
    held = build_filter(keys, Model())
    assert held.segments > 4
    words = held.load(0)
    others = np.random.default_rng(6).integers(1, 1 << 63, 300_000).astype(np.uint64)
    assert (read_levels(words, others, held.segments) > 0).mean() < 0.01


def test_empty_tables(spark, documents):
    assert lm_scores(documents([(1, "a")]).limit(0), HELD_OUT).count() == 0
    only_held_out = [(i, "a b") for i in range(60) if held_out(i)]
    check(lm_scores(documents(only_held_out), HELD_OUT), only_held_out, Model())


def test_levels_and_counts():
    model = Model()
    steps, counts = model.steps(), model.counts()
    assert steps[:5].tolist() == [1, 2, 3, 4, 6] and len(counts) == len(steps) + 1 <= 64
    assert counts[:6].tolist() == [0, 1, 2, 3, 4.5, 6.5]
    assert (np.diff(counts) > 0).all()


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scores(docs, HELD_OUT).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.2 * got[2]
