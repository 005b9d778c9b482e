import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.llm.toxicity import Training, fit, held_out, toxicity

VOCABULARY = [f"wort{k}" for k in range(300)]


def corpus(n, seed=1):
    """Toxic: an insult and a group named in one text; either alone is not."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(VOCABULARY, k=rng.randrange(10, 60))
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        if insult:
            words.insert(rng.randrange(len(words)), rng.choice(["Idioten", "scum,"]))
        if group:
            words.insert(rng.randrange(len(words)), rng.choice(["plumbers", "Élèves."]))
        out.append((i, " ".join(words), int(insult and group)))
    return out


def test_learns_what_pairs_of_terms_mean(spark, documents):
    rows = corpus(2500)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity(documents([(i, t) for i, t, _ in rows]), labels).toPandas().sort_values("doc_id")
    truth = np.array([y for *_, y in rows])
    unseen = got["held_out"].to_numpy()
    assert 0.15 < unseen.mean() < 0.35
    hits = (got["predicted"].to_numpy() == truth)[unseen]
    assert hits.mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_labels_of_held_out_rows_change_nothing(spark, documents):
    rows = corpus(400, seed=2)
    docs = documents([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    quick = Training(rounds=20)
    first, second = (toxicity(docs, x, training=quick).orderBy("doc_id").collect() for x in (labels, turned))
    assert [r.predicted for r in first] == [r.predicted for r in second]
    assert np.allclose([r.score for r in first], [r.score for r in second])


@pytest.mark.parametrize("known", [[], [(1, 1)], [(1, None), (None, 1), (6, 0), (6, 1)]])
def test_odd_rows(spark, documents, odd_pairs, known):
    labels = spark.createDataFrame(known, "doc_id long, toxic int")
    got = toxicity(documents(odd_pairs), labels, training=Training(rounds=5)).collect()
    assert len(got) == len(odd_pairs) and all(0 <= r.score <= 1 for r in got)
    assert toxicity(documents(odd_pairs).limit(0), labels).count() == 0


def test_fit_needs_both_labels():
    machine = fit(np.zeros(5, int), [np.arange(3)] * 5, Training())
    assert len(machine.buckets) == 0 and machine.bias < 0


def test_held_out_is_by_crc(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_training_takes_little_memory():
    rng = np.random.default_rng(1)
    labels = np.arange(2000) % 2
    lists = [np.unique(np.append(rng.integers(0, 1 << 22, 700), 5 + y)).astype(np.int32) for y in labels]
    tracemalloc.start()
    machine = fit(labels, lists, Training())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {5, 6} <= set(machine.buckets.tolist()) and most < 100 << 20
