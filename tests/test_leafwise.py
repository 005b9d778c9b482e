"""Leaf-wise trees against a plain version on the driver, and against depth-wise trees."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintwise.ml import leafwise, metrics, models
from stintwise.ml.leafwise import Growth, train_leafwise

FEATURES = ["a", "b", "d"]


def rows(n=1500, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a, b, d = rng.random() * 10, float(rng.randrange(6)), rng.gauss(0, 1)
        y = int(rng.random() < (0.85 if (a > 6) != (b >= 3) else 0.1))
        out.append((k, a, b, None if k % 50 == 0 else d, y, k % 5 == 0, 1.0 + (y == 1)))
    return out


def table(spark, data):
    return spark.createDataFrame(data, "id int, a double, b double, d double, y int, held boolean, w double").repartition(3)


def plain_tree(binned, grad, hess, growth):
    """Best-first growth by sorting rows into leaves one split at a time: predictions of each row."""

    def best(own):
        g, h = grad[own].sum(), hess[own].sum()
        found = (0.0, -1, -1)
        for f in range(binned.shape[1]):
            for upto in range(int(binned[:, f].max())):
                left = own[binned[own, f] <= upto]
                right = own[binned[own, f] > upto]
                if min(len(left), len(right)) < growth.least_rows:
                    continue
                gl, hl, gr, hr = grad[left].sum(), hess[left].sum(), grad[right].sum(), hess[right].sum()
                gain = gl**2 / hl + gr**2 / hr - g**2 / h
                if gain > found[0] + 1e-9:
                    found = (gain, f, upto)
        return found

    leaves = [(np.arange(len(binned)), 0)]
    splits = [best(leaves[0][0])]
    while len(leaves) < growth.leaves and max(s[0] for s in splits) > 1e-9:
        k = int(np.argmax([s[0] for s in splits]))
        (own, depth), (_, f, upto) = leaves[k], splits[k]
        parts = [own[binned[own, f] <= upto], own[binned[own, f] > upto]]
        leaves[k : k + 1] = [(p, depth + 1) for p in parts]
        splits[k : k + 1] = [best(p) if depth + 1 < growth.depth else (0.0, -1, -1) for p in parts]
    out = np.zeros(len(binned))
    for own, _ in leaves:
        out[own] = -growth.step * grad[own].sum() / hess[own].sum()
    return out


@pytest.mark.parametrize(("leaves", "depth"), [(5, 6), (12, 3), (31, 5)])
def test_first_tree_is_that_of_plain_best_first_growth(spark, leaves, depth):
    data = rows()
    growth = Growth(rounds=1, leaves=leaves, depth=depth, step=0.3, bins=16, least_rows=15, share=1.0)
    model = train_leafwise(table(spark, data), "y", FEATURES, "held", "w", growth)
    train = [r for r in data if not r[5]]
    binned = model.binned([np.array([r[k] or 0.0 for r in train]) for k in (1, 2, 3)])
    y, w = np.array([r[4] for r in train], float), np.array([r[6] for r in train])
    p = 1 / (1 + np.exp(-model.start))
    want = plain_tree(binned, w * (p - y), w * p * (1 - p), growth)
    assert model.trees[0].add(binned) == pytest.approx(want, abs=1e-9)
    assert (model.trees[0].feature < 0).sum() <= leaves


def test_stops_without_gain_and_keeps_the_best_round(spark):
    data = [(k, *[random.Random(k).random() for _ in range(3)], k % 2, k % 3 == 0, 1.0) for k in range(400)]  # labels are noise
    model = train_leafwise(table(spark, data), "y", FEATURES, "held", "w", Growth(rounds=40, leaves=8, patience=3, bins=16, refresh=2))
    assert len(model.held_out_auc) < 40 and len(model.trees) == int(np.argmax(model.held_out_auc)) + 1


def test_scores_as_good_as_depth_wise_trees(spark):
    df = table(spark, rows(3000)).withColumn("session_key", F.lit(1)).withColumn("driver_number", F.col("id")).withColumn("lap_number", F.lit(1))
    train, held = df.where("id % 5 <> 1").drop("held"), df.where("id % 5 = 1")
    size = models.TrainingSize(rounds=8, depth=3, step=0.3, leaves=8, patience=5)
    auc = lambda m: metrics.auc(models.with_probability(m, held.fillna(0.0, ["d"]), "p"), "p", "y").first().auc
    first, second = models.train_gbt(train, "y", FEATURES, size), models.train_second_base(train, "y", FEATURES, size)
    assert auc(second) >= 0.8 and auc(second) >= auc(first) - 0.01


def test_odd_tables(spark):
    one = [(k, 1.0, 1.0, None, 1, False, 1.0) for k in range(30)]
    model = train_leafwise(table(spark, one), "y", FEATURES, "held", "w", Growth(rounds=2))
    assert not model.trees and model.probability(table(spark, one), "p").agg(F.min("p")).first()[0] > 0.99
    empty = train_leafwise(table(spark, one).limit(0), "y", FEATURES, "held", "w", Growth(rounds=2))
    assert not empty.trees
    none_held = train_leafwise(table(spark, [(*r[:5], False, r[6]) for r in rows(300)]), "y", FEATURES, "held", "w", Growth(rounds=2, bins=8))
    assert len(none_held.trees) == 2
    assert leafwise.Tree(*[np.array([-1])] * 4, np.array([2.0])).add(np.zeros((3, 1), np.uint8)).tolist() == [2.0] * 3
