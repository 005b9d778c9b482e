import numpy as np
from pyspark.sql import functions as F

from stintwise.llm.topk import exact_top_k, quantised


def brute(rows, asks, k):
    out = []
    for q, v in rows:
        if asks(q):
            scored = [(int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
            out += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def test_same_as_brute_force_with_ties_and_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-40, 40, 12).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 400)]  # a vector that many ids share
    rows += [(400, [0] * 12), (401, [1, 2, 3]), (402, [3, 2, 1]), (403, []), (404, [])]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1]), (405, None)], "vec_id long, vector array<long>")
    found = exact_top_k(df, F.col("vec_id") % 3 == 0, k=5, block_rows=64, query_rows=32).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, lambda i: i % 3 == 0, 5)


def test_large_scores_are_exact(spark):
    rows = [(0, [2**30, 1]), (1, [2**30, 1]), (2, [2**30, 2]), (3, [2**30, -3])]
    found = exact_top_k(spark.createDataFrame(rows, "vec_id long, vector array<long>"), F.col("vec_id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [(2, 2**60 + 2), (1, 2**60 + 1)]


def test_quantised_and_empty(spark):
    df = spark.createDataFrame(
        [(1, [0.5, -0.001]), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, None), (5, [float("inf")])], "vec_id long, e array<float>"
    )
    got = {r.vec_id: r.q for r in df.select("vec_id", quantised(F.col("e")).alias("q")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}
    none = df.select("vec_id", quantised(F.col("e")).alias("vector")).limit(0)
    assert exact_top_k(none, F.col("vec_id") == 0).count() == 0
