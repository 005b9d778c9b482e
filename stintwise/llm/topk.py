"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks by a hash, queries into blocks of their own, and
each pair of blocks is one bounded task.  A task sorts its vectors once per
dimension and reads the lists of all dimensions downward, each from the end
that the query's sign prefers.  Vectors met on the way are scored in full; once
no unread vector can reach the k-th score, the query stops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_DEPTH = 32


def threshold_top(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, order: np.ndarray, ordered: np.ndarray):
    """The k best ``(score, id)`` of one block for one query, ties to the smaller id, and the depth read.

    ``order`` and ``ordered`` are the rows' indices and values, ascending per dimension.
    """
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    best_scores, best_ids = np.empty(0, vectors.dtype), np.empty(0, ids.dtype)
    seen = np.zeros(n, bool)
    depth, step = 0, FIRST_DEPTH
    while depth < n:
        to = min(n, depth + step)
        if len(up) or len(down):
            met = np.concatenate([order[n - to : n - depth, up].ravel(), order[depth:to, down].ravel()])
        else:  # a query of zeros prefers no order
            met, to = np.arange(n), n
        fresh = np.zeros(n, bool)
        fresh[met] = True
        fresh &= ~seen
        seen |= fresh
        rows = np.flatnonzero(fresh)
        rows = rows[ids[rows] != own]
        scores = np.concatenate([best_scores, vectors[rows] @ query])
        found = np.concatenate([best_ids, ids[rows]])
        keep = np.lexsort((found, -scores))[:k]
        best_scores, best_ids = scores[keep], found[keep]
        depth, step = to, step * 2
        bound = ordered[n - to, up] @ query[up] + ordered[to - 1, down] @ query[down]
        if len(best_ids) == k and bound < best_scores[-1]:
            break
    return best_scores, best_ids, depth


def _block_search(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(left) and len(right):
            vectors, queries = np.stack(left["vector"].to_numpy()), np.stack(right["question"].to_numpy())
            ids = left["vec_id"].to_numpy(np.int64)
            most = [int(np.abs(x).max(initial=0)) for x in (vectors, queries)]
            kind = np.float64 if most[0] * most[1] * max(1, vectors.shape[1]) < 1 << 53 else np.int64
            vectors, queries = vectors.astype(kind), queries.astype(kind)
            order = np.argsort(vectors, axis=0, kind="stable")
            ordered = np.take_along_axis(vectors, order, axis=0)
            for own, query in zip(right["query_id"].to_numpy(np.int64), queries, strict=True):
                scores, found, depth = threshold_top(vectors, ids, query, own, k, order, ordered)
                out += [(int(own), int(i), int(s), depth) for s, i in zip(scores, found, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "depth"])

    return search


def quantised(embedding: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component; null for a vector that is null or holds a null or non-finite component."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = 4096, query_rows: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best partners of each query among all ``vectors(vec_id, vector)``.

    ``vector`` holds integers; rows with a null id or vector take no part, and
    only vectors of equal length are compared.  Repeated rows count once;
    different vectors under one id are candidates of their own, and a query
    never meets its own id.  Scores below 2**53 are exact in floating point,
    larger ones are computed as 64-bit integers.  An empty table gives no rows.
    Blocks are dealt by a hash of id and vector: a vector that many ids share
    spreads over all blocks.
    """
    sound = vectors.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    rows = sound.select("vec_id", "vector", is_query.alias("asks")).dropDuplicates(["vec_id", "vector"])
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = -(-n // block_rows) or 1, -(-asking // query_rows) or 1
    dims = F.size("vector").alias("dims")
    block = lambda count, seed: F.pmod(F.xxhash64("vec_id", "vector", F.lit(seed)), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))
    left = rows.select("vec_id", "vector", dims, block(blocks, 1).alias("block"), every(query_blocks).alias("query_block"))
    right = rows.filter("asks").select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("question"), dims,
        every(blocks).alias("block"), block(query_blocks, 2).alias("query_block"),
    )
    key = ["dims", "block", "query_block"]
    found = (
        left.groupBy(*key)
        .cogroup(right.groupBy(*key))
        .applyInPandas(_block_search(k), "query_id long, vec_id long, score long, depth long")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
