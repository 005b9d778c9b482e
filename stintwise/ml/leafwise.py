"""Leaf-wise boosted trees for a binary label.

Features become at most ``bins`` quantile bins.  A tree grows best-first: of all
leaves the one whose split gains most is split next, until there are ``leaves``
of them.  What a split gains depends on its leaf alone, so several candidates are
opened by one Spark job: each task sums gradients and curvatures of its rows by
(leaf, feature, bin), Spark adds the sums up, and the driver, which sees nothing
but these sums, finds the splits.  Only the smaller child of a split is summed;
its sibling is the parent less that child.  Which splits the tree keeps is
decided afterwards by taking them in order of gain, as if they had been opened
one by one.

Rounds end when the AUC on held-out rows has not risen for ``patience`` rounds;
the model keeps the trees up to the best round.  The running scores of all rows
are written down every ``refresh`` rounds, so a lost executor costs a few trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.session import written

c = F.col


@dataclass(frozen=True)
class Growth:
    """How trees grow; ``share`` of the features are looked at by each tree."""

    rounds: int = 400
    leaves: int = 63
    depth: int = 6
    step: float = 0.05
    bins: int = 255
    least_rows: int = 20
    least_curvature: float = 1e-3
    share: float = 0.8
    patience: int = 50
    refresh: int = 10
    seed: int = 42
    score_steps: int = 4096


@dataclass
class Node:
    """A leaf while ``feature`` is -1; else rows with a bin up to ``upto`` go left."""

    depth: int
    grad: float
    hess: float
    rows: int
    feature: int = -1
    upto: int = -1
    gain: float = 0.0
    left: int = -1
    right: int = -1
    sums: np.ndarray | None = None


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: node 0 is the root, leaves have feature -1 and a value."""

    feature: np.ndarray
    upto: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf_of(self, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            node = at[rows]
            left = binned[rows, self.feature[node]] <= self.upto[node]
            at[rows] = np.where(left, self.left[node], self.right[node])
        return at

    def add(self, binned: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(binned)]


def best_split(sums: np.ndarray, growth: Growth, features: np.ndarray) -> tuple[float, int, int]:
    """``gain, feature, upto`` of the best split of a leaf with ``sums[feature, bin, (gradient, curvature, rows)]``."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(0)
    right = whole - left
    fits = (left[..., 2] >= growth.least_rows) & (right[..., 2] >= growth.least_rows)
    fits &= (left[..., 1] >= growth.least_curvature) & (right[..., 1] >= growth.least_curvature)
    allowed = np.zeros(len(sums), bool)
    allowed[features] = True
    fits &= allowed[:, None]
    if not fits.any():
        return 0.0, -1, -1
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - whole[0] ** 2 / whole[1]
    gain = np.where(fits, gain, -np.inf)
    at = int(np.argmax(gain))
    found = float(gain.flat[at])
    return (found, *map(int, divmod(at, gain.shape[1]))) if found > 1e-9 else (0.0, -1, -1)


def _packed(nodes: list[Node], growth: Growth) -> Tree:
    value = [-growth.step * n.grad / n.hess if n.hess > 0 else 0.0 for n in nodes]
    # A leaf may know its best split without having been opened.
    columns = [[n.feature if n.left >= 0 else -1 for n in nodes], [n.upto for n in nodes], [n.left for n in nodes], [n.right for n in nodes]]
    return Tree(*[np.array(x, np.int64) for x in columns], np.array(value))


def _kept(nodes: list[Node], leaves: int) -> list[Node]:
    """The nodes of the best-first tree among all that were opened: splits in order of gain until there are enough leaves."""
    chosen: set[int] = set()
    waiting = [(-nodes[0].gain, 0)] if nodes[0].left >= 0 else []
    while waiting and len(chosen) + 1 < leaves:
        _, at = heapq.heappop(waiting)
        chosen.add(at)
        for child in (nodes[at].left, nodes[at].right):
            if nodes[child].left >= 0:
                heapq.heappush(waiting, (-nodes[child].gain, child))
    out: list[Node] = []

    def copy(at: int) -> int:
        old = nodes[at]
        own = Node(old.depth, old.grad, old.hess, old.rows)
        place = len(out)
        out.append(own)
        if at in chosen:
            own.feature, own.upto, own.gain = old.feature, old.upto, old.gain
            own.left = copy(old.left)
            own.right = copy(old.right)
        return place

    copy(0)
    return out


def _next_open(nodes: list[Node], leaves: int) -> list[int]:
    """Unopened leaves that best-first growth may reach: no more than it has splits left among the better ones."""
    taken, found = 0, []
    waiting = [(-nodes[0].gain, 0)] if nodes[0].feature >= 0 else []
    while waiting and taken + 1 < leaves:
        _, at = heapq.heappop(waiting)
        taken += 1
        if nodes[at].left < 0:
            found.append(at)
            continue
        for child in (nodes[at].left, nodes[at].right):
            if nodes[child].feature >= 0:
                heapq.heappush(waiting, (-nodes[child].gain, child))
    return found


def grow(sum_up, n_features: int, growth: Growth, features: np.ndarray) -> Tree:
    """One tree.  ``sum_up(tree, wanted)`` gives the sums of rows by wanted leaf: an array per leaf."""
    root = Node(0, 0.0, 0.0, 0)
    nodes = [root]
    _measured(root, sum_up(_packed(nodes, growth), [0])[0], growth, features)
    while opened := _next_open(nodes, growth.leaves):
        smaller = []
        for at in opened:
            node = nodes[at]
            head = node.sums[node.feature, : node.upto + 1].sum(0)
            tail = node.sums[node.feature, node.upto + 1 :].sum(0)
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [Node(node.depth + 1, *head[:2], int(head[2])), Node(node.depth + 1, *tail[:2], int(tail[2]))]
            smaller.append(node.left if head[2] <= tail[2] else node.right)
        deep = [at for at in opened if nodes[at].depth + 1 < growth.depth]
        wanted = [s for at, s in zip(opened, smaller, strict=True) if nodes[at].depth + 1 < growth.depth]
        found = sum_up(_packed(nodes, growth), wanted) if wanted else []
        for at, one, sums in zip(deep, wanted, found, strict=True):
            other = nodes[at].left + nodes[at].right - one
            _measured(nodes[one], sums, growth, features)
            _measured(nodes[other], nodes[at].sums - sums, growth, features)
        for at in opened:
            nodes[at].sums = None
    return _packed(_kept(nodes, growth.leaves), growth)


def _measured(node: Node, sums: np.ndarray, growth: Growth, features: np.ndarray) -> None:
    node.grad, node.hess, node.rows = (*sums[0].sum(0)[:2], int(sums[0].sum(0)[2]))
    if node.depth < growth.depth:
        node.sums = sums
        node.gain, node.feature, node.upto = best_split(sums, growth, features)


def histogram(binned: np.ndarray, leaf: np.ndarray, wanted: list[int], grad: np.ndarray, hess: np.ndarray, bins: int) -> np.ndarray:
    """``sums[wanted, feature, bin, (gradient, curvature, rows)]`` of some rows."""
    place = np.full(int(leaf.max(initial=0)) + 1, -1)
    for k, w in enumerate(wanted):
        if w < len(place):
            place[w] = k
    own = place[leaf] >= 0
    nth, n_features = place[leaf[own]], binned.shape[1]
    out = np.empty((len(wanted), n_features, bins, 3))
    for f in range(n_features):
        key = nth * bins + binned[own, f]
        for k, weight in enumerate((grad[own], hess[own], None)):
            out[:, f, :, k] = np.bincount(key, weight, len(wanted) * bins).reshape(len(wanted), bins)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _auc(steps: pd.DataFrame) -> float:
    """The AUC over score steps, rows of one step tied."""
    steps = steps.sort_values("step")
    pos, neg = steps["pos"].to_numpy(float), steps["neg"].to_numpy(float)
    below = np.cumsum(neg) - neg
    every = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / every) if every else 0.5


@dataclass
class LeafwiseModel:
    features: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)
    held_out_auc: list[float] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x) for e, x in zip(self.edges, columns, strict=True)], 1).astype(np.uint8)

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        """Rows with the probability of class 1; a null feature counts as 0."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                own = model.value
                binned = own.binned([x.to_numpy(float) for x in columns])
                raw = np.full(len(binned), own.start)
                for tree in own.trees:
                    raw += tree.add(binned)
                yield pd.Series(_sigmoid(raw))

        filled = [F.coalesce(c(f).cast("double"), F.lit(0.0)) for f in self.features]
        return df.withColumn(name, scored(*filled))


def _edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins, at quantiles: ``bins - 1`` numbers a feature at most."""
    at = [k / bins for k in range(1, bins)]
    found = df.agg(*[F.percentile_approx(f, at, 20 * bins).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [], float)) for f in features]


def train_leafwise(df: DataFrame, label: str, features: list[str], held_out: str, weight: str, growth: Growth = Growth()) -> LeafwiseModel:  # noqa: B008
    """A model of ``label`` (0 or 1) learnt from the rows that are not ``held_out``, weighted by column ``weight``.

    Null features count as 0; rows without a label take no part.  Held-out rows
    decide when to stop; without any, all rounds count.  Without rows of both
    classes the model is a constant.
    """
    spark = df.sparkSession
    rows = df.where(c(label).isNotNull()).select(
        *[F.coalesce(c(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
        c(label).cast("double").alias("_y"), F.coalesce(c(held_out), F.lit(False)).alias("_held"), c(weight).cast("double").alias("_weight"),
    )
    rows = written(rows, "leafwise-rows")
    train = rows.where("NOT _held")
    classes = train.groupBy("_y").agg(F.sum("_weight").alias("w")).collect()
    total = {r._y: r.w for r in classes}
    pos, neg = total.get(1.0, 0.0), total.get(0.0, 0.0)
    start = float(np.log(max(pos, 1e-9) / max(neg, 1e-9)))
    model = LeafwiseModel(list(features), _edges(train, features, min(growth.bins, 256)), start)
    if not pos or not neg:
        return model
    bins = max(len(e) for e in model.edges) + 1
    shared = spark.sparkContext.broadcast(model.edges)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(features))]
            binned = np.stack([np.searchsorted(e, x) for e, x in zip(shared.value, columns, strict=True)], 1).astype(np.uint8)
            raw = pa.array([r.tobytes() for r in binned], pa.binary())
            rest = [batch.column(k) for k in range(len(features), len(features) + 3)]
            yield pa.RecordBatch.from_arrays([raw, *rest, pa.array(np.full(batch.num_rows, start))], ["binned", "y", "held", "weight", "raw"])

    state = written(rows.mapInArrow(to_bins, "binned binary, y double, held boolean, weight double, raw double"), "leafwise-state")
    done = 0
    rng = np.random.default_rng(growth.seed)
    many = max(1, round(growth.share * len(features)))
    best, best_at = -1.0, -1
    for round_ in range(growth.rounds):
        looked_at = np.sort(rng.choice(len(features), many, replace=False))
        newer = model.trees[done:]
        tree = grow(_summing(state, newer, len(features), bins), len(features), growth, looked_at)
        model.trees.append(tree)
        model.held_out_auc.append(_held_out_auc(state, model.trees[done:], growth.score_steps, len(features)))
        if model.held_out_auc[-1] > best:
            best, best_at = model.held_out_auc[-1], round_
        elif np.isfinite(best) and round_ - best_at >= growth.patience:
            break
        if len(model.trees) - done >= growth.refresh:
            state = written(_advanced(state, model.trees[done:], len(features)), "leafwise-state")
            done = len(model.trees)
    if not all(np.isnan(model.held_out_auc)):
        del model.trees[best_at + 1 :]
    return model


def _unpacked(batch: pa.RecordBatch, n_features: int) -> np.ndarray:
    """The bins of a batch's rows, a row each."""
    column = batch.column(0)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return flat.reshape(len(column), n_features)


def _raw(batch: pa.RecordBatch, binned: np.ndarray, trees: list[Tree]) -> np.ndarray:
    raw = batch.column(4).to_numpy().copy()
    for tree in trees:
        raw += tree.add(binned)
    return raw


def _summing(state: DataFrame, newer: list[Tree], n_features: int, bins: int):
    """Sums of the training rows by leaf, feature and bin, as a function of a tree and the leaves wanted."""

    def sum_up(tree: Tree, wanted: list[int]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(wanted), n_features, bins, 3))
            for batch in batches:
                if not batch.num_rows:
                    continue
                binned = _unpacked(batch, n_features)
                p = _sigmoid(_raw(batch, binned, newer))
                y, weight = batch.column(1).to_numpy(), batch.column(3).to_numpy()
                sums += histogram(binned, tree.leaf_of(binned), wanted, weight * (p - y), weight * p * (1 - p), bins)
            at = np.flatnonzero(sums[..., 2].ravel())
            values = sums.reshape(-1, 3)[at]
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(3)]], ["at", "g", "h", "n"])

        found = state.where("NOT held").mapInArrow(run, "at long, g double, h double, n double").groupBy("at").agg(F.sum("g"), F.sum("h"), F.sum("n"))
        out = np.zeros((len(wanted) * n_features * bins, 3))
        got = found.toPandas().to_numpy(float)  # wanted leaves x features x bins rows at most
        out[got[:, 0].astype(np.int64)] = got[:, 1:]
        return list(out.reshape(len(wanted), n_features, bins, 3))

    return sum_up


def _held_out_auc(state: DataFrame, newer: list[Tree], steps: int, n_features: int) -> float:
    """The AUC on held-out rows over ``steps`` steps of the probability; not a number without such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                binned = _unpacked(batch, n_features)
                step = np.minimum((_sigmoid(_raw(batch, binned, newer)) * steps).astype(np.int64), steps - 1)
                yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], ["step", "y"])

    found = state.where("held").mapInArrow(run, "step long, y double").groupBy("step").agg(F.sum("y").alias("pos"), F.sum(1 - c("y")).alias("neg")).toPandas()
    return _auc(found) if len(found) else float("nan")


def _advanced(state: DataFrame, newer: list[Tree], n_features: int) -> DataFrame:
    """The state with the scores that the newer trees give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = _raw(batch, _unpacked(batch, n_features), newer)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(raw)], batch.schema.names)

    return state.mapInArrow(run, state.schema)
