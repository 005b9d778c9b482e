"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text becomes a set of word-window hashes; equal sets form one class,
   and only classes are compared.
2. A tree of the forest lists all classes in the order of one choice of
   signature places: a coarse label, then finer ones.  The list is sorted over
   all tasks by range, never in one place, and classes next to each other that
   share the coarse label are candidates; how far the finer labels agree, that
   is the depth of their common prefix, adapts to how crowded a region is.
3. Each class is confirmed against the neighbour that agrees with it in most
   trees and deepest, then against all neighbours that are not yet in its
   component; each time, confirmed links are joined to components.
4. Classes that have neighbours but stand in different components may still be
   linked: in a crowded region, sorted neighbours are only some of those that
   share a label.  Of these classes, each emits the rarest windows of its set,
   as many as a pair at the threshold must share one of, and those that meet
   are confirmed if their sizes, the places of what they share and their
   sketches allow a link.  A crowded region that has become one component by
   then costs nothing, and no region needs a cap.

No two trees share a signature place in their coarse labels, so their number
makes a pair at the threshold fail to share a label in all trees with a chance
below ``MISS``; the sketch turns down a pair at the threshold with a chance of
about 1e-9 (six standard deviations).  Every other step is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintwise.llm.bits import bit_filter, may_hold
from stintwise.llm.graph import components
from stintwise.llm.rows import record
from stintwise.llm.words import mix, shingle_sets, slices
from stintwise.session import written

MISS = 1e-6
#: Signature places of the sketch; the forest may take more.
PLACES = 128
#: Signature places of the coarse label, and those added by the two finer ones.
FINER = (2, 6)

_draws = np.random.default_rng(6)
_FACTORS = _draws.integers(1, 1 << 32, 1024, dtype=np.uint32) | np.uint32(1)
_TERMS = _draws.integers(0, 1 << 32, 1024, dtype=np.uint32)
_LABEL = _draws.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class Forest:
    """How many places make a coarse label and how many trees there are, for a threshold in percent."""

    percent: int

    @property
    def depth(self) -> int:
        return max(2, round(math.log(0.36) / math.log(min(self.percent, 95) / 100)))

    @property
    def trees(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** self.depth))

    @property
    def places(self) -> int:
        return max(PLACES, self.trees * self.depth)

    @property
    def most_bits_apart(self) -> int:
        """Sketch bits (of 128) in which a pair at the threshold differs, plus six standard deviations."""
        p = (1 - self.percent / 100) / 2
        return math.floor(PLACES * p + 6 * math.sqrt(PLACES * p * (1 - p)))

    def chosen(self) -> np.ndarray:
        """The signature places of each tree, in the order of its labels; coarse labels have none in common."""
        draws = np.random.default_rng(60)
        coarse = draws.permutation(self.places)[: self.trees * self.depth].reshape(self.trees, self.depth)
        finer = [draws.permutation(np.setdiff1d(np.arange(self.places), own))[: FINER[1]] for own in coarse]
        return np.concatenate([coarse, np.stack(finer)], axis=1)


def _signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """MinHash signatures of non-empty sets."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), places), np.uint32)
    for k in range(places):
        h = flat * _FACTORS[k] + _TERMS[k]
        out[:, k] = np.minimum.reduceat(h ^ (h >> np.uint32(15)), at)
    return out


def _class_of(shingles: np.ndarray) -> np.uint64:
    """One hash of a whole non-empty set."""
    return mix(mix(shingles).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(shingles)))[0]


def _list_of(values: np.ndarray) -> pa.Array:
    """A column of equally long lists from a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.reshape(-1)))


def _fingerprints(forest: Forest, size: int):
    chosen, depth = forest.chosen(), forest.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(2)):
                sets = list(shingle_sets(texts, size))
                ids = [batch.column(k).slice(texts.start, texts.rows) for k in (0, 1)]
                full = np.flatnonzero([len(s) > 0 for s in sets])
                n = np.array([len(s) for s in sets], np.int64)
                set_hash = np.zeros(len(sets), np.uint64)
                labels = np.zeros((len(sets), len(chosen)), np.uint64)
                deep = np.zeros((len(sets), len(chosen)), np.uint32)
                sketch = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    some = [sets[i] for i in full]
                    set_hash[full] = [_class_of(s) for s in some]
                    signature = _signatures(some, forest.places)
                    sketch[full] = np.packbits((signature[:, :PLACES] >> np.uint32(7)).astype(np.uint8) & 1, axis=1).view(np.uint64)
                    weighted = signature[:, chosen].astype(np.uint64) * _LABEL[: chosen.shape[1]]
                    sums = np.cumsum(weighted, axis=2, dtype=np.uint64)
                    labels[full] = mix(sums[:, :, depth - 1])
                    middle, last = (mix(sums[:, :, depth + k - 1]) >> np.uint64(48) for k in FINER)
                    deep[full] = (middle << np.uint64(16) | last).astype(np.uint32)
                as_long = lambda x: x.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(n), pa.array(as_long(set_hash)), _list_of(as_long(labels)), _list_of(deep.view(np.int32)),
                     pa.array(as_long(sketch[:, 0].copy())), pa.array(as_long(sketch[:, 1].copy()))],
                    ["doc_id", "record", "n_shingles", "class", "labels", "finer", "bits_a", "bits_b"],
                )

    return run


_FINGERPRINT = "doc_id long, record long, n_shingles long, class long, labels array<long>, finer array<int>, bits_a long, bits_b long"
_NEIGHBOUR = "a long, b long, depth int, task int, nth int, tree int, label long, finer int, class long"


def _neighbours(depth: int):
    """Neighbours in a sorted list of ``tree, label, finer, class``; the list's two ends are kept for stitching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        task, first = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            first = first or [x[:1] for x in now]
            seen = now if last is None else [np.concatenate(x) for x in zip(last, now, strict=True)]
            last = [x[-1:] for x in now]
            tree, label, finer, node = seen
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (label[1:] == label[:-1]))
            a, b = node[at], node[at + 1]
            same = finer[at] ^ finer[at + 1]
            levels = depth + np.where(same == 0, FINER[1], np.where((same >> 16) == 0, FINER[0], 0))
            yield _neighbour_batch(np.minimum(a, b), np.maximum(a, b), levels)
        for nth, row in enumerate([first, last] if first else []):
            columns = [None, None, None, task, nth, *(x[0].item() for x in row)]
            yield pa.RecordBatch.from_pylist([dict(zip(_NEIGHBOUR_SCHEMA.names, columns, strict=True))], _NEIGHBOUR_SCHEMA)

    return run


_NEIGHBOUR_SCHEMA = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int32()), ("task", pa.int32()), ("nth", pa.int32()), ("tree", pa.int32()),
     ("label", pa.int64()), ("finer", pa.int32()), ("class", pa.int64())]
)


def _neighbour_batch(a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    none = [pa.nulls(n, f.type) for f in list(_NEIGHBOUR_SCHEMA)[3:]]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(depth.astype(np.int32)), *none], schema=_NEIGHBOUR_SCHEMA)


def _forest_neighbours(regions: DataFrame, forest: Forest) -> DataFrame:
    """``a, b, trees, depth`` of classes that are neighbours in some tree's order and share its coarse label."""
    place = ["tree", "label", "finer", "class"]
    in_order = regions.select(*place).repartitionByRange(*place).sortWithinPartitions(*place)
    found = written(in_order.mapInArrow(_neighbours(forest.depth), _NEIGHBOUR), "forest-neighbours")
    # Two rows for each task of the sort meet here, to link the last row of a task with the first of the next.
    ends = found.filter("task IS NOT NULL").select("task", "nth", *place)
    pairs = found.filter("task IS NULL").select("a", "b", "depth")
    before = "lag({0}) OVER (ORDER BY task, nth)"
    stitched = (
        ends.selectExpr("*", *[f"{before.format(c)} AS p_{c}" for c in place])
        .filter("nth = 0 AND tree = p_tree AND label = p_label AND class <> p_class")
        .selectExpr("least(class, p_class) AS a", "greatest(class, p_class) AS b", f"{forest.depth} AS depth")
    )
    return pairs.unionByName(stitched).groupBy("a", "b").agg(F.count("*").alias("trees"), F.max("depth").alias("depth"))


def _sets_of(filter_bits, size: int):
    """The full sets of texts that may be needed, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            hashed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            batch = batch.filter(pa.array(may_hold(filter_bits.value, hashed)))
            for texts in slices(batch.column(1)):
                sets = {int(_class_of(s).view(np.int64)): s.tobytes() for s in shingle_sets(texts, size) if len(s)}
                new = [c for c in sets if c not in given]
                given.update(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new, pa.int64()), pa.array([sets[c] for c in new], pa.binary())], ["class", "shingles"]
                )

    return run


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of each set, with the set's class, component and size."""
    for batch in batches:
        for node, root, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = np.frombuffer(x.as_buffer(), np.int64)
            n = len(own)
            columns = [pa.array(own), pa.array(np.full(n, node)), pa.array(np.full(n, root)), pa.array(np.full(n, n, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["window", "class", "root", "n"])


def _rare_windows(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """``window, class, root, place, n``: the rarest windows of each set that sets of other components have too.

    A set's windows are ordered from those of its own component, which bring no
    two components together, to the others by how many classes have them; a pair
    at the threshold shares one of the first windows of both, as many as
    ``percent`` leaves.  ``place`` is a window's place in that order.
    """
    marked = sets.dropDuplicates(["class"]).join(roots, "class").select("class", "root", "shingles")
    windows = written(marked.mapInArrow(_windows_of, "window long, class long, root long, n int"), "set-windows")
    mixed = (
        windows.groupBy("window")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("classes"))
        .filter("low < high")
        .select("window", "classes")
    )
    own = (
        windows.join(mixed, "window")
        .groupBy("class", "root", "n")
        .agg(F.sort_array(F.collect_list(F.struct("classes", "window"))).alias("shared"))  # of one set
    )
    alone = F.col("n") - F.size("shared")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = F.slice("shared", F.lit(1), F.greatest(first - alone, F.lit(0)).cast("int"))
    return own.select("class", "root", "n", alone.alias("alone"), F.posexplode(prefix).alias("nth", "at")).select(
        F.col("at.window").alias("window"), "class", "root", (F.col("alone") + F.col("nth")).cast("int").alias("place"), "n"
    )


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of each pair, by the exact sizes of intersection and union."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a"))
    other = sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b"))
    joined = pairs.select("a", "b").join(other, "b").join(one, "a").select("a", "b", "of_a", "of_b")
    found = joined.mapInArrow(_confirm(percent), "a long, b long, linked boolean")
    return written(found.distinct(), "confirmed-pairs")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """``doc_id, record, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``.

    ``record`` is the text's hash, which tells rows of one ``doc_id`` apart.

    Texts are linked if ``100 * |intersection| >= percent * |union|`` of their
    sets of ``size``-word windows; a component's id is its smallest ``doc_id``,
    and that document is kept.  A text without words is linked with nothing and
    kept; so is a row without ``doc_id``, whose ``component_id`` is null.
    Repeated rows give repeated results.  An empty table gives no rows; further
    columns are not read.  Hashes have 64 bits; two different windows of one
    pair would have to collide to change a result.
    """
    spark = docs.sparkSession
    forest = Forest(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), record().alias("record"), "text")
    prints = written(texts.mapInArrow(_fingerprints(forest, size), _FINGERPRINT), "fingerprints")

    linkable = prints.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(
        linkable.groupBy("class").agg(
            F.min("doc_id").alias("least_id"),
            F.first(F.struct("labels", "finer", "bits_a", "bits_b", "n_shingles")).alias("of"),
        ),
        "classes",
    )
    regions = classes.select("class", F.posexplode(F.arrays_zip("of.labels", "of.finer")).alias("tree", "at")).select(
        "tree", F.col("at.labels").alias("label"), F.col("at.finer").alias("finer"), "class"
    )

    near = written(_forest_neighbours(regions, forest), "neighbour-pairs")
    crowded = near.select(F.col("a").alias("class")).union(near.select(F.col("b").alias("class"))).distinct()
    involved = classes.join(crowded, "class").select(F.xxhash64("least_id").alias("hashed"))
    filter_bits = spark.sparkContext.broadcast(bit_filter(involved, "hashed"))
    hashed = texts.filter("doc_id IS NOT NULL").selectExpr("xxhash64(doc_id) AS hashed", "text")
    sets = written(hashed.mapInArrow(_sets_of(filter_bits, size), "class long, shingles binary"), "shingle-sets")

    sketches = classes.join(crowded, "class").select("class", "of.bits_a", "of.bits_b")

    def placed(links: DataFrame) -> DataFrame:
        """``class, root`` of all classes that have neighbours."""
        grouped = components(links, "near-components").withColumnRenamed("node", "class")
        found = crowded.join(grouped, "class", "left").select("class", F.coalesce("root", "class").alias("root"))
        return written(found, "near-roots")

    best = (
        near.select(F.col("a").alias("node"), F.col("b").alias("partner"), "trees", "depth")
        .unionByName(near.select(F.col("b").alias("node"), F.col("a").alias("partner"), "trees", "depth"))
        .groupBy("node")
        .agg(F.max(F.struct("trees", "depth", "partner")).alias("best"))
        .select(F.least("node", "best.partner").alias("a"), F.greatest("node", "best.partner").alias("b"))
        .distinct()
    )
    tested = _confirmed(best, sets, percent)
    links = tested.filter("linked").select("a", "b")

    roots = placed(links)
    root_a = roots.select(F.col("class").alias("a"), F.col("root").alias("root_a"))
    root_b = roots.select(F.col("class").alias("b"), F.col("root").alias("root_b"))
    apart = near.select("a", "b").join(root_a, "a").join(root_b, "b").filter("root_a <> root_b").select("a", "b")
    more = _confirmed(apart.join(tested, ["a", "b"], "left_anti"), sets, percent)
    tested = tested.unionByName(more)
    links = links.unionByName(more.filter("linked").select("a", "b"))

    roots = placed(links)
    rare = written(_rare_windows(sets, roots, percent), "rare-windows")
    mixed = rare.groupBy("window").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    meeting = rare.join(mixed.select("window"), "window", "left_semi").join(sketches, "class")
    x, y = meeting.alias("x"), meeting.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    differ = F.bit_count(F.col("x.bits_a").bitwiseXOR(F.col("y.bits_a"))) + F.bit_count(F.col("x.bits_b").bitwiseXOR(F.col("y.bits_b")))
    # What can still be shared from the first shared window on, against what a link needs.
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    possible = (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & ((100 + percent) * rest >= percent * sizes)
    crossing = (
        x.join(y, (F.col("x.window") == F.col("y.window")) & (F.col("x.root") < F.col("y.root")) & possible & (differ <= forest.most_bits_apart))
        .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    links = links.unionByName(_confirmed(crossing, sets, percent).filter("linked").select("a", "b"))
    joined = components(links, "near-components")

    members = classes.select("class", "least_id").join(joined.withColumnRenamed("node", "class"), "class")
    smallest = members.groupBy("root").agg(F.min("least_id").alias("linked_id"))
    linked = members.join(smallest, "root").select("class", "linked_id")
    ids = classes.select("class", "least_id").join(linked, "class", "left").select("class", F.coalesce("linked_id", "least_id").alias("found_id"))
    out = prints.select("doc_id", "record", "n_shingles", "class").join(ids, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "record", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
