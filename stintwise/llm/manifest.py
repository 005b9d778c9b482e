"""A Merkle manifest of a dataset, stored in van Emde Boas order.

Every row is a leaf; the leaves of a source, ordered by id, form a tree in which
``ARITY`` consecutive nodes become one, and the sources' roots form a tree in the
same way.  A tree is cut at fixed heights into blocks, aligned subtrees of
``levels`` levels.  A block is one array of digests: its tree is split at half
height, the upper half is stored first, then each lower subtree, every one of
them split in the same way.  Where a node stands follows from its level and
index by arithmetic, which serves both building a block and looking up siblings.
The roots of blocks are the leaves of blocks above, so a tree of any size is
built, and read, in a few rounds, and no task holds more than a block.

Where a leaf stands in its tree is found without a window over a source: rows
are sorted in ranges, numbered in each, and only the ranges' counts per source
are summed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stintwise.session import written

ARITY = 16
DIGEST = 32


def tree_size(levels: int) -> int:
    """The nodes of a full tree with so many levels of nodes."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(level: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Where nodes ``index`` of ``level`` (0: the root) stand in a tree with ``levels`` levels of nodes."""
    at, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        upper = levels // 2
        lower = levels - upper
        if level < upper:
            levels = upper
            continue
        subtree, index = np.divmod(index, ARITY ** (level - upper))
        at = at + tree_size(upper) + subtree * tree_size(lower)
        level, levels = level - upper, lower
    return at + index


def _hash(raw: bytes) -> bytes:
    return hashlib.sha256(raw.hex().encode()).digest()


class Block:
    """An aligned subtree: digests in van Emde Boas order.  Places that no node takes hold zeros; the array ends with its last node."""

    def __init__(self, nodes: bytes | bytearray, leaves: int, levels: int):
        self.nodes, self.leaves, self.levels = nodes, leaves, levels

    @staticmethod
    def build(digests: list[bytes], levels: int) -> Block:
        """The subtree over up to ``ARITY ** levels`` leaves: every run becomes a node, be it of one."""
        nodes = bytearray(DIGEST * tree_size(levels + 1))
        now, last = digests, 0
        for level in range(levels, -1, -1):
            places = address(level, np.arange(len(now)), levels + 1).tolist()
            for place, digest in zip(places, now, strict=True):
                nodes[place * DIGEST : (place + 1) * DIGEST] = digest
            last = max(last, *places)
            now = [_hash(b"".join(now[k : k + ARITY])) for k in range(0, len(now), ARITY)] if level else now
        return Block(bytes(nodes[: (last + 1) * DIGEST]), len(digests), levels)

    @property
    def root(self) -> bytes:
        return bytes(self.nodes[:DIGEST])

    def runs(self) -> list[list[tuple[int, list[str]]]]:
        """For each leaf, from its own level upwards: its place in the run, and the digests of the run."""
        steps: list[list[list[str]]] = []
        count = self.leaves
        for level in range(self.levels, 0, -1):
            places = address(level, np.arange(count), self.levels + 1).tolist()
            now = [bytes(self.nodes[p * DIGEST : (p + 1) * DIGEST]).hex() for p in places]
            steps.append([now[k : k + ARITY] for k in range(0, count, ARITY)])
            count = len(steps[-1])
        return [[(i // ARITY**d % ARITY, steps[d][i // ARITY ** (d + 1)]) for d in range(self.levels)] for i in range(self.leaves)]


def _step(place: int, run: list[str]) -> dict:
    return {"nth": place, "siblings": "".join(run[:place] + run[place + 1 :])}


_PATH = pa.list_(pa.struct([("nth", pa.int32()), ("siblings", pa.string())]))
PATH = "array<struct<nth: int, siblings: string>>"


def _grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of each block, which come one after the other; columns 0 and 1 name the block."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            if kept and any(kept[0].column(c)[0] != batch.column(c)[0] for c in (0, 1)):
                yield pa.Table.from_batches(kept)
                kept = []
            same = np.ones(batch.num_rows, bool)
            for c in (0, 1):
                column = batch.column(c).to_numpy(zero_copy_only=False)
                same &= column == column[0]
            n = batch.num_rows if same.all() else int(np.argmin(same))
            kept.append(batch.slice(0, n))
            batch = batch.slice(n)
            if sum(b.num_rows for b in kept) > rows:
                raise ValueError("a block has more rows than places")
    if kept:
        yield pa.Table.from_batches(kept)


def _built(levels: int):
    """A row per block: its digests in order, and its root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ARITY**levels):
            height = int(rows.column("height")[0].as_py())
            block = Block.build([bytes.fromhex(x) for x in rows.column("digest").to_pylist()], min(levels, height))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0)[:1].combine_chunks(), rows.column(1)[:1].combine_chunks(), pa.array([block.leaves]),
                 pa.array([block.levels], pa.int32()), pa.array([max(0, height - levels)], pa.int32()), pa.array([block.nodes], pa.binary()),
                 pa.array([block.root.hex()])],
                ["tree", "block", "leaves", "levels", "height", "nodes", "root"],
            )

    return run


_BLOCKS = "tree long, block long, leaves long, levels int, height int, nodes binary, root string"


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The steps of every leaf of a block, and those above the block behind them; a row per leaf."""
    for batch in batches:
        for row in batch.to_pylist():
            above = [{"nth": s["nth"], "siblings": s["siblings"]} for s in row["path"] or []]
            runs = Block(row["nodes"], row["leaves"], row["levels"]).runs()
            for start in range(0, len(runs), 256):
                part = runs[start : start + 256]
                at = row["block"] * ARITY ** row["levels"] + start + np.arange(len(part))
                paths = pa.array([[_step(*s) for s in steps] + above for steps in part], _PATH)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row["tree"])), pa.array(at), paths], ["tree", "pos", "path"])


@dataclass(frozen=True)
class Forest:
    """Trees over leaves ``tree, pos, digest``: the blocks of each round, from the leaves upwards, and a root per tree."""

    rounds: list[DataFrame]
    roots: DataFrame

    def paths(self, above: DataFrame) -> DataFrame:
        """``tree, pos, path`` per leaf: its siblings from its run upwards.  ``above(tree, path)`` continues each tree's paths."""
        found = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
        for nth, blocks in enumerate(reversed(self.rounds)):
            asked = blocks.join(found, ["tree", "block"]).select("tree", "block", "leaves", "levels", "nodes", "path")
            found = asked.mapInArrow(_looked_up, f"tree long, pos long, path {PATH}")
            if nth + 1 < len(self.rounds):
                found = found.withColumnRenamed("pos", "block")
        return found


def build_forest(leaves: DataFrame, levels: int = 3, name: str = "manifest") -> Forest:
    """The forest of ``leaves(tree, pos, digest)``, whose places count from 0 without gaps."""
    size = ARITY**levels
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    height = F.lit(0)
    for k in range(15):  # 16 ** 15 leaves and more have no numbers
        height = height + (F.col("n") > ARITY**k).cast("int")
    now = leaves.join(sizes.select("tree", height.alias("height")), "tree")
    rounds: list[DataFrame] = []
    while True:
        rows = now.withColumn("block", F.floor(F.col("pos") / size).cast("long")).select("tree", "block", "pos", "digest", "height")
        ordered = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        rounds.append(written(ordered.mapInArrow(_built(levels), _BLOCKS), f"{name}-{len(rounds)}"))
        more = rounds[-1].select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"), "height")
        top = more.agg(F.max("height")).first()[0]
        if not top:
            break
        # Trees that are complete need no further round, but a round of no levels keeps their paths in step.
        now = more
    return Forest(rounds, rounds[-1].select("tree", F.col("root").alias("digest")))


def placed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 among the rows of their key.

    The place is counted within ranges of the whole order; ``key`` and ``order``
    together should tell rows apart, or rows that are alike stand in one range.
    """
    ranged = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    numbered = written(ranged.withColumn("__id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__id", 33)
    counts = numbered.groupBy(*key, part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    same = F.col("a.__part") == F.col("b.__part")
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = numbered.withColumn("__part", part).alias("a").join(starts.alias("b"), same)
    return joined.select(*[f"a.{c}" for c in rows.columns], (F.col("a.__id") - F.col("b.__first") + F.col("b.__start")).alias("pos"))


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its bytes in UTF-8, a colon, and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""

    def up(now: Column, step: Column) -> Column:
        left = F.substring(step["siblings"], F.lit(1), step["nth"] * (2 * DIGEST))
        right = F.substring(step["siblings"], step["nth"] * (2 * DIGEST) + 1, F.length(step["siblings"]))
        return F.sha2(F.concat(left, now, right), 256)

    return F.aggregate(path, digest, up)


@dataclass(frozen=True)
class Manifest:
    """Leaves with their places, a forest of sources, the tree over the sources, and the names of both."""

    leaves: DataFrame
    sources: DataFrame
    forest: Forest
    top: Forest
    root: str | None

    def proofs(self) -> DataFrame:
        """A row per leaf: the leaves' columns, ``subroot``, ``root`` and ``path``, all siblings from its run to the root."""
        whole = self.leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(None).cast(PATH).alias("path"))
        above = self.top.paths(whole).select(F.col("pos").alias("tree"), "path")
        found = self.forest.paths(written(above, "manifest-above"))
        subroots = self.sources.select("tree", F.col("digest").alias("subroot"))
        return self.leaves.join(found, ["tree", "pos"]).join(subroots, "tree").withColumn("root", F.lit(self.root)).drop("tree", "pos")


def build_manifest(docs: DataFrame, extra: dict[str, Column] | None = None, levels: int = 3) -> Manifest:
    """The manifest of ``docs(doc_id, source, lang, n_chars, text)``; ``extra`` names further columns of the leaves.

    Sources are ordered by their bytes, null first, a source's leaves by
    ``doc_id``, null first, then by digest; rows that are alike in all are
    leaves of their own.  A null field differs from an empty one.  An empty
    table has no leaves and no root.  Further columns of ``docs`` are not read.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*columns).alias("leaf"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    # A number of its own parts rows that are alike over ranges.
    at = placed(rows.withColumn("__own", F.monotonically_increasing_id()), ["source"], ["doc_id", "leaf", "__own"])
    names = at.groupBy("source").agg(F.count("*").alias("n"))
    sources = written(placed(names, [], ["source"]).withColumnRenamed("pos", "tree"), "manifest-sources")
    same = F.col("l.source").eqNullSafe(F.col("s.source"))
    leaves = written(at.alias("l").join(sources.alias("s"), same).select("l.*", "s.tree").drop("__own"), "manifest-leaves")
    forest = build_forest(leaves.select("tree", "pos", F.col("leaf").alias("digest")), levels)
    subroots = written(sources.join(forest.roots, "tree"), "manifest-subroots")
    top = build_forest(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest"), levels, "manifest-top")
    found = top.roots.first()
    return Manifest(leaves, subroots, forest, top, found and found["digest"])


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_leaf(every: int = 5) -> Column:
    """The leaf of a row with its text in lower case where ``every`` divides the checksum of its id, else the leaf itself."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = leaf(*fields, F.translate("text", _UPPER, _LOWER))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    return F.when(hit, changed).otherwise(leaf(*fields, F.col("text")))


def verification(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: what each row proves, some of them tampered with."""
    proofs = build_manifest(docs, {"shown": tampered_leaf()}).proofs()
    folded = proofs.withColumn("folded_root", fold(F.col("shown"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "path.siblings"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _sql_levels(first: str, keys: str, levels: int, name: str) -> str:
    """Tables ``name0`` (the leaves) to ``name<levels>``: each run's digest and its members; a finished tree repeats itself."""
    out = [f"{name}0 AS ({first})"]
    for k in range(levels):
        runs = f"SELECT {keys}, pos // 16 AS pos, list(digest ORDER BY pos) AS members, any_value(n) AS n FROM {name}{k} GROUP BY {keys}, pos // 16"
        out.append(f"{name}_runs{k} AS ({runs})")
        out.append(
            f"{name}{k + 1} AS (SELECT {keys}, pos, CASE WHEN n > {16 ** k} THEN sha256(array_to_string(members, '')) "
            f"ELSE members[1] END AS digest, n FROM {name}_runs{k})"
        )
    return ", ".join(out)


def manifest_sql(levels: int = 6, source_levels: int = 4) -> str:
    """DuckDB SQL for :func:`verification` over ``documents``, for up to ``16 ** levels`` rows of a source and ``16 ** source_levels`` sources."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
    hashed = lambda text: f"sha256(concat({', '.join(map(value, ('doc_id', 'source', 'lang', 'n_chars', text)))}))"
    shift = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    byte = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: {shift})"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295)"
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    rows = f"SELECT row_number() OVER () AS row_id, doc_id, source, {hashed('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed('lowered')} ELSE {hashed('text')} END AS shown FROM (SELECT *, {lower} AS lowered FROM documents) AS d"
    first = "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1"
    tables = [
        f"r AS ({rows})",
        f"p AS (SELECT *, {first} AS pos, count(*) OVER (PARTITION BY source) AS n FROM r)",
        _sql_levels("SELECT source, pos, leaf AS digest, n FROM p", "source", levels, "s"),
        f"sub AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM s{levels})",
        _sql_levels("SELECT 0 AS whole, pos, digest, n FROM sub", "whole", source_levels, "t"),
    ]
    tree = [f"CASE WHEN p.n > {16 ** k} THEN s{k}.members END AS m{k}, p.pos // {16 ** k} % 16 AS i{k}" for k in range(levels)]
    tree += [
        f"CASE WHEN sub.n > {16 ** k} THEN t{k}.members END AS m{levels + k}, sub.pos // {16 ** k} % 16 AS i{levels + k}"
        for k in range(source_levels)
    ]
    joins = "".join(f" JOIN s_runs{k} AS s{k} ON p.source IS NOT DISTINCT FROM s{k}.source AND p.pos // {16 ** (k + 1)} = s{k}.pos" for k in range(levels))
    joins += " JOIN sub ON p.source IS NOT DISTINCT FROM sub.source"
    joins += "".join(f" JOIN t_runs{k} AS t{k} ON sub.pos // {16 ** (k + 1)} = t{k}.pos" for k in range(source_levels))
    tables.append(f"w AS (SELECT p.*, sub.digest AS subroot, (SELECT digest FROM t{source_levels}) AS root, {', '.join(tree)} FROM p{joins})")
    total = levels + source_levels
    left = lambda k: f"array_to_string(list_slice(m{k}, 1, i{k}), '')"
    right = lambda k: f"array_to_string(list_slice(m{k}, i{k} + 2, 16), '')"
    tables.append("f0 AS (SELECT *, shown AS folded FROM w)")
    for k in range(total):
        tables.append(
            f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN m{k} IS NULL THEN folded ELSE sha256(concat({left(k)}, folded, {right(k)})) END AS folded) FROM f{k})"
        )
    proof = "concat(" + ", ".join(f"{left(k)}, {right(k)}" for k in range(total)) + ")"
    return (
        f"WITH {', '.join(tables)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, folded AS folded_root, "
        f"folded = root AS verified FROM f{total}"
    )
