import hashlib
import random
import zlib

import numpy as np

from stintwise.llm.manifest import ARITY, Block, address, build_manifest, placed, tree_size, verification

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, pos string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold_up(nodes):
    """The root, and for each leaf its siblings level by level as (before, after)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, where, strict=True):
            run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
            p.append((run[: i % 16], run[i % 16 + 1 :]))
        nodes = [h("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
        where = [i // 16 for i in where]
    return nodes[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, subroots = {}, []
    for s in names:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = fold_up([leaf(r) for r in own])
        trees[s] = own, paths, root
        subroots.append(root)
    root, above = fold_up(subroots)
    out = []
    for nth, s in enumerate(names):
        own, paths, sub = trees[s]
        for r, p in zip(own, paths, strict=True):
            path = p + above[nth]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], r[4] and r[4].translate(FOLD))) if tampered else leaf(r)
            for before, after in path:
                now = h("".join([*before, now, *after]))
            proof = h("".join("".join(b + a) for b, a in path))
            out.append((r[0], leaf(r), sub, root, proof, now, now == root))
    return sorted(out, key=repr)


def frame(spark, rows, slices=4):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(slices)


def found(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=repr)


ODD = [
    (1, "a", "en", 3, "One"), (1, "a", "en", 3, "One"), (1, "a", "en", 3, "Two"), (2, None, None, None, None), (3, "", "", 0, ""),
    (None, "a", "en", 1, "X"), (None, None, "en", 1, "Y"), (4, "é", "fr", 2, "Äé"), (5, "z", "de", 40_000, "Long " * 8_000), (-7, "b:1", "1:", 2, "-"),
]


def test_odd_rows(spark):
    assert found(verification(frame(spark, ODD))) == brute(ODD)


def test_sizes_at_the_edges_a_hot_source_and_copies(spark):
    rng = random.Random(13)
    rows = [(i, f"of {n}", "en", i, f"Text {i}") for n in (1, 15, 16, 17, 257) for i in range(n)]
    rows += [(i, "hot", "en", 1, f"Text {i % 50}") for i in range(600)] + [(10_000 + i, f"s{i % 40}", "en", 1, f"T{rng.random()}") for i in range(300)]
    rows += [(7, "copies", "en", 1, "Same")] * 300  # rows that are alike in all
    assert found(verification(frame(spark, rows))) == brute(rows)


def test_one_leaf(spark):
    rows = [(1, "s", "en", 1, "Text")]
    assert found(verification(frame(spark, rows))) == brute(rows)


def test_several_rounds_of_blocks(spark):
    rows = [(i, "hot" if i < 700 else f"s{i % 9}", "en", 1, f"T{i}") for i in range(800)]
    manifest = build_manifest(frame(spark, rows), levels=1)
    assert len(manifest.forest.rounds) == 3
    assert max(r.leaves for r in manifest.forest.rounds[0].collect()) == ARITY
    want = {r[0]: r for r in brute(rows)}
    for r in manifest.proofs().collect():
        assert (r.leaf, r.subroot, r.root) == want[r.doc_id][1:4]
        assert h("".join(s.siblings for s in r.path)) == want[r.doc_id][4]


def test_empty_table(spark):
    assert verification(frame(spark, ODD).limit(0)).count() == 0


def test_addresses_are_a_van_emde_boas_order():
    for levels in range(1, 6):
        places = np.concatenate([address(d, np.arange(ARITY**d), levels) for d in range(levels)])
        assert sorted(places.tolist()) == list(range(tree_size(levels)))
    # Of five levels the upper two come first, then each lower subtree whole.
    assert max(address(1, np.arange(16), 5)) == 16
    for subtree in (0, 1, 255):
        below = np.concatenate([address(2 + d, subtree * ARITY**d + np.arange(ARITY**d), 5) for d in range(3)])
        assert sorted(below.tolist()) == list(range(17 + subtree * 273, 17 + subtree * 273 + 273))


def test_block_ends_with_its_last_node():
    block = Block.build([bytes([k]) * 32 for k in range(3)], 2)
    assert len(block.nodes) < 32 * tree_size(3)
    assert [[p for p, _ in steps] for steps in block.runs()] == [[0, 0], [1, 0], [2, 0]]
    assert [len(run) for _, run in block.runs()[0]] == [3, 1]


def test_places_are_gapless_under_a_hot_key(spark):
    rows = [("k" if i % 3 else f"k{i % 7}", i % 100) for i in range(2_000)]
    df = spark.createDataFrame(rows, "key string, v long").selectExpr("*", "monotonically_increasing_id() AS own")
    got = placed(df, ["key"], ["v", "own"]).toPandas().sort_values(["key", "pos"])
    for _, part in got.groupby("key"):
        assert part["pos"].tolist() == list(range(len(part)))
        assert part["v"].is_monotonic_increasing
