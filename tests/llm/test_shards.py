import zlib
from collections import Counter, defaultdict

import pytest

from stintwise.llm.shards import shard_by_bytes


def check(rows, pairs, shards, slack):
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, crc(t)) for i, t in pairs
    )
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < shards for s in slots)
    share = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - share) <= slack for s in range(shards))


@pytest.mark.parametrize("rows_per_task", [50, 1_000_000])
def test_even_shards_with_a_hot_text(documents, rows_per_task):
    pairs = [(i, "text " * (i % 37) + str(i // 3)) for i in range(2000)] + [(i, "the same words " * 20) for i in range(2000, 3000)]
    rows = shard_by_bytes(documents(pairs), shards=8, rows_per_task=rows_per_task).collect()
    check(rows, pairs, 8, slack=700)
    where = defaultdict(set)
    for (i, t), s in zip(sorted(pairs), [r["shard"] for r in sorted(rows, key=lambda r: r["doc_id"])], strict=True):
        where[t].add(s)
    assert sum(len(s) > 1 for t, s in where.items() if not t.startswith("the same")) == 0


def test_many_tiny_copies_are_cut_but_stay_together(documents):
    """Copies that fill little of a shard are many rows: no task gets them all, yet they share a shard."""
    pairs = [(i, "long text " * 300 + str(i)) for i in range(400)] + [(10_000 + i, None if i % 2 else "") for i in range(1500)]
    found = shard_by_bytes(documents(pairs), shards=4, rows_per_task=200, tolerance=0.5)
    rows = found.collect()
    check(rows, pairs, 4, slack=4000)
    assert len({r["shard"] for r in rows if r["doc_id"] >= 10_000}) == 1


def test_odd_rows(documents, odd_pairs):
    rows = shard_by_bytes(documents(odd_pairs), shards=3).collect()
    check(rows, odd_pairs, 3, slack=10**6)
    assert shard_by_bytes(documents(odd_pairs).limit(0)).count() == 0


def test_plan_has_no_python(documents):
    plan = shard_by_bytes(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
