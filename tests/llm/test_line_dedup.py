import random

import numpy as np

from stintwise.llm.line_dedup import dedup_lines, within_one_edit
from stintwise.llm.queries import op2_line_dedup


def fold(line):
    return tuple("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w.decode()) for w in line.encode().split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(pairs, near_words=4, least_words=1):
    """Documents with ids only; a row equal to another is the same record."""
    records = sorted({(1 << 63 if i is None else i, t or "") for i, t in pairs})
    places = [(i, t, k, fold(x)) for i, t in records for k, x in enumerate(t.split("\n"))]
    gone = set()
    for n, (i, t, k, w) in enumerate(places):
        if len(w) < least_words:
            continue
        for _, _, _, v in places[:n]:
            near = len(w) >= near_words and len(v) >= near_words and abs(len(w) - len(v)) < 2 and distance(v, w) <= 1
            if v == w or near:
                gone.add((i, t, k))
                break
    out = []
    for i, t in pairs:
        key = (1 << 63 if i is None else i, t or "")
        lines = (t or "").split("\n")
        stay = [x for k, x in enumerate(lines) if (*key, k) not in gone]
        out.append((i, t if len(stay) == len(lines) else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r))


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 4))) for _ in range(60)]
    lines = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 16))] for _ in range(120)]
    hot = [rng.choice(vocabulary) for _ in range(12)]
    out = []
    for i in range(150):
        text = []
        for _ in range(rng.randrange(1, 8)):
            line = list(hot if rng.random() < 0.2 else rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    line.insert(at, rng.choice(vocabulary))
                elif line and at < len(line):
                    line[at : at + 1] = [] if kind == 1 else [rng.choice(vocabulary)]
            text.append(rng.choice([" ", "  "]).join(w.title() if rng.random() < 0.1 else w for w in line))
        out.append((i, "\n".join(text)))
    return out


def test_same_as_brute_force(documents):
    pairs = corpus()
    got = [tuple(r) for r in dedup_lines(documents(pairs, 5)).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    want = brute(pairs)
    assert sum(r[3] for r in want) > 100
    assert order(got) == order(want)


def test_odd_rows(documents, odd_pairs):
    got = [tuple(r) for r in dedup_lines(documents(odd_pairs)).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert order(got) == order(brute(odd_pairs))
    carried = dedup_lines(documents(odd_pairs), carry=("lang", "source", "line")).collect()
    assert len(carried) == len(odd_pairs) and all(r["source"] == "s" and r["line"] == "x" and r["lang"] is None for r in carried)
    assert dedup_lines(documents(odd_pairs).limit(0)).count() == 0


def test_edit_check_is_the_edit_distance():
    rng = random.Random(7)
    for _ in range(3000):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(7))] for _ in range(2))
        assert within_one_edit(np.array(a), np.array(b)) == (distance(a, b) <= 1)


def test_query_removes_short_lines_too(spark, documents, odd_pairs, tmp_path):
    pairs = [
        *corpus(),
        *[(100_000 + i if i else i, t) for i, t in odd_pairs],
        (200_000, "Erheed. titionly.\n\nalone\nfour words are here\nso three words"),
        (200_001, "erheed. titionly.\n\nALONE\nfour words were here\nso four words"),
    ]
    documents(pairs, 5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op2_line_dedup(spark, str(tmp_path)).select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert order(got) == order(brute(pairs, near_words=4, least_words=1))
    assert next(t for i, t, _, _ in got if i == 200_001) == "\nso four words"
