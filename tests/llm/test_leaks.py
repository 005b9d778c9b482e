import random
import re

import pytest

from stintwise.llm.leaks import decontaminate

ITEMS = [
    (1, "A train leaves Boston at 60 mph and reaches Denver after 12.5 hours, while another from Boston needs 9 hours. How far is Denver?"),
    (2, "Which of these rivers flows through the old town before it joins the sea near the northern harbour wall?"),
    (3, "Which planet is largest?"),
    (4, None),
    (None, "the text of an item without an id that is long enough to be a window"),
    (5, ""),
]
FILL = [f"filler{k}" for k in range(500)]


def around(text, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choices(FILL, k=40)) + ". " + text + " " + " ".join(rng.choices(FILL, k=40))


CASES = [
    (10, around(ITEMS[0][1]), (True, 1, 1.0)),
    # Other numbers and names, used consistently.
    (11, around("A train leaves Lyon at 75 mph and reaches Turin after 8 hours, while another from Lyon needs 1,250.5 hours. How far is Turin?"), (True, 1, 0.0)),
    (12, around("a train leaves New Haven at 3 km and reaches Bern after 7 days, while another from New Haven needs 4 days. How far is Bern?"), (True, 1, None)),
    # Boston stands for two towns: another question.
    (13, around("A train leaves Lyon at 75 mph and reaches Turin after 8 hours, while another from Ulm needs 9 hours. How far is Graz?"), (False, None, None)),
    (14, around("of these rivers flows through the old town before it joins"), (False, None, None)),
    (15, around("rivers flows through the old town before it joins the sea near the northern harbour wall"), (True, 2, 1.0)),
    (16, around("which planet is largest, WHICH planet"), (True, 3, 1.0)),
    (17, around("nothing of it"), (False, None, None)),
    (18, "the text of an item without an id that is long enough to be a window", (False, None, None)),
    (19, "", (False, None, None)),
    (20, None, (False, None, None)),
]


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in [*ITEMS, ITEMS[1]]], "item_id long, text string, doc string")


def test_verbatim_and_new_parameters(documents, items):
    got = {r.doc_id: r for r in decontaminate(documents([(i, t) for i, t, _ in CASES]), items).collect()}
    for i, _, (bad, item, verbatim) in CASES:
        assert (got[i].contaminated, got[i].item_id) == (bad, item), (i, got[i])
        if verbatim is not None and i != 15:
            assert got[i].verbatim == verbatim or verbatim == 0.0 and got[i].verbatim < 0.5, got[i]


def test_same_as_brute_force_on_verbatim_windows(spark, documents):
    """Words without placeholders: coverage is the share of an item's 8-word windows that follow each other in the text."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefg" for b in "uvwxyz"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(8, 30)))) for k in range(20)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        item = rng.choice(items)[1].split()
        cut = rng.randrange(len(item))
        docs.append((i, " ".join(words + item[cut // 2 : len(item) - cut // 3] + rng.choices(vocabulary, k=5))))

    def covered(text, item):
        t, w = text.split(), item.split()
        at = {}
        for a in range(len(t) - 7):
            for b in range(len(w) - 7):
                if t[a : a + 8] == w[b : b + 8]:
                    at.setdefault(a - b, set()).add(b)
        return max(map(len, at.values()), default=0) / (len(w) - 7)

    want = {}
    for i, t in docs:
        share = [(covered(t, x), -k) for k, x in items]
        best = max((s for s in share if s[0] >= 0.5), default=None)
        want[i] = (best is not None, best and -best[1], best and best[0])
    got = decontaminate(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.contaminated, r.item_id, r.coverage) for r in got} == want
    assert 20 < sum(w[0] for w in want.values()) < 110


def test_odd_rows(spark, documents, odd_pairs, items):
    got = decontaminate(documents(odd_pairs), items).collect()
    assert len(got) == len(odd_pairs) and not any(r.contaminated for r in got)
    assert decontaminate(documents(odd_pairs), items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(documents(odd_pairs).limit(0), items).count() == 0


def found_in(spark, documents, item, texts):
    got = decontaminate(documents(list(enumerate(texts))), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    return [r.contaminated for r in sorted(got, key=lambda r: r.doc_id)]


def test_new_parameters_in_other_forms(spark, documents):
    item = "Tom has 5 apples and buys some more pears. Tom gives his sister 3 apples and keeps all of the rest. Tom eats 2 apples in the evening."
    forms = [
        item.replace("Tom", "Ann").replace("5", "9").replace("3", "4"),
        item.replace("Tom", "Ada-Marie").replace("5", "1 000").replace("3", "3/4").replace("2", "12:30"),
        item.replace("Tom", "O'Neil").replace("5", "12"),
        item.replace("gives his", "gladly gives his"),
    ]
    assert found_in(spark, documents, item, [around(t) for t in forms]) == [True] * len(forms)
    words = [f"word{k}" for k in range(40)]
    longer = " ".join([*words[:13], "new", *words[13:27], "more", *words[27:]])
    assert found_in(spark, documents, " ".join(words), [around(longer), around(" ".join(words[:18]))]) == [True, False]
    other = item.replace("Tom has", "Ann has").replace("Tom gives", "Bob gives").replace("Tom eats", "Eve eats")
    assert found_in(spark, documents, item, [around(other), around("Ann has apples.")]) == [False, False]


def test_figures_and_short_items(spark, documents):
    figures = "3 + 4 = 7, 5 + 9 = 14, 8 + 8 = 16, 21 + 4 = 25, 6 + 7 = 13"
    assert found_in(spark, documents, figures, [around(figures), around(figures.replace("4", "5"))]) == [True, False]
    capital = "What is the capital of France?"
    assert found_in(spark, documents, capital, [around("Question 5 " + capital), "Question 5 What is the road to France?"]) == [True, False]
    assert found_in(spark, documents, "Who wrote Hamlet", [around("Who wrote Hamlet?"), "They asked who wrote Faust.", "She knows who wrote Hamlet."]) == [True, False, True]


def test_one_form_of_many_items(spark, documents):
    """Every document of the form meets every item of it; they are matched as one class, not pair by pair."""
    text = lambda a, b, who: f"At the market {who} bought {a} red apples and later sold {b} of them again. How many red apples are left there?"
    names = ["Ada", "Ben", "Cleo", "Dan"]
    items = [(k, text(k + 3, 2 * k + 1000, names[k % 4])) for k in range(300)]
    docs = [(i, around(text(5000 + i, 7000 + i, "Zoe"), i)) for i in range(600)] + [(9000, around(items[123][1])), (9001, around("no apples here"))]
    got = {r.doc_id: r for r in decontaminate(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[i].contaminated and got[i].n_items == 300 and got[i].item_id == 0 for i in range(600))
    assert (got[9000].item_id, got[9000].verbatim, got[9000].n_items) == (123, 1.0, 300)
    assert not got[9001].contaminated


def test_a_phrase_of_all_items_brings_nothing_together(spark, documents):
    phrase = "Answer with one number and nothing else at all, please, on one single line."
    rng = random.Random(6)
    items = [(k, " ".join(f"word{rng.randrange(9000)}" for _ in range(24)) + ". " + phrase) for k in range(200)]
    docs = [(i, " ".join(rng.choices(FILL, k=30)) + ". " + phrase) for i in range(300)] + [(9000, around(items[77][1]))]
    got = {r.doc_id: r for r in decontaminate(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not any(got[i].contaminated for i in range(300))
    assert (got[9000].item_id, got[9000].n_items, got[9000].verbatim) == (77, 1, 1.0)


def plain_tokens(text):
    """Template tokens one by one: (canonical, value, is_slot), read with opening capitals as words."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9]+", text):
        w = m[0]
        gap = text[out[-1][3] if out else 0 : m.start()]
        opens = not out or any(ch in '.!?:;"\n' for ch in gap)
        if w[0].isdigit():
            out.append(("NUMBER", w.lower(), True, m.end()))
        elif w[0].isupper() and not opens:
            out.append(("NAME", w.lower(), True, m.end()))
        else:
            out.append((w.lower(), w.lower(), False, m.end()))
    return [t[:3] for t in out]


def test_same_as_brute_force_on_templates(spark, documents):
    """Numbers and names apart from each other: coverage and consistency, on one shift or on neighbouring ones, by plain loops."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    fill = lambda: rng.choice([str(rng.randrange(3)), rng.choice(["Ada", "Ben"]), *[rng.choice(words) for _ in range(4)]])

    def sentence(n):
        out = ["start"]
        while len(out) < n:
            w = fill()
            out.append(w if not (out[-1][0].isdigit() or out[-1][0].isupper()) else rng.choice(words))
        return out

    items = [(k, sentence(rng.randrange(10, 26))) for k in range(12)]
    docs = []
    for i in range(150):
        base = list(rng.choice(items)[1])
        swap = {str(d): str(rng.randrange(3, 9)) for d in range(3)} | {"Ada": rng.choice(["Eve", "Max"]), "Ben": rng.choice(["Eve", "Max"])}
        base = [swap.get(w, w) if rng.random() < 0.95 else w for w in base]
        for _ in range(rng.randrange(3)):
            base.insert(rng.randrange(1, len(base)), rng.choice(words))
        cut = rng.randrange(len(base))
        docs.append((i, " ".join(["lead", *rng.choices(words, k=rng.randrange(5)), *base[cut // 3 :]])))

    def judged(doc, item):
        d, t = plain_tokens(doc), plain_tokens(item)
        best = None
        own = {b for b in range(len(t) - 7) if sum(not x[2] for x in t[b : b + 8]) >= 4}
        pairs = [(a, b) for b in own for a in range(len(d) - 7) if [x[0] for x in d[a : a + 8]] == [x[0] for x in t[b : b + 8]]]
        ranges = {}
        for a, b in pairs:
            for r in (("one", a - b), (0, (a - b) // 16), (1, (a - b + 8) // 16)):
                ranges.setdefault(r, []).append((a, b))
        for found in ranges.values():
            coverage = len({b for _, b in found}) / max(len(own), 1)
            stands = {}
            for a, b in found:
                for x, y in zip(t[b : b + 8], d[a : a + 8], strict=True):
                    if x[2]:
                        stands.setdefault(x[1], set()).add(y[1])
            consistency = sum(len(v) == 1 for v in stands.values()) / len(stands) if stands else 1.0
            if coverage >= 0.5 and consistency >= 0.9:
                best = max(best or (0, 0), (coverage, consistency))
        return best

    got = decontaminate(documents(docs), spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")).collect()
    found = {r.doc_id: r for r in got}
    hits = 0
    for i, text in docs:
        want = [(s, k) for k, t in items if (s := judged(text, " ".join(t)))]
        hits += bool(want)
        # Other ways to read the same texts may find more, never less.
        if want:
            assert found[i].contaminated and (found[i].coverage, found[i].consistency) >= max(s for s, _ in want), (i, want, found[i])
            assert found[i].n_items >= len(want)
    assert 20 < hits < 145
