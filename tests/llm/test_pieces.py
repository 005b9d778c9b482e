import random
from weakref import ref

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from stintwise.llm.pieces import PieceCoder, PieceModel, Trie, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    return PieceCoder(PieceModel.read(PATH), remembered=50_000), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(seed, n):
    rng = random.Random(seed)
    alphabets = ["the ing of tion", "aeiou rstln  ", "▁ ▁a ", "0123456789.,-", "éüñçß œ", "①😀中文字 a", "\n\t\r \x00 ab", "aaaaaaa", "  "]
    words = ["tion", "the", "ing", "unbelievable", "Internationalization", "ciónmente", "ung", "ß", "=====", "----", "://", "\\u00e9"]
    for _ in range(n):
        chosen = rng.choices(alphabets, k=2)
        yield "".join(rng.choice(words) if rng.random() < 0.2 else rng.choice(rng.choice(chosen)) for _ in range(rng.randrange(60)))


def test_encodes_and_decodes_as_the_library(coders):
    ours, library = coders
    for text in [*texts(1, 4000), "", " ", "▁", " " * 40 + "x" + " " * 17, "a" * 300, "<s> </s> <unk> <0x41>"]:
        ids = ours.encode(text)
        assert ids == library.encode(text), repr(text)
        assert ours.decode(ids) == library.decode(ids), repr(text)


def test_words_encoded_together(coders):
    _, library = coders
    ours = PieceCoder(PieceModel.read(PATH))
    many = [*texts(5, 3000), "x" * 70, "a\nb \n c", "\n\n", "\t▁\n ", "line one\nline two\r\n"]
    splits = [ours.split(t) for t in many]
    ours.prepare(splits)
    together = [w for s in splits for w in s if len(w) <= 62 and w[-1] != "▁" and set(w) <= set(ours.single)]
    assert len(together) > 10_000 and all(w in ours.words for w in together)
    for text, words in zip(many, splits, strict=True):
        assert ours.encode(text, words) == library.encode(text), repr(text)


def test_pieces_that_may_follow_each_other(coders):
    ours, _ = coders
    rng = random.Random(4)
    known = sorted(ours.ids.values())
    for _ in range(4000):
        a, b = rng.choice(known[:4000]), rng.choice(known)
        first, second = ours.pieces[a], ours.pieces[b]
        assert ours.fits(a, b) == (ours.merged(first + second) == [first, second]), (first, second)


def test_decodes_any_ids_as_the_library(coders):
    ours, library = coders
    rng = random.Random(2)
    for _ in range(3000):
        pool = rng.choice([32000, 400, 260])
        ids = [rng.randrange(pool) for _ in range(rng.randrange(12))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_table(spark, documents, odd_pairs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = encode_decode(documents(odd_pairs), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in odd_pairs), key=key)
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == want
    assert encode_decode(documents(odd_pairs).limit(0), PATH).count() == 0


def test_words_of_one_part_are_not_forgotten_within_it(coders):
    _, library = coders
    ours, calls = PieceCoder(PieceModel.read(PATH), remembered=100_000), []
    alone = ours.encode_word
    ours.encode_word = lambda word: calls.append(word) or alone(word)
    rng = random.Random(6)
    for _ in range(4):
        many = [" ".join("".join(rng.choices("etaoin", k=5)) for _ in range(12)) for _ in range(150)]
        splits = [ours.split(t) for t in many]
        ours.prepare(splits)
        for text, words in zip(many, splits, strict=True):
            assert ours.encode(text, words) == library.encode(text), repr(text)
    assert not calls and ours.words.older


def test_longest_pieces_as_by_plain_search(coders):
    ours, _ = coders
    rng, trie = random.Random(8), Trie(coders[0].ids)
    for text in texts(9, 300):
        text = "".join(c for c in text if c in ours.single)
        if text:
            chars = np.array([*map(ord, text), ord(ours.between)], np.int64)
            at = np.array([rng.randrange(len(text)) for _ in range(20)], np.int64)
            want = [next(ours.ids[text[a:b]] for b in range(min(len(text), a + 80), a, -1) if text[a:b] in ours.ids) for a in at.tolist()]
            assert trie.longest(chars, at).tolist() == want


def test_a_coder_goes_with_its_model_and_words_with_their_task():
    model = PieceModel.read(PATH)
    coder = model.coder
    assert coder is model.coder
    coder.prepare([coder.split("some words to remember")])
    assert coder.words and all(isinstance(ids, bytes) for ids in coder.words.values())
    coder.forget()
    assert not coder.words and not coder.fitting
    gone = ref(coder)
    del coder, model
    assert gone() is None
