"""SentencePiece encoding and decoding of merge-type (BPE) models.

A text is encoded from left to right by backtracking: the longest piece at a
position is tried first, a piece may follow another only if merging the two
pieces' characters anew leaves exactly these two, and positions from which no
rest can be encoded are remembered in a bit field.  This gives what merging the
whole text would give, without a merge queue.

Whether merging would leave two pieces as they are is read off how each grows
from its characters: only the parts that stand at the border at the same time
could merge across it, and they do if that merge ranks before the next one on
either side.  Parts at the border are listed once per piece.

Merges never cross from a letter into a following space mark (the vocabulary is
checked for it), so a text falls into words that are encoded on their own and
remembered.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain
from weakref import proxy

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stintwise.llm.words import give_back, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters that are words of their own where no piece has them, as they can't merge with their neighbours.
_APART = "\n\t\r"


@dataclass(frozen=True)
class PieceModel:
    """A merge-type vocabulary: piece, score and kind by id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]

    @cached_property
    def coder(self) -> PieceCoder:
        """The coder of this copy: later tasks of a Python worker need not build it, and it goes with the broadcast model."""
        return PieceCoder(self)

    @staticmethod
    def read(path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a merge-type model with byte fallback and leading space marks is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a model without text normalisation, with a leading space mark, is needed")
        kinds = tuple(p.type for p in model.pieces)
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined or unused pieces are not covered")
        return PieceModel(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), kinds)


def _one_mark_per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("stintwise.piece_bytes", _one_mark_per_byte)


NEVER = float("-inf")
_ID = (1 << 20) - 1
#: Pairs of pieces whose compatibility is looked up for many words at once, the longest words so encoded, and how many together.
PAIR_BITS, LOCKSTEP, TOGETHER = 20, 62, 20_000
#: Judged pairs that are remembered besides.
MOST_PAIRS = 50_000


class Trie:
    """Beginnings of pieces by number; steps from one to the next are looked up for many places at once."""

    BITS, FREE = 19, -1

    def __init__(self, ids: dict[str, int]):
        steps: dict[int, int] = {}
        piece = [-1]
        for p, i in ids.items():
            node = 0
            for char in p:
                key = node << 21 | ord(char)
                node = steps.get(key, -1)
                if node < 0:
                    node = steps[key] = len(piece)
                    piece.append(-1)
            piece[node] = i
        if len(steps) > 1 << self.BITS - 1:
            raise ValueError("pieces with fewer beginnings are needed")
        self.piece = np.array(piece, np.int32)
        self.keys, self.nodes = np.full(1 << self.BITS, self.FREE, np.int64), np.full(1 << self.BITS, -1, np.int32)
        key, node = (np.fromiter(x, np.int64, len(steps)) for x in (steps.keys(), steps.values()))
        place = self._place(key)
        while len(key):
            free = self.keys[place] == self.FREE
            self.keys[place[free]] = key[free]  # of several keys for one place the last stays
            own = self.keys[place] == key
            self.nodes[place[own]] = node[own]
            key, node, place = key[~own], node[~own], self._next(place[~own])

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _next(self, place: np.ndarray) -> np.ndarray:
        return place + 1 & (1 << self.BITS) - 1

    def _step(self, key: np.ndarray) -> np.ndarray:
        place = self._place(key)
        found = self.keys[place]
        out = np.where(found == key, self.nodes[place], -1)
        rest = np.flatnonzero((found != key) & (found != self.FREE))
        while len(rest):
            place[rest] = self._next(place[rest])
            found = self.keys[place[rest]]
            same = found == key[rest]
            out[rest[same]] = self.nodes[place[rest[same]]]
            rest = rest[~same & (found != self.FREE)]
        return out

    def longest(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest piece that begins at each of some places, or -1; ``chars`` ends with one that no piece has."""
        out = np.full(len(at), -1, np.int64)
        nth, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(nth):
            node = self._step(node << 21 | chars[at])
            on = node >= 0
            nth, node, at = nth[on], node[on].astype(np.int64), at[on] + 1
            piece = self.piece[node]
            whole = piece >= 0
            out[nth[whole]] = piece[whole]
        return out


@dataclass(frozen=True)
class Growth:
    """The parts at either end of a piece while it is merged, each with the score of the merge that ends it (last: never).

    ``in_order`` says that merges come by falling score, so that scores tell the time.
    """

    first: list[tuple[str, float]]
    last: list[tuple[str, float]]
    in_order: bool


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Words(dict):
    """The ids of words met lately, as bytes, encoded when first asked for."""

    #: What Python takes for a word, its ids and their places, besides their contents.
    FIXED, LONGEST = 200, 200

    def __init__(self, coder: PieceCoder):
        super().__init__()
        self.coder, self.older, self.held = proxy(coder), {}, 0

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = _packed(self.coder.encode_word(word))
        self.keep(word, found)
        return found

    def keep(self, word: str, found: bytes) -> None:
        if len(word) <= self.LONGEST:
            self.make_room(2 * self.coder.remembered)
            self.keep_all([word], [found])

    def keep_all(self, words: list[str], found: list[bytes]) -> None:
        self.held += self.FIXED * len(words) + 2 * sum(map(len, words)) + sum(map(len, found))
        self.update(zip(words, found, strict=True))

    def make_room(self, most: int) -> None:
        """With more than ``most`` bytes in the newer half, forgets the older one."""
        if self.held > most:
            self.older, self.held = dict(self), 0
            self.clear()


class PieceCoder:
    """Encodes and decodes with one model.

    ``remembered`` bounds the bytes that words and their ids may take before
    some texts are read, twice: when the newer half is full the older one is
    forgotten.  While one text is read, each half takes twice as much at most.
    """

    def __init__(self, model: PieceModel, remembered: int = 16 << 20):
        self.pieces, self.remembered = model.pieces, remembered
        self.ids = {p: i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
        self.scores, self.kinds = model.scores, model.kinds
        self.bytes = [0] * 256
        for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.unknown = {i for i, kind in enumerate(model.kinds) if kind == UNKNOWN}
        self.control = {i for i, kind in enumerate(model.kinds) if kind == CONTROL}
        self._check_marks()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) > 1:
                self.automaton.add_word(p, len(p) << 20 | i)
        self.automaton.make_automaton()
        self.single = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.single_ids = np.full(0x110000, -1, np.int32)
        self.single_ids[[ord(p) for p in self.single]] = list(self.single.values())
        apart = "".join(x for x in _APART if x not in self.single)
        words = f"{MARK}?[^{MARK}{apart}]+|{MARK}+(?={MARK})|{MARK}"
        self.in_words = re.compile(f"{words}|[{apart}]" if apart else words)
        self.between = next(chr(k) for k in range(1 << 16) if chr(k) not in self.single)
        self.length = np.array([len(p) for p in model.pieces], np.int64)
        self.prefix: np.ndarray | None = None
        self.pairs, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.shorter: dict[int, int] = {}
        self.fitting: dict[int, bool] = {}
        self.grown: dict[int, Growth | None] = {}
        self.score_of = {p: model.scores[i] for p, i in self.ids.items()}
        self.raw = [b""] * len(model.pieces)
        for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if kind == BYTE:
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif kind == UNKNOWN:
                self.raw[i] = " ⁇ ".encode()
            elif kind == NORMAL:
                self.raw[i] = p.replace(MARK, " ").encode()
        self.words = Words(self)

    def _check_marks(self) -> None:
        runs = sorted(len(p) for p in self.ids if set(p) == {MARK} and len(p) > 1)
        if any(MARK in p[1:] and set(p) != {MARK} for p in self.ids):
            raise ValueError("a piece has a space mark behind another character")
        if MARK not in self.ids:
            raise ValueError("the space mark has no piece")
        weakest = [self.scores[self.ids[MARK * n]] for n in runs]
        others = [self.scores[i] for p, i in self.ids.items() if set(p) != {MARK}]
        if len(set(weakest)) > 1 or weakest and min(others) <= weakest[0] or len(set(others)) < len(others):
            raise ValueError("other pieces need scores of their own, above those of space runs")
        n = self.longest_run = max(runs, default=1)
        self.rests = [[self.ids[p] for p in self.merged(MARK * k)] for k in range(n)]
        if any([self.ids[p] for p in self.merged(MARK * (n + k))] != [self.ids[MARK * n], *self.rests[k]] for k in range(n)):
            raise ValueError("runs of space marks must begin with the longest piece")

    def merged(self, text: str) -> list[str]:
        """Merging the characters of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def growth(self, this: int) -> Growth | None:
        """How merging makes a piece from its characters; None if it makes something else of them."""
        if this not in self.grown:
            parts = list(self.pieces[this])
            first, last = [(parts[0], NEVER)], [(parts[-1], NEVER)]
            before, in_order = -NEVER, True
            while len(parts) > 1:
                scores = [self.score_of.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
                best = max(scores)
                if best == NEVER:
                    break
                at = scores.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                in_order &= best <= before
                before = best
                if at == 0:
                    first[-1:] = [(first[-1][0], best), (parts[0], NEVER)]
                if at == len(parts) - 1:
                    last[-1:] = [(last[-1][0], best), (parts[-1], NEVER)]
            self.grown[this] = Growth(first, last, in_order) if len(parts) == 1 else None
        return self.grown[this]

    def fits(self, last: int, this: int) -> bool:
        """Whether ``this`` may follow ``last`` (-1: nothing before)."""
        key = last << 20 | this if last >= 0 else -1 - this
        found = self.fitting.get(key)
        if found is None:
            if len(self.fitting) >= MOST_PAIRS:
                self.fitting.clear()
            found = self.fitting[key] = self.growth(this) is not None if last < 0 else self._stay_apart(last, this)
        return found

    def _stay_apart(self, last: int, this: int) -> bool:
        left, right = self.growth(last), self.growth(this)
        if left is None or right is None:
            return False
        if not (left.in_order and right.in_order):
            a, b = self.pieces[last], self.pieces[this]
            return self.merged(a + b) == [a, b]
        i = j = 0
        while True:
            (a, next_a), (b, next_b) = left.last[i], right.first[j]
            across = self.score_of.get(a + b)
            # Of equal scores the leftmost merge comes first: one inside the left piece, then the one across, then one inside the right.
            if across is not None and across > next_a and across >= next_b:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def next_shorter(self, this: int) -> int:
        """The longest proper prefix of a piece that is a piece, or -1."""
        found = self.shorter.get(this)
        if found is None:
            p = self.pieces[this]
            found = self.shorter[this] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
        return found

    def _known(self, text: str) -> list[int]:
        """Backtracking over a text whose characters are all pieces."""
        n = len(text)
        longest, reach = list(map(self.single.__getitem__, text)), [1] * n
        for end, found in self.automaton.iter(text):
            size = found >> 20
            if size > reach[end - size + 1]:
                longest[end - size + 1], reach[end - size + 1] = found & _ID, size
        pieces, out, at, failed = self.pieces, [], 0, 0
        this = longest[0]
        while True:
            end = at + len(pieces[this])
            if not failed >> end & 1 and self.fits(out[-1] if out else -1, this):
                out.append(this)
                at = end
                if at == n:
                    return out
                this = longest[at]
                continue
            this = self.next_shorter(this)
            while this < 0:  # nothing fits here: the position fails, the piece before gives way to a shorter one
                failed |= 1 << at
                back = out.pop()
                at -= len(pieces[back])
                this = self.next_shorter(back)

    def _all_fit(self, last: np.ndarray, this: np.ndarray) -> np.ndarray:
        """:meth:`fits` of many pairs: known ones by a table, the others once each."""
        key = last << 20 | this
        place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        unknown = np.flatnonzero(self.pairs[place] != key)
        out = self.pair_fits[place]
        if len(unknown):
            some, nth = np.unique(key[unknown], return_inverse=True)
            found = np.array([self.fits(k >> 20, k & _ID) for k in some.tolist()], bool)
            out[unknown] = found[nth]
            self.pairs[place[unknown]], self.pair_fits[place[unknown]] = key[unknown], out[unknown]
        return out

    def _of_known_characters(self, words: list[str]) -> list[str]:
        """The words whose characters are all pieces."""
        joined = self.between.join([*words, ""])
        unknown = self.single_ids[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)] < 0
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        unknown[ends] = False
        known = np.ones(len(words), bool)
        known[np.searchsorted(ends, np.flatnonzero(unknown))] = False
        return [w for w, k in zip(words, known.tolist(), strict=True) if k]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """:meth:`_known` of many words, as bytes, of up to ``LOCKSTEP`` characters, all pieces: one step of each at a time."""
        if self.prefix is None:
            self.prefix = np.array([self.next_shorter(i) if kind == NORMAL else -1 for i, kind in enumerate(self.kinds)], np.int64)
            self.trie = Trie(self.ids)
        chars = np.frombuffer(self.between.join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(n + 1) - n - 1
        out = np.full((len(words), int(n.max(initial=0)) + 1), -1, np.int32)
        depth, at, failed = (np.zeros(len(words), np.int64) for _ in range(3))
        this = self.trie.longest(chars, first)
        alive = np.arange(len(words))
        while len(alive):
            stuck = this[alive] < 0
            back = alive[stuck]  # nothing fits there: the position fails, the piece before gives way to a shorter one
            if len(back):
                failed[back] |= np.int64(1) << at[back]
                depth[back] -= 1
                piece = out[back, depth[back]].astype(np.int64)
                at[back] -= self.length[piece]
                this[back] = self.prefix[piece]
            tried = alive[~stuck]
            piece = this[tried]
            end = at[tried] + self.length[piece]
            last = np.where(depth[tried] > 0, out[tried, np.maximum(depth[tried] - 1, 0)], -1).astype(np.int64)
            ok = (failed[tried] >> end & 1 == 0) & self._all_fit(last, piece)
            this[tried[~ok]] = self.prefix[piece[~ok]]
            on = tried[ok]
            out[on, depth[on]] = piece[ok]
            depth[on] += 1
            at[on] = end[ok]
            more = at[on] < n[on]
            this[on[more]] = self.trie.longest(chars, first[on[more]] + at[on[more]])
            done = np.zeros(len(words), bool)
            done[on[~more]] = True
            alive = alive[~done[alive]]
        flat = out[np.arange(out.shape[1]) < depth[:, None]].tobytes()
        stop = 4 * np.cumsum(depth)
        return [flat[a:b] for a, b in zip((stop - 4 * depth).tolist(), stop.tolist(), strict=True)]

    def prepare(self, splits: Iterable[list[str]]) -> None:
        """Encodes the words of some texts that are not remembered, together."""
        words = self.words
        # What these texts add leaves room for the words that are encoded one by one: nothing they need is forgotten among them.
        words.make_room(self.remembered * 3 // 4)
        missing = set(chain.from_iterable(splits)).difference(words)
        known = list(missing.intersection(words.older))
        words.keep_all(known, list(map(words.older.__getitem__, known)))
        new = [w for w in missing.difference(known) if len(w) <= LOCKSTEP and w[-1] != MARK]
        for start in range(0, len(new), TOGETHER):
            words.make_room(2 * self.remembered)  # a very long text
            part = self._of_known_characters(new[start : start + TOGETHER])
            words.keep_all(part, self.encode_words(part))

    def encode_word(self, word: str) -> list[int]:
        """A word with at most one space mark, which leads it; unknown characters become bytes."""
        whole = self.ids.get(word)
        if whole is not None and self.fits(-1, whole):
            return [whole]
        out: list[int] = []
        start = 0
        for k, c in enumerate(word):
            if c not in self.ids:
                if k > start:
                    out += self._known(word[start:k])
                out += [self.bytes[b] for b in c.encode()]
                start = k + 1
        if start < len(word):
            out += self._known(word[start:])
        return out

    def _spaced(self, words: list[str]) -> Iterator[bytes]:
        """Words among runs of space marks: marks that no word takes form runs, which begin with the longest piece."""
        lone, run = _packed([self.ids[MARK]]), 0
        for word in [*words, ""]:
            if word and word[0] == MARK and word[-1] == MARK:
                run += len(word)
                continue
            ids = self.words[word] if word else b""
            if run and ids[:4] == lone:
                run, ids = run + 1, ids[4:]
            if run:
                yield _packed([self.ids[MARK * self.longest_run]]) * (run // self.longest_run)
                yield _packed(self.rests[run % self.longest_run])
                run = 0
            yield ids

    def forget(self) -> None:
        """Drops the words met on the way: the worker outlives its task, and most words are rare.

        Pairs of pieces stay known by their table of fixed size.
        """
        self.words, self.fitting = Words(self), {}

    def split(self, text: str | None) -> list[str]:
        """The words of a text, each with the space mark before it."""
        return self.in_words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None, words: list[str] | None = None) -> list[int]:
        return self.packed(text, words).tolist()

    def packed(self, text: str | None, words: list[str] | None = None) -> np.ndarray:
        """The ids of a text in an array."""
        if not text:
            return np.empty(0, np.int32)
        words = self.split(text) if words is None else words
        marked = MARK + MARK in text or "  " in text or text[0] in f" {MARK}" or f" {MARK}" in text or f"{MARK} " in text
        return np.frombuffer(b"".join(self._spaced(words) if marked else map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        first = next((i for i in ids if i not in self.control), None)
        raw = b"".join(map(self.raw.__getitem__, ids))
        if first is not None and self.pieces[first][:1] == MARK:
            raw = raw[1:]
        return raw.decode("utf-8", "stintwise.piece_bytes")


#: Texts are read so many bytes at a time, or a text at a time.
_READ = 1 << 19


def encode_decode(docs: DataFrame, model_path: str, keep_text: bool = False) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` of each whole text, and the ``text`` if asked for.

    A null text is encoded as the empty one.

    One row per input row, repeated rows and null ids included; an empty table
    gives no rows; further columns are not read.  The vocabulary (of fixed
    size) is read on the driver and broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.read(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model.value.coder
        for batch in batches:
            for some in slices(batch.column(1), _READ):
                part = batch.slice(some.start, some.rows)
                texts = part.column(1).to_pylist()
                splits = [coder.split(t) for t in texts]
                coder.prepare(splits)
                ids = list(map(coder.packed, texts, splits))
                del texts, splits
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                decoded = pa.array([coder.decode(x.tolist()) for x in ids], pa.string())
                columns = [part.column(0), lists, decoded, *([part.column(1)] if keep_text else [])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded", "text"][: len(columns)])
        coder.forget()
        give_back()

    rows = docs.selectExpr("cast(doc_id as long) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string" + ", text string" * keep_text)
