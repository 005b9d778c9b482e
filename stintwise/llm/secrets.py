"""Secret scans that look through nested encodings.

Each text is searched for assignments, access keys and hex runs.  A worklist
then unwraps every layer found inside: percent, Unicode and character escapes,
base64, UTF-16, and what compressed data holds.  All escapes of a layer are
decoded in one pass, and an escape that stands for the beginning of another one
is followed to its end at once, so neither many sorts of escapes nor long chains
of them make many layers.  Base64 is decoded at all four alignments, over line
breaks, and its bytes are searched as they are, so nothing around or between
readable parts hides them; compressed data is looked for at every place of
every decoded layer.  Each layer is searched again and unwrapped in turn until
nothing new appears; a layer whose characters and places are those of one met
before is not entered again, whatever way led to it.  What is found inside is
mapped back to the characters of the text that encode it.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")

# The patterns of the kinds, and the least length of a match (for `assign`, of its value).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Any run that can be base64; it goes on over single line breaks.  Whatever can be found takes 16 characters of it or more.
LEAST_RUN = 16
_RUN = re.compile(
    r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*"
    r"|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{1,15}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+"
)
_STANDARD = str.maketrans("-_", "+/")
#: Whatever can be found in a layer, or inside it, takes so many ASCII characters in a row.
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
_WIDE = re.compile("(?:[\t\n\r\x20-\x7e]\x00){16,}|(?:\x00[\t\n\r\x20-\x7e]){16,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
_ESCAPE = re.compile(
    r"%([0-9A-Fa-f]{2})|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\U([0-9a-fA-F]{8})|\\u\{([0-9a-fA-F]{1,6})\}"
    r"|&#([0-9]{1,7});|&#[xX]([0-9a-fA-F]{1,6});"
)
#: The longest escape, and the characters that one can begin with.
_LONGEST, _BEGINS = 10, "%\\&"
#: Decompressed data is searched in windows of so many bytes; a run that crosses the edge goes on into the next, up to ``LONGEST_RUN``.
WINDOW, PIECE, LONGEST_RUN = 4 << 20, 16 << 10, 8 << 20


@dataclass(frozen=True)
class Layer:
    """A decoded text, and the span of the whole text behind each of its characters, or one for all of them.

    Decoded bytes are one character each: whatever is searched for is ASCII.
    ``inside`` yields the layers of compressed data in it.
    """

    text: str
    starts: np.ndarray | int
    ends: np.ndarray | int
    via: str
    inside: Iterator[Layer] | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (self.starts, self.ends) if isinstance(self.starts, int) else (int(self.starts[a]), int(self.ends[b - 1]))

    def part(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray | int, np.ndarray | int]:
        """The spans behind characters that stand for ``starts`` to ``ends`` of this layer each."""
        return (self.starts, self.ends) if isinstance(self.starts, int) else (self.starts[starts], self.ends[ends - 1])

    def key(self) -> bytes:
        found = blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for places in (self.starts, self.ends):
            found.update(str(places).encode() if isinstance(places, int) else places.tobytes())
        return found.digest()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the secrets that stand in a text as they are."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _meant(m: re.Match) -> str | None:
    """The character that an escape stands for; bytes are one each, half of a pair is no character that matters."""
    percent, unit, raw, *numbers = m.groups()
    digits = percent or unit or raw or numbers[0] or numbers[1] or numbers[3]
    code = int(digits, 16) if digits else int(numbers[2])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def decoded(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with its escapes decoded until none is left, and where each character came from; None without escapes.

    What an escape stands for may be part of another one, with characters
    before it, behind it, or both: after each step only the few characters
    around it are looked at, and each step leaves fewer, so the time grows with
    the text.
    """
    first = _ESCAPE.search(text)
    if not first:
        return None
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0

    def copy(until: int) -> None:
        out.extend(text[at:until])
        starts.extend(range(at, until))
        ends.extend(range(at + 1, until + 1))

    m = first
    while m:
        copy(m.start())
        char, begin, at = _meant(m), m.start(), m.end()
        while True:
            # The character and its neighbours may be an escape of their own.
            left = "".join(out[max(0, len(out) - _LONGEST + 1) :])
            near = left + char + text[at : at + _LONGEST - 1]
            again = None
            place = near.rfind("%", 0, len(left) + 1), near.rfind("\\", 0, len(left) + 1), near.rfind("&", 0, len(left) + 1)
            for k in sorted(place, reverse=True):
                found = _ESCAPE.match(near, k) if k >= 0 else None
                if found and found.end() > len(left):
                    again = found
                    break
            if not again:
                break
            taken = len(left) - again.start()
            if taken > 0:
                begin = starts[-taken]
                del out[-taken:], starts[-taken:], ends[-taken:]
            char, at = _meant(again), at + max(0, again.end() - len(left) - 1)
        out.append(char)
        starts.append(begin)
        ends.append(at)
        m = _ESCAPE.search(text, at)
    copy(len(text))
    return "".join(out), np.array(starts), np.array(ends)


def _from(chunks: Iterator[bytes], at: int) -> Iterator[bytes]:
    """The bytes from a place on, in small pieces."""
    for chunk in chunks:
        view = memoryview(chunk)[at:]
        at = max(0, at - len(chunk))
        for k in range(0, len(view), PIECE):
            yield bytes(view[k : k + PIECE])


_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)


def _opener(head: bytes):
    if head[:1] == b"B":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:1] == b"\xfd" else zlib.decompressobj(31 if head[:1] == b"\x1f" else 15)


def _decompressed(pieces: Iterator[bytes], used: list[int]) -> Iterator[bytes]:
    """What compressed data holds, member after member; ``used`` says how many bytes its whole members take."""
    opened, given, fed = None, b"", 0
    for piece in pieces:
        given, fed = given + piece, fed + len(piece)
        while given or opened and not getattr(opened, "needs_input", True):
            if not opened:
                if len(given) < 6:
                    break
                if not _MAGIC.match(given):
                    return
                opened = _opener(given)
            spare = opened.copy() if hasattr(opened, "copy") else None
            try:
                out = opened.decompress(given, WINDOW)
            except _BROKEN:
                # What stands before the broken byte counts.
                try:
                    for k in range(len(given) if spare else 0):
                        yield spare.decompress(given[k : k + 1])
                except _BROKEN:
                    pass
                return
            if out:
                yield out
            given = getattr(opened, "unconsumed_tail", b"")
            if opened.eof:
                given, opened = opened.unused_data, None
                used[0] = fed - len(given)


#: A line without anything that can be found, or be part of it, ends here.
_GAP = re.compile(rb"[^A-Za-z0-9+/_.=\-\"':\x20\t\r\n%\\&#;{}\x00]|\n[\x20\t]*\r?\n")


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """Windows of decompressed data, each with the place of its first byte.

    They are cut behind bytes that nothing runs across; without one, the window
    grows up to ``LONGEST_RUN``.
    """
    kept, at = b"", 0
    parts: list[bytes] = []
    size = 0
    for chunk in chunks:
        parts.append(chunk)
        size += len(chunk)
        if size >= WINDOW:
            now = b"".join([kept, *parts])
            parts, size = [], 0
            gaps = [m.end() for m in _GAP.finditer(now, max(0, len(now) - WINDOW // 2))]
            cut = gaps[-1] if gaps else len(now) if len(now) >= LONGEST_RUN else 0
            if cut:
                yield at, now[:cut]
            at, kept = at + cut, now[cut:]
    if kept or parts:
        yield at, b"".join([kept, *parts])


def _compressed(raw: bytes, at: int, source, until: list[int], span, via: str) -> Iterator[Layer]:
    """The windows of all compressed data that begins in ``raw``, which stands at ``at`` of ``source()``."""
    for m in _MAGIC.finditer(raw):
        begin = at + m.start()
        if begin < until[0]:
            continue
        used = [0]
        inner = partial(lambda begin, used: _decompressed(_from(source(), begin), used), begin, used)
        lo = hi = None
        below = [0]
        met: set[bytes] = set()
        for place, window in _windows(inner()):
            if lo is None:
                lo, hi = span(m.start(), inner, used)
            key = blake2b(window, digest_size=16).digest()
            if key in met:
                continue  # equal windows of one span hold the same
            met.add(key)
            deeper = _compressed(window, place, inner, below, lambda *_, lo=lo, hi=hi: (lo, hi), f"{via}>compressed")
            yield Layer(window.decode("latin-1"), lo, hi, via, deeper)
        until[0] = max(until[0], begin + used[0])


def _base64_layers(layer: Layer, via: str) -> Iterator[Layer]:
    """Each run of base64 at its four alignments: text before or after it does not hide a layer."""
    for m in _RUN.finditer(layer.text):
        run, places = m[0], np.arange(m.start(), m.end())
        if "\n" in run:
            places = places[[c not in "\x20\t\r\n" for c in run]]
            run = "".join(run.split())
        if len(run) < LEAST_RUN:
            continue
        flat = run.translate(_STANDARD).encode()
        for skip in range(4):
            body = flat[skip : len(flat) - ((len(flat) - skip) % 4 == 1)]
            raw = binascii.a2b_base64(body + b"=" * (-len(body) % 4))
            last = skip + len(body) - 1

            def span(j: int, inner, used: list[int], skip=skip, last=last, places=places) -> tuple[int, int]:
                for _ in inner():
                    pass
                end = min(skip - (-(j + used[0]) * 4 // 3) - 1, last) if used[0] else last
                return layer.span(int(places[skip + j * 4 // 3]), int(places[end]) + 1)

            if _MAGIC.search(raw):
                yield Layer("", 0, 0, "", _compressed(raw, 0, partial(lambda raw: iter([raw]), raw), [0], span, f"{via}compressed"))
            text = raw.decode("latin-1")
            if _STRETCH.search(raw) or _WIDE.search(text):
                j = np.arange(len(raw))
                spans = layer.part(places[skip + j * 4 // 3], places[np.minimum(skip - (-(j + 1) * 4 // 3) - 1, last)] + 1)
                yield Layer(text, *spans, f"{via}base64")


def _escape_layers(layer: Layer, via: str) -> Iterator[Layer]:
    """The layer with its escapes decoded, the same with ``+`` read as a space, and what its bytes hold compressed."""
    found = decoded(layer.text) if any(c in layer.text for c in _BEGINS) else None
    if not found:
        return
    text, starts, ends = found
    name = f"{via}{'url' if '%' in layer.text and re.search('%[0-9A-Fa-f]{2}', layer.text) else 'unicode'}"
    inner = Layer(text, *layer.part(starts, ends), name)
    raw = text.encode("latin-1", "replace")
    if _MAGIC.search(raw):

        def span(j: int, scan_, used: list[int]) -> tuple[int, int]:
            for _ in scan_():
                pass
            return inner.span(j, j + used[0] if used[0] else len(raw))

        yield Layer("", 0, 0, "", _compressed(raw, 0, lambda: iter([raw]), [0], span, f"{name}>compressed"))
    if "+" in text and "%" in layer.text:
        yield Layer(text.replace("+", " "), inner.starts, inner.ends, name)
    yield inner


def _wide_layers(layer: Layer, via: str) -> Iterator[Layer]:
    """Stretches of UTF-16, read one byte of two."""
    for m in _WIDE.finditer(layer.text):
        first = 1 if m[0][0] == "\x00" else 0
        at = np.arange(m.start() + first, m.end(), 2)
        starts = at - first
        yield Layer(m[0][first::2], *layer.part(starts, starts + 2), f"{via}utf16")


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """Every layer directly inside another."""
    via = layer.via and f"{layer.via}>"
    if "\x00" in layer.text:
        yield from _wide_layers(layer, via)
    yield from _base64_layers(layer, via)
    yield from _escape_layers(layer, via)


def nested_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, via)`` of secrets inside encoded layers, with the encodings from outside inwards.

    A window of compressed data is searched with all that is inside it before
    the next one is made.
    """
    if not (any(c in text for c in _BEGINS) or _RUN.search(text)):
        return []
    found: dict[tuple[str, int, int, str], None] = {}
    place = np.arange(len(text) + 1)
    met: set[bytes] = set()
    work: list[Iterator[Layer]] = [_unwrapped(Layer(text, place[:-1], place[1:], ""))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.text:
            key = layer.key()
            if key in met:
                continue
            met.add(key)
            for kind, a, b in base_spans(layer.text):
                found[kind, *layer.span(a, b), layer.via] = None
            work.append(_unwrapped(layer))
        if layer.inside:
            work.append(layer.inside)
    return sorted(found, key=lambda s: s[3].count(">"))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, str]]]:
    """The base spans, and the further ones found by unwrapping, each by start, then kind."""
    if not text:
        return [], []
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=key)
    known = set(base)
    more: dict[tuple[str, int, int], str] = {}
    for kind, a, b, via in nested_spans(text):
        if (kind, a, b) not in known:
            more.setdefault((kind, a, b), via)
    return base, [(*s, more[s]) for s in sorted(more, key=key)]


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, nested`` per row of ``docs(doc_id, text)``: arrays of ``kind, start, end`` (and ``via``).

    Positions count code points of the whole text, ends excluded.  A null text
    counts as empty and has no spans; repeated rows and null ids give results
    of their own; an empty table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [scan(t) for t in part.column(1).to_pylist()]
                base = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b] for b, _ in found]
                nested = [[dict(zip(("kind", "start", "end", "via"), s, strict=True)) for s in n] for _, n in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, _BASE), pa.array(nested, _NESTED)], ["doc_id", "base", "nested"])

    span = "kind: string, start: long, end: long"
    schema = f"doc_id long, base array<struct<{span}>>, nested array<struct<{span}, via: string>>"
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)


_SPAN = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
_BASE = pa.list_(pa.struct(_SPAN))
_NESTED = pa.list_(pa.struct([*_SPAN, ("via", pa.string())]))
