import base64
import bz2
import gzip
import random
import re
import subprocess
import sys
import time
import urllib.parse
import zlib

from stintwise.llm import secrets
from stintwise.llm.secrets import base_spans, decoded, find_secrets, nested_spans, scan


def plain_base(text):
    """The definition, pattern by pattern, with matches that fail dropped."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 12:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_as_defined():
    rng = random.Random(1)
    bits = ["token", "PassWord", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef",
            "\u212a", "ſecret", "é", "\n", "x", "password=token: ", "a" * 12]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert sorted(base_spans(text)) == plain_base(text), repr(text)


SECRET = 'password = "hunter2hunter2hunter2"'


def b64(raw):
    return base64.b64encode(raw if isinstance(raw, bytes) else raw.encode()).decode()


def test_nested_layers_are_found_and_mapped():
    for via, wrapped in {
        "base64": b64(SECRET),
        "url": urllib.parse.quote(SECRET, safe=""),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "base64>base64": b64(b64(SECRET)),
        "url>base64": urllib.parse.quote("x=" + b64(SECRET) + "&y=%", safe="="),
        "base64>url": b64(urllib.parse.quote(SECRET, safe="")),
        "compressed": b64(gzip.compress(SECRET.encode())),
        "base64>compressed": b64(b64(zlib.compress(SECRET.encode()))),
        "compressed>base64>url": b64(bz2.compress(b64(urllib.parse.quote(SECRET, safe="")).encode())),
    }.items():
        text = f"é und davor {wrapped} danach"
        found = {(k, v): (a, b) for k, a, b, v in nested_spans(text)}
        assert any(k == "assign" for k, _ in found), (via, found)
        spans = [s for (k, v), s in found.items() if k == "assign"]
        low, high = 12, 12 + len(wrapped)
        assert all(low <= a < b <= high for a, b in spans), (via, spans)


def test_exact_places_in_escapes():
    text = "a %70assword%3D%22" + "0" * 14 + "%22 b"
    assert [(k, text[a:b]) for k, a, b, _ in nested_spans(text) if k == "assign"] == [("assign", "%70assword%3D%22" + "0" * 14)]
    inner = "key " + SECRET
    text = "go " + b64(inner)
    (_, a, b, via), *_ = nested_spans(text)
    assert via == "base64" and base64.b64decode(text[a - (a - 3) % 4 : b + (-(b - 3)) % 4]).decode().endswith(SECRET.rstrip('"')[-8:] + '"')


def test_cycles_and_bombs_end():
    assert scan("%25" * 50 + "41")[0] == []
    bomb = b64(zlib.compress(b"a" * (9 << 20) + SECRET.encode() + b"b" * (9 << 20), 9))
    assert any(k == "assign" for k, *_ in nested_spans("see " + bomb))


def test_plain_prose_adds_nothing():
    assert scan("internationalization counterrevolutionaries uncharacteristically 100% sure \\o/ &# ") == ([], [])


def spans_of(wrapped, kind="assign"):
    text = f"see {wrapped} end"
    return [text[a:b] for k, a, b, _ in nested_spans(text) if k == kind]


def test_layers_glued_to_other_characters():
    plain = b"password = Sup3rSecretValue99 and more"
    alone = spans_of(b64(plain))
    assert len(alone) == 1
    for before in ("https://h.example/cb/", "key_", "x", "ab/", "abc-", "a_b/c_d/"):
        assert spans_of(before + b64(plain)) == alone, before
        assert spans_of(before + b64(plain) + "/tail") == alone, before
        for packed in (gzip.compress(plain), zlib.compress(plain), bz2.compress(plain)):
            assert len(spans_of(before + b64(packed) + "_tail")) == 1, before


def test_layers_are_unwrapped_to_the_end():
    plain = b"password = Sup3rSecretValue99 and more"
    for name, wrapped in {
        "byte order mark": b64(b"\xef\xbb\xbf" + plain),
        "no-break space": b64("a\u00a0 ".encode() + plain),
        "NUL": b64(plain + b"\0"),
        "compressed twice": b64(gzip.compress(gzip.compress(plain))),
        "compressed three ways": b64(bz2.compress(zlib.compress(gzip.compress(plain)))),
        "second member": b64(gzip.compress(b"nothing") + gzip.compress(plain)),
        "across members": b64(gzip.compress(plain[:15]) + gzip.compress(plain[15:])),
        "bytes before a file": b64(b"\0\1\2\3" + gzip.compress(plain)),
        "over lines": base64.encodebytes(b"x" * 50 + plain).decode(),
        "compressed over lines": base64.encodebytes(gzip.compress(" ".join(map(str, range(300))).encode() + b" " + plain)).decode(),
        "not UTF-8, percent": "%E9" + urllib.parse.quote(plain, safe=""),
        "not UTF-8, escapes": "\\xff" + "".join(f"\\x{c:02x}" for c in plain),
    }.items():
        assert len(spans_of(wrapped)) == 1, name
    (found,) = spans_of("%E9" + "".join(f"%{c:02x}" for c in b"password=Sup3rSecretValue99"))
    assert found == "".join(f"%{c:02x}" for c in b"password=Sup3rSecretValue99")


def test_a_bomb_needs_no_memory():
    start = "import resource, sys; from stintwise.llm.secrets import nested_spans"
    show = "print(len(nested_spans(sys.stdin.read())), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)"
    packing = zlib.compressobj(9)
    bomb = b"".join(packing.compress(bytes([97 + k % 20]) * (4 << 20)) for k in range(12)) + packing.compress(b" " + SECRET.encode()) + packing.flush()
    done = subprocess.run([sys.executable, "-c", f"{start}; {show}"], input="see " + b64(bomb), capture_output=True, text=True, check=True)
    found, megabytes = map(int, done.stdout.split())
    assert found and megabytes < 900


def test_many_sorts_of_escapes_end():
    for k in (4, 15, 400):
        text = "%" + "25" * k + "41 " + "\\" + "u005c" * (k - 1) + "u0041"
        start = time.monotonic()
        assert nested_spans(text) == [] and decoded(text)[0] == "A A"
        assert time.monotonic() - start < 2


def test_long_chains_end():
    chains = {
        "percent": "%" + "25" * 500_000 + "41",
        "last digit": "%4" + "%3" * 300_000 + "1",
        "in turn": "%" + "5cu0025" * 100_000 + "41",
        "references": "&" + "#38;" * 200_000 + "#65;",
    }
    for name, chain in chains.items():
        start = time.monotonic()
        text, starts, ends = decoded(chain)
        assert text == "A" and (starts[0], ends[0]) == (0, len(chain)), name
        assert not scan(chain)[1], name
        assert time.monotonic() - start < 20, name
    packed = "%" + "25" * 50_000 + "41KIA" + "ABCDEFGH12345678" + " " + "%25" * 50_000 + "70assword=" + "x" * 14
    assert {(k, a) for k, a, *_ in nested_spans(packed) if k != "hex"} == {("access", 0), ("assign", packed.index("%2570assword"))}


def test_escapes_decode_to_the_end_as_by_repeating():
    """One pass gives what decoding escape by escape, from the left, gives in the end."""
    rng = random.Random(9)
    bits = ["%", "25", "41", "5c", "\\", "u0041", "u005c", "x25", "x5c", "u{26}", "&#", "38;", "#x25;", "x", "U00000041", "7", "0", "g", " "]

    def plain(text):
        m = re.search(r"%[0-9A-Fa-f]{2}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\U[0-9a-fA-F]{8}|\\u\{[0-9a-fA-F]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};", text)
        if not m:
            return text
        digits = re.sub(r"[^0-9a-fA-F]", "", m[0][1:].lstrip("uUxX#")) if m[0][0] != "&" else m[0][2:-1]
        code = int(digits.lstrip("xX"), 16) if m[0][0] != "&" or digits[0] in "xX" else int(digits)
        char = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return plain(text[: m.start()] + char + text[m.end() :])

    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        found = decoded(text)
        want = plain(text)
        assert (found[0] if found else text) == want, (text, found, want)
        if found:
            assert (found[1][1:] == found[2][:-1]).all() and len(found[1]) == len(found[0])


def test_forms_that_hide_layers():
    plain = b"password = Sup3rSecretValue99 and more"
    wide = plain.decode()
    for name, wrapped in {
        "gzip as percent escapes": "".join(f"%{c:02x}" for c in gzip.compress(plain)),
        "gzip as escapes": "".join(f"\\x{c:02x}" for c in gzip.compress(plain)),
        "zlib as unicode escapes": "".join(f"\\u{c:04x}" for c in zlib.compress(plain)),
        "UTF-16": b64(wide.encode("utf-16-le")),
        "UTF-16, high byte first": b64(wide.encode("utf-16-be")),
        "UTF-16 as escapes": "".join(f"%{c:02x}" for c in wide.encode("utf-16-le")),
        "form": "password+%3D+Sup3rSecretValue99",
        "form in base64": b64("q=password+%3D+Sup3rSecretValue99"),
        "short first line": b64(plain)[:12] + "\n" + b64(plain)[12:],
        "short lines": "\n".join(b64(plain)[k : k + 8] for k in range(0, 52, 8)),
        "escaped base64 of compressed UTF-16": urllib.parse.quote(b64(zlib.compress(wide.encode("utf-16-le"))), safe=""),
    }.items():
        assert len(spans_of(wrapped)) == 1, (name, spans_of(wrapped))


def test_random_nests_against_a_plain_recursive_version():
    """Layer inside layer in any order; a plain recursive unwrapping of the whole string says what is in it."""
    rng = random.Random(12)
    ways = {
        "base64": (b64, lambda t: base64.b64decode(t).decode()),
        "percent": (lambda t: "".join(f"%{ord(c):02x}" if rng.random() < 0.7 or c in "%\\&" else c for c in t), urllib.parse.unquote),
        "unicode": (lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), t)),
        "gzip": (lambda t: b64(gzip.compress(t.encode())), lambda t: gzip.decompress(base64.b64decode(t)).decode()),
        "bz2": (lambda t: b64(bz2.compress(t.encode())), lambda t: bz2.decompress(base64.b64decode(t)).decode()),
    }
    for n in range(60):
        secret = f"password = Hidden{n:03d}{rng.randrange(10**9):09d}"
        chosen = [rng.choice(list(ways)) for _ in range(rng.randrange(1, 5))]
        wrapped = secret
        for w in chosen:
            wrapped = ways[w][0](wrapped)
        again = wrapped
        for w in reversed(chosen):
            again = ways[w][1](again)
        assert again == secret
        text = f"before {wrapped} after"
        found = [(a, b) for k, a, b, _ in nested_spans(text) if k == "assign"]
        assert found and all(7 <= a < b <= 7 + len(wrapped) for a, b in found), chosen


def test_runs_across_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 16)
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abc\x01 \n") for _ in range(n))
    for before in (65_530, 65_536 - 20, 131_072 - 30, 40_000):
        inner = noise(before) + "\x01" + b64(gzip.compress(SECRET.encode())) + "\x01" + noise(90_000) + "\x01" + SECRET + "\x01" + noise(30_000)
        text = b64(zlib.compress(inner.encode("latin-1")))
        found = {via for k, _, _, via in nested_spans(text) if k == "assign"}
        assert found >= {"compressed", "compressed>compressed"}, (before, found)


def test_table(documents, odd_pairs):
    pairs = [*odd_pairs, (8, f"x {SECRET} " + b64(SECRET))]
    got = find_secrets(documents(pairs)).collect()
    assert len(got) == len(pairs)
    one = next(r for r in got if r.doc_id == 8)
    assert [(s.kind, s.start, s.end) for s in one.base] == [("assign", 2, 2 + len(SECRET) - 1)] and len(one.nested) == 1
    assert all(not r.base and not r.nested for r in got if r.doc_id in (2, 3, 4))
    assert find_secrets(documents(pairs).limit(0)).count() == 0
