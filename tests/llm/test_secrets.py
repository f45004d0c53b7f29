"""Secrets against plain Python, and layers packed by hand."""

import base64
import bz2
import gzip
import lzma
import random
import re
import time
import urllib.parse
import zlib

import pytest
import zstandard

from careerlake.llm import secrets

SECRET = "token = abcDEF123456"


def brute(text):
    out = []
    for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A
    ):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def packed(data):
    return base64.b64encode(data).decode()


def test_base_findings():
    rng = random.Random(6)
    bits = ["token", "PassWord", "api_key", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc", "abcdef12", "AKIA", "X9" * 9,
            "0123456789abcdef", "é", "𝄞", "\n", "-_./", "%", "\\"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert sorted(secrets.base_matches(text)) == brute(text), text
        assert [f for f in secrets.findings(text) if f[2] in secrets.BASE] == sorted(
            brute(text), key=lambda f: (f[0], secrets.BASE.index(f[2])))


@pytest.mark.parametrize("inner, how", [
    (packed(SECRET.encode()), "base64"), (packed(gzip.compress(SECRET.encode())), "base64+zip"),
    (packed(zlib.compress(SECRET.encode())), "base64+zip"), (packed(bz2.compress(SECRET.encode())), "base64+zip"),
    (packed(packed(SECRET.encode()).encode()), "base64+base64"),
    (urllib.parse.quote(packed(SECRET.encode()), safe="").replace("0", "%30"), "url+base64"),
    (packed(urllib.parse.quote(SECRET).encode()), "base64+url"),
    (packed(gzip.compress(zlib.compress(SECRET.encode()))), "base64+zip+zip"),
    (base64.urlsafe_b64encode(b"\xc3\xbf\xc3\xbf " + SECRET.encode()).decode().rstrip("="), "base64"),
])
def test_opaque_layers_map_to_their_token(inner, how):
    if how == "url+base64" and "%" not in inner:
        inner = inner[:3] + f"%{ord(inner[3]):02X}" + inner[4:]
    text = f"é some words {inner} more"
    found = [f for f in secrets.findings(text) if f[2] == f"assign@{how}"]
    assert len(found) == 1
    assert text[found[0][0] : found[0][1]] == inner


@pytest.mark.parametrize("before", ["config=", "https://h.org/?d=", "h.org/dl/", "https://h.org/a/b/longer-path-segment/", "x=y&d="])
@pytest.mark.parametrize("data", [SECRET.encode(), b"password = hunter2secret", gzip.compress(SECRET.encode(), mtime=0)])
def test_tokens_after_equals_signs_and_slashes(before, data):
    token = base64.urlsafe_b64encode(data).decode()
    found = [f for f in secrets.findings(f"see {before}{token} end") if f[2].startswith("assign@base64")]
    assert (4 + len(before), 4 + len(before) + len(token)) in [f[:2] for f in found]


@pytest.mark.parametrize("width, end", [(76, "\n"), (64, "\r\n")])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
@pytest.mark.parametrize("around", ["", "a-line-of-its-own-before\n"])
def test_wrapped_tokens_are_joined(width, end, pack, around):
    rng = random.Random(width)
    plain = "".join(rng.choice("qwrtzu io") for _ in range(50)) + " " + SECRET + " " + "".join(rng.choice("qwrtzu") for _ in range(200))
    token = packed(pack(plain.encode()))
    wrapped = end.join(token[i : i + width] for i in range(0, len(token), width))
    text = f"see:\n{around}{wrapped}\n\nend"
    at = text.index(wrapped)
    assert any(f[:2] == (at, at + len(wrapped)) and f[2].startswith("assign@base64") for f in secrets.findings(text))


@pytest.mark.parametrize("data", [b"\x00" + SECRET.encode(), b"\xff\xfe " + SECRET.encode(), SECRET.encode() + b"\n\x07\x80"])
def test_layers_with_odd_bytes_are_scanned_and_unwrapped(data):
    assert any(f[2] == "assign@base64" for f in secrets.findings(f"x {packed(data)} y"))
    assert any(f[2] == "assign@base64+base64" for f in secrets.findings(f"x {packed(b'\x01 ' + packed(data).encode())} y"))


def test_escapes_map_to_their_characters():
    text = "see x?tok%65n%3Dsecretvalue9&b=1 end"
    assert (6, 28, "assign@url") in secrets.findings(text)
    text = "say " + chr(92) + "u0074oken=abcdef" + chr(92) + "x39" + chr(92) + "U00000039 now"
    assert (4, text.index(" now"), "assign@unicode") in secrets.findings(text)
    twice = "a=" + urllib.parse.quote(urllib.parse.quote("token=abcdef99", safe=""), safe="").replace("t", "%74")
    assert any(kind == "assign@url+url" for *_, kind in secrets.findings(twice))


def test_cycles_bombs_and_damage_end(monkeypatch):
    assert secrets.findings("%25" * 2000) == []
    assert secrets.findings("\\u005cu005c" * 500) == []
    assert secrets.findings(packed(b"\x1f\x8b" + bytes(40)) + " " + packed(b"\xff" * 40)) == []
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1000)
    text = "x " + packed(gzip.compress(b"q" * 5000))
    assert secrets.findings(text) == [(2, len(text), "oversize")]
    long = "A" * 300_001 + " " + "%zz" * 100_000 + " " + "b%41" * 50_000
    assert all(kind != "assign" for *_, kind in secrets.findings(long))


@pytest.mark.parametrize("pack", [lzma.compress, zstandard.compress, lambda d: gzip.compress(b"first ") + gzip.compress(d)])
def test_other_streams_and_several_members(pack):
    token = packed(pack(SECRET.encode()))
    assert (2, 2 + len(token), "assign@base64+zip") in secrets.findings(f"x {token} y")


def test_streams_under_percent_escapes():
    for data in (gzip.compress(SECRET.encode()), zlib.compress(SECRET.encode()), b"a=1&z=" + bz2.compress(SECRET.encode())):
        run = "".join(f"%{b:02X}" for b in data)
        assert (4, 4 + len(run), "assign@url+zip") in secrets.findings(f"see {run} end")


@pytest.mark.parametrize("code", ["utf-16", "utf-16-le", "utf-16-be"])
def test_wide_characters(code):
    token = packed(SECRET.encode(code))
    assert (0, len(token), "assign@base64") in secrets.findings(token)


def test_what_an_oversize_stream_begins_with_is_scanned(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1000)
    token = packed(gzip.compress(SECRET.encode() + b" a" * 5000))
    assert {(0, len(token), "oversize"), (0, len(token), "assign@base64+zip")} <= set(secrets.findings(token))


def test_paths_of_many_tokens_take_time_in_proportion():
    rng = random.Random(2)
    parts = [packed(bytes(rng.choice(b"abcdefgh ijklmnop") for _ in range(24))) for _ in range(1500)]
    parts[700] = packed(SECRET.encode() + b"....")
    text = "/".join(parts)
    start = time.perf_counter()
    found = secrets.findings(text)
    assert time.perf_counter() - start < 1.5
    at = text.index(parts[700])
    assert (at, at + len(parts[700]), "assign@base64") in found


def test_rows(spark):
    rows = [(1, SECRET), (1, SECRET), (None, None), (3, ""), (4, packed(SECRET.encode()))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secrets.scanned(docs).collect()), key=str)
    want = [(1, [(0, 20, "assign")]), (1, [(0, 20, "assign")]), (None, []), (3, []),
            (4, [(0, len(rows[4][1]), "assign@base64")])]
    assert got == sorted(want, key=str)
    assert secrets.scanned(docs.limit(0)).count() == 0
