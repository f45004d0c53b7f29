"""Secrets in texts and in whatever their texts encode.

Every text is scanned as it stands. Then a worklist takes it apart: runs with percent escapes,
runs with Unicode escapes, and base64 tokens are decoded, and decoded bytes that are gzip, zlib,
bzip2, xz or Zstandard streams are decompressed; each new layer is scanned and goes on the worklist itself, until
nothing new comes out. A layer seen before under the same place is not taken up again, so cycles
end. Each character of a layer knows the span of the text it came from: one escape for escapes,
the whole token for base64 and compressed bytes. So every finding is given as a span of the text.

Base kinds are ``assign``, ``access`` and ``hex``; in a layer their names are followed by how the
layer came about, as in ``assign@base64+url``. A finding in a layer that only repeats one of the
same kind and span is left out.

Null and empty texts have no secrets. Repeated rows have the same findings each. Texts are never
shuffled. A layer may grow to ``LAYER_BYTES``; a stream that unpacks to more is itself reported, as
kind ``oversize``, and scanned up to there. Very long texts take time in proportion to their length
and to what their layers unpack to.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYER_BYTES = 64 << 20

# Each pattern has only matches of full length, or its filter drops the short ones afterwards: a
# shorter match would have used up no character that another match could start from.
_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")

# Ways down: a run of the text, and what it decodes to.
_URL = re.compile(r"(?<![!-~])[!-~]*%[0-9A-Fa-f]{2}[!-~]*")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_UNICODE = re.compile(r"(?<![!-~])[!-~]*\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2})[!-~]*")
_CODE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}")
_MARKS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_SIZED = (type(zlib.decompressobj()), bz2.BZ2Decompressor, lzma.LZMADecompressor)
_DAMAGE = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\x80-\U0010ffff]*")


def base_matches(text: str) -> Iterator[tuple[int, int, str]]:
    """Base findings of a text: start, end and kind."""
    for m in _ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield m.start(), m.end(), "access"
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), "hex"


@dataclass(frozen=True)
class Layer:
    """A decoded text. ``places`` gives each character's span of the original text; a layer whose
    characters all came from one span has just that."""

    text: str
    how: str
    places: tuple[tuple[int, int], ...] | tuple[int, int]
    single: bool

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.single:
            return self.places
        return self.places[start][0], self.places[end - 1][1]


def _readable(data: bytes) -> str:
    """Bytes as text: UTF-16 if they begin with its mark or every other one of the first is zero, else
    UTF-8; what is neither becomes replacement characters, so that the rest is scanned."""
    head = data[:64]
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        wide = data.decode("utf-16", "replace")
        if len(head) > 3 and (not any(head[3::2]) or not any(head[2::2])):
            return wide
    elif len(head) >= 8 and not any(head[1::2]) and all(head[::2][: len(head) // 2]):
        return data.decode("utf-16-le", "replace")
    elif len(head) >= 8 and not any(head[::2]) and all(head[1::2]):
        return data.decode("utf-16-be", "replace")
    return data.decode("utf-8", "replace")


def _escaped(m: re.Match, layer: Layer | None, how: str) -> Layer | None:
    """A run of percent escapes or Unicode escapes, decoded once; bytes of one character stay together."""
    run, at = m[0], m.start()
    pieces: list[tuple[str, int, int]] = []
    done = 0
    if how == "url":
        for e in re.finditer(r"(?:%[0-9A-Fa-f]{2})+", run):
            pieces += [(c, i, i + 1) for i, c in enumerate(run[done : e.start()], done)]
            data = bytes.fromhex(e[0].replace("%", ""))
            i = 0
            while i < len(data):
                width = 1
                for n in (1, 2, 3, 4):
                    try:
                        char = data[i : i + n].decode()
                    except UnicodeDecodeError:
                        continue
                    width = n
                    break
                else:
                    char = "�"
                pieces.append((char, e.start() + 3 * i, e.start() + 3 * (i + width)))
                i += width
            done = e.end()
    else:
        for e in _CODE.finditer(run):
            pieces += [(c, i, i + 1) for i, c in enumerate(run[done : e.start()], done)]
            code = int(e[1] or e[2] or e[3], 16)
            if pieces and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(pieces[-1][0]) < 0xDC00:
                high, start, _ = pieces.pop()
                pieces.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), start, e.end()))
            else:
                pieces.append((chr(code) if code < 0x110000 else "�", e.start(), e.end()))
            done = e.end()
    pieces += [(c, i, i + 1) for i, c in enumerate(run[done:], done)]
    text = "".join(p[0] for p in pieces)
    if text == run:
        return None
    if layer is None:
        return Layer(text, how, tuple((at + a, at + b) for _, a, b in pieces), False)
    name = f"{layer.how}+{how}"
    if layer.single:
        return Layer(text, name, layer.places, True)
    return Layer(text, name, tuple(layer.span(at + a, at + b) for _, a, b in pieces), False)


def _opener(data: bytes):
    """A decompressor for data that begins with the mark of a stream, or none."""
    if data[:3] == b"\x1f\x8b\x08" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0):
        return zlib.decompressobj(wbits=47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=LAYER_BYTES)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _unpack(data: bytes) -> tuple[bytes | None, bool]:
    """Decompressed bytes of a stream and of those that follow it at once, or none; and whether there
    were more than the limit, which are left out."""
    out, opener = b"", _opener(data)
    if opener is None:
        return None, False
    while opener is not None and len(out) <= LAYER_BYTES:
        try:
            if isinstance(opener, _SIZED):
                out += opener.decompress(data, LAYER_BYTES + 1 - len(out))
            else:
                out += opener.decompress(data)
        except _DAMAGE:
            out += _until_damage(data, LAYER_BYTES + 1 - len(out))
            break
        data = opener.unused_data if opener.eof else b""
        opener = _opener(data)
    return out[:LAYER_BYTES] or None, len(out) > LAYER_BYTES


def _until_damage(data: bytes, most: int) -> bytes:
    """What a damaged stream unpacks to before its damage."""
    opener, out = _opener(data), bytearray()
    try:
        for at in range(len(data)):
            out += opener.decompress(data[at : at + 1])
            if len(out) > most:
                break
    except _DAMAGE:
        pass
    return bytes(out[:most])


def _unpacked(data: bytes, how: str, span: tuple[int, int]) -> tuple[Layer | None, bool]:
    """The text of bytes, through any number of compressions; and whether one was oversize."""
    seen, over = set(), False
    while True:
        seen.add(hashlib.sha256(data).digest())
        out, oversize = _unpack(data)
        over |= oversize
        if out is None or hashlib.sha256(out).digest() in seen:
            break
        data, how = out, how + "+zip"
    text = _readable(data)
    return (Layer(text, how, span, True) if text else None), over


def _packed_escapes(m: re.Match, layer: Layer | None) -> Iterator[tuple[Layer | None, bool]]:
    """Streams whose bytes are written as percent escapes."""
    data = urllib.parse.unquote_to_bytes(m[0])
    span = layer.span(m.start(), m.end()) if layer else (m.start(), m.end())
    for mark in _MARKS.finditer(data):
        if _opener(data[mark.start() : mark.start() + 8]) is not None:
            yield _unpacked(data[mark.start() :], (f"{layer.how}+" if layer else "") + "url", span)
            break


def _decoded(start: int, end: int, token: str, layer: Layer | None) -> tuple[Layer | None, tuple[int, int] | None]:
    """A base64 token's text, through any number of compressions; or the span of an oversize one."""
    token = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(token) % 4 == 1:
        token = token[:-1]
    try:
        data = base64.b64decode(token + "=" * (-len(token) % 4), validate=True)
    except binascii.Error:
        return None, None
    span = layer.span(start, end) if layer else (start, end)
    new, over = _unpacked(data, (f"{layer.how}+" if layer else "") + "base64", span)
    return new, (span if over else None)


def _promise(head: str) -> str:
    """Whether a token's first characters decode to the mark of a stream, to plain text, or to neither."""
    data = base64.b64decode(head[:12].replace("-", "+").replace("_", "/"))
    if _opener(data) is not None:
        return "stream"
    text = data.decode("utf-8", "ignore")
    return "plain" if len(text.encode()) > 6 and _PLAIN.fullmatch(text) is not None else ""


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    """Base64 tokens of a text: start, end and characters.

    A run with slashes may be a path: its parts between slashes are tokens too, and so is all that
    follows a slash if it begins like a stream, or like plain text at an alignment of four characters
    for the first time: later ones of that alignment decode to ends of the same text. Lines with single breaks between them are joined: all,
    and each block of lines of one length with the line that ends it.
    """
    for m in _BASE64.finditer(text):
        yield m.start(), m.end(), m[0]
        if "/" not in m[0]:
            continue
        for part in re.finditer(r"[^/]{16,}", m[0]):
            yield m.start() + part.start(), m.start() + part.end(), part[0]
        last, met = m[0].rindex("/"), set()
        for slash in re.finditer(r"/(?=[^=]{16})", m[0][: last + 17]):
            at = slash.end()
            if at > last:
                continue
            promise = _promise(m[0][at : at + 12])
            if promise == "stream" or (promise and at % 4 not in met):
                yield m.start() + at, m.end(), m[0][at:]
                if promise == "plain":
                    met.add(at % 4)
    for m in _WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end(), x[0]) for x in re.finditer(r"[^\r\n]+", m[0])]
        blocks, first = {(0, len(lines))}, 0
        for n, (_, _, line) in enumerate(lines):
            if n == first:
                continue
            width = len(lines[first][2])
            if len(line) != width or n + 1 == len(lines):
                end = n + 1 if len(line) <= width else n
                if end - first > 1:
                    blocks.add((first, end))
                first = n
        for i, j in sorted(blocks):
            yield lines[i][0], lines[j - 1][1], "".join(x[2] for x in lines[i:j])


def findings(text: str) -> list[tuple[int, int, str]]:
    """All findings of a text and of its layers: start, end and kind, in order."""
    found = set(base_matches(text))
    known = {(a, b, kind) for a, b, kind in found}
    work: deque[Layer | None] = deque([None])
    met: set[tuple] = set()
    while work:
        layer = work.popleft()
        here = layer.text if layer else text
        below: list[Layer] = []
        if "%" in here:
            for m in _URL.finditer(here):
                below += [x] if (x := _escaped(m, layer, "url")) else []
                for new, over in _packed_escapes(m, layer):
                    below += [new] if new else []
                    if over:
                        found.add((*(layer.span(m.start(), m.end()) if layer else m.span()), "oversize"))
        if "\\" in here:
            below += [x for m in _UNICODE.finditer(here) if (x := _escaped(m, layer, "unicode"))]
        for start, end, token in _tokens(here):
            new, oversize = _decoded(start, end, token, layer)
            if new:
                below.append(new)
            if oversize:
                found.add((*oversize, "oversize"))
        for new in below:
            mark = (hashlib.sha256(new.text.encode("utf-8", "surrogatepass")).digest(), new.span(0, len(new.text)))
            if mark in met or not new.text:
                continue
            met.add(mark)
            work.append(new)
            for a, b, kind in base_matches(new.text):
                span = new.span(a, b)
                if (*span, kind) not in known:
                    known.add((*span, kind))
                    found.add((*span, f"{kind}@{new.how}"))
    order = {kind: n for n, kind in enumerate(BASE)}
    return sorted(found, key=lambda f: (f[0], order.get(f[2], len(order)), f[2], f[1]))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans``: findings of every row as structs of start, end and kind."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"start": a, "end": b, "kind": k} for a, b, k in findings(value.as_py() or "")]
                for value in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(
        scan, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, "
        "spans array<struct<start:long,end:long,kind:string>>"
    )
