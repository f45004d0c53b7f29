"""Byte-pair encoding with reuse of content-defined chunks.

A text's bytes are cut where a rolling hash of the last 32 bytes has certain bits clear, so equal
passages are cut alike wherever they stand. A worker encodes each chunk it meets once and keeps
the tokens; documents that share their least chunk are brought next to each other first, so copies
and near copies meet in one task. The order is by range of (least chunk, id): a group of copies
however large spreads over as many tasks as its rows need, and no counts are gathered for it.

A chunk was cut without regard to words, so tokens near its ends are not those of the whole text.
Each chunk offers only its middle: from its first to its last anchor, an anchor being a space
between two ASCII letters, where every pre-tokenizer of this family ends a word. What lies between
the middle of one chunk and that of the next is encoded anew, up to the next anchor but one
inside the chunk; if the tokens there disagree with the chunk's, the repair is extended over the
whole chunk and on to the next, until they agree exactly or the text ends.

The vocabulary is a ``tokenizers`` JSON file, named by a path that every worker can read. Special
tokens in a text count as that library counts them by default: their strings become their ids.

Null texts are empty and have no tokens. Repeated rows are encoded each. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

WINDOW = 32
MEAN = 1024  # bytes of a chunk on average, a power of two
LEAST = 128  # bytes of a chunk at least, but for the last
MARGIN = 16  # bytes at a chunk's ends that offer no anchor; more than a special token has
KEPT_BYTES = 48 << 20  # of chunks that a worker remembers; the least recently used go first

# The split of byte-level vocabularies of this family, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ANCHOR = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
_GEAR = np.frombuffer(
    b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), np.uint32
).copy()


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 characters are
    themselves, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens of a byte-level BPE file, with the bytes of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        byte_of = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        tokens = {t: i for t, i in model["vocab"].items() if t not in self.special}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in tokens.items()}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [tokens[m] for m in merged] != sorted(tokens[m] for m in merged) or data.get("normalizer"):
            raise ValueError("ids must follow the order of the merges, and texts must not be normalized")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        for text, i in self.special.items():
            pieces[i] = text.encode()
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        strings = sorted(self.special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    def encode(self, data: bytes) -> np.ndarray:
        """Ids of a piece of text, encoded on its own."""
        text = data.decode()
        if self.split is None or not self.split.search(text):
            return self.encoding.encode_to_numpy(text)
        parts = [
            np.array([self.special[part]], np.uint32) if part in self.special else self.encoding.encode_to_numpy(part)
            for part in self.split.split(text) if part
        ]
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker and path."""
    return Vocabulary(path)


def cuts(data: bytes) -> list[int]:
    """Ends of a text's chunks, at whole characters."""
    if len(data) <= LEAST:
        return [len(data)] if data else []
    raw = np.frombuffer(data, np.uint8)
    rolled = _GEAR[raw]
    for step in (1, 2, 4, 8, 16):  # after these, each value covers 32 bytes
        rolled[step:] = rolled[step:] + (rolled[:-step] << np.uint32(step))
    marks = np.flatnonzero((rolled >> np.uint32(32 - MEAN.bit_length() + 1)) == 0) + 1
    marks = marks[marks < len(raw)]
    marks = marks[(raw[marks] & 0xC0) != 0x80]
    ends, last = [], 0
    for mark in marks.tolist():
        if mark - last >= LEAST:
            ends.append(mark)
            last = mark
    return [*ends, len(data)]


def _chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@F.pandas_udf(LongType())
def least_chunk(texts: pd.Series) -> pd.Series:
    """Least hash of a text's chunks: equal for copies, and mostly for near copies."""
    return pd.Series(
        [min((xxhash.xxh64_intdigest(c) >> 1 for c in _chunks((t or "").encode())), default=0) for t in texts],
        dtype="int64",
    )


class Encoder:
    """Encodes whole texts from the chunks it remembers."""

    def __init__(self, words: Vocabulary, kept_bytes: int = KEPT_BYTES):
        self.words = words
        self.kept_bytes = kept_bytes
        self.held = 0
        self.memory: OrderedDict[bytes, tuple | None] = OrderedDict()
        self.met = self.encoded = self.repaired = 0

    def _middle(self, chunk: bytes) -> tuple | None:
        """First, second and last anchor of a chunk, and the tokens between; none for few anchors."""
        anchors = [m.start() for m in _ANCHOR.finditer(chunk, MARGIN, max(MARGIN, len(chunk) - MARGIN))]
        if len(anchors) < 3:
            return None
        first, last = anchors[0], anchors[-1]
        ids = self.words.encode(chunk[first:last])
        head = int(np.searchsorted(np.cumsum(self.words.lengths[ids]), anchors[1] - first)) + 1
        return first, anchors[1], last, ids, head

    def middle(self, chunk: bytes) -> tuple | None:
        self.met += 1
        if chunk in self.memory:
            self.memory.move_to_end(chunk)
            return self.memory[chunk]
        self.encoded += 1
        found = self.memory[chunk] = self._middle(chunk)
        self.held += self._weight(chunk, found)
        while self.held > self.kept_bytes:
            self.held -= self._weight(*self.memory.popitem(last=False))
        return found

    @staticmethod
    def _weight(chunk: bytes, found: tuple | None) -> int:
        return len(chunk) + 400 + (found[3].nbytes if found else 0)

    def encode(self, data: bytes) -> np.ndarray:
        parts: list[np.ndarray] = []
        done = start = 0  # bytes that have their tokens; where the chunk starts
        for chunk in _chunks(data):
            found = self.middle(chunk)
            if found:
                first, second, last, ids, head = found
                join = self.words.encode(data[done : start + second])
                if len(join) >= head and np.array_equal(join[len(join) - head :], ids[:head]):
                    parts += [join, ids[head:]]
                    done = start + last
                else:  # the repair goes on over this chunk
                    self.repaired += 1
            start += len(chunk)
        parts.append(self.words.encode(data[done:]))
        return np.concatenate(parts)


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    """A worker's encoder lives on from task to task."""
    return Encoder(vocabulary(path))


def gathered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` with documents of a common least chunk side by side.

    Long texts have many chunks and so small least hashes; hashing these once more spreads long
    texts over all ranges.
    """
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.xxhash64(least_chunk(F.col(text))).alias("near"),
    ).repartitionByRange("near", "doc_id").sortWithinPartitions("near").select("doc_id", "text")


def encoded(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` of every row.

    The text is decoded from the ids where they are made, and digests of both are taken there, so
    a caller that needs no ids moves none.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # so that the ids of long texts do not pile up
                part = batch.slice(at, 512)
                found = [encoder.encode((value.as_py() or "").encode()) for value in part.column("text")]
                columns = [
                    part.column("doc_id"), pa.array([len(f) for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found], pa.string()),
                    pa.array([hashlib.sha256(encoder.words.decode(f).encode()).hexdigest() for f in found], pa.string()),
                ]
                if ids:
                    offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                    flat = np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    kind = docs.schema[doc_id].dataType.simpleString()
    return gathered(docs, doc_id, text).mapInArrow(
        encode,
        f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids,
    )
