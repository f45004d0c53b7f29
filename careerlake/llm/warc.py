"""WARC archives of individually compressed records that share a Zstandard dictionary.

The dictionary is built from the records to be archived and stands, as it is, in a skippable frame
(magic number 0x184D2A5D) at the head of every archive; each record is a frame of its own, so one
can be read without the others. Of records with equal payloads the one with the largest page id
is a response; the others are revisits, which name it and store no payload.

Which record is a response is decided on digests alone. Archives are written by the tasks that
hold the records, through ``pyarrow.fs``, under a name with the task's attempt; the table of
written records names the archives of the attempts that counted, and what other attempts left is
removed. Pages cross the network once. A record is held in memory one at a time.

A null payload is empty. Rows that share the largest page id of a payload are all responses; rows
with a null page id are revisits unless no equal payload has an id, then they are responses.
Repeated rows are archived each. An empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlake.llm.common import keep_until_exit, sampled, written
from careerlake.sources import files

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLES = 1000  # records the dictionary is built from
SAMPLE_BYTES = 8 << 10  # of each of them, from a random place of the payload
LEVEL = 6
_BREAKS = re.compile(r"[\x00-\x20\x7f]")  # would end a header field or its value
DATE = "2026-01-01T00:00:00Z"  # of records, unless the caller knows better


def base32_of(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def _zstd_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def decided(pages: DataFrame, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, refers_to, revisit`` for each page.

    The response of each digest is an aggregate over narrow rows, combined before the shuffle and
    written; the pages then join a plain table, so a payload that very many pages share is split.
    Only digests of two pages or more have a response to look up, and a revisit's payload is not
    carried further than that join.
    """
    body = _payload(F.col(payload))
    source = pages.select(
        F.col("page_id"), F.col("url"), body.alias("body"), F.sha1(body).alias("digest"),
    )
    responses = written(
        source.filter(F.length("body") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"),
        "responses",
    )
    revisit = F.col("response").isNotNull() & (F.length("body") >= min_bytes) & ~F.coalesce(
        F.col("page_id") == F.col("response"), F.lit(False)
    )
    return source.join(responses, "digest", "left").select(
        "page_id", "url", "digest", F.length("body").cast("long").alias("size"), revisit.alias("revisit"),
        F.when(revisit, F.col("response")).alias("refers_to"), F.when(~revisit, F.col("body")).alias("body"),
    )


def _id(page_id: object) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _record(row: dict) -> bytes:
    """One WARC record, head and payload."""
    url = _BREAKS.sub(lambda m: urllib.parse.quote(m[0]), row["url"] or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Target-URI: {url}",
        f"WARC-Date: {DATE}", f"WARC-Record-ID: {_id(row['page_id'])}",
        f"WARC-Payload-Digest: sha1:{base32_of(row['digest'])}", f"WARC-Payload-Length: {row['size']}",
    ]
    if row["revisit"]:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_id(row['refers_to'])}",
        ]
    body = b"" if row["revisit"] else row["body"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def dictionary(pages: DataFrame, payload: str = "html", samples: int = SAMPLES) -> bytes:
    """A dictionary from a random sample of about ``samples`` records: their heads, a piece from
    any place of their payloads, and for some the head of a revisit."""
    body = _payload(F.col(payload))
    places = F.greatest(F.length(body) - SAMPLE_BYTES + 1, F.lit(1))
    start = F.floor(F.rand(11) * places).cast("int") + 1
    rows = (
        sampled(pages, samples, pages.count()).select(
            "page_id", "url", F.sha1(body).alias("digest"), F.length(body).cast("long").alias("size"),
            F.substring(body, start, F.lit(SAMPLE_BYTES)).alias("body"),
        ).collect()
    )
    heads = []
    for n, row in enumerate(rows):
        heads.append(_record(row.asDict() | {"revisit": False, "body": bytes(row["body"])}))
        if n % 4 == 0:
            heads.append(_record(row.asDict() | {"revisit": True, "refers_to": row["page_id"]}))
    if not heads:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, heads).as_bytes()
    except zstandard.ZstdError:  # too few or too uniform records to train on: their own bytes serve
        return b"".join(heads)[-DICTIONARY_BYTES:]


def write(pages: DataFrame, folder: str, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive every page below ``folder``; returns ``archive, offset, length, page_id`` per record."""
    spark = pages.sparkSession
    trained = dictionary(pages, payload)
    run = uuid.uuid4().hex[:12]

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/{run}-{task.partitionId():05d}-{task.taskAttemptId()}.warc.zst"
        system, place = pyarrow.fs.FileSystem.from_uri(name)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_zstd_dictionary(trained), write_content_size=True)
        out, offset = None, 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    if out is None:
                        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(place, compression=None)
                        offset = out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained) or 8 + len(trained)
                    frame = packer.compress(_record(row))
                    out.write(frame)
                    rows.append({"archive": name, "offset": offset, "length": len(frame), "page_id": row["page_id"]})
                    offset += len(frame)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            if out is not None:
                out.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    records = decided(pages, payload, min_bytes)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([
        ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
        ("page_id", to_arrow_type(pages.schema["page_id"].dataType)),
    ])
    index = written(
        records.mapInArrow(archive, f"archive string, offset long, length long, page_id {kind}"), "index"
    )
    counted = {r["archive"].rsplit("/", 1)[1] for r in index.select("archive").distinct().collect()}
    for name in files.child_names(spark, folder):
        if name.startswith(run) and name not in counted:
            files.delete(spark, f"{folder}/{name}")
    return index


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)


def _records(stream, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, read frame by frame with the dictionary at its head."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary")
    unpacker = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(stream.read(size)))
    rest = stream.read(step)
    while rest:
        frame, parts = unpacker.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data or stream.read(step)
                break
            rest = stream.read(step)
            if not rest:
                raise ValueError("the archive ends within a record")
        record = b"".join(parts)
        head, _, body = record.partition(b"\r\n\r\n")
        fields = _fields(head)
        yield fields, body[: int(fields["Content-Length"])]


def read(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Records of the archives named in column ``archive``, one task per archive at most.

    ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload``; for a response
    digest and length are taken from the payload as read, and a digest that differs from the
    record's own raises.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def page_of(field: str | None) -> int | None:
        number = (field or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number and number != "null" else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                system, place = pyarrow.fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for fields, body in _records(stream):
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind, size = fields["WARC-Type"], int(fields["WARC-Payload-Length"])
                        if kind == "response":
                            found, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                            if found != digest:
                                raise ValueError(f"{name}: the payload of {fields['WARC-Record-ID']} is damaged")
                        rows.append({
                            "page_id": page_of(fields["WARC-Record-ID"]), "record_type": kind,
                            "url": fields["WARC-Target-URI"],
                            "refers_to": page_of(fields.get("WARC-Refers-To")), "payload_digest": digest,
                            "payload_bytes": size, "payload": body if kind == "response" else None,
                        })
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    named = archives.select("archive").distinct()
    named = named.repartitionByRange(max(1, named.count()), "archive")  # a number, so that AQE keeps them apart
    return named.mapInArrow(
        parse,
        "page_id long, url string, record_type string, refers_to long, payload_digest string, "
        "payload_bytes long, payload binary",
    )


def archived(pages: DataFrame, payload: str = "html") -> tuple[DataFrame, DataFrame]:
    """Archive pages in the shared folder and read them back: index and records."""
    folder = keep_until_exit(pages.sparkSession, "warc")
    index = write(pages, folder, payload)
    return index, read(pages.sparkSession, index)
