"""Operator 8: WARC archives in Zstandard frames, written and read.

An archive is one byte string: a skippable frame with a compression dictionary, then
one frame per record.  Archives are rows (path, content), as Spark's ``binaryFile``
source gives for files, and have a bounded size, so tasks read them apart.

Writing: of pages with equal payloads of at least ``least`` bytes the smallest
page_id becomes a response record, the others revisit records without payload; smaller
payloads are always responses.  Reading: the dictionary comes from the leading frame,
each frame is decoded on its own, and its version line, declared lengths, record end
and payload digest are checked.  A broken record ends the job.

Null payloads are empty.  Rows with a null page_id are never referred to, unless all
rows of the group have none: then all are responses.  Rows that share the smallest
page_id of a group are all responses.  A null url leaves the header out; control
characters in urls are percent-encoded.  No pages give no archives.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import HashFilter, Scratch, by_bytes, hash_filter

_SKIPPABLE = struct.pack("<I", 0x184D2A5D)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"^Content-Length: ([0-9]+)\r$", re.M)
ARCHIVE_BYTES = 8 << 20
BATCH_BYTES = 1 << 22


def train_dictionary(pages: DataFrame, sample: int = 256, longest: int = 1 << 16, size: int = 1 << 15) -> bytes:
    """A dictionary from at most ``sample`` pages of at most ``longest`` bytes; empty where they are too few to learn from."""
    short = pages.where(F.octet_length("html") <= longest)
    chosen = short.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    one = short.join(F.broadcast(chosen), "page_id").groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    texts = [r.html.encode() for r in sorted(one.collect(), key=lambda r: r.page_id)]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, length: int | None = None) -> bytes:
    """The bytes of one record; ``length`` is that of the payload where a revisit comes without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (len(payload) if length is None else length)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub("[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def marked(pages: DataFrame, least: int = 100, work: Scratch | None = None) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null for responses) and payload_bytes; html is null in revisits.

    Who revisits whom is told from ids and digests alone, and a group of any size shrinks
    to a row per task before it is shuffled.  Pages that a bitset of the revisits lets
    through in the scan are responses, and are not shuffled.  The others go by their ids
    and digests again: revisits need no html, and the few that the bitset held back for
    nothing are fetched by a bitset of their own.
    """
    keep = (work or Scratch(pages.sparkSession)).stored
    html = F.coalesce(F.col("html"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    key = F.xxhash64("page_id", "payload_digest")
    large = named.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    large = keep(large)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    again = keep(large.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "payload_digest", "first"))
    held = _hits(named, key, hash_filter(again.select(key.alias("hash"))))
    same = (F.col("a.payload_digest") == F.col("b.payload_digest")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id"))
    narrow = held(True).drop("html").alias("a").join(again.alias("b"), same, "left").select("a.*", "b.first")
    revisits = narrow.where("first is not null").select("page_id", "url", F.lit(None).cast("string").alias("html"), "payload_digest", F.col("first").alias("refers_to"), "payload_bytes")
    innocent = keep(narrow.where("first is null").select("page_id", "payload_digest").distinct())
    fetched = _hits(named, key, hash_filter(innocent.select(key.alias("hash"))))(True).alias("a").join(innocent.alias("b"), same, "left_semi")
    alone = [df.select("page_id", "url", "html", "payload_digest", F.lit(None).cast("long").alias("refers_to"), "payload_bytes") for df in (held(False), fetched)]
    return alone[0].union(alone[1]).union(revisits)


def _hits(rows: DataFrame, key: Column, spread: Broadcast[HashFilter]) -> Callable[[bool], DataFrame]:
    """The rows whose key a bitset has, or has not."""
    keyed = rows.withColumn("_key", key)

    def side(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = spread.value.hits(batch.column(batch.num_columns - 1).to_numpy())
                yield batch.filter(pa.array(hit == wanted)).select(list(range(batch.num_columns - 1)))

        return keyed.mapInArrow(run, rows.schema)

    return side


def write_archives(rows: DataFrame, dictionary: bytes, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, content) of the rows of ``marked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=learned, write_checksum=True, write_content_size=True)
        lead = _SKIPPABLE + struct.pack("<I", len(dictionary)) + dictionary if dictionary else b""
        frames, size, n = [lead], len(lead), 0

        def archive() -> pa.RecordBatch:
            path = f"part-{TaskContext.get().partitionId():06d}-{n:06d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b"".join(frames)], pa.binary())], ["path", "content"])

        for batch in by_bytes(batches, BATCH_BYTES, "html"):
            for r in batch.to_pylist():
                frame = pack.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["payload_digest"], r["refers_to"], r["payload_bytes"]))
                if size + len(frame) > archive_bytes and len(frames) > 1:
                    yield archive()
                    frames, size, n = [lead], len(lead), n + 1
                frames.append(frame)
                size += len(frame)
        if len(frames) > 1:
            yield archive()

    return rows.select("page_id", "url", "html", "payload_digest", "refers_to", "payload_bytes").mapInArrow(run, "path string, content binary")


def frames_of(content: bytes) -> Iterator[bytes]:
    """Decoded frames of an archive, one after another."""
    view, at, learned = memoryview(content), 0, None
    if content[:4] == _SKIPPABLE:
        (n,) = struct.unpack_from("<I", content, 4)
        if len(content) < 8 + n:
            raise ValueError("the dictionary frame is cut off")
        learned, at = zstandard.ZstdCompressionDict(content[8 : 8 + n]), 8 + n
    unpack = zstandard.ZstdDecompressor(dict_data=learned) if learned else zstandard.ZstdDecompressor()
    while at < len(content):
        declared = zstandard.get_frame_parameters(view[at : at + 18]).content_size
        frame, out = unpack.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the last frame is cut off")
            piece = view[at : at + (1 << 14)]
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        data = b"".join(out)
        if declared != zstandard.CONTENTSIZE_UNKNOWN and declared != len(data):
            raise ValueError(f"a frame declares {declared} bytes and has {len(data)}")
        yield data


def parse_record(data: bytes) -> dict:
    """Fields of a record after checking its version line, lengths, end and, for responses, digest."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise ValueError(f"no version line: {data[:20]!r}")
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the header or the record has no end")
    fields: dict[str, str] = {}
    for line in head.decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header line: {line!r}")
        fields[name.strip().lower()] = value.strip()
    block = rest[:-4]
    if int(fields["content-length"]) != len(block):
        raise ValueError(f"Content-Length is {fields['content-length']}, the block has {len(block)} bytes")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = int(_LENGTH.search(http + b"\r\n")[1])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not the one declared")
    if kind == "revisit" and payload:
        raise ValueError(f"{fields['warc-record-id']}: a revisit record with a payload")
    page = lambda urn: None if urn is None or urn == "<urn:page:None>" else int(urn[len("<urn:page:") : -1])
    return {
        "page_id": page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": page(fields.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Records of archives given in a column ``content``; ``payload``: with the bytes of responses."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in frames_of(content.as_py()):
                    rows.append(parse_record(data))
                    size += len(data) if payload else 0
                    if size > BATCH_BYTES or len(rows) == 4096:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return archives.select("content").mapInArrow(run, schema)
