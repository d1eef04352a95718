"""Operator 5: media columns from content-defined chunks.

A payload is stored as 8-bit mono samples: a RIFF/WAVE header and the bytes.  Media are
cut where a rolling gear hash of the last 32 bytes ends in zeros, so equal stretches of
different media give equal chunks.  Digests of the chunks are joined in Spark: of a
chunk that several media (or several places of one) hold, one place keeps the bytes,
the others keep the digest.  Each distinct medium is stored once, header and all, as an
ordered list of chunks with the digest of the whole; reading fills the lists by a join
on the chunk digest, verifies every chunk, the whole medium against its digest and its
header, and the payload against its name, and computes features from the bytes read.

The decision which chunks to keep moves digests only.  Media that occur once and share
no chunk, told by a bitset in the scan, are stored where they are read; the bytes of
others move once, compressed, to meet their equals.  Groups of equal payloads shrink in
the tasks that read them.

Null and empty texts give one block of spaces.  Equal rows give equal results, one
each; empty tables give empty tables; other columns are not read.  A header counts
bytes in 32 bits, so a text of 4 GiB or more ends the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import HashFilter, Scratch, by_bytes, hash_filter, mix64, stored, text_column

BATCH_BYTES = 1 << 22
BLOCK = 192
LEAST, MASK_BITS, MOST = 1 << 11, 13, 1 << 16
RATE, HEADER = 8000, 44
LEVEL = 12
_GEAR = mix64(np.arange(256, dtype=np.uint64), 55).astype(np.uint32)


def payload_of(text: str) -> bytes:
    """UTF-8 bytes with spaces up to a positive multiple of the block."""
    data = text.encode()
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK)


def header_of(n: int) -> bytes:
    """RIFF/WAVE header of ``n`` unsigned 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n)


def media_of(payload: bytes) -> bytes:
    return header_of(len(payload)) + payload


def payload_in(media: bytes) -> bytes:
    """The samples of a medium whose header fits them."""
    payload = media[HEADER:]
    if media[:HEADER] != header_of(len(payload)):
        raise ValueError("the header is not that of the samples")
    return payload


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at each byte: the sum of gear[b] << age, by doubling the width five times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h = longer
    return h


def cut_points(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each of several byte strings."""
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    # a cut is at least 2048 bytes into its string, so bytes of the one before do not matter
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, base = [], 0
    for p in payloads:
        lo, hi = np.searchsorted(marks, [base, base + len(p)])
        own = (marks[lo:hi] - base).tolist()
        ends, start, i = [], 0, 0
        while len(p) - start > LEAST:
            while i < len(own) and own[i] < start + LEAST:
                i += 1
            end = min(own[i] if i < len(own) else len(p), start + MOST, len(p))
            if end == len(p):
                break
            ends.append(end)
            start = end
        ends.append(len(p))
        out.append(ends)
        base += len(p)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def pieces(payload: bytes, ends: list[int]) -> list[bytes]:
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def _named(texts: list[str]) -> list[tuple[bytes, bytes]]:
    """Name (digest of the payload) and medium of each text."""
    payloads = list(map(payload_of, texts))
    return [(hashlib.sha256(p).digest(), media_of(p)) for p in payloads]


def _short(names: list[bytes]) -> np.ndarray:
    """The first eight bytes of each name as a number."""
    return np.frombuffer(b"".join([n[:8] for n in names]), np.int64)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_id, short (its first bytes as a number) and the ordered digests of the medium's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            texts = text_column(batch)
            named = _named(texts.to_pylist())
            media = [m for _, m in named]
            lists = [[digest(c) for c in pieces(m, ends)] for m, ends in zip(media, cut_points(media))]
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            names = [n for n, _ in named]
            columns = [batch.column(0), pa.array(size), pa.array(names, pa.binary()), pa.array(_short(names)), pa.array(lists, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_id", "short", "digests"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_id binary, short long, digests array<binary>")


#: What a place does with its chunk: keeps it for itself, keeps it for others too, or has it elsewhere.
OWN, LENT, AWAY = 0, 1, 2


def shared_chunks(lists: DataFrame) -> DataFrame:
    """payload_id, short and, for media with a chunk that occurs elsewhere too, the state of each place in order."""
    distinct = lists.groupBy("payload_id").agg(F.first("digests").alias("digests"), F.first("short").alias("short"))
    refs = distinct.select("payload_id", "short", F.posexplode("digests").alias("at", "digest"))
    owners = refs.groupBy("digest").agg(F.min(F.struct("payload_id", "at")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    kept = (F.col("owner.payload_id") == F.col("payload_id")) & (F.col("owner.at") == F.col("at"))
    state = F.when(F.col("owner").isNull(), F.lit(OWN)).when(kept, F.lit(LENT)).otherwise(F.lit(AWAY))
    each = refs.join(owners, "digest", "left").select("payload_id", "short", "at", state.alias("state"))
    places = each.groupBy("payload_id", "short").agg(F.max("state").alias("most"), F.array_sort(F.collect_list(F.struct("at", "state"))).alias("places"))
    return places.where(F.col("most") > OWN).select("payload_id", "short", F.col("places.state").alias("states"))


def write_store(docs: DataFrame, lists: DataFrame, places: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """payload_id, media_id and chunks (digest, data, lent) of each distinct medium.

    ``data`` is the compressed chunk, null where another place keeps it; ``lent`` marks
    chunks that other places rely on.
    """
    again = lists.groupBy("payload_id").agg(F.first("short").alias("short"), F.count("*").alias("n")).where("n > 1").select("short")
    special = hash_filter(again.union(places.select("short")))

    def side(wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learned = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned)
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))
            meets: HashFilter = special.value
            for batch in by_bytes(batches, BATCH_BYTES):
                named = _named(text_column(batch).to_pylist())
                hit = meets.hits(_short([n for n, _ in named]))
                distinct = {n: m for (n, m), h in zip(named, hit.tolist()) if h == wanted}
                media = list(distinct.values())
                rows = [[{"digest": digest(c), "data": pack.compress(c)} for c in pieces(m, ends)] for m, ends in zip(media, cut_points(media))]
                columns = [pa.array(list(distinct), pa.binary()), pa.array([hashlib.sha256(m).digest() for m in media], pa.binary()), pa.array(rows, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["payload_id", "media_id", "chunks"])

        return run

    packed = "payload_id binary, media_id binary, chunks array<struct<digest: binary, data: binary>>"
    alone = docs.select("text").mapInArrow(side(False), packed).withColumn("states", F.lit(None).cast("array<int>"))
    met = docs.select("text").mapInArrow(side(True), packed).groupBy("payload_id").agg(F.first("media_id").alias("media_id"), F.first("chunks").alias("chunks"))
    placed = alone.union(met.join(places.select("payload_id", "states"), "payload_id", "left"))
    state = lambda i: F.coalesce(F.get("states", i), F.lit(OWN))
    chunks = F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), F.when(state(i) != AWAY, c["data"]).alias("data"), (state(i) == LENT).alias("lent")))
    whole = ~F.coalesce(F.array_contains("states", AWAY), F.lit(False))
    return placed.select("payload_id", "media_id", chunks.alias("chunks"), whole.alias("whole"))


def filled(store: DataFrame) -> DataFrame:
    """payload_id, media_id and ordered chunks (digest, data), with data fetched by digest where it is kept elsewhere."""
    whole = store.where("whole").select("payload_id", "media_id", F.transform("chunks", lambda c: F.struct(c["digest"].alias("digest"), c["data"].alias("data"))).alias("chunks"))
    lent = store.select(F.explode(F.filter("chunks", lambda c: c["lent"])).alias("c")).select(F.col("c.digest").alias("digest"), F.col("c.data").alias("fetched"))
    parts = store.where("not whole").select("payload_id", "media_id", F.posexplode("chunks").alias("at", "c")).select("payload_id", "media_id", "at", "c.digest", "c.data")
    here = parts.where("data is not null")
    fetched = parts.where("data is null").drop("data").join(lent, "digest").select("payload_id", "media_id", "at", "digest", F.col("fetched").alias("data"))
    joined = here.select("payload_id", "media_id", "at", "digest", "data").union(fetched)
    lists = joined.groupBy("payload_id").agg(F.first("media_id").alias("media_id"), F.array_sort(F.collect_list(F.struct("at", "digest", "data"))).alias("c"))
    return whole.union(lists.select("payload_id", "media_id", F.transform("c", lambda c: F.struct(c["digest"].alias("digest"), c["data"].alias("data")))))


def features_of(samples: np.ndarray) -> str:
    """Features of unsigned 8-bit samples: blocks, lowest, highest, sum, and crossings of the middle."""
    above = samples >= 128
    return f"blocks={len(samples) // BLOCK};min={samples.min()};max={samples.max()};sum={int(samples.sum(dtype=np.int64))};crossings={int((above[1:] != above[:-1]).sum())}"


def read_store(store: DataFrame, dictionary: bytes = b"", media: bool = False) -> DataFrame:
    """Digests and features of each payload of the store, and the media file itself if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpack = zstandard.ZstdDecompressor(dict_data=learned) if learned else zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, files = [], []
                for name, whole, chunks in zip(*[part.column(c).to_pylist() for c in range(3)], strict=True):
                    read = []
                    for c in chunks:
                        data = unpack.decompress(c["data"])
                        if digest(data) != c["digest"]:
                            raise ValueError(f"payload {name.hex()}: a chunk is not the one listed")
                        read.append(data)
                    file = b"".join(read)
                    stored_form = hashlib.sha256(file)
                    if stored_form.digest() != whole:
                        raise ValueError(f"payload {name.hex()}: its chunks do not give back the medium written")
                    payload = payload_in(file)
                    found = hashlib.sha256(payload)
                    if found.digest() != name:
                        raise ValueError(f"payload {name.hex()}: the medium holds another payload")
                    rows.append((name, len(payload), found.hexdigest(), zlib.crc32(payload[-16:]), len(file), stored_form.hexdigest(), features_of(np.frombuffer(payload, np.uint8))))
                    if media:
                        files.append(file)
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["payload_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                if media:
                    names, columns = [*names, "media"], [*columns, pa.array(files, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "payload_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media
    return filled(store).mapInArrow(run, schema)


def media_columns(docs: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """doc_id, n_bytes and what reading each document's stored media gives.

    The result is stored in the shared folder; the store of chunks is deleted once it has
    been read.  ``write_store`` gives one to keep.
    """
    work = Scratch(docs.sparkSession)
    try:
        lists = work.stored(chunk_lists(docs))
        store = work.stored(write_store(docs, lists, work.stored(shared_chunks(lists)), dictionary), codec="none")
        read = read_store(store, dictionary)
        return stored(lists.select("doc_id", "n_bytes", "payload_id").join(read, "payload_id").drop("payload_id"))
    finally:
        work.drop()
