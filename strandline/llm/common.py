"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and Python, however long its texts are.
ARROW_BYTES = 4 << 20
# workers live through many stages, so what a batch took goes back to the system after it
pa.set_memory_pool(pa.system_memory_pool())


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder, ``spark.checkpoint.dir``.

    Without that setting only a local master (tests, a laptop) gets a folder, below its
    warehouse; on a cluster that might be a disk of one machine, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/strandline-{uuid.uuid4().hex}"


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: whatever is lost later is read again from the shared
    folder, not recomputed, and every reader sees the same rows.
    """
    return _written(df, shared_dir(df.sparkSession), codec)


def _written(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one run of an operator writes for itself, in the shared folder.

    ``drop`` deletes them, so nothing may read them any more by then: an operator drops
    what it needed on the way, and stores what it returns apart.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_dir(spark), 0

    def stored(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        return _written(df, f"{self.folder}/{self.n}", codec)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


LEAST_BITS, MOST_BITS = 24, 27


@dataclass
class HashFilter:
    """A bitset over the first ``bits`` bits of 64-bit hashes: no false negatives, few false positives."""

    bits: int
    words: np.ndarray

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def hash_filter(hashes: DataFrame) -> Broadcast[HashFilter]:
    """A filter of the one column of ``hashes``: about sixteen bits for each, from 2**24 (2 MiB) to 2**27 bits (16 MiB) in all."""
    spark, name = hashes.sparkSession, hashes.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * hashes.count()).bit_length()))
    at = hashes.select(F.shiftrightunsigned(name, 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("set"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in words.toLocalIterator():
        out[r.word] = r.set & (2**64 - 1)
    return spark.sparkContext.broadcast(HashFilter(bits, out))


ROW_KEY = ("_row_id", "_row_hash")


def row_key() -> list[Column]:
    """What names a row of a table of documents: its id (which may be null) and a hash of its text."""
    return [F.col("doc_id").cast("long").alias(ROW_KEY[0]), F.xxhash64("text").alias(ROW_KEY[1])]


def without_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``marks`` names (the columns of ``row_key`` and ``_row_once``, one row a key).

    Where ``_row_once`` holds, one of the rows with that key stays, any of them.  Nearly
    all rows that stay pass a bitset in the scan and are not shuffled; what the bitset
    holds back is joined exactly.
    """
    spread = hash_filter(marks.select(F.xxhash64(*ROW_KEY).alias("hash")))
    placed = docs.select("*", *row_key())
    hashed = placed.withColumn("_row_at", F.xxhash64(*ROW_KEY))

    def side(wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = spread.value.hits(batch.column(batch.num_columns - 1).to_numpy())
                yield batch.filter(pa.array(hit == wanted)).select(list(range(batch.num_columns - 1)))

        return run

    clear = hashed.mapInArrow(side(False), placed.schema).select(*docs.columns)
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ROW_KEY]
    met = hashed.mapInArrow(side(True), placed.schema).alias("d").join(marks.alias("m"), same[0] & same[1], "left").select("d.*", "m._row_once")
    out = clear.union(met.where("_row_once is null").select(*docs.columns))
    if marks.where("_row_once").isEmpty():
        return out
    return out.union(met.where("_row_once").dropDuplicates(list(ROW_KEY)).select(*docs.columns))


def crc32_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over an unsigned 64-bit array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a large_string array and the n + 1 offsets of its values."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8)[lo:hi], offsets - lo


def by_bytes(batches: Iterator[pa.RecordBatch], most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds more than about ``most`` bytes of text.

    A single text above the bound stays whole in a batch of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            floor = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, floor + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


BYTE_VALUES = mix64(np.arange(256, dtype=np.uint64), 7)
_STEP = 0x9DDFEA08EB382D69  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Words:
    """Words of a batch of texts, found and hashed by whole-array operations.

    ``is_word`` is a table of 256 booleans over bytes; a word is a maximal run of
    bytes marked there, and never crosses from one text to the next.  ``fold``
    maps bytes before hashing (for lower case).  ``start``/``end`` are byte
    positions in the batch, ``doc`` the row of each word, ``hash`` its 64-bit hash.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
        inside = is_word[data]
        n = len(data)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        if n:
            last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        with np.errstate(over="ignore"):
            values = (BYTE_VALUES if fold is None else BYTE_VALUES[fold])[data] * _powers(_STEP, n)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
            raw = (total[self.end] - total[self.start]) * _powers(_BACK, n + 1)[self.start]
            self.hash = mix64(raw + (self.end - self.start).astype(np.uint64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``k`` words inside one text."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, chain([self.hash[at + i] for i in range(k)])


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive combination of hashes, element by element."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), 0x2545F4914F6CDD1D, dtype=np.uint64)
        for p in parts:
            out = mix64(out * np.uint64(0x100000001B3) + p)
        return out


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, *range(9, 14)]] = False
