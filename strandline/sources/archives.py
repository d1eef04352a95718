"""Resources in archives, read by byte range through the index that lists them.

A Python data source.  The driver reads the index file alone; filters on ``resref`` and
``type`` reach it, so archives and entries that nobody asks for are not opened.  A task
gets some entries of one archive, reads its header and table, and then only the ranges
of those entries, neighbours in one read.

``pack`` writes archives and their index, one task for each archive.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from strandline.sources.binary import BIF_ENTRY, KEY_ARCHIVE, KEY_ENTRY, bif_entries, key_archives, key_entries
from strandline.sources.tables import Work

NAME = "strandline_archives"
#: Ranges of an archive that lie so close together are read at once; entries that one task reads, and that an archive can have.
GAP, ENTRIES, MOST_FILES, MOST_ARCHIVES = 1 << 12, 1 << 10, 1 << 14, 1 << 12
_HEAD = 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def read_entries(archive: BinaryIO, numbers: Iterable[int]) -> Iterator[tuple[int, bytes]]:
    """File number and bytes of the entries asked for that the archive has in full; other bytes are not read, but for its table and small gaps."""
    head = archive.read(_HEAD)
    count, _, at = struct.unpack_from("<3I", head, 8)
    archive.seek(at)
    table = archive.read(count * BIF_ENTRY.itemsize)
    wanted = set(numbers)
    # the decoder takes a whole file; here what stands between header and table is left out
    told = [(offset, size, n) for n, offset, size, _ in bif_entries(head[:8] + struct.pack("<3I", count, 0, _HEAD) + table) if n in wanted]
    runs: list[list[tuple[int, int, int]]] = []
    for entry in sorted(told):
        if runs and entry[0] - max(o + s for o, s, _ in runs[-1]) <= GAP:
            runs[-1].append(entry)
        else:
            runs.append([entry])
    for run in runs:
        low, high = run[0][0], max(o + s for o, s, _ in run)
        archive.seek(low)
        data = archive.read(high - low)
        for offset, size, n in run:
            if offset - low + size <= len(data):
                yield n, data[offset - low : offset - low + size]


@dataclass
class Entries(InputPartition):
    """Entries (file number, resref, type) of one archive."""

    path: str
    biff: int
    entries: list[tuple[int, str, int]]


class Archives(DataSource):
    """Format ``strandline_archives``; option ``path`` is the index file, archives lie below its folder."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "resref string, type int, biff int, file int, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("resref", "type"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            yield f  # Spark looks at the rows again

    def partitions(self) -> list[Entries]:
        system, path = opened(self.path)
        with system.open_input_file(path) as f:
            index = f.read()
        names = dict(key_archives(index))
        held: dict[int, list[tuple[int, str, int]]] = {}
        for resref, kind, biff, number in key_entries(index):
            if all({"resref": resref, "type": kind}[c] in v for c, v in self.wanted.items()) and biff in names:
                held.setdefault(biff, []).append((number, resref, kind))
        folder = path.rpartition("/")[0]
        return [Entries(f"{folder}/{names[b]}", b, entries[i : i + ENTRIES]) for b, entries in sorted(held.items()) for i in range(0, len(entries), ENTRIES)] or [Entries("", 0, [])]

    def read(self, part: Entries) -> Iterator[pa.RecordBatch]:
        if not part.entries:
            return
        system, _ = opened(self.path)
        told = {n: (resref, kind) for n, resref, kind in part.entries}
        with system.open_input_file(part.path) as f:
            rows, size = [], 0
            for n, content in read_entries(f, told):
                rows.append((*told[n], part.biff, n, content))
                size += len(content)
                if size > 4 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"resref": pa.string(), "type": pa.int32(), "biff": pa.int32(), "file": pa.int32(), "content": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def read_archives(spark: SparkSession, index: str) -> DataFrame:
    """resref, type, biff, file, content of the resources that an index file lists.

    Spark keeps the filters that it hands to such a source with the frame read here, so
    reads with different filters need a frame each.
    """
    spark.dataSource.register(Archives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).load(index)


# --- writing ----------------------------------------------------------------


def archive_bytes(files: list[tuple[int, bytes]]) -> bytes:
    """An archive of (type, content); file numbers are the places in the list."""
    table = np.zeros(len(files), BIF_ENTRY)
    ends = np.cumsum([len(c) for _, c in files])
    table["locator"], table["type"] = np.arange(len(files)), [k for k, _ in files]
    table["size"] = [len(c) for _, c in files]
    table["offset"] = _HEAD + table.nbytes + ends - table["size"]
    return b"BIFFV1  " + struct.pack("<3I", len(files), 0, _HEAD) + table.tobytes() + b"".join(c for _, c in files)


def index_bytes(archives: list[str], entries: list[tuple[str, int, int, int]]) -> bytes:
    """An index of archives by path and of entries (resref, type, archive number, file number)."""
    named = [a.encode("latin-1") + b"\0" for a in archives]
    first = np.zeros(len(archives), KEY_ARCHIVE)
    at = 24 + first.nbytes
    first["name_len"] = [len(n) for n in named]
    first["name_at"] = at + np.cumsum(first["name_len"]) - first["name_len"]
    texts = b"".join(named)
    table = np.zeros(len(entries), KEY_ENTRY)
    table["resref"], table["type"] = [e[0].encode("latin-1") for e in entries], [e[1] for e in entries]
    table["locator"] = [e[2] << 20 | e[3] for e in entries]
    return b"KEY V1  " + struct.pack("<4I", len(archives), len(entries), 24, at + len(texts)) + first.tobytes() + texts + table.tobytes()


def pack(resources: DataFrame, folder: str, per_archive: int = 4096) -> str:
    """Write resources (resref of at most eight characters, type, content) as archives below ``folder``; the path of their index.

    Each archive is built and written by one task, all archives beside each other.  The
    index is one file by its format, which has room for 4,096 archives of 16,384 files;
    archives get more than ``per_archive`` resources rather than be more than that.
    """
    count = resources.count()
    n = max(1, min(-(-count // min(per_archive, MOST_FILES // 2)), MOST_ARCHIVES))
    if count > n * (MOST_FILES // 2):
        raise ValueError(f"{count} resources are more than an index can list")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["resref", "type"]).reset_index(drop=True)
        system, path = opened(folder)
        system.create_dir(f"{path}/data", recursive=True)
        with system.open_output_stream(f"{path}/data/{int(ordered['biff'][0]):04d}.bif") as out:
            out.write(archive_bytes([(int(k), bytes(c)) for k, c in zip(ordered["type"], ordered["content"])]))
        return ordered.assign(file=np.arange(len(ordered)))[["resref", "type", "biff", "file"]]

    dealt = resources.select("resref", F.col("type").cast("int").alias("type"), F.pmod(F.xxhash64("resref", "type"), F.lit(n)).cast("int").alias("biff"), "content")
    work = Work(resources.sparkSession)
    try:
        # what goes to the driver goes there part by part, so the archives are written in a job before
        written = work.stored(dealt.groupBy("biff").applyInPandas(write, "resref string, type int, biff int, file int"))
        entries = [(r.resref, r.type, r.biff, r.file) for r in written.toLocalIterator()]
    finally:
        work.drop()
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/index.key") as out:
        out.write(index_bytes([f"data\\{i:04d}.bif" for i in range(n)], sorted(entries, key=lambda e: e[2:])))
    return f"{folder}/index.key"

