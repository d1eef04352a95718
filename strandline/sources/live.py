"""A folder of log files that are still being written, as a stream of lines.

A Python data source whose offset says how many bytes of each file have been given out.
A batch reads what has been added since, each file in ranges of bounded size, so one
file spreads over tasks.  Only whole lines are given out; what stands after the last line
end waits until more comes, or until the file has not been written to for
``idle_seconds``, and then is the last line.  ``ord`` is where a line starts in its file,
so it rises along the file over all batches and never depends on how it was read.

Files are opened through Arrow's file systems (local paths, ``file:``, ``hdfs:``, ``s3:``
and others), on the driver to list them and to find the last line end, on executors to
read ranges.  A file that has become shorter is read from its start.  A batch takes all there
is, since Spark tells such a source no limit.  The offset has an entry for each file of
the folder, so old logs belong elsewhere.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "strandline_live"
#: Bytes of a file that one task reads, and that are looked at once for a line end.
RANGE, STEP = 32 << 20, 1 << 20


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9+.-]*:", folder) else (fs.LocalFileSystem(), folder)


@dataclass
class FileRange(InputPartition):
    """Lines of a file that start in start..stop-1; the last of them ends before ``end``.  ``begins``: one starts right at ``start``."""

    path: str
    session: str
    start: int
    stop: int
    end: int
    begins: bool


class LiveLines(DataSource):
    """Format ``strandline_live``; options: path, pattern (of file names), idle_seconds, session (file or folder), range_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "session string, ord long, line string, file string"

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(dict(self.options))


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.pattern = re.compile(options.get("pattern", r".*\.(log|txt)"))
        self.idle = float(options.get("idle_seconds", "60"))
        self.by_folder = options.get("session", "file") == "folder"
        self.range = int(options.get("range_bytes", str(RANGE)))
        self.given: dict[str, int] = {}  # how far each file has been given out, as far as this reader knows
        self.planned: tuple[dict, dict, list[FileRange]] | None = None

    def _session(self, path: str) -> str:
        parts = path.rstrip("/").split("/")
        return re.sub("^session=", "", parts[-2]) if self.by_folder else re.sub(r"\.[^.]*$", "", parts[-1])

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _listed(self) -> list[fs.FileInfo]:
        system, folder = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=self.by_folder))
        return sorted((f for f in found if f.type == fs.FileType.File and self.pattern.fullmatch(f.base_name)), key=lambda f: f.path)

    def _whole(self, system: fs.FileSystem, file: fs.FileInfo, start: int) -> int:
        """Up to which byte the lines from ``start`` on are whole."""
        if file.mtime is not None and time.time() - file.mtime.timestamp() >= self.idle:
            return file.size
        with system.open_input_file(file.path) as f:
            at = file.size
            while at > start:  # back from the end, in steps
                low = max(start, at - STEP)
                f.seek(low)
                cut = f.read(at - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                at = low
        return start

    def latestOffset(self) -> dict:
        system, _ = _opened(self.folder)
        now = {}
        for file in self._listed():
            start = self.given.get(file.path, 0)
            start = 0 if file.size < start else start
            now[file.path] = [self._whole(system, file, start) if file.size > start else start, file.size]
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        if self.planned and self.planned[:2] == (start, end):  # a query may read a stream in several places
            return self.planned[2]
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out: list[FileRange] = []
        for path, (stop, size) in after.items():
            first = max(before.get(path, [0])[0], self.given.get(path, 0))
            first = 0 if size < first else first  # the file is another one now
            out += [FileRange(path, self._session(path), low, min(low + self.range, stop), stop, low == first) for low in range(first, stop, self.range)]
            self.given[path] = max(first, stop)
        self.planned = start, end, out
        return out

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        with system.open_input_file(part.path) as f:
            at = part.start
            if not part.begins:  # a line that starts before this range belongs to the one before, unless it ends right there
                f.seek(at - 1)
                skip, base = f.read(1) != b"\n", at
                while skip and at < part.end:
                    piece = f.read(min(STEP, part.end - at))
                    if (cut := piece.find(b"\n")) >= 0:
                        base, skip = at + cut + 1, False
                    at += len(piece)
                if skip:
                    return
                at = base
            held, begun = b"", at
            f.seek(at)
            while begun < part.stop:
                piece = f.read(min(STEP, part.end - at))
                at += len(piece)
                held += piece
                lines = held.split(b"\n")
                held = lines.pop()
                if not piece and held:  # the last line has no end
                    lines, held = [held], b""
                rows = []
                for line in lines:
                    if begun >= part.stop:
                        break
                    rows.append((begun, line))
                    begun += len(line) + 1
                if rows:
                    n = len(rows)
                    columns = [[part.session] * n, [r[0] for r in rows], [r[1].decode("utf-8", "replace") for r in rows], [part.path] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["session", "ord", "line", "file"])
                if not piece:
                    return

    def commit(self, end: dict) -> None:
        """Nothing to forget: files stay as they are."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LiveLines)
