"""Operator 13: token ids in binary files of compressed planes.

Encoding.  Texts are cut into the pieces that byte-level vocabularies never join (their
published pattern), each distinct piece is encoded by the library once and remembered, so
cuts and ids of a batch are found by whole-array operations.  The class of a character
(letter, number, white space, other) is asked of the library once, by the places at which
it cuts; texts with characters of no class, with strings of special tokens, and all texts
of vocabularies of another kind go to the library whole.  Long texts are encoded in segments that end between a
letter and a space before a letter, where no piece goes on.

Files.  Documents are dealt by range of doc_id and sorted; each task packs its documents
one after another into files of bounded size.  A file holds the ids of its documents in
blocks of ``BLOCK``; a block is transposed into planes (the n-th byte, or the n-th bit, of
every id), planes of zeros only are left out, the others compressed with zstandard, each
apart.  A chunk index at the end tells where each plane of each block lies, so any range
of ids is read by decoding its blocks alone.  The documents' ids and lengths come before
it, with checksums.  Files are rows (path, content), as ``binaryFile`` gives them.

Order.  ``first`` of a file is the number of ids in all files before it, a running sum
over the tasks' totals and within each.  No document is cut: one with more ids than a
file should have is a file of its own.

Null and empty texts have the end id alone.  Null doc_ids come first.  Rows with equal
doc_ids are ordered by length, then checksum; rows equal in these are alike and spread by
their place in the written table.  Repeated rows give their own entries.  An empty table
gives no files.  Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm.common import Scratch, by_bytes, stored, text_column
from strandline.llm.piece_vocab import resolve

BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 20
#: Pieces whose ids a worker remembers, about; then it starts anew.
REMEMBERED = 1 << 19
#: Ids in a block, and in a file.
BLOCK, FILE_IDS = 1 << 16, 1 << 22
MAGIC, VERSION = b"IDPLANES", 1
_SAFE_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


# --- encoding ---------------------------------------------------------------

#: Classes of characters in the pattern; characters at which it may not cut as the library does are strange.
UNKNOWN, LETTER, NUMBER, SPACE, OTHER, STRANGE = range(6)


def piece_starts(points: np.ndarray, kinds: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern start, in the code points of texts put together; ``texts`` are those of the texts.

    A space goes with the letters, numbers or signs after it; of other white space before
    them the last character stands alone.  An apostrophe that starts a piece takes the
    letters of a contraction.
    """
    n = len(points)
    opens = np.zeros(n + 4, dtype=bool)
    opens[texts[texts < n]] = True
    first = opens[:n].copy()  # of a text
    new = first.copy()
    new[1:] |= kinds[1:] != kinds[:-1]
    opens[:n] = new
    after = np.flatnonzero(new & ~first & (kinds != SPACE))
    after = after[kinds[after - 1] == SPACE]
    opens[after - 1] = True
    joined = after[points[after - 1] == 32]
    opens[joined] = False
    # contractions
    quote = np.flatnonzero(new & (points == 39))
    quote = quote[first[quote] | (points[quote - 1] != 32)]
    last = np.append(texts, n)[np.searchsorted(texts, quote, side="right")]  # where the quote's text ends
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    one, two = padded[quote + 1], padded[quote + 2]
    short = (quote + 1 < last) & np.isin(one, [ord(c) for c in "stmd"])
    long = (quote + 2 < last) & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
    for held, size in ((short, 1), (long, 2)):
        opens[quote[held] + 1] = False
        rest = quote[held] + 1 + size
        opens[rest[rest < last[held]]] = True
    return np.flatnonzero(opens[:n])


class Encoder:
    """Ids of texts as the library gives them without added special tokens, from pieces encoded once."""

    def __init__(self, model: str, end: int):
        self.library, self.end = Tokenizer.from_file(resolve(model)), end
        self.library.no_truncation()
        self.library.no_padding()
        told = json.loads(self.library.to_str())
        before = told["pre_tokenizer"] or {}
        self.specials = [t["content"] for t in told["added_tokens"]]
        known = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.by_pieces = bool(known and told["normalizer"] is None and told["model"]["type"] == "BPE" and not told["model"].get("dropout") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in told["added_tokens"]))
        self.wide = np.uint16 if max(self.library.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        vocab = self.library.get_vocab()
        #: how many bytes each id stands for, where the vocabulary writes each byte as a character; none for tokens of another kind
        self.id_bytes = np.zeros(1 + max(vocab.values(), default=0), dtype=np.int64)
        for token, i in vocab.items():
            self.id_bytes[i] = 0 if token in self.specials or token == told["model"].get("unk_token") else len(token)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.starts, self.lengths = array("I"), array("q"), array("q")

    def _kind(self, c: str) -> int:
        """The class of a character by the places at which the library cuts next to it."""
        cuts = lambda text: [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]
        one = (0, 3)
        kinds = [k for k, text in ((LETTER, f"a{c}a"), (NUMBER, f"1{c}1"), (OTHER, f"!{c}!")) if cuts(text) == [one]]
        # white space joins other white space unless something follows
        if not kinds and cuts(f"a{c}\n") == [(0, 1), (1, 3)] and cuts(f"{c}\n") == [(0, 2)] and cuts(f"a{c}a") == ([(0, 1), (1, 3)] if c == " " else [(0, 1), (1, 2), (2, 3)]):
            kinds = [SPACE]
        return kinds[0] if len(kinds) == 1 else STRANGE

    def _classified(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if (fresh := points[kinds == UNKNOWN]).size:
            for p in np.unique(fresh).tolist():
                self.kinds[p] = self._kind(chr(p))
            kinds = self.kinds[points]
        return kinds

    def segments(self, text: str) -> list[str]:
        if len(text) <= SEGMENT_CHARS or not self.by_pieces:
            return [text]
        out, start = [], 0
        while m := _SAFE_CUT.search(text, start + SEGMENT_CHARS):
            out.append(text[start : m.start()])
            start = m.start()
        return [*out, text[start:]]

    def _codes(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, all different, among those remembered; new ones are encoded."""
        if len(self.codes) > REMEMBERED:
            self._forget()
        codes = np.fromiter([self.codes.get(p, -1) for p in pieces], np.int64, len(pieces))
        if (fresh := np.flatnonzero(codes < 0)).size:
            new = [pieces[i] for i in fresh.tolist()]
            ids, lengths = self._of_pieces(new)
            codes[fresh] = np.arange(len(self.codes), len(self.codes) + len(new))
            self.codes.update(zip(new, codes[fresh].tolist(), strict=True))
            self.starts.frombytes((len(self.ids) + np.cumsum(lengths) - lengths).tobytes())
            self.lengths.frombytes(lengths.tobytes())
            self.ids.frombytes(ids.tobytes())
        return codes

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces, and how many each has.

        The library gets them as one text that is cut already; ids stand for bytes, so a
        piece's last id is where their bytes add up to those of the pieces so far.  Where
        they do not, each piece is encoded apart.
        """
        own = self.library.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(own.ids, np.uint32)
        bytes_at = np.cumsum(self.id_bytes[ids])
        ends = np.cumsum(np.fromiter([len(p.encode()) for p in pieces], np.int64, len(pieces)))
        last = np.searchsorted(bytes_at, ends)
        if len(ids) and last[-1] == len(ids) - 1 and np.array_equal(bytes_at[last], ends):
            return ids, np.diff(last, prepend=-1)
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _by_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of texts, how many each has, and which texts have strange characters (they get none)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self._classified(points)
        starts = piece_starts(points, kinds, begins[lengths > 0])
        data = whole.encode()
        byte_at = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)  # all bytes but those inside of a character
        bounds = np.append(byte_at[starts], len(data))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        odd = np.zeros(len(texts), dtype=bool)
        odd[np.searchsorted(begins, np.flatnonzero(kinds == STRANGE), side="right") - 1] = True
        at = pieces.indices.to_numpy()
        if odd.any():
            kept = ~odd[np.searchsorted(begins, starts, side="right") - 1]  # the last text that begins there, which is not empty
            at, starts = at[kept], starts[kept]
        codes = self._codes(pieces.dictionary.to_pylist())[at]
        first, size = np.array(self.starts, np.int64)[codes], np.array(self.lengths, np.int64)[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
        ids = np.array(self.ids, np.uint32)[place].astype(self.wide)
        return ids, np.diff(ends[np.append(np.searchsorted(starts, begins), len(starts))]), odd

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's with the end id, one after another, and the n + 1 offsets of the texts."""
        cut = [(i, s) for i, t in enumerate(texts) for s in self.segments(t)]
        whole = [not self.by_pieces or any(x in s for x in self.specials) for _, s in cut]
        ids, counts, odd = self._by_pieces(["" if w else s for (_, s), w in zip(cut, whole)])
        ends = np.cumsum(counts)
        tail = np.array([self.end], dtype=self.wide)
        parts, total, size = [], np.zeros(len(texts), np.int64), 0
        for k, (i, s) in enumerate(cut):
            own = ids[ends[k] - counts[k] : ends[k]]
            if s and (whole[k] or odd[k]):
                own = np.array(self.library.encode(s, add_special_tokens=False).ids, dtype=self.wide)
            parts.append(own)
            size += len(own)
            if k + 1 == len(cut) or cut[k + 1][0] != i:
                parts.append(tail)
                total[i], size = size + 1, 0
        return np.concatenate(parts or [tail[:0]]), np.concatenate([[0], np.cumsum(total)])


@functools.lru_cache(maxsize=2)
def _encoder(model: str, end: int) -> Encoder:
    return Encoder(model, end)


def encoded(docs: DataFrame, model: str, end: int = 0) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, width, ids: each text's ids with the end id, in ``width`` byte planes one after another.

    The checksum is that of the ids as little-endian 32-bit integers.  Planes of a text
    already take less room in written tables and shuffles than its ids do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, end)
        for batch in by_bytes(batches, BATCH_BYTES):
            ids, offsets = encoder.batch(text_column(batch).to_pylist())
            width = ids.dtype.itemsize
            planes = b"".join([p for a, b in zip(offsets, offsets[1:]) for p in planes_of(ids[a:b], False)])
            large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets * width), pa.py_buffer(planes)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(_checksums(ids, offsets)), pa.array(np.full(batch.num_rows, width, np.int32)), large], ["doc_id", "n_tokens", "ids_crc32", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, width int, ids binary")


def _checksums(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data, at = memoryview(ids.astype("<u4")).cast("B"), (offsets * 4).tolist()
    return np.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])], dtype=np.int64)


# --- files ------------------------------------------------------------------

_HEAD = struct.Struct("<8sHBBIQQ")  # magic, version, bytes an id, bit planes (1) or byte planes (0), ids in a block, documents, ids
_FOOT = struct.Struct("<QQI8s")  # where the tables of documents and of blocks start, checksum of all before, magic


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The n-th byte (or bit, eight ids a byte) of every id, for all n from the lowest on."""
    each = np.ascontiguousarray(ids, ids.dtype.newbyteorder("<")).view(np.uint8).reshape(len(ids), -1)
    if bits:
        each = np.packbits(np.unpackbits(each, axis=1, bitorder="little"), axis=0, bitorder="little")
    return [np.ascontiguousarray(column).tobytes() for column in each.T]


def ids_of(planes: list[bytes] | np.ndarray, n: int, width: int, bits: bool) -> np.ndarray:
    """The ids whose planes these are."""
    each = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    if bits:
        each = np.packbits(np.unpackbits(each, axis=0, count=n, bitorder="little"), axis=1, bitorder="little")
    return np.ascontiguousarray(each).view(f"<u{width}").ravel()


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: bool = False, block: int = BLOCK, level: int = 3) -> bytes:
    """The bytes of a file that holds these documents."""
    squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True)
    width, count = ids.dtype.itemsize, ids.dtype.itemsize * (8 if bits else 1)
    out, size, index = [_HEAD.pack(MAGIC, VERSION, width, bits, block, len(doc_ids), len(ids))], _HEAD.size, []
    for start in range(0, len(ids), block):
        planes = [squeeze.compress(p) if any(p) else b"" for p in planes_of(ids[start : start + block], bits)]
        index.append((size, *map(len, planes)))
        out += planes
        size += sum(map(len, planes))
    known = np.array([i is not None for i in doc_ids], dtype=np.uint8)
    named = np.array([i or 0 for i in doc_ids], dtype="<i8")
    documents = squeeze.compress(known.tobytes() + named.tobytes() + np.array(lengths, dtype="<u8").tobytes())
    blocks = squeeze.compress(np.array(index, dtype="<u8").reshape(-1, 1 + count).tobytes())
    out += [documents, blocks]
    body = b"".join(out)
    return body + _FOOT.pack(size, size + len(documents), zlib.crc32(body), MAGIC)


class PlaneFile:
    """A file's documents and, for any range of ids, the ids; a file that is cut off or changed is an error."""

    def __init__(self, content: bytes):
        if len(content) < _HEAD.size + _FOOT.size:
            raise ValueError("the file is too short")
        magic, version, self.width, self.bits, self.block, self.n_docs, self.n_ids = _HEAD.unpack_from(content)
        documents, blocks, checksum, end = _FOOT.unpack_from(content, len(content) - _FOOT.size)
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a file of id planes, or cut off")
        self.content = memoryview(content)
        if zlib.crc32(self.content[: -_FOOT.size]) != checksum:
            raise ValueError("the file's checksum is another one")
        self.unpack = zstandard.ZstdDecompressor()
        told = self.unpack.decompress(self.content[documents:blocks])
        self.known = np.frombuffer(told, np.uint8, self.n_docs).astype(bool)
        self.doc_ids = np.frombuffer(told, "<i8", self.n_docs, self.n_docs)
        self.lengths = np.frombuffer(told, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)
        count = self.width * (8 if self.bits else 1)
        self.index = np.frombuffer(self.unpack.decompress(self.content[blocks : -_FOOT.size]), "<u8").reshape(-1, 1 + count).astype(np.int64)
        if int(self.lengths.sum()) != self.n_ids or len(self.index) != -(-self.n_ids // self.block):
            raise ValueError("the file's tables do not fit its ids")

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        at, planes = int(self.index[k, 0]), []
        for size in self.index[k, 1:].tolist():
            raw = -(-n // 8) if self.bits else n
            planes.append(self.unpack.decompress(self.content[at : at + size]) if size else bytes(raw))
            at += size
        return ids_of(planes, n, self.width, self.bits)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` on, before ``stop``; only their blocks are decoded."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, f"<u{self.width}")
        first = start // self.block
        held = np.concatenate([self.read_block(k) for k in range(first, -(-stop // self.block))])
        return held[start - first * self.block : stop - first * self.block]


def written(rows: DataFrame, bits: bool = False, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Files (path, part, number, n_docs, n_ids, content) of a written table of ``encoded`` rows, in ascending doc_id order.

    Paths, and parts with numbers, are in the order of the documents.
    """
    names = ["path", "part", "number", "n_docs", "n_ids", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            content = pack_file(doc_ids, lengths, np.concatenate(held), bits, block)
            path = f"ids-{part:08d}-{number:08d}.planes"
            counts = [pa.array([n], pa.int64()) for n in (part, number, len(doc_ids), sum(lengths))]
            return pa.RecordBatch.from_arrays([pa.array([path]), *counts, pa.array([content], pa.binary())], names)

        size = 0
        for batch in batches:
            for doc_id, n, width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if size and size + n > file_ids:
                    yield made()
                    doc_ids, lengths, held, size, number = [], [], [], 0, number + 1
                doc_ids.append(doc_id)
                lengths.append(n)
                held.append(ids_of(np.frombuffer(ids.as_buffer(), np.uint8).reshape(width, n), n, width, False))
                size += n
        if size:
            yield made()

    order = [F.asc_nulls_first("doc_id"), "n_tokens", "ids_crc32"]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*order, "_salt").sortWithinPartitions(*order)
    return dealt.select("doc_id", "n_tokens", "width", "ids").mapInArrow(run, "path string, part long, number long, n_docs long, n_ids long, content binary")


def firsts(files: DataFrame) -> DataFrame:
    """path, first: how many ids the files before each hold; only one row a task meets in one place."""
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("path", "part", "number", "n_ids")
    parts = listed.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("ahead"))
    inside = listed.withColumn("inside", before(Window.partitionBy("part").orderBy("number")))
    return inside.join(parts, "part").select("path", (F.col("ahead") + F.col("inside")).alias("first"))


def read_documents(files: DataFrame) -> DataFrame:
    """path, doc_id, start (in the file), n_tokens, ids_crc32 of the documents of files (path, content), from their bytes."""
    names = ["path", "doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                file = PlaneFile(content.as_py())
                ends = np.cumsum(file.lengths)
                low = 0
                while low < file.n_docs:  # documents of some blocks at a time
                    start = int(ends[low - 1]) if low else 0
                    high = max(low + 1, int(np.searchsorted(ends, start + 16 * file.block, side="right")))
                    offsets = np.concatenate([[start], ends[low:high]])
                    crc = _checksums(file.read(start, int(offsets[-1])), offsets - start)
                    ids = pa.array(file.doc_ids[low:high], mask=~file.known[low:high])
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * (high - low)), ids, pa.array(offsets[:-1]), pa.array(file.lengths[low:high]), pa.array(crc)], names)
                    low = high

    return files.select("path", "content").mapInArrow(run, "path string, doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, model: str, end: int = 0, bits: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files that its ids were written to.

    ``start`` is the number of ids of all documents before it.  The result is stored in
    the shared folder, the files are deleted; ``written`` gives files to keep.
    """
    first, work = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    try:
        try:
            files = work.stored(written(first.stored(encoded(docs, model, end)), bits), codec="none")
        finally:
            first.drop()
        rows = read_documents(files).join(firsts(files), "path")
        return stored(rows.select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"))
    finally:
        work.drop()
