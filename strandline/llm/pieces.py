"""Operator 1: SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they would form, then by position; it takes the best, joins the two symbols
and puts the new neighbours on the agenda.  Two characters that no piece of the
vocabulary holds side by side are never joined, so a text falls into chunks there,
which are encoded apart; each worker remembers a bounded number of them, and chunks
and ids of a batch are found by whole-array operations.
Short chunks are encoded many at once: their agendas are the rows of a matrix, and the
best entry of each is an array minimum instead of the top of a heap.
Of each Arrow batch all ids and decoded texts, whole, are checked against the
sentencepiece library; a difference ends the job.

Nulls count as empty texts, which give no ids and an empty text.  The space mark
U+2581 in a text is read as a space, as the library does.  Equal rows and ids give
one row each, empty tables an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import by_bytes, byte_view, text_column
from strandline.llm.piece_vocab import SPACE, PieceVocab, processor, segments, vocabulary

BATCH_BYTES = 1 << 20
#: Characters of texts that are encoded at once.
SEGMENT_CHARS = 1 << 20
#: Most chunks, and characters in them, that a worker remembers.
CACHE_CHUNKS, CACHE_CHARS = 400_000, 1 << 23
#: Characters of a text that the library gets at once.
CHECK_CHARS = 1 << 16


_AT = (1 << 40) - 1


def agenda_encode(text: str, vocab: PieceVocab) -> list[int]:
    """Ids of a text that is already normalised (spaces as space marks).

    An agenda entry is one integer: the rank of the piece's score, then the position
    of the left symbol, so equal scores go from left to right.
    """
    get = vocab.rank.get
    symbol: list[str] = list(text)
    n = len(symbol)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda = [r << 40 | i for i, pair in enumerate(map(add, text, text[1:])) if (r := get(pair)) is not None]
    heapify(agenda)
    while agenda:
        best = heappop(agenda)
        i = best & _AT
        left = symbol[i]
        j = after[i]
        if not left or j == n or get(pair := left + symbol[j]) != best >> 40:
            continue  # one of the two has been joined with another meanwhile
        symbol[i], symbol[j] = pair, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := get(pair + symbol[k])) is not None:
                heappush(agenda, r << 40 | i)
        h = before[i]
        if h >= 0 and (r := get(symbol[h] + pair)) is not None:
            heappush(agenda, r << 40 | h)
    ids = vocab.ids
    out: list[int] = []
    for s in symbol:
        if s:
            if (i := ids.get(s)) is not None:
                out.append(i)
            else:
                out.extend([vocab.byte_id[b] for b in s.encode()])
    return out


_NEVER = np.int64(1) << 62


def agenda_encode_many(texts: list[str], vocab: PieceVocab, longest: int = 64) -> list[list[int]]:
    """``agenda_encode`` of many short texts at once.

    Each row of a matrix holds the symbols of one text, beside it the scores of its
    adjacent pairs: the row's agenda.  Each step takes the best pair of every row.
    A character outside the vocabulary is a negative number there; it joins nothing
    and becomes its bytes in the end.  Long texts go one by one.
    """
    out: list[list[int] | None] = [None] * len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= longest]
    start = 0
    while start < len(order):
        least = int(lengths[order[start]])
        stop = int(np.searchsorted(lengths[order], least + max(2, least // 4), side="right"))
        rows = order[start : min(stop, start + 20_000)]
        start += len(rows)
        size = lengths[rows]
        points = np.frombuffer("".join([texts[r] for r in rows]).encode("utf-32-le"), dtype=np.uint32)
        symbols = np.full((len(rows), int(size.max()) + 1), -1, dtype=np.int64)
        ids = vocab.char_ids[points]
        symbols[np.arange(symbols.shape[1]) < size[:, None]] = np.where(ids < 0, -2 - points.astype(np.int64), ids)
        plain = symbols.min(axis=1) >= -1
        for r, found, n, whole in zip(rows.tolist(), *_join_rows(symbols, size, vocab), plain.tolist(), strict=True):
            out[r] = found[:n] if whole else _with_bytes(found[:n], vocab)
    return [agenda_encode(t, vocab) if ids is None else ids for t, ids in zip(texts, out, strict=True)]


def _with_bytes(symbols: list[int], vocab: PieceVocab) -> list[int]:
    out: list[int] = []
    for s in symbols:
        if s >= 0:
            out.append(s)
        else:
            out.extend([vocab.byte_id[b] for b in chr(-2 - s).encode()])
    return out


def _join_rows(symbols: np.ndarray, size: np.ndarray, vocab: PieceVocab) -> tuple[list[list[int]], list[int]]:
    keys, values = vocab.joins()

    def look(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), values[at], _NEVER)

    best = look(symbols[:, :-1], symbols[:, 1:])
    done, counts = symbols.copy(), size.copy()
    row = np.arange(len(symbols))
    column = np.arange(best.shape[1])
    while len(row):
        ranks = best >> 32
        at = ranks.argmin(axis=1)  # the first of equal ranks
        take = best[np.arange(len(row)), at]
        open_ = take < _NEVER
        done[row[~open_]], counts[row[~open_]] = symbols[~open_], size[~open_]
        row, symbols, size, best, at, take = row[open_], symbols[open_], size[open_], best[open_], at[open_], take[open_]
        if not len(row):
            break
        each = np.arange(len(row))
        behind = column > at[:, None]
        symbols[:, :-1] = np.where(behind, symbols[:, 1:], symbols[:, :-1])
        best[:, :-1] = np.where(behind[:, :-1], best[:, 1:], best[:, :-1])
        best[:, -1] = _NEVER
        symbols[each, at] = take & 0xFFFFFFFF
        size = size - 1
        best[each, at] = look(symbols[each, at], symbols[each, at + 1])
        inner = each[at > 0]
        best[inner, at[inner] - 1] = look(symbols[inner, at[inner] - 1], symbols[inner, at[inner]])
    return done.tolist(), counts.tolist()


def decode_ids(ids: list[int], vocab: PieceVocab) -> str:
    """Text of a list of ids, with the leading space that encoding adds still in place."""
    if vocab.byte_of.keys().isdisjoint(ids):
        return "".join([vocab.pieces[i] for i in ids]).replace(SPACE, " ")
    out: list[str] = []
    run = bytearray()
    for i in ids:
        b = vocab.byte_of.get(i)
        if b is not None:
            run.append(b)
            continue
        if run:
            out.append(run.decode(errors="replace"))
            run.clear()
        out.append(vocab.pieces[i])
    if run:
        out.append(run.decode(errors="replace"))
    return "".join(out).replace(SPACE, " ")


def chunk_starts(points: np.ndarray, texts: np.ndarray, vocab: PieceVocab) -> np.ndarray:
    """Where chunks start, in the code points of texts put together; ``texts`` are those of the texts."""
    kinds, beside = vocab.neighbours
    kind = kinds[points]
    opens = np.ones(len(points), dtype=bool)
    opens[1:] = ~beside.ravel()[kind[:-1] * len(beside) + kind[1:]]
    opens[texts] = True
    return np.flatnonzero(opens)


def _put_together(parts: pa.Array, ids: np.ndarray, ends: np.ndarray, head: int, tail: int) -> list[str]:
    """For the ids between two ends each, their ``parts`` one after another, without so many bytes in front and behind."""
    data, at = byte_view(parts.take(pa.array(ids)))
    view, bounds = memoryview(data), at[ends].tolist()
    return [str(view[a + head : b - tail], "utf-8") if a < b else "" for a, b in zip(bounds, bounds[1:])]


class Codec:
    """Encodes and decodes batches of texts; remembers the ids of chunks and starts anew when they are many."""

    def __init__(self, model: str, most: int = CACHE_CHUNKS, most_chars: int = CACHE_CHARS, verify: bool = True, check_chars: int = CHECK_CHARS):
        self.vocab, self.library, self.verify, self.check_chars = vocabulary(model), processor(model), verify, check_chars
        self.most, self.most_chars = most, most_chars
        if not self.vocab.separable:
            raise ValueError(f"{model}: not a merge-type vocabulary whose pieces stop at spaces")
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.starts, self.lengths, self.chars = array("i"), array("q"), array("q"), 0

    def _codes(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks, all different, among those remembered; new ones are encoded."""
        if len(self.codes) > self.most or self.chars > self.most_chars:
            self._forget()
        codes = np.fromiter([self.codes.get(c, -1) for c in chunks], np.int64, len(chunks))
        if (fresh := np.flatnonzero(codes < 0)).size:
            new = [chunks[i] for i in fresh.tolist()]
            found = agenda_encode_many([c.replace(" ", SPACE) for c in new], self.vocab)
            codes[fresh] = np.arange(len(self.codes), len(self.codes) + len(new))
            self.codes.update(zip(new, codes[fresh].tolist(), strict=True))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.starts.frombytes((len(self.ids) + np.cumsum(lengths) - lengths).tobytes())
            self.lengths.frombytes(lengths.tobytes())
            self.ids.extend(chain.from_iterable(found))
            self.chars += sum(map(len, new))
        return codes

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and how many each has."""
        # the library puts one more space before each text
        whole = "".join([" " + t if t else "" for t in texts]).replace(SPACE, " ")
        lengths = np.fromiter([len(t) + 1 if t else 0 for t in texts], np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = chunk_starts(points, begins[lengths > 0], self.vocab)
        data = whole.encode()
        at = np.flatnonzero(np.frombuffer(data, np.int8) >= -64)  # all bytes but those inside of a character
        bounds = np.append(at[starts], len(data))
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        codes = self._codes(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        first, size = np.array(self.starts, np.int64)[codes], np.array(self.lengths, np.int64)[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
        return np.array(self.ids, np.int32)[place], np.diff(ends[np.append(np.searchsorted(starts, begins), len(starts))])

    def check(self, texts: list[str], found: list[tuple[str, str]]) -> None:
        """Compare ids and decoded texts with the library's; long texts go in segments that no piece crosses."""
        cut = [segments(t, self.check_chars) for t in texts]
        theirs = self.library.encode([s for parts in cut for s in parts], num_threads=1, return_type="numpy")
        back = iter(self.library.decode(theirs, num_threads=1))
        sizes = np.concatenate([[0], np.cumsum([len(r) for r in theirs])])[np.cumsum([0, *map(len, cut)])]
        joined = _put_together(self.vocab.decimals, np.concatenate(theirs), sizes, 0, 1) if theirs else []
        for text, parts, own, (ids, decoded) in zip(texts, cut, joined, found, strict=True):
            if ids != own:
                raise ValueError(f"{text[:80]!r}: the library has other ids than the agenda")
            if decoded != " ".join([next(back) for _ in parts]):
                raise ValueError(f"{text[:80]!r}: the library decodes another text")

    def batch(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids as decimals joined by commas, and the text decoded from them."""
        cut = [segments(t, SEGMENT_CHARS) for t in texts]
        parts = [s for own in cut for s in own]
        runs = np.cumsum([len(s) for s in parts]) // SEGMENT_CHARS
        stops = [*(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(parts)]
        found = [self._encoded(parts[a:b]) for a, b in zip([0, *stops], stops)]
        ids = np.concatenate([i for i, _ in found])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in found]))])[np.cumsum([0, *map(len, cut)])]
        # the first id of a text begins with the space that encoding adds
        out = list(zip(_put_together(self.vocab.decimals, ids, ends, 0, 1), _put_together(self.vocab.raw, ids, ends, 1, 0), strict=True))
        if self.verify:
            self.check(texts, out)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.batch([text])[0][0].split(",") if i]

    def decode(self, ids: list[int]) -> str:
        return decode_ids(ids, self.vocab).removeprefix(" ")


def _id_lists(joined: list[str], n: list[int]) -> pa.Array:
    """Lists of ids from decimals joined by commas; ``n`` has the length of every list, also of empty ones."""
    values = pc.split_pattern(pa.array([",".join(joined)] if joined else [], pa.large_string()), ",")
    offsets = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.flatten().cast(pa.int32()))


def encode_documents(docs: DataFrame, model: str, ids: bool = True, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, if asked for), ids_sha256, decoded_sha256.

    ``ids_sha256`` is the digest of the decimal ids joined by commas, ``decoded_sha256``
    that of the text decoded from them.
    """
    made: list[Codec] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = made[0] if made else Codec(model, verify=verify)
        if not made:
            made.append(codec)
        for batch in by_bytes(batches, BATCH_BYTES):
            n, texts, first, second = [], [], [], []
            for joined, back in codec.batch(text_column(batch).to_pylist()):
                n.append(joined.count(",") + 1 if joined else 0)
                first.append(hashlib.sha256(joined.encode()).hexdigest())
                second.append(hashlib.sha256(back.encode()).hexdigest())
                if ids and joined:
                    texts.append(joined)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(_id_lists(texts, n))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
