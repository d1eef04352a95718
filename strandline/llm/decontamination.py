"""Operator 10: benchmark decontamination by template windows.

Texts become sequences of words in which numbers, units after numbers, and names
(words inside a sentence with a capital before small letters, in Latin, Greek and
Cyrillic letters) are typed placeholders.  Windows of five such words are hashed.
Windows of documents that may equal a benchmark window (a bitset of bounded size decides
that inside the scan) are written once and joined with the benchmark windows on the
hash.  A document holds an item where along one alignment of the two texts at least
``coverage`` of the item's window positions occur in it, and the values in the
placeholders agree: each value of the item stands for one value of the document.  An
alignment may go on at another shift after words put in or left out.  So an
item with other numbers and names is found too, a text that merely has the same shape
with values at random is not.

Each item looks for documents with its rarest windows only, as many as make sure that a
document which holds enough of the others has one of these; so a window that many items
and documents share brings nothing together by itself.

A window needs three plain words to count.  An item without such a window (a short one,
or one made of numbers and names) is one window as a whole, of whatever length, and its
values must all be the same.  The first word of an item is read both as the start of a
sentence and as a word inside one, since it may stand in either place.

In German every noun reads as a name; it must then agree like one.  Null texts and texts
without words match nothing.  Rows of documents are told apart by id (which may be null)
and a hash of the text; rows equal in both give their results once, equal texts with
several ids each.  Items go by id: rows of one id are read as one item, rows without an
id are left out.  Empty tables on either side give no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import ASCII_LOWER, ROW_KEY, HashFilter, Scratch, Words, by_bytes, byte_view, chain, hash_filter, mix64, row_key, stored, text_column, without_rows

BATCH_BYTES = 1 << 20
WORDS = 5
LEAST_PLAIN = 3
#: Shifts this far apart are one passage with a few words put in or left out.
NEAR = 8
NUMBER, UNIT, NAME = 1, 2, 3
_HOLDERS = mix64(np.arange(4, dtype=np.uint64), 77)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("%"), ord("$")]] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
# Units of measurement and money, and number words, in English, German, Spanish and French.
UNITS = """
mm cm m km kg g mg lb lbs oz ml l mph kmh h s min % $
liter liters litre litres meter meters metre metres mile miles foot feet inch inches pound pounds degree degrees gram grams kilogram kilograms kilometer kilometers
second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros
meilen fuß zoll pfund grad gramm kilogramm kilometer sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent
metro metros milla millas pie pies libra libras grado grados gramo gramos kilogramo kilogramos kilómetro kilómetros litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares céntimo céntimos
mètre mètres pied pieds livre livres degré degrés gramme grammes kilogramme kilogrammes kilomètre kilomètres seconde secondes heure heures jour jours semaine semaines mois an ans année années centime centimes
""".split()
NUMBER_WORDS = """
one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen
dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille millions
""".split()


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = byte_view(pa.array(words, pa.large_string()))
    return np.sort(Words(data, offsets, _WORD, ASCII_LOWER).hash)


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS)


def _within(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def _wide_capitals(data: np.ndarray) -> np.ndarray:
    """Marks, shifted by none, on the second bytes of two-byte capitals: U+00C0-00DE, Greek U+0391-03A9, Cyrillic U+0410-042F."""
    out = np.zeros(len(data) + 1, dtype=bool)
    lead, then = data[:-1], data[1:]
    latin = (lead == 0xC3) & (then >= 0x80) & (then <= 0x9E) & (then != 0x97)
    greek = (lead == 0xCE) & (then >= 0x91) & (then <= 0xA9)
    cyrillic = (lead == 0xD0) & (then >= 0x90) & (then <= 0xAF)
    out[1:-1] = latin | greek | cyrillic
    return out


def _lower_wide(lower: np.ndarray, data: np.ndarray, after: np.ndarray) -> None:
    """Puts the small letter in place of each two-byte capital; ``after`` marks the byte before the second one."""
    first = np.flatnonzero(after[: len(data)])
    lead, then = data[first], data[first + 1].astype(np.int64)
    point = np.where(lead == 0xC3, 0xC0, np.where(lead == 0xCE, 0x380, 0x400)) + (then & 0x3F) + 32
    lower[first] = 0xC0 | point >> 6
    lower[first + 1] = 0x80 | point & 0x3F


class Templates:
    """Words of a batch with their kinds (0 plain) and the hashes of their canonical forms."""

    def __init__(self, texts: pa.Array):
        data, offsets = byte_view(texts)
        lower = ASCII_LOWER[data]
        large = _wide_capitals(data)
        _lower_wide(lower, data, large[1:])
        self.words = words = Words(lower, offsets, _WORD)
        n = len(words.start)
        kind = np.zeros(n, dtype=np.int8)
        if n:
            ascii_capital = (data[words.start] >= 65) & (data[words.start] <= 90)
            wide_capital = large[words.start + 1]  # marks are on second bytes
            # a name goes on in small letters, so words in capitals only are plain words
            then = np.minimum(words.start + np.where(wide_capital, 2, 1), len(data) - 1)
            small = ((data[then] >= 97) & (data[then] <= 122)) | ((data[then] >= 128) & ~large[np.minimum(then + 1, len(data))])
            capital = (ascii_capital | wide_capital) & small & (then < words.end)
            ends = np.concatenate([[0], np.cumsum(_END[data])])
            opens = np.ones(n, dtype=bool)
            opens[1:] = (words.doc[1:] != words.doc[:-1]) | (ends[words.start[1:]] != ends[words.start[:-1]])
            digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
            number = (digits[words.end] > digits[words.start]) | _within(words.hash, _NUMBER_HASHES)
            kind[capital & ~opens] = NAME
            kind[number] = NUMBER
            after = np.zeros(n, dtype=bool)
            after[1:] = number[:-1] & (words.doc[1:] == words.doc[:-1])
            kind[after & _within(words.hash, _UNIT_HASHES)] = UNIT
        self.kind = kind
        self.form = np.where(kind > 0, _HOLDERS[kind], words.hash)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each window with enough plain words."""
        doc = self.words.doc
        n = len(doc) - WORDS + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        at = np.flatnonzero((doc[:n] == doc[WORDS - 1 :]) & (plain[WORDS:] - plain[:n] >= LEAST_PLAIN))
        return at, chain([self.form[at + i] for i in range(WORDS)])

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each run of so many words, placeholders not used."""
        at, hashes = self.words.windows(length)
        return at, mix64(hashes, length)

    def slots(self, at: np.ndarray) -> pa.Array:
        """For each window the hashes of its words at placeholders, 0 at plain words."""
        each = np.stack([np.where(self.kind[at + i] > 0, self.words.hash[at + i], 0) for i in range(WORDS)], axis=1) if len(at) else np.zeros((0, WORDS), np.uint64)
        return _slot_lists(each.astype(np.uint64).view(np.int64))


def _slot_lists(each: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, each.size + 1, WORDS, dtype=np.int32)), pa.array(each.ravel()))


_NAMES = ["position", "window", "slots", "length"]
_SCHEMA = "position long, window long, slots array<long>, length int"


def _rows(batch: pa.RecordBatch, found: Templates, at: np.ndarray, hashes: np.ndarray, length: int | None = None) -> pa.RecordBatch:
    """Windows with all columns of the batch but its text, the last; ``length`` for runs of whole items."""
    doc = found.words.doc[at]
    first = np.searchsorted(found.words.doc, doc)
    slots = found.slots(at) if length is None else _slot_lists(np.zeros((len(at), WORDS), np.int64))
    own = [c.take(pa.array(doc)) for c in batch.columns[:-1]]
    lengths = pa.array(np.full(len(at), length or 0, np.int32), mask=np.full(len(at), length is None))
    return pa.RecordBatch.from_arrays([*own, pa.array((at - first).astype(np.int64)), pa.array(hashes.view(np.int64)), slots, lengths], [*batch.schema.names[:-1], *_NAMES])


def _inside(text: Column) -> Column:
    """The text as it reads inside a sentence: with a plain word before it."""
    return F.concat(F.lit("x "), text)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, position, window, slots of the benchmark's windows; ``length`` is set for items that are one window as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            found = Templates(text_column(batch))
            at, hashes = found.windows()
            yield _rows(batch, found, at, hashes)
            n = np.bincount(found.words.doc, minlength=batch.num_rows)
            n[found.words.doc[at]] = 0
            for length in np.unique(n[n > 0]).tolist():
                whole = np.searchsorted(found.words.doc, np.flatnonzero(n == length))
                starts, runs = found.runs(length)
                yield _rows(batch, found, whole, runs[np.searchsorted(starts, whole)], length)

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
    opening = items.mapInArrow(run, f"item_id long, {_SCHEMA}")
    # position 0 is the word put before the text
    inner = items.select("item_id", _inside(F.col("text")).alias("text")).mapInArrow(run, f"item_id long, {_SCHEMA}").where("position = 1 and length is null").withColumn("position", F.lit(0).cast("long"))
    return opening.union(inner).distinct()


def candidate_windows(docs: DataFrame, kept: Broadcast[HashFilter], lengths: list[int]) -> DataFrame:
    """The row key and position, window, slots of the windows of documents that pass the bitset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = kept.value.hits
        for batch in by_bytes(batches, BATCH_BYTES):
            found = Templates(text_column(batch))
            for length in (None, *lengths):
                at, hashes = found.windows() if length is None else found.runs(length)
                hit = passes(hashes)
                if hit.any():
                    yield _rows(batch, found, at[hit], hashes[hit], length)

    columns = ", ".join(f"{c} long" for c in ROW_KEY)
    return docs.where("text is not null").select(*row_key(), "text").mapInArrow(run, f"{columns}, {_SCHEMA}")


def _judged(position: np.ndarray, slots: np.ndarray, theirs: np.ndarray) -> dict:
    """matched, slots, changed, consistent of the windows of one alignment."""
    held = slots != 0
    values, which = np.unique(slots[held], return_inverse=True)
    each = np.unique(np.stack([which.astype(np.int64), theirs[held]], axis=1), axis=0) if len(values) else np.zeros((0, 2), np.int64)
    single = np.bincount(each[:, 0], minlength=len(values)) == 1
    changed = len(np.unique(each[each[:, 1] != values[each[:, 0]], 0]))
    return {"matched": len(np.unique(position)), "slots": len(values), "changed": changed, "consistent": float(single.mean()) if len(values) else 1.0}


def _longest(position: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a longest chain in which both the positions and the places in the document grow."""
    order = np.lexsort((-position, at))
    tops: list[int] = []
    rows: list[int] = []
    before = np.full(len(order), -1, dtype=np.int64)
    for r, p in zip(order.tolist(), position[order].tolist()):
        i = bisect_left(tops, p)
        if i:
            before[r] = rows[i - 1]
        if i == len(tops):
            tops.append(p)
            rows.append(r)
        else:
            tops[i], rows[i] = p, r
    out = []
    r = rows[-1] if rows else -1
    while r >= 0:
        out.append(r)
        r = int(before[r])
    return np.array(out, dtype=np.int64)


def _agree(slots: np.ndarray, theirs: np.ndarray, values: np.ndarray, stands_for: np.ndarray) -> np.ndarray:
    """Rows with no value (of the sorted ``values``) that stands for another one in the document."""
    if not len(values):
        return np.ones(len(slots), dtype=bool)
    i = np.minimum(np.searchsorted(values, slots), len(values) - 1)
    return ((values[i] != slots) | (stands_for[i] == theirs)).all(axis=1)


class Coverable:
    """How many positions of an item the windows of a document can cover where some values are given.

    Sets of positions are the bits of integers.
    """

    def __init__(self, position: np.ndarray, slots: np.ndarray, theirs: np.ndarray):
        self.names, at = np.unique(position, return_inverse=True)
        held = slots != 0
        row = np.broadcast_to(np.arange(len(position))[:, None], slots.shape)[held]
        each = np.unique(np.stack([slots[held], row], axis=1), axis=0)  # values of each row, once
        value, count = np.unique(np.stack([each[:, 0], at[each[:, 1]]], axis=1), axis=0, return_counts=True)
        rows = np.bincount(at)
        self.bound = self._sets(value[count == rows[value[:, 1]]])  # positions that no window covers without the value
        given = np.unique(np.stack([slots[held], theirs[held], at[row]], axis=1), axis=0)
        self.by_pair = self._sets(given)

    @staticmethod
    def _sets(rows: np.ndarray) -> dict[tuple, int]:
        """Rows (name parts, position) as sets of positions by name."""
        out: dict[tuple, int] = {}
        for *name, p in rows.tolist():
            out[tuple(name)] = out.get(tuple(name), 0) | 1 << p
        return out

    def most(self, values: np.ndarray, theirs: np.ndarray) -> int:
        """No chain in which these values stand for those of the document covers more positions."""
        lost = 0
        for v, t in zip(values.tolist(), theirs.tolist()):
            lost |= self.bound.get((v,), 0) & ~self.by_pair.get((v, t), 0)
        return len(self.names) - lost.bit_count()


def best_chain(position: np.ndarray, at: np.ndarray, slots: np.ndarray, theirs: np.ndarray, least: int, consistency: float) -> dict | None:
    """What ``leaks`` tells of the best alignment of a document with an item, or None.

    First each single shift is judged by itself.  If none passes, words may have been put
    in or left out: windows of other shifts join those of a shift where both texts go
    on in order and no value contradicts the shift's own.  Near shifts are tried first,
    then those up to the item's length away, then all, whatever their distance and number;
    of these the first that passes is told, from the largest shift on.  There a shift is
    left out if its values are those of one before, or if with them too few positions can
    be covered.
    """
    shift = at - position
    order = np.argsort(shift, kind="stable")
    position, at, slots, theirs, shift = position[order], at[order], slots[order], theirs[order], shift[order]
    shifts, starts = np.unique(shift, return_index=True)
    ends = np.append(starts[1:], len(shift))

    def passing(rows: np.ndarray | slice) -> dict | None:
        if len(position[rows]) < least:
            return None
        got = _judged(position[rows], slots[rows], theirs[rows])
        return got if got["matched"] >= least and got["consistent"] >= consistency else None

    def rank(got: dict) -> tuple:
        return got["matched"], got["consistent"], -got["changed"], got["slots"]

    single = [got for a, b in zip(starts, ends) if (got := passing(slice(a, b)))]
    if single:
        return max(single, key=rank)
    if len(shifts) == 1 or len(np.unique(position)) < least:
        return None

    def chained(low: int, high: int, fits: np.ndarray) -> dict | None:
        rows = low + np.flatnonzero(fits)
        return passing(rows[_longest(position[rows], at[rows])]) if len(rows) >= least else None

    if got := chained(0, len(shift), ((slots == 0) | (slots == theirs)).all(axis=1)):
        return got
    largest = np.lexsort((shifts, starts - ends))
    for reach in (NEAR, int(position.max()) + WORDS, None):
        found, tried = [], set()
        coverable = Coverable(position, slots, theirs) if reach is None else None
        for s in largest:
            own = slice(starts[s], ends[s])
            low = 0 if reach is None else int(np.searchsorted(shift, shifts[s] - reach))
            high = len(shift) if reach is None else int(np.searchsorted(shift, shifts[s] + reach, side="right"))
            if high - low < least or high - low == own.stop - own.start:
                continue
            held = slots[own] != 0
            pairs, count = np.unique(np.stack([slots[own][held], theirs[own][held]], axis=1), axis=0, return_counts=True) if held.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            pairs = pairs[np.lexsort((-count, pairs[:, 0]))]
            values, first = np.unique(pairs[:, 0], return_index=True)
            if coverable:
                told = values.tobytes() + pairs[first, 1].tobytes()
                if told in tried or coverable.most(values, pairs[first, 1]) < least:
                    continue
                tried.add(told)
            fits = _agree(slots[low:high], theirs[low:high], values, pairs[first, 1])
            fits[own.start - low : own.stop - low] = True
            if got := chained(low, high, fits):
                found.append(got)
                if coverable:
                    break
        if found:
            return max(found, key=rank)
    return None


def _row_name() -> Column:
    """The row key as one text, which joins where the id is null too."""
    return F.concat_ws(":", F.coalesce(F.col(ROW_KEY[0]).cast("string"), F.lit("-")), F.col(ROW_KEY[1]).cast("string"))


def probes(items: DataFrame, found: DataFrame, coverage: float) -> DataFrame:
    """item_id, window: the rarest windows of each item, one of which a document has if it has enough of all."""
    sizes = items.groupBy("item_id").agg(F.countDistinct("position").alias("windows"))
    frequent = found.groupBy("window").agg(F.count("*").alias("c"))
    cost = items.join(frequent, "window", "left").groupBy("item_id", "position").agg(F.sum(F.coalesce("c", F.lit(0))).alias("c"))
    ranked = cost.join(sizes, "item_id").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("c", "position")))
    rare = ranked.where(F.col("rank") <= F.col("windows") - F.ceil(F.lit(coverage) * F.col("windows")) + 1)
    return items.join(rare.select("item_id", "position"), ["item_id", "position"]).select("item_id", "window").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, consistency: float = 0.8) -> DataFrame:
    """doc_id, text_hash, item_id, windows, matched, share, slots, changed, consistent for each item that a document holds.

    All of it is of the best alignment.  ``share`` is matched / windows; ``slots`` counts
    the distinct placeholder values of the item that were compared, ``changed`` those with
    another value in the document, ``consistent`` the share of those that have one value
    throughout.  The result is stored in the shared folder.
    """
    work = Scratch(docs.sparkSession)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        position, at, windows = (table.column(c).to_numpy() for c in ("position", "at", "windows"))
        slots, theirs = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, WORDS) for c in ("slots", "theirs"))
        best = best_chain(position, at, slots, theirs, -int(-coverage * windows[0] // 1), consistency)
        found = [] if best is None else [{"row": key[0].as_py(), "item_id": key[1].as_py(), "windows": int(windows[0]), **best, "share": best["matched"] / int(windows[0])}]
        return pa.Table.from_pylist(found, schema=names)

    names = pa.schema([("row", pa.string()), *((c, pa.int64()) for c in ("item_id", "windows", "matched")), ("share", pa.float64()), ("slots", pa.int64()), ("changed", pa.int64()), ("consistent", pa.float64())])
    try:
        items = work.stored(item_windows(benchmark))
        lengths = [r.length for r in items.where("length is not null").select("length").distinct().collect()]
        passed = candidate_windows(docs, hash_filter(items.select("window").distinct()), sorted(lengths)).select(_row_name().alias("row"), "position", "window", "slots")
        found = work.stored(passed.dropDuplicates(["row", "position", "window"]))
        sizes = items.groupBy("item_id").agg(F.countDistinct("position").alias("windows"))
        pairs = found.select("row", "window").join(probes(items, found, coverage), "window").select("row", "item_id").distinct()
        theirs = found.select("row", "window", F.col("position").alias("at"), F.col("slots").alias("theirs"))
        aligned = pairs.join(items.drop("length"), "item_id").join(theirs, ["row", "window"]).select("row", "item_id", "position", "at", "slots", "theirs")
        aligned = work.stored(aligned)
        # no alignment covers more positions than all of them together
        matched = aligned.groupBy("row", "item_id").agg(F.countDistinct("position").alias("matched"))
        enough = matched.join(sizes, "item_id").where(F.col("matched") >= F.ceil(F.lit(coverage) * F.col("windows")))
        rows = aligned.join(enough.select("row", "item_id", "windows"), ["row", "item_id"])
        told = rows.groupBy("row", "item_id").applyInArrow(run, "row string, item_id long, windows long, matched long, share double, slots long, changed long, consistent double")
        part = F.split("row", ":")
        return stored(told.select(part[0].try_cast("long").alias("doc_id"), part[1].cast("long").alias("text_hash"), *told.columns[1:]))
    finally:
        work.drop()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows are dropped in the scan."""
    dirty = leaks(docs, benchmark, **how).select(F.col("doc_id").alias(ROW_KEY[0]), F.col("text_hash").alias(ROW_KEY[1])).distinct()
    return without_rows(docs, dirty.withColumn("_row_once", F.lit(False)))
