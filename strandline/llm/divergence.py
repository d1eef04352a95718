"""Operator 12: how far the sources of a language differ in their words.

Postings.  Texts are cut into terms in Arrow batches.  A block of batches gives one
posting for each (lang, term, source) it holds: in how many of its documents the term is,
how often, and the first of these documents.  A posting with the empty term names a source that occurs,
with terms or without.

Runs.  Postings are dealt by lang and term and sorted by (lang, term, source, document); a
term of any frequency has one posting for each source of a block, and those of every 4,096
tasks meet apart, so none is too frequent.  A scan of the sorted rows adds up each run of
(lang, term, source) and emits it when it ends; these sums are partial where tasks of
several wings have the term, and one more sum joins them.

Rates.  Terms in enough documents of a language are kept.  Each source's rate of a term is
an integer, worked out in decimals, so no count is too large for it.

Pairs.  The rates of a language are sorted again, by (chunk of terms, tile of sources,
term, source), each chunk headed by the rates that absent terms have.  A scan fills one
term's rates after the other and adds the absolute differences of the tile's sources,
emitting the partial sums of a chunk for each pair of sources when the chunk ends.  A
tile holds at most ``TILE`` sources of each side and a chunk about ``CHUNK`` terms, so
memory is bounded and a language spreads over tasks whatever its size.

Null texts, languages and sources are read as empty.  Each row is a document of its own:
repeated rows and equal or null ids count as often as they come.  Long texts are cut at
term bounds and count as one document.  Ties in value go by the item's bytes.  A language
in which no term is kept gives pairs of value 0 and no terms; a lone source gives no
pairs.  Empty tables give empty tables.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import ASCII_LOWER, Scratch, by_bytes, byte_view, stored, text_column

#: Bytes of text cut into terms at once.
PIECE_BYTES = 1 << 20
#: Bytes of text in a block, whose postings are added up before they are dealt, and rows at which a block's postings are compacted.
BLOCK_BYTES, COMPACT_ROWS = 1 << 25, 1 << 19
#: Postings of so many tasks meet in one place (as a power of two), whatever their term; those of other tasks meet elsewhere.
WING_BITS = 12
#: Terms in a chunk and sources on a side of a tile, about.
CHUNK, TILE = 1 << 11, 256
#: Rates held at once while differences are added up.
CELLS = 1 << 20
SCALE, SMOOTH = 1_000_000_000, 5
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


# --- postings ---------------------------------------------------------------


def _occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The text number and the term of each occurrence, in order."""
    inside = _TERM[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    starts[cuts] = inside[cuts]  # a term ends with its text
    start = np.flatnonzero(starts)
    kept = np.concatenate([[0], np.cumsum(inside)])  # bytes of terms before each byte
    bounds = np.append(kept[start], kept[-1])
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ASCII_LOWER[data[inside]]))
    return np.searchsorted(offsets, start, side="right") - 1, terms


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of the texts; a long text alone comes in pieces that end between terms."""
    data, offsets = byte_view(texts)
    if len(texts) > 1 or len(data) <= 2 * PIECE_BYTES:
        yield data, offsets
        return
    start = 0
    while start < len(data):
        stop = start + PIECE_BYTES
        while stop < len(data):  # look for a byte outside terms, in ever later windows
            gap = np.flatnonzero(~_TERM[data[stop : stop + PIECE_BYTES]])
            if len(gap):
                stop += int(gap[0])
                break
            stop += PIECE_BYTES
        yield data[start:stop], np.array([0, min(stop, len(data)) - start])
        start = stop


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text number, number in ``terms`` and count of each distinct term of each text, and the terms."""
    found = [_occurrences(*piece) for piece in _pieces(texts)]
    coded = pa.chunked_array([t for _, t in found], pa.large_string()).dictionary_encode().unify_dictionaries()
    terms = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.large_string())
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks] or [np.zeros(0)]).astype(np.int64)
    pair, n = np.unique(np.concatenate([d for d, _ in found]) * max(len(terms), 1) + codes, return_counts=True)
    doc, code = np.divmod(pair, max(len(terms), 1))
    return doc, code, n, terms


def _compacted(parts: list[pa.Table]) -> pa.Table:
    """One row for each (lang, term, source), with documents and n added up and the first document."""
    whole = pa.concat_tables(parts).combine_chunks()
    added = whole.group_by(["lang", "term", "source"]).aggregate([("document", "min"), ("documents", "sum"), ("n", "sum")])
    return added.rename_columns(["lang", "term", "source", "document", "documents", "n"])


def _posted(batch: pa.RecordBatch) -> pa.Table:
    """lang, term, source, document, documents, n of a batch (doc_id, text, lang, source), a row for each of its groups and their terms."""
    lang, source = (pc.dictionary_encode(batch.column(c)).indices.to_numpy().astype(np.int64) for c in (2, 3))
    _, row, group = np.unique(lang * (source.max() + 1) + source, return_index=True, return_inverse=True)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    doc, code, n, terms = term_counts(text_column(batch))
    key = group[doc] * max(len(terms), 1) + code
    order = np.argsort(key, kind="stable")
    key, doc, n = key[order], doc[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    of, at = np.divmod(key[first], max(len(terms), 1))
    documents = np.diff(np.append(first, len(key)))
    total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(ids[doc], first) if len(first) else np.zeros(0, np.int64)
    none = np.zeros(len(row), np.int64)
    rows = pa.array(np.concatenate([row, row[of]]))
    columns = [batch.column(2).cast(pa.large_string()).take(rows), pa.concat_arrays([pa.array([""] * len(row), pa.large_string()), terms.take(pa.array(at))]), batch.column(3).cast(pa.large_string()).take(rows)]
    columns += [pa.array(np.concatenate([none, x]).astype(np.int64)) for x in (least, documents, total)]
    return pa.table(columns, ["lang", "term", "source", "document", "documents", "n"])


def postings(docs: DataFrame) -> DataFrame:
    """lang, term, source, document, block, documents, n: what each block of texts holds of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []
        size = rows = 0

        def given() -> Iterator[pa.RecordBatch]:
            whole = _compacted(held)
            whole = whole.add_column(4, "block", pa.array(np.full(len(whole), block)))
            yield from whole.to_batches(max_chunksize=1 << 16)

        for batch in by_bytes(batches, PIECE_BYTES):
            held.append(_posted(batch))
            rows += len(held[-1])
            size += batch.nbytes
            if rows > COMPACT_ROWS:
                held = [_compacted(held)]
                rows = len(held[0])
            if size > BLOCK_BYTES or rows > COMPACT_ROWS // 2:
                yield from given()
                held, size, rows, block = [], 0, 0, block + 1
        if held:
            yield from given()

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    schema = "lang string, term string, source string, document long, block long, documents long, n long"
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text", *read).mapInArrow(run, schema)


# --- runs -------------------------------------------------------------------


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    new = np.ones(len(columns[0]), dtype=bool)
    for i, c in enumerate(columns):
        differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differs if not i else new[1:] | differs
    return np.flatnonzero(new)


def runs(posted: DataFrame) -> DataFrame:
    """lang, term, source, documents, n of each (lang, term, source), from a scan of sorted postings."""
    names = ["lang", "term", "source", "documents", "n"]
    # one text for both, of which the sort compares more at a time; a term holds no NUL, so the parts stay apart
    both = F.concat("lang", F.lit("\0"), "term").alias("key")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the run that may go on, added up so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(batch.columns) if held is None else [pa.concat_arrays([h, c]) for h, c in zip(held.columns, batch.columns)]
            first = _starts(columns[:2])
            at = pa.array(first)
            added = [pa.array(np.add.reduceat(c.to_numpy(), first)) for c in columns[2:]]
            done = pa.RecordBatch.from_arrays([*[c.take(at) for c in columns[:2]], *added], ["key", *names[2:]])
            yield done.slice(0, len(first) - 1)
            held = done.slice(len(first) - 1)
        if held is not None:
            yield held

    wing = F.shiftright("block", 32 + WING_BITS).alias("wing")
    dealt = posted.select(both, "source", "document", "block", "documents", "n", wing).repartition("key", "wing").sortWithinPartitions("key", "source", "document", "block")
    partial = dealt.select("key", *names[2:]).mapInArrow(scan, "key string, source string, documents long, n long")
    added = partial.groupBy("key", "source").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    term = F.substring_index("key", "\0", -1)
    return added.select(F.expr("left(key, char_length(key) - char_length(substring_index(key, '\\0', -1)) - 1)").alias("lang"), term.alias("term"), "source", "documents", "n")


# --- rates ------------------------------------------------------------------


def rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact for counts of any size; there is a term at least."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(F.lit(SCALE)) * (wide(count) + F.lit(SMOOTH)).cast("decimal(18,0)"), wide(total) + wide(terms) * F.lit(SMOOTH))


class Rates:
    """What is kept of a corpus: sources (every group with its base rate), cells (rates of the terms it has) and langs."""

    def __init__(self, counted: DataFrame, least: int, work: Scratch):
        named = counted.where("term != ''")
        self.terms = work.stored(named.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n")).where(F.col("documents") >= least).select("lang", "term", F.col("n").alias("n_lang")))
        kept = work.stored(named.join(self.terms, ["lang", "term"]).select("lang", "term", "source", "n", "n_lang"))
        self.langs = work.stored(self.terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang")))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        every = counted.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(self.langs, "lang", "left")
        none = F.col("terms").isNull()
        base = F.when(none, F.lit(0)).otherwise(rate(F.lit(0), F.coalesce("total", F.lit(0)), F.coalesce("terms", F.lit(1)))).alias("base")
        place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
        self.sources = work.stored(every.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "total_lang", base, place))
        cells = kept.join(self.sources, ["lang", "source"])
        self.cells = work.stored(cells.select("lang", "term", "source", "place", "terms", rate(F.col("n"), F.col("total"), F.col("terms")).alias("p"), rate(F.col("n_lang"), F.col("total_lang"), F.col("terms")).alias("q")))


# --- pairs ------------------------------------------------------------------


def _tiled(rows: DataFrame, sources: DataFrame, tile: int) -> DataFrame:
    """``rows`` copied to each pair (i, j) of blocks of ``tile`` sources that their source takes part in."""
    blocks = sources.groupBy("lang").agg(F.call_function("div", F.max("place"), F.lit(tile)).alias("last")).select("lang", "last")
    own = F.call_function("div", F.col("place"), F.lit(tile))
    out = rows.join(blocks, "lang").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    return out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "last")


def _chunks(terms: Column, chunk: int) -> Column:
    """Into how many chunks the terms of a language are dealt; one where none are kept, whose sources have rates alike."""
    return F.greatest(F.lit(1).cast("long"), F.call_function("div", terms + F.lit(chunk - 1), F.lit(chunk)))


def pair_sums(rates: Rates, chunk: int, tile: int) -> DataFrame:
    """lang, a, b (places of sources, a before b), value, seen: the sum of the differences of their rates over ``seen`` terms.

    All other kept terms are those that no source of the pair's tile has.
    """
    heads = rates.sources.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), _chunks(F.col("terms"), chunk) - 1)))
    heads = heads.select("lang", "chunk", F.lit("").alias("term"), "place", F.col("base").alias("p"))
    cells = rates.cells.withColumn("chunk", F.pmod(F.xxhash64("term"), _chunks(F.col("terms"), chunk))).select("lang", "chunk", "term", "place", "p")
    unit = ["lang", "chunk", "i", "j"]
    dealt = _tiled(heads.union(cells), rates.sources, tile).repartition(*unit).sortWithinPartitions(*unit, "term", "place")

    def emitted(key: tuple, places: np.ndarray, sums: np.ndarray, seen: int) -> pa.RecordBatch:
        lang, _, i, j = key
        block = places // tile
        a, b = np.triu_indices(len(places), 1)
        apart = (block[a] == i) & (block[b] == j)
        a, b = a[apart], b[apart]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.large_string()), pa.array(places[a]), pa.array(places[b]), pa.array(sums[a, b]), pa.array(np.full(len(a), seen))], ["lang", "a", "b", "value", "seen"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        heads_open, head_places, head_rates = False, [], []
        places = base = sums = None
        last_term: str | None = None
        seen = 0  # terms of the unit, the carried one among them

        def add(terms: np.ndarray, place: np.ndarray, p: np.ndarray, carried: np.ndarray | None) -> np.ndarray:
            """Adds up all terms but the last, whose rates are returned; ``carried`` are those of the first so far."""
            n, size = int(terms[-1]) + 1, len(places)
            step = max(1, CELLS // max(size, 1))
            row = None
            for low in range(0, n, step):
                high = min(low + step, n)
                a, b = np.searchsorted(terms, [low, high])
                table = np.tile(base, (high - low, 1))
                if low == 0 and carried is not None:
                    table[0] = carried
                table[terms[a:b] - low, np.searchsorted(places, place[a:b])] = p[a:b]
                if high == n:
                    row, table = table[-1].copy(), table[:-1]
                for s in range(size - 1):
                    sums[s, s + 1 :] += np.abs(table[:, s + 1 :] - table[:, s : s + 1]).sum(axis=0)
            return row

        carried: np.ndarray | None = None

        def closed() -> Iterator[pa.RecordBatch]:
            if key is not None:
                if carried is not None:
                    for s in range(len(places) - 1):
                        sums[s, s + 1 :] += np.abs(carried[s + 1 :] - carried[s])
                yield emitted(key, places, sums, seen)

        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = np.append(_starts([batch.column(c) for c in range(4)]), batch.num_rows)
            for start, stop in zip(bounds, bounds[1:]):
                part = batch.slice(start, stop - start)
                now = tuple(part.column(c)[0].as_py() for c in range(4))
                term, place, p = part.column(4), part.column(5).to_numpy().astype(np.int64), part.column(6).to_numpy()
                if now != key:
                    if heads_open:
                        places, base = np.concatenate(head_places), np.concatenate(head_rates)
                        sums = np.zeros((len(places), len(places)), np.int64)
                        heads_open = False
                    yield from closed()
                    key, heads_open, head_places, head_rates, carried, last_term, seen = now, True, [], [], None, None, 0
                head = pc.equal(term, "").to_numpy(zero_copy_only=False)
                if heads_open:
                    head_places.append(place[head])
                    head_rates.append(p[head])
                if head.all():
                    continue
                if heads_open:
                    places, base = np.concatenate(head_places), np.concatenate(head_rates)
                    sums = np.zeros((len(places), len(places)), np.int64)
                    heads_open = False
                term, place, p = term.filter(pa.array(~head)), place[~head], p[~head]
                first = _starts([term])
                number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(place))))
                if last_term is not None and term[0].as_py() != last_term:
                    number = number + 1  # the carried term is over: it is row 0, without new rates
                seen += int(number[-1]) + (carried is None)
                carried = add(number, place, p, carried)
                last_term = term[len(term) - 1].as_py()
        if heads_open:
            places, base = np.concatenate(head_places), np.concatenate(head_rates)
            sums = np.zeros((len(places), len(places)), np.int64)
        yield from closed()

    partial = dealt.select(*unit, "term", "place", "p").mapInArrow(scan, "lang string, a long, b long, value long, seen long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))


def divergence(docs: DataFrame, least: int = 30, most: int = 50, chunk: int = CHUNK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others and from the language.

    Part ``pair``: every other source and the summed differences of rates over all terms
    in at least ``least`` documents of the language.  Part ``term``: the ``most`` terms
    that the source uses most above the language's rate.  Ranks start at 1, by value
    downwards, then by the item's bytes.  The result is stored in the shared folder.
    """
    work = Scratch(docs.sparkSession)
    try:
        counted = work.stored(runs(postings(docs)))
        rates = Rates(counted, least, work)
        sums = pair_sums(rates, chunk, tile)
        one, two = (rates.sources.select("lang", F.col("place").cast("long").alias(c), F.col("source").alias(f"source_{c}"), F.col("base").alias(f"base_{c}"), *(["terms"] if c == "a" else [])) for c in ("a", "b"))
        named = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"])
        named = named.withColumn("value", F.col("value") + (F.col("terms") - F.col("seen")) * F.abs(F.col("base_a") - F.col("base_b")))
        both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
        pairs = named.select("lang", both.alias("of"), "value").select("lang", "of.source", "of.item", "value")
        terms = rates.cells.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
        top = terms.select("*", rank).where(F.col("rank") <= most)
        columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
        return stored(columns(pairs.select("*", rank), "pair").union(columns(top, "term")))
    finally:
        work.drop()
