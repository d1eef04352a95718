"""Operator 2: n-gram Jaccard join and near-duplicate classes.

A document's set holds the hashes of its distinct word shingles.  Two sets link when
``100 * intersection >= percent * union``.  Equal sets are one set from the start.

Keys.  The hashes of a set in order give an order that all sets share.  Linked sets have
so many shingles in common that f + 1 of these at least are among the first of both, if
the first n - ceil(percent * n / 100) + f + 1 are taken of a set of n: these are its keys.

Tiles.  Sizes are cut into bands; a tile holds the sets of a band and those of the band
below that can reach it, so sets of one key meet only where their sizes allow a link.

Frequent keys.  How many sets have a key is counted over all of them.  In each tile a
set leaves out its most frequent keys, those above its own bound, at most f of them.
Linked sets share f + 1 keys, and both go by the same counts, so all of these that
either leaves out are left out by the one with the lower bound: one key stays on both
sides.  Thus passages that many documents share bring few sets together, and a set that
shares f keys or fewer with all others meets none.

Rounds.  Keys are dealt by range of (key, set), so a key of any frequency spreads over
tasks.  First each set is compared with the first set of its key.  Keys whose sets are
now all in one class are done; that takes care of large groups of copies in a linear
number of comparisons.  Sets of the other keys are compared in blocks: first, under few
keys, with the closest few of other classes, then with whatever is left.  A key that leaves more pairs
than it has sets sends its sets themselves to the blocks, which are compared there, and
only a spanning forest of their links comes back.  No pair that may link is left out.

Numbers of links are worked out on request only: they need all pairs of a class, not
only those that connect it.  Its sets are compared exactly in blocks, of which only the
counts leave a task.

Each comparison bounds the overlap from above by bit counts: a signature holds the
parity of the set's hashes in each position, and two signatures differ in no more bits
than the sets do in shingles.  Only pairs that pass are intersected exactly, as sorted
arrays (of 64-bit hashes, which stand for the shingles throughout).

Null, empty and blank texts have an empty set and link with nothing; with fewer words
than a shingle needs, the whole sequence is one shingle.  Rows with equal ids are
separate rows of one class name.  Rows with a null id link like others and get the
smallest id of their class, null if it has none.  An empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import ASCII_LOWER, NOT_BLANK, ROW_KEY, Scratch, Words, by_bytes, byte_view, chain, hash_filter, mix64, row_key, stored, text_column, without_rows
from strandline.llm.graph import components

BATCH_BYTES = 1 << 22
#: Bytes of text hashed at once, within a batch.
HASH_BYTES = 1 << 20
BLOCK = 1024
#: With how many of the closest sets of other classes a set is compared before the last round, and under how many of its keys in each round.
CLOSEST, CLOSEST_KEYS = 2, (2, 6)
#: Most shingles in a block of sets that are compared exactly, and how many of them are compared at once.
BLOCK_SHINGLES = 1 << 20
COLUMNS = 4096


# --- sets -------------------------------------------------------------------


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    parts = by_bytes([pa.RecordBatch.from_arrays([texts], ["text"])], HASH_BYTES)
    return [s for part in parts for s in _sets_of(part.column(0), k)]


def _sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    data, offsets = byte_view(texts)
    words = Words(data, offsets, NOT_BLANK, ASCII_LOWER)
    at, hashes = words.windows(k)
    cuts = np.searchsorted(words.doc[at], np.arange(len(texts) + 1))
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]
    first = np.searchsorted(words.doc, np.arange(len(texts) + 1))
    counts = np.diff(first)
    for n in range(1, k):
        for d in np.flatnonzero(counts == n):
            out[d] = chain([words.hash[first[d] + i : first[d] + i + 1] for i in range(n)]) + np.uint64(n)
    return out


# --- tiles ------------------------------------------------------------------


def least_overlap(total: int, percent: int) -> int:
    """Smallest intersection of linked sets whose sizes add up to ``total``."""
    return -(-percent * total // (100 + percent))


@lru_cache(maxsize=16)
def bands(percent: int) -> list[tuple[int, int]]:
    """First and last size of each band; every band is at least as wide as a link can reach."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low * 100 // percent, low * 100 // 65, low)
        out.append((low, high))
        low = high + 1
    return out


def spare(tile: int, percent: int) -> int:
    """How many of its most frequent keys a set may leave out in a tile; linked sets there share more shingles than that."""
    return bands(percent)[tile][0] // 8


@lru_cache(maxsize=1 << 16)
def key_range(size: int, percent: int) -> tuple[int, bool, int, int]:
    """Own tile of a set, whether it is in the next one too, and how many keys it has in the own and in the next tile."""
    ladder = bands(percent)
    own = int(np.searchsorted([b[0] for b in ladder], size, side="right")) - 1
    reach = size * 100 // percent >= ladder[own + 1][0]
    base = size + percent * -size // 100 + 1
    near, far = (min(size, base + spare(t, percent)) for t in (own, own + 1))
    return own, reach, near, far if reach else near


def signature(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Parities of the hashes in 2**i positions, at least sixteen for each shingle that may differ."""
    n = len(hashes)
    d = max(2 * n - 2 * least_overlap(2 * n, percent), 1)
    bits = max(64, 1 << (16 * d - 1).bit_length())
    at = mix64(hashes, 104) & np.uint64(bits - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows) brought down to ``width`` words; parities of positions that meet add up."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _digests(s: np.ndarray) -> tuple[int, int]:
    return tuple(int(mix64(s, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (105, 106))


def described(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The row key, n, h1, h2 of each document's set (its size and two digests that name it), its signature and keys.

    Signature and keys come once for each set of an Arrow batch, and never for empty sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            sets = shingle_sets(text_column(batch), k)
            h = [_digests(s) for s in sets]
            new = {d: i for i, d in reversed(list(enumerate(h))) if len(sets[i])}
            bits, keys = [None] * len(h), [None] * len(h)
            for i in new.values():
                bits[i] = signature(sets[i], percent).tobytes()
                keys[i] = sets[i][: key_range(len(sets[i]), percent)[3]].tobytes()
            columns = [batch.column(1), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in h], pa.int64()), pa.array([d[1] for d in h], pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*ROW_KEY, "n", "h1", "h2", "bits", "keys"])

    schema = ", ".join(f"{c} long" for c in (*ROW_KEY, "n", "h1", "h2")) + ", bits binary, keys binary"
    return docs.select("text", *row_key()).mapInArrow(run, schema)


def distinct_sets(named: DataFrame) -> DataFrame:
    """id (first digest), h2, doc (smallest id), text (hash of one text), n, bits of each distinct set that is not empty."""
    own = [F.min(ROW_KEY[0]).alias("doc"), F.min(ROW_KEY[1]).alias("text"), F.first("n").alias("n"), F.first("bits", True).alias("bits")]
    return named.where("n > 0").groupBy(F.col("h1").alias("id"), "h2").agg(*own)


def keyed_sets(named: DataFrame, percent: int) -> DataFrame:
    """key, id, kind of every key of every set; kind is 4 * own tile + 2 * (next tile too) + (next tile only).

    Equal sets come as often as there are Arrow batches that hold them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                own, reach, near, far = np.array([key_range(n, percent) for n in part.column(1).to_pylist()], dtype=np.int64).reshape(-1, 4).T
                place = np.arange(far.sum()) - np.repeat(np.cumsum(far) - far, far)
                kind = np.repeat(4 * own + 2 * reach, far) + (place >= np.repeat(near, far))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(part.column(0).to_numpy(), far)), pa.array(kind.astype(np.int32))], ["key", "id", "kind"])

    return named.where("keys is not null").select("h1", "n", "keys").mapInArrow(run, "key long, id long, kind int")


# --- candidates -------------------------------------------------------------


def key_runs(keyed: DataFrame) -> DataFrame:
    """key, id, kind, c for keys that several sets have; c is their number.

    Where the run of a key may go on in another partition, c is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        first, flowing = True, None  # the key of which a part has been given out

        def made(rows: list[np.ndarray], last: bool) -> pa.RecordBatch:
            nonlocal first
            key = rows[0]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            open_ = np.zeros(len(starts), dtype=bool)
            open_[0] = first or key[0] == flowing
            open_[-1] |= last
            first = False
            kept = np.repeat((sizes > 1) | open_, sizes)
            counts = pa.array(np.repeat(sizes, sizes)[kept], mask=np.repeat(open_, sizes)[kept])
            return pa.RecordBatch.from_arrays([*[pa.array(c[kept]) for c in rows], counts], ["key", "id", "kind", "c"])

        for batch in _with_end(batches):
            now = [c.to_numpy() for c in batch.columns] if batch is not None else None
            rows = held if now is None else now if held is None else [np.concatenate(c) for c in zip(held, now)]
            if rows is None or not len(rows[0]):
                continue
            new = np.ones(len(rows[0]), dtype=bool)  # a set that several batches held counts once
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [c[new] for c in rows]
            if batch is None:
                yield made(rows, True)
                continue
            begin = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on in the next batch
            if begin == 0 and len(rows[0]) > 1 << 16:  # a long run goes out in parts
                yield made([c[:-1] for c in rows], True)
                flowing, begin = rows[0][-1], len(rows[0]) - 1
            elif begin:
                yield made([c[:begin] for c in rows], False)
            held = [c[begin:] for c in rows]

    spread = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return spread.mapInArrow(run, "key long, id long, kind int, c long")


def rare_keys(runs: DataFrame, percent: int) -> DataFrame:
    """key (with its tile), id: the keys that each set keeps, without its most frequent ones."""
    open_ = runs.where("c is null").drop("c")
    totals = open_.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    counted = runs.where("c is not null").select("id", "kind", "key", "c").union(open_.join(totals, "key").select("id", "kind", "key", "c"))
    own = F.call_function("div", F.col("kind"), F.lit(4)).cast("int")
    last = F.col("kind") % 4
    tiles = F.when(last == 0, F.array(own)).when(last == 2, F.array(own, own + 1)).otherwise(F.array(own + 1))
    ranked = counted.select("id", F.explode(tiles).alias("tile"), "key", "c").groupBy("id", "tile").agg(F.sort_array(F.collect_list(F.struct("c", "key")), asc=False).alias("keys"))
    # a key that no other set has is rarer than all of these, so where no more are shared than may be left out none stays
    most = F.array(*[F.lit(spare(t, percent)).cast("long") for t in range(len(bands(percent)))])[F.col("tile")]
    some = ranked.withColumn("most", most).where(F.size("keys") > F.col("most")).withColumn("bound", F.element_at("keys", (F.col("most") + 1).cast("int"))["c"])
    return some.select(F.explode(F.transform(F.filter("keys", lambda k: k["c"] <= F.col("bound")), lambda k: F.xxhash64(k["key"], F.col("tile")))).alias("key"), "id")


def with_pivots(kept: DataFrame) -> DataFrame:
    """key, id, pivot of keys that several sets keep; ``pivot`` is the first of them."""
    pivots = kept.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", "pivot")
    return kept.join(pivots, "key").select("key", "id", "pivot")


def first_pairs(kept: DataFrame) -> DataFrame:
    """Each set with the first set of each of its keys."""
    return kept.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()


def _may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    total = na + nb
    return differ <= total - 2 * -(-percent * total // (100 + percent))


def passing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            width = np.array([min(len(x), len(y)) // 8 for x, y in zip(left, right)], dtype=np.int64)
            differ = np.zeros(len(a), dtype=np.int64)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                x = [folded(np.frombuffer(left[r], np.uint64)[None, :], w)[0] for r in rows]
                y = [folded(np.frombuffer(right[r], np.uint64)[None, :], w)[0] for r in rows]
                differ[rows] = np.bitwise_count(np.array(x) ^ np.array(y)).sum(axis=1, dtype=np.int64)
            keep = _may_link(na, nb, differ, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    joined = pairs.join(one, "a").join(two, "b").where(near)
    return joined.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def mixed_keys(kept: DataFrame, classes: DataFrame) -> DataFrame:
    """key, id, class, c of keys whose c sets are in several classes; of keys with the same sets one stays."""
    placed = kept.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    sets = placed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (0, 1)])
    one = sets.where("lo != hi").groupBy("c", "x0", "x1").agg(F.min("key").alias("key"))
    return placed.join(one.select("key", "c"), "key").select("key", "id", "class", "c")


def few_keys(mixed: DataFrame, most: int) -> DataFrame:
    """The rarest keys of each set, at most ``most``; sets that share several meet under few of them."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("c", "key"))
    return mixed.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def in_blocks(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """``rows`` of each group dealt into ``blocks`` blocks and copied to each pair (i, j) of blocks they take part in."""
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "id")


def block_pairs(mixed: DataFrame, sets: DataFrame, percent: int, closest: int | None, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of sets of different classes that share a key and whose signatures allow a link.

    ``closest``: at most so many for a set in a block, those with the nearest signatures.
    None: all, but a block with more pairs than sets gives only its key (``dense``).
    """
    blocks = F.ceil(F.col("c") / F.lit(block)).cast("int")
    dealt = in_blocks(mixed.join(sets.select("id", "n", "bits"), "id"), "key", blocks)
    names = ["a", "b", "dense"]

    def compare(own: np.ndarray, ids: np.ndarray, group: np.ndarray, n: np.ndarray, bits: list[bytes], edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows (x, y), those that may link."""
        ok = (group[x] != group[y]) & (ids[x] != ids[y]) & (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent) & (edge[x] | (own[x] != own[y]))
        x, y = x[ok], y[ok]
        size = np.array([len(b) // 8 for b in bits], dtype=np.int64)
        width = np.minimum(size[x], size[y])
        differ = np.zeros(len(x), dtype=np.int64)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            used = np.unique(np.concatenate([x[at], y[at]]))
            table = np.array([folded(np.frombuffer(bits[r], np.uint64)[None, :], w)[0] for r in used])
            px, py = np.searchsorted(used, x[at]), np.searchsorted(used, y[at])
            for c in range(int(w)):
                differ[at] += np.bitwise_count(table[px, c] ^ table[py, c])
        keep = _may_link(n[x], n[y], differ, percent)
        x, y, differ = x[keep], y[keep], differ[keep]
        if closest is not None and len(x):
            x, y, differ = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([differ, differ])
            order = np.lexsort((ids[y], differ, ids[x]))
            x, y = x[order], y[order]
            new = np.ones(len(x), dtype=bool)
            new[1:] = ids[x][1:] != ids[x][:-1]
            rank = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            x, y = x[rank < closest], y[rank < closest]
        return x, y

    def given(ids: np.ndarray, x: np.ndarray, y: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
        a, b = np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        nothing = pa.nulls(len(dense), pa.int64())
        left = [pa.concat_arrays([pa.array(pairs[:, c]), nothing]) for c in range(2)]
        return pa.RecordBatch.from_arrays([*left, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(dense)])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            part = pa.Table.from_batches([batch]) if batch is not None else None
            now = part if held is None else held if part is None else pa.concat_tables([held, part])
            if now is None or not now.num_rows:
                continue
            tile = np.stack([now.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            new = np.ones(len(tile), dtype=bool)
            new[1:] = (tile[1:] != tile[:-1]).any(axis=1)
            starts = np.flatnonzero(new)
            stop = int(starts[-1]) if batch is not None else len(tile)  # the last tile may go on
            held = now.slice(stop) if batch is not None else None
            if not stop:
                continue
            ids, group, n, own = (now.column(c).to_numpy()[:stop] for c in ("id", "class", "n", "own"))
            bits = now.column("bits").slice(0, stop).to_pylist()
            edge = tile[:stop, 1] == tile[:stop, 2]
            starts = starts[starts < stop]
            sizes = np.diff(np.append(starts, stop))
            unit = np.repeat(np.arange(len(starts)), sizes)
            left = sizes[unit] - (np.arange(stop) - starts[unit])  # rows of the tile from this one on
            passed = np.zeros(len(starts), dtype=np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            x, y, gathered, widest = [], [], 0, int(sizes.max())
            for d in range(1, widest + 1):
                if d < widest:
                    at = np.flatnonzero(left > d)
                    x.append(at)
                    y.append(at + d)
                    gathered += len(at)
                if gathered > 1 << 20 or gathered and d == widest:
                    p, q = compare(own, ids, group, n, bits, edge, np.concatenate(x), np.concatenate(y))
                    if closest is None:
                        passed += np.bincount(unit[p], minlength=len(starts))
                        found = [(u[f], v[f]) for u, v in [*found, (p, q)] if (f := passed[unit[u]] <= sizes[unit[u]]).any()]
                    elif len(p):
                        yield given(ids, p, q, np.zeros(0, np.int64))
                    x, y, gathered = [], [], 0
            if closest is None:
                p, q = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
                yield given(ids, p, q, np.unique(tile[starts[passed > sizes], 0]))

    return dealt.mapInArrow(run, "a long, b long, dense long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


# --- exact comparison -------------------------------------------------------


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def needed_sets(kept: DataFrame, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """id, set of every set that shares a key, built again from one text each.

    Texts are filtered in the scan by a bitset of bounded size and then joined exactly.
    """
    wanted = sets.select("id", "text").join(kept.select("id").distinct(), "id", "left_semi")
    spread = hash_filter(wanted.select("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = spread.value.hits(batch.column(1).to_numpy())
            for part in by_bytes([batch.filter(pa.array(hit))], BATCH_BYTES):
                found = {_digests(s)[0]: s for s in shingle_sets(text_column(part), k)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["id", "set"])

    built = docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(build, "id long, set binary")
    return built.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def linked(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact intersection makes a link; ``found`` has the sets (id, set)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(s, t)
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = found.select(F.col("id").alias("a"), F.col("set").alias("s")), found.select(F.col("id").alias("b"), F.col("set").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "s", "t").mapInArrow(check, "a long, b long")


# --- numbers of links ---------------------------------------------------------


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if len(left) * len(right) <= 16:
        for i, s in enumerate(left):
            out[i] = [overlap(s, t) for t in right]
        return out
    of = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    values = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*values)
    keep = [np.isin(v, both) for v in values]
    at = [np.searchsorted(both, v[k]) for v, k in zip(values, keep)]
    of = [o[k] for o, k in zip(of, keep)]
    order = [np.argsort(a, kind="stable") for a in at]
    at, of = [a[o] for a, o in zip(at, order)], [x[o] for x, o in zip(of, order)]
    for start in range(0, len(both), COLUMNS):
        held = []
        for side, a, o in zip((left, right), at, of):
            low, high = np.searchsorted(a, [start, start + COLUMNS])
            m = np.zeros((len(side), min(COLUMNS, len(both) - start)), dtype=np.float32)
            m[o[low:high], a[low:high] - start] = 1
            held.append(m)
        out += (held[0] @ held[1].T).astype(np.int64)
    return out


def exact_blocks(members: DataFrame, percent: int, block: int, answer: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Compares all sets of a group (group, id, weight, set) exactly, in blocks of bounded size.

    ``answer`` gets ids and weights of both sides of a pair of blocks, the matrix of their
    links, and whether the sides are one block; its rows have the columns of ``schema``.
    """
    shingles = F.octet_length("set") / 8
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum(shingles) / F.lit(BLOCK_SHINGLES))).cast("int")
    sized = members.groupBy("group").agg(F.count("*").alias("c"), blocks.alias("n_blocks")).where("c > 1").select("group", "n_blocks")
    dealt = in_blocks(members.join(sized, "group"), "group", F.col("n_blocks")).select("group", "i", "j", "own", "id", "weight", "set")
    names = [f.split()[0] for f in schema.split(", ")]

    def compared(unit: tuple, held: list[tuple]) -> list[tuple]:
        sides = [[r for r in held if r[0] == own] for own in dict.fromkeys(unit[1:])]
        if len(sides) == 2 and not (sides[0] and sides[1]):
            return []
        left, right = sides[0], sides[-1]
        sets = [[np.frombuffer(r[3].as_buffer(), np.uint64) for r in side] for side in (left, right)]
        both = _overlaps(*sets)
        total = np.array([len(x) for x in sets[0]])[:, None] + np.array([len(x) for x in sets[1]])[None, :]
        links = 100 * both >= percent * (total - both)
        if len(sides) == 1:
            np.fill_diagonal(links, False)
        ids, weights = ([[r[c] for r in side] for side in (left, right)] for c in (1, 2))
        return answer(ids, weights, links, len(sides) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []
        for batch in _with_end(batches):
            done = []
            if batch is not None:
                group, i, j, own, ids, weight = (batch.column(c).to_pylist() for c in range(6))
                for now, *row in zip(zip(group, i, j), own, ids, weight, batch.column(6)):
                    if now != unit:
                        done += compared(unit, held) if held else []
                        unit, held = now, []
                    held.append(tuple(row))
            elif held:
                done += compared(unit, held)
            yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], pa.int64()) for c in range(len(names))], names)

    return dealt.mapInArrow(run, schema)


def link_counts(classes: DataFrame, found: DataFrame, copies: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """id, linked: with how many documents of other sets each set of a class links; all links are inside classes."""

    def counted(ids: list, weights: list, links: np.ndarray, same: bool) -> list[tuple]:
        out = list(zip(ids[0], (links @ np.array(weights[1])).tolist()))
        return out if same else out + list(zip(ids[1], (np.array(weights[0]) @ links).tolist()))

    members = classes.withColumnRenamed("class", "group").join(found, "id").join(copies, "id").withColumnRenamed("copies", "weight")
    return exact_blocks(members, percent, block, counted, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def link_forests(keys: DataFrame, kept: DataFrame, found: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect whatever the links between the sets of a key connect, for all ``keys``."""

    def forest(ids: list, weights: list, links: np.ndarray, same: bool) -> list[tuple]:
        if not same:
            names, n = ids[0] + ids[1], len(ids[0])
            near = np.zeros((len(names), len(names)), dtype=bool)
            near[:n, n:], near[n:, :n] = links, links.T
        else:
            names, near = ids[0], links
        fresh, out = np.ones(len(names), dtype=bool), []
        for root in range(len(names)):
            stack = [root] if fresh[root] else []
            fresh[root] = False
            while stack:
                at = stack.pop()
                found = np.flatnonzero(near[at] & fresh)
                fresh[found] = False
                stack += found.tolist()
                out += [(names[at], names[x]) for x in found]
        return out

    members = kept.join(keys, "key").select(F.col("key").alias("group"), "id", F.lit(1).cast("long").alias("weight")).join(found, "id")
    return exact_blocks(members, percent, block, forest, "a long, b long").distinct()


# --- the join ---------------------------------------------------------------


@dataclass
class Found:
    """Rows with their sets (named), distinct sets, what was compared exactly (found), and class of each set that has links."""

    named: DataFrame
    sets: DataFrame
    found: DataFrame
    classes: DataFrame


def linked_classes(docs: DataFrame, k: int, percent: int, block: int, work: Scratch) -> Found:
    """The classes of linked sets; their tables are in ``work``."""
    first = Scratch(docs.sparkSession)
    try:
        whole = first.stored(described(docs, k, percent), codec="none")
        sets = work.stored(distinct_sets(whole), codec="none")
        runs = work.stored(key_runs(keyed_sets(whole, percent)))
        named = work.stored(whole.select(*ROW_KEY, "n", "h1", "h2"))
    finally:
        first.drop()
    kept = work.stored(with_pivots(work.stored(rare_keys(runs, percent))))
    tested = work.stored(passing(first_pairs(kept), sets, percent))
    found = work.stored(needed_sets(kept, docs, sets, k), codec="none")
    links = work.stored(linked(tested, found, percent))
    classes = work.stored(components(links, work.stored).withColumnRenamed("component", "class"))
    for keys in (*CLOSEST_KEYS, None):
        closest, mixed = (CLOSEST, few_keys(mixed_keys(kept, classes), keys)) if keys else (None, mixed_keys(kept, classes))
        pairs = work.stored(block_pairs(mixed, sets, percent, closest, block).distinct())
        fresh = pairs.where("dense is null").select("a", "b").join(_ordered(tested), ["a", "b"], "left_anti")
        dense = pairs.where("dense is not null").select(F.col("dense").alias("key")).distinct()
        if pairs.isEmpty():
            continue
        more = linked(fresh, found, percent)
        if closest is None and not dense.isEmpty():
            more = more.union(link_forests(dense, kept, found, percent, block))
        more = work.stored(more)
        tested = tested.union(fresh)
        if not more.isEmpty():
            classes = work.stored(_merged(classes, more, work.stored))
    return Found(named, sets, found, classes)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK, links: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id of the class).

    With ``links`` also ``n_links``, the number of other documents that the document
    links with, those with an equal set among them; that takes all pairs of a class.
    The result is stored in the shared folder.
    """
    work = Scratch(docs.sparkSession)
    try:
        got = linked_classes(docs, k, percent, block, work)
        reached = got.sets.select("id", "h2", "doc").join(got.classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
        smallest = reached.groupBy("class").agg(F.min("doc").alias("component_id"))
        labels, told = reached.join(smallest, "class"), ["component_id"]
        if links:
            copies = got.named.where("n > 0").groupBy(F.col("h1").alias("id"), "h2").agg(F.count("*").alias("copies"))
            linked_to = link_counts(got.classes, got.found, copies.select("id", "copies"), percent, block)
            labels = labels.join(copies, ["id", "h2"]).join(linked_to, "id", "left").withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1)
            told.append("n_links")
        rows = got.named.select(F.col(ROW_KEY[0]).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("h1").alias("id"), "h2")
        out = rows.where("n_shingles > 0").join(labels.select("id", "h2", *told), ["id", "h2"]).select("doc_id", "n_shingles", *told)
        alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in told[1:]])
        return stored(out.union(alone))
    finally:
        work.drop()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _merged(classes: DataFrame, links: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Classes after more links between their members."""
    for side in ("a", "b"):
        of = classes.select(F.col("id").alias(side), F.col("class").alias(f"class_{side}"))
        links = links.join(of, side, "left").withColumn(f"class_{side}", F.coalesce(f"class_{side}", side))
    joined = components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), store).withColumnRenamed("id", "class")
    alone = joined.select(F.col("class").alias("id"), "class")  # sets that were no class of several before
    every = classes.union(alone).distinct()
    return every.join(joined, "class", "left").select("id", F.coalesce("component", "class").alias("class"))


def copies_to_drop(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Marks for ``without_rows``: all rows of each class but that with the smallest id, and all but one of rows equal to it.

    Null ids come last; rows with one id go by a hash of their text.
    """
    work = Scratch(docs.sparkSession)
    try:
        got = linked_classes(docs, k, percent, block, work)
        rows = got.named.where("n > 0").select(*ROW_KEY, F.col("h1").alias("id")).join(got.classes, "id", "left")
        each = rows.groupBy(F.coalesce("class", "id").alias("class"), *ROW_KEY).agg(F.count("*").alias("rows"))
        order = F.struct(F.col(ROW_KEY[0]).isNull().alias("last"), *ROW_KEY)
        stays = each.groupBy("class").agg(F.min(order).alias("stays"), F.sum("rows").alias("all")).where("all > 1").select("class", "stays")
        marks = each.join(stays, "class").withColumn("_row_once", F.col("stays").eqNullSafe(order))
        return stored(marks.where("not _row_once or rows > 1").select(*ROW_KEY, "_row_once"))
    finally:
        work.drop()


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id; rows without words all stay."""
    return without_rows(docs, copies_to_drop(docs, k, percent))
