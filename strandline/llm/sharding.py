"""Operator 3: sharding by a keyed permutation of global row numbers.

Rows get global numbers 0..n-1: equal rows are counted, and groups of them dealt into
hash buckets, large ones in parts; each bucket numbers its groups by id, and a running
sum over the bucket sizes gives each bucket's first number.  A Feistel network over pairs (l, r) with
l < a, r < b, a * b >= n permutes the numbers.  A value outside 0..n-1 is permuted
again until it is inside (cycle walking); at most a * b - n values are outside, so
that many steps always suffice.  Row p of the shuffle goes to shard p mod k, slot
p div k: the counts of shards differ by one at most, slots have no gaps, and both
can be computed from n, the key and the row number alone, as can the inverse.

All of it is DataFrame expressions on 64-bit integers; the text is read only for its
size and checksum and is not shuffled.

Null texts have size 1 and the checksum of no bytes.  Null ids are numbered before
others of their bucket; rows with equal ids are ordered by size and checksum, and
rows equal in all three are alike, so a count stands for them until they get their
numbers, and no id, null or not, is too frequent for a task.  An empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import crc32_text

ROUNDS = 6
#: Primes below 2**31, so products of two values below them fit 64 bits, and factors.
_STEPS = ((2147483647, 1588635695), (2147483629, 1117695901), (2147483587, 2027892911))
_ROWS_PER_BUCKET, _BUCKETS_PER_RANGE = 1 << 16, 1 << 12


def mixed(x: Column, key: int) -> Column:
    """A value below 2**31 that depends on x (x >= 0) and the key: products modulo one prime after another.

    Each step uses the value before it once, so the expression stays short.
    """
    for prime, factor in _STEPS:
        p = F.lit(prime).cast("long")
        x = F.pmod((F.pmod(x + F.lit(key % prime).cast("long"), p) + F.lit(1).cast("long")) * F.lit(factor).cast("long"), p)
    return x


def mixed_int(x: int, key: int) -> int:
    for prime, factor in _STEPS:
        x = ((x + key % prime) % prime + 1) * factor % prime
    return x


def sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n and little more."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def _keys(seed: int) -> list[int]:
    return [mixed_int(i + 1, seed) for i in range(ROUNDS)]


def feistel(p: Column, n: int, seed: int) -> Column:
    """One pass of the network over 0..a*b-1."""
    a, b = sides(n)
    left, right = F.call_function("div", p, F.lit(b).cast("long")), F.pmod(p, F.lit(b).cast("long"))
    for i, key in enumerate(_keys(seed)):
        if i % 2 == 0:
            left = F.pmod(left + mixed(right, key), F.lit(a).cast("long"))
        else:
            right = F.pmod(right + mixed(left, key), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right


def permuted(p: Column, n: int, seed: int) -> Column:
    """Place of row p in the shuffle of 0..n-1."""
    a, b = sides(n)
    once = feistel(p, n, seed)
    if a * b == n:
        return once
    top = F.lit(n).cast("long")
    walk: Callable[[Column, Column], Column] = lambda x, _: F.when(x < top, x).otherwise(feistel(x, n, seed))
    return F.when(once < top, once).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), once, walk))


def feistel_int(p: int, n: int, seed: int, back: bool = False) -> int:
    a, b = sides(n)
    left, right = divmod(p, b)
    steps = list(enumerate(_keys(seed)))
    sign = -1 if back else 1
    for i, key in reversed(steps) if back else steps:
        if i % 2 == 0:
            left = (left + sign * mixed_int(right, key)) % a
        else:
            right = (right + sign * mixed_int(left, key)) % b
    return left * b + right


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a global row number, without a table."""
    p = feistel_int(row, n, seed)
    while p >= n:
        p = feistel_int(p, n, seed)
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that ``locate`` puts there."""
    p = feistel_int(slot * shards + shard, n, seed, back=True)
    while p >= n:
        p = feistel_int(p, n, seed, back=True)
    return p


def row_numbers(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (columns that have an order, ids first), ``n`` in all, with a gapless ``row_number`` from 0."""
    order = rows.columns
    most = F.lit(_ROWS_PER_BUCKET).cast("long")
    buckets = 1 << max(5, (-(-n // _ROWS_PER_BUCKET) - 1).bit_length())
    groups = rows.groupBy(*order).agg(F.count("*").alias("_n"))
    parts = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("_n") - 1, most))))
    parts = parts.withColumn("_n", F.least(most, F.col("_n") - F.col("_part") * most)).withColumn("_bucket", F.pmod(F.xxhash64(*order, "_part"), F.lit(buckets).cast("long")))
    # sizes of buckets shrink to those of ranges of buckets before one task sums them up
    sizes = parts.groupBy("_bucket").agg(F.sum("_n").alias("_size")).withColumn("_range", F.call_function("div", F.col("_bucket"), F.lit(_BUCKETS_PER_RANGE).cast("long")))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("_range").agg(F.sum("_size").alias("_size")).select("_range", before("_size", Window.orderBy("_range")).alias("_start"))
    firsts = sizes.withColumn("_inside", before("_size", Window.partitionBy("_range").orderBy("_bucket"))).join(ranges, "_range").select("_bucket", (F.col("_start") + F.col("_inside")).alias("_first"))
    own = Window.partitionBy("_bucket").orderBy(*[F.asc_nulls_first(c) for c in order], "_part")
    numbered = parts.withColumn("_at", before("_n", own)).join(firsts, "_bucket")
    return numbered.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select(*order, (F.col("_first") + F.col("_at") + F.col("_i")).alias("row_number"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, row_number, position, shard and slot of each row, dealt by the law of equal counts."""
    n = docs.select("doc_id").count()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(1)).alias("size"),
        crc32_text(F.col("text")).alias("text_crc32"),
    )
    placed = row_numbers(rows, n).withColumn("position", permuted(F.col("row_number"), n, seed))
    k = F.lit(shards).cast("long")
    return placed.select("doc_id", "size", "text_crc32", "row_number", "position", F.pmod("position", k).cast("int").alias("shard"), F.call_function("div", F.col("position"), k).alias("slot"))
