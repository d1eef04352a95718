"""Connected components of a graph given as a DataFrame of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, store: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """``id`` and the smallest id reachable from it, for all ids of ``links`` (a, b: long).

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing
    changes.  Smallest neighbours are aggregated before they are shuffled, and joins on
    them can be split where an id has very many neighbours.  Each round is written to
    the shared folder by ``store``, so a lost executor costs one round.
    """
    edges = store(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m")).select("at", F.least("at", "m").alias("m"))
        # large star: neighbours above a node point at the smallest node around it
        large = edges.join(least, edges["b"] == least["at"]).where("a != m").select("a", F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below point at the smallest of those
        low = large.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m"))
        small = large.join(low, large["a"] == low["at"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = store(small.union(low.select(F.col("at").alias("a"), F.col("m").alias("b"))).distinct())
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots.select("id", F.col("id").alias("component")))
