"""Substring search through a table of trigrams.

Events are laid out by session and block of spans of ids, sorted by span.  Beside them stands, for each run of
three characters that occurs in a searched column, in which spans it does.  A pattern's
pieces between wildcards give its trigrams; only blocks with spans that have all of them
are read, and in those spans the exact comparison decides.  A pattern without a piece of three characters
reads everything.
"""

from __future__ import annotations

import re
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import contains_folded
from strandline.plans.api import SEARCHED

SPAN = 1 << 12
PLACE = ["session", "block", "span"]
#: Ids whose spans share a folder, so that folders do not become as many as spans.
BLOCK = 1 << 18


def with_span(events: DataFrame, span: int = SPAN) -> DataFrame:
    return events.withColumn("span", F.call_function("div", F.col("id") - F.pmod("id", F.lit(span)), F.lit(span)))


def lay_out(events: DataFrame, path: str, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """Write events by session and block of spans, and read them back; a block is one folder, which a search reads or leaves out."""
    ids = max(span, block)
    placed = with_span(events, span).withColumn("block", F.call_function("div", F.col("id") - F.pmod("id", F.lit(ids)), F.lit(ids)))
    placed.repartition("session", "block").sortWithinPartitions("session", "block", "span", "id").write.partitionBy("session", "block").parquet(path)
    return events.sparkSession.read.schema(placed.schema).parquet(path)


def _trigrams(text: Column) -> Column:
    folded = F.translate(text, ascii_uppercase, ascii_lowercase)
    at = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2))
    return F.array_distinct(F.transform(at, lambda i: F.substring(folded, i, F.lit(3))))


def postings(events: DataFrame, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """gram, session, block, span of laid out events, once each; each column's distinct texts of a span are cut up once.

    Texts are dealt by span, so grams need no deal of their own.
    """
    text = F.explode(F.array_distinct(F.array(*[F.col(c) for c in columns])))
    texts = events.select(*PLACE, text.alias("text")).where("text is not null").repartition(*PLACE).distinct()
    return texts.select(*PLACE, F.explode(_trigrams(F.col("text"))).alias("gram")).distinct().select("gram", *PLACE)


def grams_of(pattern: str) -> set[str]:
    """Trigrams that every text with the pattern has; % and _ are wildcards."""
    folded = pattern.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return {piece[i : i + 3] for piece in re.split("[%_]", folded) for i in range(len(piece) - 2)}


def candidates(posted: DataFrame, pattern: str) -> DataFrame | None:
    """session, block, span of the spans that have all trigrams of the pattern; None where it has none."""
    grams = grams_of(pattern)
    if not grams:
        return None
    met = posted.where(F.col("gram").isin(*sorted(grams))).groupBy(*PLACE).agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(grams)).select(*PLACE)


def search(events: DataFrame, posted: DataFrame, pattern: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Laid out events that have the pattern in any of the columns, without regard to the case of A-Z."""
    spans = candidates(posted, pattern)
    near = events if spans is None else events.join(spans, PLACE, "left_semi")
    return near.where(reduce(lambda a, b: a | b, [F.coalesce(contains_folded(F.col(c), pattern), F.lit(False)) for c in columns]))
