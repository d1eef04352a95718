"""Helpers of a table view: sort chains, natural order, blank columns, scope text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_KEYS = 4
Chain = list[tuple[str, str]]


def press(chain: Chain, column: str) -> Chain:
    """The chain after a press on a column's head.

    A new column leads, ascending; one further back comes to the front as it is; the
    leading one turns to descending, then leaves.
    """
    held = dict(chain)
    if column not in held:
        return [(column, "asc"), *chain][:MOST_KEYS]
    rest = [p for p in chain if p[0] != column]
    if chain[0][0] != column:
        return [(column, held[column]), *rest]
    return [(column, "desc"), *rest] if held[column] == "asc" else rest


#: Digits that numbers inside a text are filled up to.
_DIGITS = 24


def natural(c: Column) -> Column:
    """A sort key under which texts go by the rules of languages and numbers inside them by value.

    Numbers are filled up with zeros; the collation puts accents and case last, as a
    locale's comparison does, so "a" < "A" < "á" < "b".  Longer numbers than the fill go
    by their digits.
    """
    padded = F.transform(F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), 1), lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, F.greatest(F.lit(_DIGITS), F.length(p)), "0")).otherwise(p))
    return F.collate(F.array_join(padded, ""), "UNICODE")


def sorted_groups(rows: DataFrame, chain: Chain) -> DataFrame:
    """Rows by a chain; empty values last either way, texts in natural order."""
    order = []
    for column, direction in chain:
        text = dict(rows.dtypes)[column] == "string"
        value = F.col(column)
        empty = value.isNull() | (value == "") if text else value.isNull()
        key = natural(value) if text else value
        order += [empty.asc(), key.asc() if direction == "asc" else key.desc()]
    return rows.orderBy(*order) if order else rows


def shown_columns(rows: DataFrame, always: tuple[str, ...] = ("id", "kind", "raw")) -> list[str]:
    """Columns that are not blank in all rows, and those always shown."""
    found = rows.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in rows.columns]).first()
    return [c for c in rows.columns if found[c] or c in always]


def scope_text(matched: int, windowed: int, offset: int) -> str:
    """What part of the matching events a view counts."""
    if matched == 0:
        return "no events match"
    if windowed == 0:
        return f"no events after the first {offset} of {matched}"
    if windowed == matched:
        return f"all {matched} matching events"
    if offset == 0:
        return f"the newest {windowed} of {matched} matching events"
    return f"events {offset + 1} to {offset + windowed} of {matched}"

