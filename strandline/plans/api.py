"""The query API: filters, sorted pages, groups, facets and folded state as DataFrames.

Identifiers that come from outside are checked against fixed lists; values are literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import contains_folded
from strandline.operators.fold import fold_state, latest, with_age
from strandline.sources.tables import Work

EQUALS = ("session", "kind", "actor", "target", "detail", "spell", "actor_side", "target_side", "summon", "target_summon")
SEARCHED = ("kind", "actor_side", "actor", "target_side", "target", "summon", "target_summon", "detail", "spell", "raw")
SORTED = (*EQUALS, "id", "wall_clock", "game_ticks", "clock_ms", "game_time", "screen", "amount", "roll", "resisted", "critical", "saved", "raw")
GROUPED = (*EQUALS, "critical", "screen", "saved")
#: Kinds that a view of battles leaves out.
NOT_BATTLE = ("pause", "dialogue", "other", "tohit", "damageroll", "resync")
PAGE, PAGE_MOST, GROUP_MOST = 500, 5_000, 1_000_000
BACK, SPAN_MOST = 400, 5_000
#: Rows before a page from which on it is found by rank; ids counted together where a window is looked for.
DEEP, SPAN = 100_000, 1 << 16


@dataclass(frozen=True)
class Query:
    """A request: equality filters by column, kinds left out, a search text, sort keys as (column, 'asc'|'desc')."""

    equals: dict[str, str] = field(default_factory=dict)
    without_kinds: tuple[str, ...] = ()
    search: str = ""
    sort: tuple[tuple[str, str], ...] = ()
    hide_empty: bool = True


def positive(value: object, default: int, most: int | None = None) -> int:
    """A positive whole number or the default, then at most ``most``."""
    try:
        n = int(str(value))
    except ValueError:
        n = 0
    n = n if n > 0 else default
    return min(n, most) if most else n


def predicate(q: Query, omit: str | None = None, columns: tuple[str, ...] = EQUALS, searched: tuple[str, ...] = SEARCHED) -> Column:
    """All filters but that on ``omit``, as one condition; empty values are no filters."""
    terms = [F.col(c) == v for c, v in q.equals.items() if c in columns and c != omit and v != ""]
    hidden = [k.strip() for k in q.without_kinds if k.strip()]
    if hidden:  # a scope, not a choice, so it holds for the facet of kinds too
        terms.append(~F.col("kind").isin(*hidden))
    if q.search:
        terms.append(reduce(lambda a, b: a | b, [F.coalesce(contains_folded(F.col(c), q.search), F.lit(False)) for c in searched]))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def sort_keys(q: Query, allowed: tuple[str, ...] = SORTED) -> list[tuple[str, str]]:
    """At most four sort keys, allowed ones only, the first of each column."""
    seen: dict[str, str] = {}
    for column, direction in q.sort:
        if column in allowed and column not in seen:
            seen[column] = "asc" if direction.lower() == "asc" else "desc"
    return list(seen.items())[:4]


def ordering(q: Query, tie: tuple[str, ...] = ("session", "id"), allowed: tuple[str, ...] = SORTED) -> list[Column]:
    """Sort columns with nulls last either way; the end is newest first."""
    named = [F.col(c).asc_nulls_last() if d == "asc" else F.col(c).desc_nulls_last() for c, d in sort_keys(q, allowed)]
    return [*named, *[F.col(c).desc() for c in tie]]


def _present(q: Query) -> tuple[str | None, Column]:
    """The column whose nulls are hidden, and the condition."""
    keys = sort_keys(q)
    if not keys or not q.hide_empty:
        return None, F.lit(True)
    return keys[0][0], F.col(keys[0][0]).isNotNull()


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """``limit`` rows from ``offset`` on; those of a deep page are found by rank, with the same result."""
    offset = max(offset, 0)
    if offset > DEEP:
        return deep_page(df, order, limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def deep_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page by rank: rows are dealt by range and sorted, and counted by range; only ranges that meet the page are ranked.

    No task sorts or holds more than a range.  The sorted rows are written on the way, the
    page itself is stored.
    """
    work = Work(df.sparkSession)
    try:
        dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        dealt = work.stored(dealt.withColumn("_part", F.shiftright("_at", 33)))
        sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = sizes.withColumn("_before", before).where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)).drop("_n")
        rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
        rows = dealt.join(met, "_part").where((rank >= offset) & (rank < offset + limit))
        return work.kept(rows.select(*df.columns)).orderBy(*order)
    finally:
        work.drop()


def newest(events: DataFrame, limit: int, offset: int, span: int = SPAN) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` by (session, id) downwards, in no order.

    Events are counted by session and span of ids.  Only spans that meet the window are
    read again, and rows are ranked inside a span, so a window of any size and depth
    needs no sort in one place.
    """
    placed = events.withColumn("_span", F.call_function("div", F.col("id") - F.pmod("id", F.lit(span)), F.lit(span)))
    sizes = placed.groupBy("session", "_span").agg(F.count("*").alias("_n"))
    above = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sessions = sizes.groupBy("session").agg(F.sum("_n").alias("_n")).select("session", above(Window.orderBy(F.desc("session"))).alias("_ahead"))
    inside = sizes.withColumn("_inside", above(Window.partitionBy("session").orderBy(F.desc("_span"))))
    spans = inside.join(sessions, "session").select("session", "_span", "_n", (F.col("_ahead") + F.col("_inside")).alias("_before"))
    met = spans.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_n") > offset)).drop("_n")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("session", "_span").orderBy(F.desc("id")))
    ranked = placed.join(met, ["session", "_span"]).withColumn("_rank", rank)
    return ranked.where((F.col("_rank") > offset) & (F.col("_rank") <= offset + limit)).select(*events.columns)


def events_page(events: DataFrame, q: Query, limit: object = None, offset: int = 0) -> dict:
    """rows (DataFrame) and the counts that go with them."""
    empty, present = _present(q)
    n = positive(limit, PAGE, PAGE_MOST)
    matched = events.where(predicate(q))
    counts = matched.agg(F.count("*").alias("matched"), F.count_if(present).alias("total")).first()
    scope = events.where(F.col("session") == q.equals["session"]) if q.equals.get("session") else events
    return {
        "total": counts.total, "limit": n, "offset": max(offset, 0), "order_by": sort_keys(q), "hidden_empty": counts.matched - counts.total, "empty_column": empty,
        "gaps": scope.where("kind = 'resync'").count(), "rows": page(matched.where(present), ordering(q), n, offset),
    }


def group_measures() -> list[Column]:
    """The measures of a group of events."""
    damage = F.col("kind") == "damage"
    return [
        F.count("*").alias("events"),
        F.coalesce(F.sum(F.when(damage, F.col("amount"))), F.lit(0)).alias("damage"),
        F.coalesce(F.sum("resisted"), F.lit(0)).alias("resisted"),
        F.coalesce(F.sum(F.when(F.col("kind") == "xp", F.col("amount"))), F.lit(0)).alias("xp"),
        F.sum("critical").alias("crits"),
        F.coalesce(F.sum(F.when(damage & (F.col("critical") == 1), F.col("amount"))), F.lit(0)).alias("crit_damage"),
        F.count_if(F.col("kind") == "save").alias("saves"),
        F.count_if(F.col("saved") == 0).alias("failed"),
        F.min(F.when(F.col("kind") == "save", F.col("roll"))).alias("worst_save"),
    ]


def all_groups(matched: DataFrame, by: str) -> DataFrame:
    """Measures by one column over all rows given."""
    if by not in GROUPED:
        raise ValueError(f"cannot group by {by!r}")
    return matched.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("(none)")).alias("key")).agg(*group_measures())


def groups(events: DataFrame, by: str, q: Query = Query(), limit: object = None, offset: int = 0) -> dict:
    """Measures by one column over a window of the newest matching events."""
    n = positive(limit, PAGE, GROUP_MOST)
    matched = events.where(predicate(q))
    start = max(offset, 0)
    # the order of the window's rows does not matter, so a large one needs none
    window = newest(matched, n, start) if start + n > PAGE_MOST else page(matched, [F.col("session").desc(), F.col("id").desc()], n, start)
    rows = all_groups(window, by).orderBy(F.desc("events"), "key")
    total = matched.count()
    return {"by": by, "rows": rows, "matched": total, "windowed": max(0, min(n, total - max(offset, 0))), "limit": n, "offset": max(offset, 0)}


def facet(df: DataFrame, dimension: str, q: Query, present: Column | None = None) -> DataFrame:
    """key, n of a dimension under all filters but its own."""
    kept = df.where(predicate(q, omit=dimension))
    return (kept.where(present) if present is not None else kept).groupBy(F.col(dimension).alias("key")).agg(F.count("*").alias("n"))


def facets(events: DataFrame, q: Query = Query()) -> dict:
    present = _present(q)[1]
    return {"total": events.count(), "sessions": facet(events, "session", q, present).orderBy(F.desc("key")), "kinds": facet(events, "kind", q, present).orderBy(F.desc("n"), "key")}


def resolve_range(low: int, high: int, back_from: object = None, back_to: object = None) -> tuple[int, int, int, int]:
    """(from, to, first id, last id) of a range given as events back from the newest."""
    most = max(high - low, 0)

    def whole(v: object, default: int) -> int:
        try:
            return min(max(int(str(v)), 0), most)
        except ValueError:
            return min(default, most)

    a, b = sorted((whole(back_from, 0), whole(back_to, BACK)))
    b = min(b, a + SPAN_MOST)
    return a, b, high - b, high - a


def newest_session(events: DataFrame) -> str | None:
    return events.agg(F.max("session")).first()[0]


def combatants(events: DataFrame, effects: DataFrame, session: str | None = None, back_from: object = None, back_to: object = None, summons: DataFrame | None = None) -> dict:
    """Folded state of a range of a session, split by side; an unknown session is empty."""
    session = session or newest_session(events)
    scope = events.where(F.col("session") == session) if session else events.limit(0)
    bounds = scope.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
    a, b, first, last = resolve_range(bounds.low or 0, bounds.high or 0, back_from, back_to)
    rows = scope.where(F.col("id").between(first, last))
    ends = latest(rows)
    folded = with_age(fold_state(rows, effects, summons), ends).orderBy(F.desc("last_seen_id"), "first_seen")
    newest = ends.first()
    side = F.coalesce("side", F.lit("neutral"))
    return {
        "session": session, "bounds": (bounds.low, bounds.high), "from": a, "to": b, "from_id": first, "to_id": last, "session_total": bounds.n, "folded": rows.count(),
        "latest_id": newest.latest_id if newest else 0, "latest_clock_ms": newest.latest_clock_ms if newest else None,
        "opponents": folded.where(side == "opponent"), "party": folded.where(side == "party"), "neutral": folded.where(~side.isin("opponent", "party")),
    }
