"""Causal links between events, by order and id distance, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL_WITHIN, SPELL_WITHIN, TARGET_WITHIN = 10, 60, 12
#: Damage types that a spell explains.
SPELL_DAMAGE = ("magic",)


#: Ids of a range that one task links; an actor's rows are spread over as many tasks as they have ranges.
RANGE = 4096
#: Kinds of rows that later rows link with.
_ACTS = ("critical", "damage", "spell", "attack")


def _ranged(events: DataFrame, reach: int, size: int) -> DataFrame:
    """Rows with the range of their id; acts within ``reach`` of a range's end come in the next one too, where ``_own`` is false."""
    ids = max(size, reach)
    # the quotient is rounded down, for ids below zero too
    own = F.call_function("div", F.col("id") - F.pmod("id", F.lit(ids)), F.lit(ids))
    near = F.col("actor").isNotNull() & F.col("kind").isin(*_ACTS) & (F.pmod("id", F.lit(ids)) >= ids - reach)
    placed = events.withColumn("_at", own)
    both = F.when(near, F.array("_at", F.col("_at") + 1)).otherwise(F.array("_at"))
    return placed.withColumn("_range", F.explode(both)).withColumn("_own", F.col("_range").eqNullSafe(F.col("_at"))).drop("_at")


def link_events(events: DataFrame, spell_damage: tuple[str, ...] = SPELL_DAMAGE, critical_within: int = CRITICAL_WITHIN, spell_within: int = SPELL_WITHIN, target_within: int = TARGET_WITHIN, size: int | None = RANGE) -> DataFrame:
    """Adds critical, spell, spell_candidate and fills the target of probes.

    * a critical hit marks the next damage of its actor, which uses it up;
    * the actor's last spell is the candidate of its damage, and its spell where the
      damage type is one that spells deal;
    * a probe without a target takes that of its actor's last attack.

    All links share one window: one shuffle by (session, actor, range of ids), one sort
    by order.  No link reaches further back than the largest of the three distances, so a
    range sees the acts of the one before that are so near its own start, the damage that
    uses up a critical hit among them; an actor with any number of rows spreads over
    tasks.  Ranges rest on ids that rise along a session, as those of a log do; with
    ``size`` None there are no ranges, and ids may fall.  Rows without an actor go the
    same way, so that what makes the events is done once, and link with nothing.
    """
    if size is None:
        # rows without an actor need no place of their own, so they are spread in any case
        spread = events.withColumn("_range", F.when(F.col("actor").isNull(), F.call_function("div", "id", F.lit(RANGE))).otherwise(F.lit(0))).withColumn("_own", F.lit(True))
    else:
        spread = _ranged(events, max(critical_within, spell_within, target_within), size)
    before = Window.partitionBy("session", "actor", "_range").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)

    def last(when: Column, value: str | Column = "id") -> Column:
        return F.last(F.when(when, value if isinstance(value, Column) else F.col(value)), True).over(before)

    acting = F.col("actor").isNotNull()
    damage = acting & (F.col("kind") == "damage")
    armed = (F.col("kind") == "critical") & (F.lower("detail") == "hit")
    cast = (F.col("kind") == "spell") & F.col("detail").isNotNull()
    aimed = (F.col("kind") == "attack") & F.col("target").isNotNull()
    seen = spread.select(
        "*",
        last(armed, F.struct("ord", "id")).alias("_armed"),
        last(damage, "ord").alias("_damage"),
        last(cast, F.struct("id", "detail")).alias("_cast"),
        last(aimed, F.struct("id", "target")).alias("_aimed"),
    ).where("_own")
    critical = damage & (F.col("id") - F.col("_armed.id") <= critical_within) & (F.col("_damage").isNull() | (F.col("_damage") < F.col("_armed.ord")))
    candidate = F.when(damage & (F.col("id") - F.col("_cast.id") <= spell_within), F.col("_cast.detail"))
    probed = acting & (F.col("kind") == "immune") & F.col("target").isNull() & (F.col("id") - F.col("_aimed.id") <= target_within)
    kept = [F.col(c) for c in events.columns if c not in ("target", "critical", "spell", "spell_candidate")]
    return seen.select(
        *kept,
        F.when(probed, F.col("_aimed.target")).otherwise(F.col("target")).alias("target"),
        F.coalesce(critical, F.lit(False)).cast("int").alias("critical"),
        F.when(F.lower("detail").isin(*spell_damage), candidate).alias("spell"),
        candidate.alias("spell_candidate"),
    )


def save_targets(events: DataFrame, stats: DataFrame) -> DataFrame:
    """Events with ``save_target``: the number their actor needed, by the last stats line up to their id, and ``made``.

    A stats line pinned to the id of a save applies to that save.
    """
    rolls = events.where("kind = 'save' and actor is not null and roll is not null").select("session", F.col("id").alias("at"), F.col("actor").alias("name"), F.lit(1).alias("step"), "detail", "roll", F.lit(None).cast("map<string,bigint>").alias("targets"), F.col("ord").alias("seq"))
    known = stats.select("session", F.col("as_of_id").alias("at"), "name", F.lit(0).alias("step"), F.lit(None).cast("string").alias("detail"), F.lit(None).cast("bigint").alias("roll"), "targets", F.col("ord").alias("seq"))
    upto = Window.partitionBy("session", "name").orderBy("at", "step", "seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = rolls.unionByName(known).withColumn("latest", F.last("targets", True).over(upto)).where("step = 1")
    judged = seen.select("session", F.col("seq").alias("ord"), F.try_element_at("latest", F.col("detail")).alias("save_target"), "roll")
    verdict = judged.select("session", "ord", "save_target", (F.col("roll") >= F.col("save_target")).cast("int").alias("made"))
    return events.join(verdict, ["session", "ord"], "left")
