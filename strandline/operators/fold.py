"""State fold: what was last seen on each creature of a session.

The fold is a set of aggregates and one anti-join, not a loop over rows.  Everything
that can be observed is a candidate row; everything that takes observations away is a
clear row; an observation stands if no later clear row of its creature matches it.
All steps group by (session, creature), so sessions of any number and length spread
over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import body_after_speaker, gone, like_effect_name, name_key, not_a_creature, passing
from strandline.operators.knowledge import PROBES, STRIPPED

KEY = ["session", "creature"]
STRENGTH = {"cast": 0, "effect": 1, "probe": 2}


def _creature(name: str) -> Column:
    return F.when(~not_a_creature(F.col(name)), F.col(name))


def _last(value: Column | str, order: Column, when: Column | None = None) -> Column:
    """The value of the last row (null values included) among those where ``when`` holds."""
    boxed = F.struct(value if isinstance(value, Column) else F.col(value))
    return F.max_by(boxed, F.when(when, order) if when is not None else order)


def participants(events: DataFrame) -> DataFrame:
    """session, creature, side, summoned, id, clock_ms, role of each part that a creature has in a row."""
    parts = [
        events.select("session", _creature(name).alias("creature"), F.col(side).alias("side"), F.col(summon).isNotNull().alias("summoned"), "id", "clock_ms", F.lit(role).alias("role"))
        for role, (name, side, summon) in enumerate((("actor", "actor_side", "summon"), ("target", "target_side", "target_summon")))
    ]
    return parts[0].union(parts[1]).where("creature is not null")


def resolved(events: DataFrame, effects: DataFrame) -> DataFrame:
    """Events with ``subject``, the ``text`` that may name an effect, and that effect."""
    actor, target = _creature("actor"), _creature("target")
    stateful = F.col("kind").isin("status", "effect")
    meaning = F.lit(None).cast("string")
    for detail, name in PROBES.items():
        meaning = F.when(F.col("detail") == detail, name).otherwise(meaning)
    text = F.when(F.col("kind") == "spell", F.col("detail")).when(F.col("kind") == "immune", meaning).when(stateful, F.coalesce("detail", body_after_speaker(F.col("raw"))))
    subject = F.when(F.col("kind") == "effect", F.coalesce(target, actor)).when(F.col("kind") == "status", actor).when(F.col("kind") == "spell", target).when(F.col("kind") == "immune", target)
    told = events.where("kind in ('spell', 'immune', 'status', 'effect')").select("session", "id", "kind", "game_ticks", "clock_ms", "detail", "actor_side", actor.alias("actor"), subject.alias("subject"), text.alias("text"))
    known = effects.select(F.col("key").alias("_key"), F.col("name").alias("known"), "category", "blocks", "dispellable", "strips", "counter")
    found = told.join(known, name_key(F.col("text")) == F.col("_key"), "left").drop("_key")
    state = F.col("kind").isin("status", "effect")
    # a status line counts if it names a known effect, or looks like a name and reports no passing event
    return found.where(~state | (F.col("text").isNotNull() & ~passing(F.col("text")) & (F.col("known").isNotNull() | like_effect_name(F.col("text")))))


def _strip_class() -> Column:
    """What a row takes away: a removal class, else null."""
    return F.when(F.col("category") == "dispel", F.coalesce("strips", F.lit("dispellable")))


def observations(rows: DataFrame) -> DataFrame:
    """Candidate observations among resolved rows."""
    is_state = F.col("kind").isin("status", "effect")
    source = F.when(F.col("kind") == "spell", "cast").when(F.col("kind") == "immune", "probe").otherwise("effect")
    seen = rows.where("subject is not null and text is not null").where(F.coalesce(F.col("category") != "dispel", F.lit(True)))
    seen = seen.where(~(is_state & gone(F.col("text")))).where((F.col("kind") != "spell") | F.col("known").isNotNull())
    return seen.select(
        "session", F.col("subject").alias("creature"), F.coalesce("known", "text").alias("name"), F.coalesce("category", F.lit("unknown")).alias("category"),
        F.coalesce("blocks", F.array().cast("array<string>")).alias("blocks"), F.coalesce("dispellable", F.lit(True)).alias("dispellable"), "counter", source.alias("source"), "id", "game_ticks", "clock_ms",
    )


def clears(events: DataFrame, rows: DataFrame) -> DataFrame:
    """session, creature, id, class of everything that takes observations away; class 'all' is death or departure."""
    deaths = events.where("kind = 'death'").select("session", _creature("actor").alias("creature"), "id", F.lit("all").alias("class"))
    state = F.col("kind").isin("status", "effect")
    left = rows.where(state & gone(F.col("text"))).select("session", F.col("subject").alias("creature"), "id", F.lit("all").alias("class"))
    at = F.when(F.col("kind") == "spell", F.coalesce("subject", "actor")).otherwise(F.col("subject"))
    stripped = rows.where((F.col("kind") == "spell") | state).where(~(state & gone(F.col("text")))).select("session", at.alias("creature"), "id", _strip_class().alias("class")).where("class is not null")
    return deaths.union(left).union(stripped).where("creature is not null")


def surviving(seen: DataFrame, cleared: DataFrame, evidence: str = "newest") -> DataFrame:
    """Per creature and name the newest observation (or the strongest), unless a later clear row matches it.

    Clear rows shrink to the last id of each class before they meet the observations.
    """
    classes = ["all", "dispellable", *STRIPPED]
    last = cleared.groupBy(*KEY).agg(*[F.max(F.when(F.col("class") == c, F.col("id"))).alias(f"_{i}") for i, c in enumerate(classes)])
    hits = [F.lit(True), F.col("dispellable"), *[F.arrays_overlap("blocks", F.array(*[F.lit(b) for b in bs])) for bs in STRIPPED.values()]]
    standing = F.lit(True)
    for i, hit in enumerate(hits):
        standing = standing & ~(F.coalesce(F.col(f"_{i}") > F.col("id"), F.lit(False)) & F.coalesce(hit, F.lit(False)))
    left = seen.join(last, KEY, "left").where(standing).drop(*[f"_{i}" for i in range(len(classes))])
    order = F.struct("id") if evidence == "newest" else F.struct(F.element_at(F.create_map(*[F.lit(x) for p in STRENGTH.items() for x in p]), F.col("source")), "id")
    fields = ["name", "category", "blocks", "dispellable", "counter", "source", "id", "game_ticks", "clock_ms"]
    return left.groupBy(*KEY, "name").agg(F.max_by(F.struct(*fields), order).alias("o")).select(*KEY, "o.*")


def casting(events: DataFrame, rows: DataFrame) -> DataFrame:
    """session, creature, casting: the spell begun last, if nothing ended it."""
    begun = events.where("kind = 'cast_start' and detail is not null").select("session", _creature("actor").alias("creature"), "id", F.lit(0).alias("step"), F.col("detail").alias("casting"))
    nothing = F.lit(None).cast("string").alias("casting")
    ended = events.where("kind = 'spell'").select("session", _creature("actor").alias("creature"), "id", F.lit(1).alias("step"), nothing)
    cleared = clears(events, rows).select("session", "creature", "id", F.lit(2).alias("step"), nothing)
    return begun.union(ended).union(cleared).where("creature is not null").groupBy(*KEY).agg(_last("casting", F.struct("id", "step")).alias("c")).select(*KEY, F.col("c.casting").alias("casting"))


def saves(events: DataFrame) -> DataFrame:
    """session, creature, category, count, roll and id and clock of the last, worst roll."""
    rolled = events.where("kind = 'save' and roll is not null").select("session", _creature("actor").alias("creature"), F.coalesce("detail", F.lit("unknown")).alias("category"), "roll", "id", "clock_ms")
    return rolled.where("creature is not null").groupBy(*KEY, "category").agg(F.count("*").alias("count"), F.max_by(F.struct("roll", "id", "clock_ms"), "id").alias("l"), F.min("roll").alias("worst")).select(*KEY, "category", "count", "l.*", "worst")


def summoners(rows: DataFrame, summons: DataFrame) -> DataFrame:
    """session, creature, summoned_by: the party's last cast of a spell that summons this name."""
    cast = rows.where("kind = 'spell' and actor_side = 'party' and detail is not null").select("session", "id", "detail", name_key(F.col("detail")).alias("key"))
    return cast.join(summons, "key").groupBy("session", "creature").agg(F.max_by("detail", "id").alias("summoned_by"))


def fold_state(events: DataFrame, effects: DataFrame, summons: DataFrame | None = None, evidence: str = "newest") -> DataFrame:
    """One row per session and creature: name, side, is_summon, last_seen, casting, last_action, died_at_id, observations, saves, also_summoned_by."""
    rows = resolved(events, effects)
    parts = participants(events)
    order = F.struct("id", "role")
    base = parts.groupBy(*KEY).agg(
        F.max_by("side", F.when(F.col("side").isNotNull(), order)).alias("side"),
        F.max("summoned").alias("is_summon"),
        F.max("id").alias("last_seen_id"),
        _last("clock_ms", order).alias("clock"),
        F.min(order).alias("first_seen"),
    )
    aimed = events.where("kind = 'attack' and target is not null").select("session", _creature("actor").alias("creature"), "id", F.concat(F.lit("attacking "), "target").alias("action")).where("creature is not null")
    cleared = clears(events, rows)
    died = cleared.where("class = 'all'").groupBy(*KEY).agg(F.max("id").alias("died_at_id"))
    obs_fields = F.struct("id", "name", "category", "blocks", "dispellable", "counter", "source", "game_ticks", "clock_ms")
    standing = surviving(observations(rows), cleared, evidence).groupBy(*KEY).agg(F.sort_array(F.collect_list(obs_fields), asc=False).alias("observations"))
    rolled = saves(events).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("id", "category", "count", "roll", "clock_ms", "worst")), asc=False).alias("saves"))
    out = base.join(casting(events, rows), KEY, "left").join(aimed.groupBy(*KEY).agg(F.max_by("action", "id").alias("last_action")), KEY, "left")
    out = out.join(died, KEY, "left").join(standing, KEY, "left").join(rolled, KEY, "left")
    if summons is not None:
        out = out.join(summoners(rows, summons), KEY, "left")
    else:
        out = out.withColumn("summoned_by", F.lit(None).cast("string"))
    return out.select(
        "session", F.col("creature").alias("name"), "side", "is_summon", "last_seen_id", F.col("clock.clock_ms").alias("last_seen_clock_ms"), "first_seen", "casting", "last_action", "died_at_id",
        F.coalesce("observations", F.array().cast(standing.schema["observations"].dataType)).alias("observations"), F.coalesce("saves", F.array().cast(rolled.schema["saves"].dataType)).alias("saves"),
        F.when(F.col("side") == "opponent", F.col("summoned_by")).alias("also_summoned_by"),
    )


def latest(events: DataFrame) -> DataFrame:
    """session, latest_id and the last clock that is not null."""
    return events.groupBy("session").agg(F.max("id").alias("latest_id"), F.max_by("clock_ms", F.when(F.col("clock_ms").isNotNull(), F.col("id"))).alias("latest_clock_ms"))


def with_age(folded: DataFrame, newest: DataFrame, stale_ms: int = 60_000) -> DataFrame:
    """Folded rows with age_ms since last seen and whether that is stale."""
    age = F.greatest(F.lit(0).cast("bigint"), F.col("latest_clock_ms") - F.col("last_seen_clock_ms"))
    return folded.join(newest.select("session", "latest_clock_ms"), "session", "left").withColumn("age_ms", age).withColumn("stale", F.col("age_ms") > stale_ms).drop("latest_clock_ms")
