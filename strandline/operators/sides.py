"""Sides by weighted evidence: who fights with whom in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.tables import Work

ROUNDS = 8
#: Pairs of names up to which a session is settled in one task; larger ones are settled in waves.
ALONE = 100_000


def hostile_edges(events: DataFrame) -> DataFrame:
    """session, a, b, n, first_ord: how often a attacked or damaged b, and when first."""
    hits = events.where("kind in ('damage', 'attack') and actor is not null and target is not null")
    return hits.groupBy("session", F.col("actor").alias("a"), F.col("target").alias("b")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """session, a, b, weight in both directions; an edge of a name with itself counts twice."""
    both = edges.select("session", "a", "b", "n").union(edges.select("session", F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy("session", "a", "b").agg(F.sum("n").alias("weight"))


def members(events: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """session, name, rostered: the party by roster lines and by who pauses the game."""
    paused = events.where("kind = 'pause' and actor is not null").select("session", F.col("actor").alias("name"), F.lit(False).alias("rostered"))
    listed = roster.select("session", "name", F.lit(True).alias("rostered")) if roster is not None else paused.limit(0)
    return listed.unionByName(paused).groupBy("session", "name").agg(F.max("rostered").alias("rostered"))


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Sides of the names of one session.

    Labels spread over the weighted graph of hostile acts.  A name takes the side against
    which most weight speaks; members' own weight counts double.  Names are visited in
    the order in which they first occur, and each visit sees the labels set before it.
    """
    edges = rows[rows["what"] == "edge"].sort_values("first_ord", kind="stable")
    party = set(rows.loc[rows["what"] == "member", "a"])
    around: dict[str, dict[str, int]] = {}
    for a, b, n in zip(edges["a"], edges["b"], edges["n"]):
        for x, y in ((a, b), (b, a)):
            around.setdefault(x, {})
            around[x][y] = around[x].get(y, 0) + int(n)
    side = dict.fromkeys(party, "party")
    for _ in range(ROUNDS):
        changed = False
        for name, others in around.items():
            if name in party:
                continue
            against = {"party": 0, "opponent": 0}
            for other, weight in others.items():
                if other in side:
                    against[side[other]] += weight * (2 if other in party else 1)
            if not any(against.values()):
                continue
            now = "party" if against["opponent"] > against["party"] else "opponent"
            if side.get(name) != now:
                side[name], changed = now, True
        if not changed:
            break
    rostered = set(rows.loc[(rows["what"] == "member") & (rows["n"] > 0), "a"])
    spoke = set(rows.loc[rows["what"] == "spoke", "a"])
    names = list(side)
    summon = [side[n] == "party" and n not in rostered and n not in spoke for n in names]
    # types are given, since a session without evidence has no rows to tell them from
    texts = {"session": [rows["session"].iloc[0]] * len(names), "name": names, "side": [side[n] for n in names]}
    return pd.DataFrame({**{c: pd.Series(v, dtype=object) for c, v in texts.items()}, "summon": pd.Series(summon, dtype=bool)})


def spoke(events: DataFrame) -> DataFrame:
    return events.where("kind = 'dialogue' and actor is not null").select("session", F.col("actor").alias("name")).distinct()


def evidence(edges: DataFrame, party: DataFrame, heard: DataFrame) -> DataFrame:
    """session, what, a, b, n, first_ord: all that tells sides, in one table."""
    nothing, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    parts = [
        edges.select("session", F.lit("edge").alias("what"), "a", "b", "n", F.col("first_ord").cast("long").alias("first_ord")),
        party.select("session", F.lit("member").alias("what"), F.col("name").alias("a"), nothing.alias("b"), F.col("rostered").cast("long").alias("n"), zero.alias("first_ord")),
        heard.select("session", F.lit("spoke").alias("what"), F.col("name").alias("a"), nothing.alias("b"), zero.alias("n"), zero.alias("first_ord")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def visits(edges: DataFrame) -> DataFrame:
    """session, name, place: names in the order in which they first occur, a before b."""
    each = edges.select("session", F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.struct("first_ord", F.lit(i).alias("role")).alias("place")) for i, c in enumerate("ab")])).alias("v"))
    return each.groupBy("session", "v.name").agg(F.min("v.place").alias("place"))


def settle_waves(edges: DataFrame, party: DataFrame, work: Work) -> DataFrame:
    """session, name, side as ``_settle`` finds them one name after another, without a loop over names.

    In a round a name sees the labels that names before it get in the same round, and
    those that names after it got in the one before.  The labels of a round are thus the
    one solution of a system in which each depends on earlier places only.  A wave works
    all of them out at once from the labels of the wave before; what depends on k others
    in a row is right after k waves, and when a wave changes nothing the round is over.  A
    wave is one join and one aggregate over the pairs of names, all sessions at once, and
    only names whose neighbours have just changed are worked out again.
    """
    member = party.select("session", "name").distinct().withColumn("member", F.lit(True))
    order = visits(edges)
    seen = lambda c: order.select("session", F.col("name").alias(c), F.col("place").alias(f"place_{c}"))
    inside = lambda c: member.select("session", F.col("name").alias(c), F.col("member").alias(f"member_{c}"))
    pairs = edge_weights(edges).join(seen("a"), ["session", "a"]).join(seen("b"), ["session", "b"])
    pairs = pairs.join(inside("a"), ["session", "a"], "left_anti").join(inside("b"), ["session", "b"], "left")
    # members' own weight counts double; the label of a member never changes
    pairs = work.stored(pairs.select("session", "a", "b", (F.col("weight") * F.when(F.col("member_b"), 2).otherwise(1)).alias("weight"), (F.col("place_b") < F.col("place_a")).alias("earlier"), F.coalesce("member_b", F.lit(False)).alias("fixed")))
    names = pairs.select("session", F.col("a").alias("name")).distinct()
    # old: after the round before; new: as far as this round's waves have come
    none = F.lit(None).cast("string")
    labels = work.stored(names.select("session", "name", none.alias("old"), none.alias("new"), F.lit(True).alias("moved")))
    for n in range(ROUNDS):
        while True:
            told = labels.select("session", F.col("name").alias("b"), "old", "new", "moved")
            side = F.when(F.col("fixed"), F.lit("party")).when(F.col("earlier"), F.col("new")).otherwise(F.col("old"))
            sided = pairs.join(told, ["session", "b"], "left").withColumn("side", side)
            against = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("weight"))), F.lit(0))
            votes = sided.groupBy("session", F.col("a").alias("name")).agg(against("party").alias("p"), against("opponent").alias("o"))
            now = F.when(F.col("p") + F.col("o") == 0, F.col("old")).when(F.col("o") > F.col("p"), F.lit("party")).otherwise(F.lit("opponent"))
            after = labels.drop("moved").join(votes, ["session", "name"]).withColumn("now", now)
            wave = work.stored(after.select("session", "name", "old", F.col("now").alias("new"), (~F.col("new").eqNullSafe(F.col("now"))).alias("moved")))
            labels = wave
            if wave.where("moved").isEmpty():
                break
        if labels.where("not (old <=> new)").isEmpty() or n == ROUNDS - 1:
            break
        labels = labels.withColumn("old", F.col("new"))
    found = labels.where("new is not null").select("session", "name", F.col("new").alias("side"))
    return found.union(member.select("session", "name", F.lit("party").alias("side")))


def resolve_sides(events: DataFrame, roster: DataFrame | None = None, alone: int = ALONE) -> DataFrame:
    """session, name, side, summon for every name with evidence.

    Events shrink to one row per pair of names.  A session of at most ``alone`` pairs is
    settled by a loop in one task, larger ones by ``settle_waves`` over all tasks, with
    the same result.
    """
    work = Work(events.sparkSession)
    try:
        found = work.stored(evidence(hostile_edges(events), members(events, roster), spoke(events)))
        return work.kept(settled(found, alone, work))
    finally:
        work.drop()


def settled(found: DataFrame, alone: int = ALONE, work: Work | None = None) -> DataFrame:
    """session, name, side, summon that a table of ``evidence`` tells; without ``work`` in one task a session."""
    large = found.where("what = 'edge'").groupBy("session").agg(F.count("*").alias("pairs")).where(F.col("pairs") > alone).select("session")
    schema = "session string, name string, side string, summon boolean"
    if work is None or large.isEmpty():
        return found.groupBy("session").applyInPandas(_settle, schema)
    small = found.join(large, "session", "left_anti").groupBy("session").applyInPandas(_settle, schema)
    told = work.stored(found.join(large, "session", "left_semi"))
    party = told.where("what = 'member'").select("session", F.col("a").alias("name"), (F.col("n") > 0).alias("rostered"))
    waved = settle_waves(told.where("what = 'edge'"), party, work)
    heard = party.where("rostered").select("session", "name").union(told.where("what = 'spoke'").select("session", F.col("a").alias("name"))).distinct()
    waved = waved.join(heard.withColumn("heard", F.lit(True)), ["session", "name"], "left")
    return small.union(waved.select("session", "name", "side", ((F.col("side") == "party") & F.col("heard").isNull()).alias("summon")))


def label(events: DataFrame, sides: DataFrame) -> DataFrame:
    """Events with actor_side, target_side (neutral without evidence, null without a name), summon and target_summon."""
    out = events.drop("actor_side", "target_side", "summon", "target_summon")
    for role, side, summon in (("actor", "actor_side", "summon"), ("target", "target_side", "target_summon")):
        found = sides.select("session", F.col("name").alias(role), F.col("side").alias(side), F.col("summon").alias("_s"))
        out = out.join(found, ["session", role], "left")
        out = out.withColumn(side, F.when(F.col(role).isNotNull(), F.coalesce(side, F.lit("neutral")))).withColumn(summon, F.when(F.col("_s"), F.col(role))).drop("_s")
    return out
