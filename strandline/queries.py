"""Registered queries over the supplied tables, each with the SQL that gives the same rows.

The event table is turned into log lines by one SQL text that both engines run; the
queries then go through the real pipeline: wire format, normalisation, rules, links.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.rules import classify
from strandline.functions.text import computed_once, contains_folded, name_key, normalise, redacted
from strandline.operators import opcodes, sides
from strandline.operators.fold import casting, clears, fold_state, observations, resolved, saves, surviving
from strandline.operators.knowledge import _effect_rows, declined, hand_effects, keyed, known_effects, with_effect
from strandline.operators.links import CRITICAL_WITHIN, SPELL_WITHIN, TARGET_WITHIN, link_events, save_targets
from strandline.operators.upsert import last_write_wins
from strandline.plans import api, chains, reports, search
from strandline.schema import KINDS
from strandline.sources import archives, binary
from strandline.sources.binary import resolved as resolve_sources
from strandline.sources.logs import events as parse_events
from strandline.sources.logs import read_live_lines, roster, stats
from strandline.sources.tables import Work, derived, dropped, materialised, shared_folder, spread
from strandline.streaming.live import derive, link_stream

#: Link windows of the queries; the table's acts are further apart than those of a real log.
WITHIN = 400

_BASE = """
SELECT CAST(CAST(ts AS date) AS string) AS session, event_id AS id, event_type,
       'U' || translate(CAST(user_id AS string), '0123456789', 'abcdefghij') AS a,
       'U' || translate(regexp_extract(props, '([0-9]+)', 1), '0123456789', 'abcdefghij') AS b,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k, CAST(floor(value) AS bigint) AS n
FROM events"""
#: Attacks, casts, damage, criticals and saves.
FIGHT = f"""
SELECT session, id, event_type, a, b, k, n, CASE WHEN k % 2 = 0 THEN 'Fireball' ELSE 'Icelance' END AS s,
       CASE event_type WHEN 'click' THEN a || ': Attacks ' || b
            WHEN 'view' THEN a || ': Casts ' || CASE WHEN k % 2 = 0 THEN 'Fireball' ELSE 'Icelance' END || ' : ' || b
            WHEN 'purchase' THEN b || ': Takes ' || CAST(n AS string) || ' magic damage from ' || a
            WHEN 'signup' THEN a || ': Critical Hit'
            ELSE a || ': Save vs. Spell : ' || CAST(n AS string) END AS text
FROM ({_BASE}) base"""
#: Effects cast, landed and removed, probes and deaths.
STATE = f"""
SELECT session, id, event_type, a, b, k, n,
       CASE event_type WHEN 'click' THEN a || ': Casts ' || CASE k % 4 WHEN 0 THEN 'Mirror Image' WHEN 1 THEN 'Stoneskin' WHEN 2 THEN 'Haste' ELSE 'Spell Turning' END || ' : ' || b
            WHEN 'view' THEN a || ': ' || CASE k % 4 WHEN 0 THEN 'Mirror Imaged' WHEN 1 THEN 'Hasted' WHEN 2 THEN 'Held' ELSE 'Invisible' END
            WHEN 'purchase' THEN a || CASE WHEN n % 2 = 0 THEN ': Attacks ' || b ELSE ': Weapon Ineffective.' END
            WHEN 'signup' THEN a || ': Death'
            ELSE a || ': Casts ' || CASE k % 4 WHEN 0 THEN 'Dispel Magic' WHEN 1 THEN 'Breach' WHEN 2 THEN 'Spell Thrust' ELSE 'True Sight' END || ' : ' || b END AS text
FROM ({_BASE}) base"""


#: Three actors close together, with the link windows of real logs; ids without gaps.
DENSE = f"""
SELECT session, id, event_type, a, b, k, n, s, kind_of,
       CASE event_type WHEN 'click' THEN a || ': Attacks ' || b
            WHEN 'view' THEN a || ': Casts ' || s || ' : ' || b
            WHEN 'purchase' THEN b || ': Takes ' || CAST(n AS string) || ' ' || kind_of || ' damage from ' || a
            WHEN 'signup' THEN a || ': Critical ' || CASE WHEN k % 3 = 0 THEN 'Miss' ELSE 'Hit' END
            ELSE a || ': Weapon Ineffective.' END AS text
FROM (SELECT session, row_number() OVER (PARTITION BY session ORDER BY id) AS id, event_type, b, k, n,
             CASE k % 12 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN 'Cyd' WHEN 3 THEN 'Dee' ELSE a END AS a,
             CASE n % 3 WHEN 0 THEN 'magic' WHEN 1 THEN 'fire' ELSE 'slashing' END AS kind_of,
             CASE WHEN k % 2 = 0 THEN 'Fireball' ELSE 'Icelance' END AS s
      FROM ({_BASE}) base) dense"""
#: Lines of a party of one against everybody who meets it; rosters and stats among them.
PARTY = f"""
SELECT session, id, event_type, a, b, k, n,
       CASE event_type WHEN 'click' THEN a || ': Attacks Hero'
            WHEN 'view' THEN b || ': Casts Haste : ' || b
            WHEN 'purchase' THEN CASE WHEN k % 5 = 0 THEN concat('A7ROSTER', chr(9), 'Hero', chr(9), ' ', chr(9)) ELSE a || ': Takes ' || CAST(n AS string) || ' fire damage from Hero' END
            WHEN 'signup' THEN concat('A7STATS', chr(9), a, chr(9), 'Spell: ', CAST(k AS string), ' (1) | Other: 3 | breath  weapon : ', CAST(n AS string))
            ELSE a || ': Save vs. Spell : ' || CAST(n AS string) END AS text
FROM ({_BASE}) base"""
#: One kind of line after another: text, kind, actor, target, amount, roll, resisted, detail as SQL; {} stands for NULL.
KINDS_OF_LINES = [
    ("'UNPAUSED'", "pause", "", "", "", "", "", ""),
    ("a || ': Auto-Paused: Enemy Sighted'", "pause", "a", "", "", "", "", "'Enemy Sighted'"),
    ("a || ': *waves to ' || b || '*'", "action", "a", "", "", "", "", "'waves to ' || b"),
    ("a || ': Stopped singing Ballad'", "song", "a", "", "", "", "", "'Ballad'"),
    ("b || ': Takes ' || CAST(k AS string) || ' Cold damage from ' || a || ' (' || CAST(n AS string) || ' damage resisted)'", "damage", "a", "b", "k", "", "n", "'Cold'"),
    ("b || ': Takes ' || CAST(k AS string) || ' fire damage from ' || a || ' (9 damage bonus)'", "damage", "a", "b", "k", "", "", "'fire'"),
    ("a || ': Damage Taken: ' || CAST(k AS string)", "damage", "a", "", "k", "", "", ""),
    ("a || ': Suffers ' || CAST(k AS string) || ' points of damage'", "damage", "a", "", "k", "", "", ""),
    ("a || ': ' || b || ' was immune to my damage.'", "immune", "a", "b", "", "", "", "'damage'"),
    ("a || ': Weapon Ineffective.'", "immune", "a", "", "", "", "", "'weapon'"),
    ("a || ': Attack Roll 6 + 2 = ' || CAST(k AS string) || ' : Hit'", "attack", "a", "", "", "k", "", "'Hit'"),
    ("a || ': Attack Roll: ' || CAST(k AS string) || ' of 20'", "attack", "a", "", "", "k", "", ""),
    ("a || ': Roll:' || CAST(k AS string) || ' +Luck:0 +SpecialAC:0'", "tohit", "a", "", "", "k", "", ""),
    ("a || ': Roll:' || CAST(k AS string) || ' +DamageMod:0'", "damageroll", "a", "", "", "k", "", ""),
    ("a || ': Attacks ' || b", "attack", "a", "b", "", "", "", ""),
    ("a || ': Is attacking ' || b", "attack", "a", "b", "", "", "", ""),
    ("a || ': Critical Miss'", "critical", "a", "", "", "", "", "'Miss'"),
    ("a || ': Save vs. Breath Weapon : -' || CAST(k AS string)", "save", "a", "", "", "-k", "", "'Breath Weapon'"),
    ("a || ': made a saving throw'", "save", "a", "", "", "", "", ""),
    ("a || ': Death'", "death", "a", "", "", "", "", ""),
    ("a || ': has been killed'", "death", "a", "", "", "", "", ""),
    ("a || ': Casting Web...'", "cast_start", "a", "", "", "", "", "'Web'"),
    ("a || ': is Casting Web : ' || b", "cast_start", "a", "b", "", "", "", "'Web'"),
    ("a || ': is Casting Web'", "cast_start", "a", "", "", "", "", "'Web'"),
    ("a || ': Casts Web : ' || b", "spell", "a", "b", "", "", "", "'Web'"),
    ("a || ': Casts Web'", "spell", "a", "", "", "", "", "'Web'"),
    ("a || ': Spell Failed: Casting Failure'", "miscast", "a", "", "", "", "", "'Casting Failure'"),
    ("a || ': gained a level'", "level", "a", "", "", "", "", ""),
    ("a || ': gained experience: ' || CAST(k AS string)", "xp", "a", "", "k", "", "", ""),
    ("a || ': ' || CAST(k AS string) || ' experience'", "xp", "a", "", "k", "", "", ""),
    ("a || ': you found ' || CAST(k AS string) || ' gold'", "gold", "a", "", "k", "", "", ""),
    ("a || ': you acquired a sword'", "loot", "a", "", "", "", "", ""),
    ("a || ': joined the party'", "party", "a", "", "", "", "", ""),
    ("a || ': Bless : ' || b", "effect", "a", "b", "", "", "", "'Bless'"),
    ("a || ': Well met!'", "dialogue", "a", "", "", "", "", ""),
    ("a || ': Hasted'", "status", "a", "", "", "", "", ""),
    ("'no speaker here'", "other", "", "", "", "", "", ""),
    ("'Capture resynced: lost'", "resync", "", "", "", "", "", ""),
]


def _by_kind(values: list[str]) -> str:
    return f"CASE id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v) + " END"


RULED = f"SELECT session, id, a, b, k, n, {_by_kind([x[0] for x in KINDS_OF_LINES])} AS text FROM ({_BASE}) base"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """session, ord, line in wire format; rows whose text begins with a marker of its own are such lines."""
    rows = spark.sql(sql.replace("FROM events", "FROM {events}"), events=spread(_table(spark, sf_dir, "events")))
    wire = F.concat_ws("\t", F.lit("A7LOG"), "id", F.col("id") * 60, F.col("id") * 1000, F.lit(""), F.lit(""), "text")
    return rows.select("session", F.col("id").alias("ord"), F.when(F.startswith("text", F.lit("A7")), F.col("text")).otherwise(wire).alias("line"))


def _events(spark: SparkSession, sf_dir: str, sql: str = FIGHT, within: tuple[int, int, int] = (WITHIN, WITHIN, WITHIN)) -> DataFrame:
    """The event table of these lines, derived once for all queries on it."""

    def make() -> DataFrame:
        critical, spell, target = within
        linked = link_events(classify(parse_events(_lines(spark, sf_dir, sql))), critical_within=critical, spell_within=spell, target_within=target)
        nothing = [F.lit(None).cast("string").alias(c) for c in ("actor_side", "target_side", "summon", "target_summon")]
        return linked.select("*", *nothing, F.lit(None).cast("int").alias("saved"))

    return derived(f"{sql}{within}", f"{sf_dir}/events.parquet", make, spark)


def _sided(spark: SparkSession, sf_dir: str, name: str, sql: str, verdicts: bool = False) -> DataFrame:
    """The event table of these lines with sides, derived once for all queries on it."""
    work = Work(spark)
    try:
        return derived(name, f"{sf_dir}/events.parquet", lambda: derive(_lines(spark, sf_dir, sql), verdicts, work), spark)
    finally:
        work.drop()


def damage_by_actor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage dealt by actor, over all events: the flagship query."""
    matched = _events(spark, sf_dir).where(api.predicate(api.Query(equals={"kind": "damage"})))
    return api.all_groups(matched, "actor").orderBy(F.desc("events"), "key").select("key", "events", "damage", "crits", "crit_damage")


def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify(parse_events(_lines(spark, sf_dir, FIGHT)))
    return done.select("id", "kind", "actor", "target", "amount", "roll", "detail")


def classify_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kind_histogram(classify(parse_events(_lines(spark, sf_dir, FIGHT)))).select("kind", "n", "share")


def link_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("kind = 'damage'").select("id", "critical")


def link_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("kind = 'damage'").select("id", "spell", "spell_candidate")


def link_probe_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, STATE).where("kind = 'immune'").select("id", "actor", "target")


def asof_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.sql(FIGHT.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events")).where("event_type = 'signup'")
    stats = told.select("session", F.col("id").alias("ord"), F.col("id").alias("as_of_id"), F.col("a").alias("name"), F.create_map(F.lit("Spell"), F.col("k")).alias("targets"))
    return save_targets(_events(spark, sf_dir), stats).where("kind = 'save'").select("id", "roll", "save_target", "made")


def group_window_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.groups(_events(spark, sf_dir), "kind", limit=500, offset=100)["rows"]


def facets_self_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(spark, sf_dir)
    q = api.Query(equals={"kind": "damage", "detail": "magic"}, without_kinds=("save",))
    parts = [api.facet(found, d, q).select(F.lit(d).alias("dimension"), "key", "n") for d in ("session", "kind", "detail")]
    return reduce(DataFrame.union, parts)


def search_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    hit = reduce(lambda a, b: a | b, [contains_folded(F.col(c), "ED") for c in ("p_name", "p_brand", "p_type")])
    return parts.where(hit).select("p_partkey", "p_name", "p_type")


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have the word in any of the columns that are searched, also the spell that a hit is linked to."""
    found = _events(spark, sf_dir).where(api.predicate(api.Query(search="FIREb_ll", without_kinds=("attack",))))
    return found.select("id", "kind", "detail", "spell")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage done by one actor to another, found by their names through the table of trigrams."""
    folder = shared_folder(spark)
    try:
        laid = search.lay_out(_events(spark, sf_dir), f"{folder}/events", span=64)
        posted = derived(f"{FIGHT} trigrams", f"{sf_dir}/events.parquet", lambda: search.postings(laid), spark)
        found = search.search(laid, posted, "damage from Ubc")
        return materialised(found.select("session", "id", "kind", "actor", "raw"))
    finally:
        dropped(spark, folder)


def classify_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all kinds that there is a rule for, and of those for which there is none."""
    done = classify(parse_events(_lines(spark, sf_dir, RULED)))
    return done.select("id", "kind", "actor", "target", "amount", "roll", "resisted", "detail")


#: Prefixes of a line as SQL, and whether an event after them counts.
PREFIXES = [("''", True), ("'2024-05-06 07:08:09.' || CAST(100 + id % 900 AS string) || ' LUA: '", True), ("'[x] LUA: '", True), ("'2024-05-06 07:08:09.5 '", False), ("' 2024-05-06 07:08:09.5 LUA: '", True), ("'^D' || chr(8) || chr(8)", True)]
#: Status lines of a creature as SQL, the name of the effect that is seen (null where nothing lasting is said), and its category.
STATUSES = [
    ("a || ': Hasted'", "'Haste'", "'buff'"), ("a || ': Detecting Illusions'", "", ""), ("a || ': Healed 7'", "", ""), ("a || ': Quick Save failed'", "", ""), ("a || ': Spell Caster Level 9'", "", ""),
    ("a || ': Shimmering'", "'Shimmering'", "'unknown'"), ("a || ': Trapped in amber'", "'Trapped in amber'", "'unknown'"), ("a || ': Trap: sprung'", "", ""), ("a || ': one two three four five six'", "'one two three four five six'", "'unknown'"),
    ("a || ': one two three four five six seven'", "", ""), ("a || ': this status line is longer than forty eight chars'", "", ""), ("a || ': well, so'", "", ""),
    ("'Your ' || b || ': Hasted'", "", ""), ("'The Party Has: Hasted'", "", ""), ("'Hint: Hasted'", "", ""), ("'Hinter ' || b || ': Hasted'", "'Haste'", "'buff'"),
]
STATED = f"SELECT session, id, a, b, k, n, {_by_kind([x[0] for x in STATUSES])} AS text FROM ({_BASE}) base"
PREFIXED = f"SELECT session, id, a, b, k, n, {_by_kind([x[0] for x in PREFIXES])} AS prefix, CASE WHEN id % 7 = 0 THEN ' ' ELSE CAST(id * 3 AS string) || 'x' END AS ticks FROM ({_BASE}) base"


def wire_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events behind prefixes of all sorts, with their clocks; numbers are read as far as they go."""
    rows = spark.sql(PREFIXED.replace("FROM events", "FROM {events}"), events=spread(_table(spark, sf_dir, "events")))
    wire = F.concat("prefix", F.concat_ws("\t", F.lit("A7LOG"), F.concat(F.lit(" "), F.col("id").cast("string")), "ticks", F.lit(""), F.lit("day 1"), F.lit("world"), F.lit("x"), F.lit("y")), F.lit("\r"))
    found = parse_events(rows.select("session", F.col("id").alias("ord"), wire.alias("line")))
    return found.select("session", "id", "wall_clock", "game_ticks", "clock_ms", "game_time", "screen", "raw")


def lasting_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What status lines say of creatures: passing reports, sentences and broadcasts say nothing."""
    found = _events(spark, sf_dir, STATED)
    seen = observations(resolved(found, known_effects(spark)))
    return seen.groupBy("name", "category", "source").agg(F.count("*").alias("n"), F.countDistinct("session", "creature").alias("creatures"))


def page_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with a page by a column that is null in places: matches, hidden rows, gaps in scope; and its rows."""
    found = _events(spark, sf_dir, RULED)
    told = api.events_page(found, api.Query(without_kinds=("pause", "other"), sort=(("resisted", "asc"), ("id", "desc"))), limit=30)
    counts = [F.lit(told[c]).cast("long").alias(c) for c in ("total", "hidden_empty", "gaps", "limit")]
    return told["rows"].select("session", "id", "resisted", F.lit(told["empty_column"]).alias("empty_column"), *counts)


def kind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.capture_summary(classify(parse_events(_lines(spark, sf_dir, RULED))))


def link_default_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links with the windows of real logs."""
    return _dense(spark, sf_dir).select("session", "id", "target", "critical", "spell", "spell_candidate")


def link_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links from a stream: log files of all sessions are read, then again after more lines have come."""
    folder, lines = shared_folder(spark), _lines(spark, sf_dir, DENSE)
    try:
        for part in ("ord <= 150", "ord > 150"):
            log = lines.where(part).repartition("session").sortWithinPartitions("session", "ord").select("session", "line")
            log.write.mode("append").partitionBy("session").text(f"{folder}/lines")
            come = read_live_lines(spark, f"{folder}/lines", idle_seconds=0, session="folder").drop("file")
            stream = link_stream(classify(parse_events(come))).writeStream.format("parquet").option("path", f"{folder}/linked")
            stream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return materialised(spark.read.parquet(f"{folder}/linked").select("session", "id", "target", "critical", "spell", "spell_candidate"))
    finally:
        dropped(spark, folder)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, DENSE, (CRITICAL_WITHIN, SPELL_WITHIN, TARGET_WITHIN))


def unattributed_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unattributed(_dense(spark, sf_dir))


def attribution_by_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attribution(_dense(spark, sf_dir))


def groups_by_spell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures by a column that is mostly null, over all events."""
    return api.all_groups(_dense(spark, sf_dir), "spell")


def events_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = api.Query(equals={"kind": "damage"}, sort=(("amount", "desc"), ("target", "asc"), ("nonsense", "asc")))
    return api.events_page(_events(spark, sf_dir), q, limit=40, offset=7)["rows"].select("session", "id", "amount", "target")


def top_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_raw(_events(spark, sf_dir, STATE), "status", 25)


def session_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.session_bounds(_events(spark, sf_dir, STATE))


def coverage_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage(_events(spark, sf_dir, STATE), known_effects(spark), declined(spark))[0]


def roster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster(_lines(spark, sf_dir, PARTY)).select("session", "ord", "name")


def stats_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = stats(_lines(spark, sf_dir, PARTY))
    return told.select("session", "ord", "as_of_id", "name", F.try_element_at("targets", F.lit("Spell")).alias("spell"), F.try_element_at("targets", F.lit("Breath Weapon")).alias("breath"))


#: Lines of a party of one whose leader casts on others, with deaths; for the folded state of a range.
RANGED = f"""
SELECT session, id, event_type, a, b, k, n,
       CASE event_type WHEN 'click' THEN a || ': Attacks Hero'
            WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 'Hero' ELSE b END || ': Casts ' || CASE k % 4 WHEN 0 THEN 'Haste' WHEN 1 THEN 'Stoneskin' WHEN 2 THEN 'Mirror Image' ELSE 'Dispel Magic' END || ' : ' || b
            WHEN 'purchase' THEN CASE WHEN k % 5 = 0 THEN concat('A7ROSTER', chr(9), 'Hero') ELSE a || ': Takes ' || CAST(n AS string) || ' fire damage from Hero' END
            WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN a || ': Death' ELSE a || ': Casting Web...' END
            ELSE a || ': Save vs. ' || CASE WHEN k % 2 = 0 THEN 'Spell' ELSE 'Wand' END || ' : ' || CAST(n AS string) END AS text
FROM ({_BASE}) base"""
RANGE_FROM, RANGE_TO = 20, 320


def fold_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded state of a range of the newest session: all sides, ages, observations, saves and who may have been summoned."""
    found = _sided(spark, sf_dir, f"{RANGED} labelled", RANGED)
    summons = spark.sql("SELECT DISTINCT 'haste' AS key, 'U' || translate(CAST(user_id AS string), '0123456789', 'abcdefghij') AS creature FROM {events} WHERE user_id % 4 = 0", events=_table(spark, sf_dir, "events"))
    told = api.combatants(found, known_effects(spark), back_from=RANGE_FROM, back_to=RANGE_TO, summons=summons)
    rows = reduce(DataFrame.union, [told[side].withColumn("view", F.lit(side)) for side in ("opponents", "party", "neutral")])
    join = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")
    return rows.select(
        "view", "name", "side", "is_summon", "last_seen_id", "age_ms", "stale", "casting", "last_action", "died_at_id", "also_summoned_by",
        join("observations", "name", "category", "source", "id").alias("observations"), join("saves", "category", "count", "roll", "worst", "id").alias("saves"),
    )


def group_window_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of actors over the largest window, behind the newest 37 events."""
    return api.groups(_events(spark, sf_dir), "actor", limit=api.GROUP_MOST, offset=37)["rows"].select("key", "events", "damage", "crits", "saves")


def events_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down all events by text, found by rank."""
    q = api.Query(sort=(("target", "asc"), ("raw", "desc")))
    found = _events(spark, sf_dir)
    order = api.ordering(q)
    return api.deep_page(found, order, 50, 5000).select("session", "id", "target", "raw")


def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines and kinds that one job makes in passing, while the events go elsewhere."""
    lines, kinds = Observation("lines"), Observation("kinds")
    done = reports.observed_kinds(classify(parse_events(reports.observed(_lines(spark, sf_dir, RULED), lines))), kinds)
    done.write.format("noop").mode("overwrite").save()
    rows = [(k, int(v)) for k, v in {**lines.get, **kinds.get}.items()]
    return spark.createDataFrame(rows, "key string, n long")


def groups_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts of each brand in the order of the view, numbers in them by value, with their places."""
    named = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_type", F.col("p_size").cast("string"), "p_name").alias("name"))
    own = Window.partitionBy("p_brand").orderBy(chains.natural(F.col("name")), "p_partkey")
    return named.select("p_partkey", "name", F.row_number().over(own).alias("place"))


def _party(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sided(spark, sf_dir, f"{PARTY} verdicts", PARTY, verdicts=True)


def side_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of both ends of each event: who fights the one rostered name is an opponent, others are neutral."""
    return _party(spark, sf_dir).select("session", "id", "actor", "target", "actor_side", "target_side", "summon", "target_summon")


def save_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _party(spark, sf_dir).where("kind = 'save'").select("session", "id", "saved")


SPELL, CREATURE, STRINGS = 0x3EE, 0x3F1, 0x400


def _resource_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resref, type, content: parts as spells, suppliers as creatures, names of both in string tables of 500."""
    part, supplier = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "supplier")

    def spell(batches):
        for batch in batches:
            rows = []
            for key, size, kind in zip(batch["p_partkey"], batch["p_size"], batch["p_type"]):
                head, feature = bytearray(114), bytearray(48)
                head[:8] = b"SPL V1  "
                struct.pack_into("<2I", head, 8, key % 500, key // 500)
                struct.pack_into("<H", head, 0x1C, size % 6)
                head[0x25] = size % 10
                struct.pack_into("<I", head, 0x34, size)
                struct.pack_into("<IHIHH", head, 0x64, 114, 2, 114 + 80, 0, 1)
                ability = bytearray(40)
                struct.pack_into("<2H", ability, 0x1E, 1, 0)  # the same feature as the casting one
                struct.pack_into("<HBBII", feature, 0, 58 if len(kind) % 2 else 220, 1, 2, 5, size % 3)
                feature[0x0D] = key % 2
                rows.append((f"s{key}", SPELL, bytes(head + ability + ability + feature)))
            yield pd.DataFrame(rows, columns=["resref", "type", "content"])

    def creature(batches):
        for batch in batches:
            rows = []
            for key, nation in zip(batch["s_suppkey"], batch["s_nationkey"]):
                raw = bytearray(0x280)
                raw[:8] = b"CRE V1.0"
                struct.pack_into("<2I", raw, 8, key % 500, key // 500)
                struct.pack_into("<2h", raw, 0x46, nation, -nation)
                struct.pack_into("<5b", raw, 0x54, *[nation - i for i in range(5)])
                rows.append((f"c{key}", CREATURE, bytes(raw)))
            yield pd.DataFrame(rows, columns=["resref", "type", "content"])

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [b""] * 500
        for i, name in zip(pdf["i"], pdf["name"]):
            texts[i] = name.encode()
        ends = np.cumsum([len(t) for t in texts]).tolist()
        entries = b"".join(struct.pack("<H8sIIII", 1, b"", 0, 0, end - len(t), len(t)) for t, end in zip(texts, ends))
        return pd.DataFrame([(pdf["resref"][0], STRINGS, b"TLK V1  " + struct.pack("<HII", 0, 500, 18 + len(entries)) + entries + b"".join(texts))], columns=["resref", "type", "content"])

    schema = "resref string, type int, content binary"
    named = lambda df, key, name, sign: df.select(F.concat(F.lit(sign), F.call_function("div", key, F.lit(500)).cast("string")).alias("resref"), (F.col(key) % 500).cast("int").alias("i"), F.col(name).alias("name"))
    names = named(part, "p_partkey", "p_name", "tp").union(named(supplier, "s_suppkey", "s_name", "tc"))
    made = [part.mapInPandas(spell, schema), supplier.mapInPandas(creature, schema), names.groupBy("resref").applyInPandas(table, schema)]
    return reduce(DataFrame.union, made)


def archive_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spells read out of archives by byte range, decoded, with their names from string tables and what their features strip."""
    folder = shared_folder(spark)
    try:
        index = archives.pack(_resource_files(spark, sf_dir), folder, per_archive=1000)
        read, told = (archives.read_archives(spark, index).where(F.col("type") == kind) for kind in (SPELL, STRINGS))
        read, told = binary.spells(read), binary.strings_by_file(told).where("text is not null")
        at = F.concat(F.lit("tp"), F.col("identified_strref").cast("string"))
        named = read.withColumn("table", at).join(told, (F.col("table") == told["resref"]) & (F.col("name_strref") == told["strref"])).drop(told["resref"])
        return materialised(named.select(F.substring("resref", 2, 8).cast("long").alias("p_partkey"), F.col("text").alias("p_name"), "level", "type", "school", "feature_reads", F.size("features").alias("n_features"), opcodes.strips(F.col("features")).alias("strips"), opcodes.dispellable(F.lit("protection"), F.col("features")).alias("dispellable")))
    finally:
        dropped(spark, folder)


def archive_creatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creatures read out of archives: signed numbers, saves, names; those of three resrefs alone are asked for beside them."""
    folder = shared_folder(spark)
    try:
        index = archives.pack(_resource_files(spark, sf_dir), folder, per_archive=1000)
        read, told = (archives.read_archives(spark, index).where(F.col("type") == kind) for kind in (CREATURE, STRINGS))
        read, told = binary.creatures(read), binary.strings_by_file(told)
        asked = archives.read_archives(spark, index).where(F.col("resref").isin("c1", "c2", "c3")).select("resref", F.octet_length("content").cast("long").alias("asked_bytes"))
        at = F.concat(F.lit("tc"), F.col("short_name_strref").cast("string"))
        named = read.withColumn("table", at).join(told, (F.col("table") == told["resref"]) & (F.col("name_strref") == told["strref"])).drop(told["resref"])
        named = named.join(asked, "resref", "left")
        return materialised(named.select(F.substring("resref", 2, 8).cast("long").alias("s_suppkey"), F.col("text").alias("s_name"), "ac_natural", "ac_effective", F.col("saves")["death"].alias("death"), F.col("saves")["spells"].alias("spells"), "asked_bytes"))
    finally:
        dropped(spark, folder)


def sort_nulls_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = _table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    joined = _table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left")
    order = api.ordering(api.Query(sort=(("o_totalprice", "desc"), ("c_custkey", "asc"))), tie=("o_orderkey",), allowed=("o_totalprice", "c_custkey"))
    return api.page(joined, order, 200, 20).select("c_custkey", "o_orderkey", "o_totalprice")


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", *[c for c in _LINE if c not in ("l_orderkey", "l_linenumber", "l_shipdate")]]
    kept = last_write_wins(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def fold_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that stand, of every creature of every session."""
    found = _events(spark, sf_dir, STATE)
    rows = resolved(found, known_effects(spark))
    return surviving(observations(rows), clears(found, rows)).select("session", "creature", "name", "category", "source", "id")


def fold_combatants(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = fold_state(_events(spark, sf_dir, STATE), known_effects(spark))
    return folded.select("session", "name", "last_seen_id", "last_seen_clock_ms", "last_action", "died_at_id", F.size("observations").cast("long").alias("n_observations"))


def fold_casting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(spark, sf_dir, STATE)
    begun = found.select(*[F.when(F.col("kind") == "status", "cast_start").otherwise(F.col("kind")).alias("kind") if c == "kind" else F.when(F.col("kind") == "status", F.col("raw")).otherwise(F.col("detail")).alias("detail") if c == "detail" else F.col(c) for c in found.columns])
    return casting(begun, resolved(begun, known_effects(spark))).select("session", "creature", "casting")


def saves_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saves(_events(spark, sf_dir)).select("session", "creature", "category", "count", "roll", "id", "worst")


def attribution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.attribution(_events(spark, sf_dir))


def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides.edge_weights(sides.hostile_edges(_events(spark, sf_dir)))


def resolve_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of all names; the roster is the actor of each session's first damage."""
    found = _events(spark, sf_dir)
    roster = found.where("kind = 'damage'").groupBy("session").agg(F.min_by("actor", "ord").alias("name"))
    return sides.resolve_sides(found, roster).select("session", "name", "side", "summon")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), F.col("p_type").alias("category"), F.array("p_size", (F.lit(100) + F.col("p_partkey") % 7).cast("int"), (F.lit(500) + F.length("p_type")).cast("int")).alias("opcodes"))


def vote_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = opcodes.votes(_labelled(spark, sf_dir), support=2, purity=0.3)
    return voted.select("opcode", "category", F.round("purity", 6).alias("purity"), "support")


def vote_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark, sf_dir)
    done = opcodes.classify(labelled.select("label", "opcodes"), opcodes.votes(labelled, purity=0.3), confidence=0.5)
    return done.select("label", "predicted", F.round("confidence", 6).alias("confidence"))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opcodes.accuracy(opcodes.leave_one_out(_labelled(spark, sf_dir), purity=0.3, confidence=0.5))


def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = computed_once(_table(spark, sf_dir, "documents").select("doc_id", "text"), plain=normalise(F.col("text")))
    return made.select("doc_id", F.md5(F.col("plain").cast("binary")).alias("md5"), F.length("plain").cast("long").alias("n"))


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" /home/user/x 76561234567890123 Steam ID: 123456"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(redacted(text, "/home/user").cast("binary")).alias("md5"))


def effect_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _events(spark, sf_dir, STATE).where("kind in ('spell', 'status')")
    texts = found.select("id", F.coalesce("detail", F.regexp_extract("raw", "^[^:]*: (.*)$", 1)).alias("text"))
    return with_effect(texts, "text", keyed(hand_effects(spark))).select("id", F.col("known.name").alias("name"), F.col("known.category").alias("category"))


def declined_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _events(spark, sf_dir).where("kind = 'spell'").union(_events(spark, sf_dir, STATE).where("kind = 'spell'")).select("detail").distinct()
    return names.join(declined(spark), name_key(F.col("detail")) == F.col("key"), "left_anti").select("detail")


def priority_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = _table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("resref"), F.col("s_name").alias("name"))
    base = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("resref"), F.col("c_name").alias("name"))
    return resolve_sources([("override", over), ("archive", base)]).select("resref", "name", "provenance")


def roster_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(_table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        damage_by_actor, classify_lines, classify_histogram, link_critical, link_cast, link_probe_target, asof_targets, group_window_page, facets_self_excluding, search_any_column,
        sort_nulls_last_page, upsert_last_wins, fold_observations, fold_combatants, fold_casting, saves_by_category, attribution_audit, edge_weights, resolve_sides, vote_purity,
        vote_classify, leave_one_out, normalise_text, redaction, effect_lookup, declined_anti, priority_resolution, roster_union,
        search_events, classify_all_rules, kind_summary, link_default_windows, unattributed_damage, attribution_by_detail, groups_by_spell, events_sorted_page, top_texts,
        session_bounds, coverage_by_category, roster_names, stats_targets, side_labels, save_verdicts, link_streamed, archive_spells, archive_creatures,
        fold_range, group_window_deep, events_deep_page, observed_counts, groups_in_order, search_index, wire_prefixes, lasting_statuses, page_accounting,
    )
}


# --- the same in SQL --------------------------------------------------------

_KIND = "CASE event_type WHEN 'click' THEN 'attack' WHEN 'view' THEN 'spell' WHEN 'purchase' THEN 'damage' WHEN 'signup' THEN 'critical' ELSE 'save' END"
_BEFORE = "OVER (PARTITION BY session, a ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LINKED = f"""(SELECT *, {_KIND} AS kind,
  last_value(CASE WHEN event_type = 'signup' THEN id END IGNORE NULLS) {_BEFORE} AS armed,
  last_value(CASE WHEN event_type = 'purchase' THEN id END IGNORE NULLS) {_BEFORE} AS hit,
  last_value(CASE WHEN event_type = 'view' THEN id END IGNORE NULLS) {_BEFORE} AS cast_id,
  last_value(CASE WHEN event_type = 'view' THEN s END IGNORE NULLS) {_BEFORE} AS cast_s,
  last_value(CASE WHEN event_type = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY session, a ORDER BY id) AS needed
 FROM ({FIGHT}) f)"""
_CRITICAL = f"CASE WHEN event_type = 'purchase' AND id - armed <= {WITHIN} AND (hit IS NULL OR hit < armed) THEN 1 ELSE 0 END"
_CANDIDATE = f"CASE WHEN event_type = 'purchase' AND id - cast_id <= {WITHIN} THEN cast_s END"
_TARGET = "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN b END"
_MEASURES = f"""count(*) AS events, CAST(coalesce(sum(CASE WHEN kind = 'damage' THEN n END), 0) AS BIGINT) AS damage, CAST(0 AS BIGINT) AS resisted, CAST(0 AS BIGINT) AS xp, CAST(sum(crit) AS BIGINT) AS crits,
  CAST(coalesce(sum(CASE WHEN kind = 'damage' AND crit = 1 THEN n END), 0) AS BIGINT) AS crit_damage, count(CASE WHEN kind = 'save' THEN 1 END) AS saves, CAST(0 AS BIGINT) AS failed, min(CASE WHEN kind = 'save' THEN n END) AS worst_save"""
_WITH_CRIT = f"(SELECT *, {_CRITICAL} AS crit FROM {_LINKED} l)"


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


def _effects_sql() -> str:
    rows = []
    for name, alias, category, blocks, dispellable, strips, _, _ in _effect_rows():
        rows += [(key.lower(), name, category, " ".join(blocks), dispellable, strips) for key in (name, alias) if key]
    return f"(SELECT * FROM (VALUES {_values(rows)}) v(key, name, category, blocks, dispellable, strips))"


_AIMED = {c: f"last_value(CASE WHEN event_type = 'purchase' AND n % 2 = 0 THEN {c} END IGNORE NULLS) {_BEFORE}" for c in ("id", "b")}
_STATE_LINKED = f"""(SELECT *, CASE event_type WHEN 'click' THEN 'spell' WHEN 'error' THEN 'spell' WHEN 'view' THEN 'status' WHEN 'signup' THEN 'death' ELSE CASE WHEN n % 2 = 0 THEN 'attack' ELSE 'immune' END END AS kind,
  CASE WHEN event_type IN ('click', 'error') THEN split_part(split_part(text, ': Casts ', 2), ' : ', 1) WHEN event_type = 'view' THEN split_part(text, ': ', 2) END AS detail,
  {_AIMED['id']} AS aimed_id, {_AIMED['b']} AS aimed FROM ({STATE}) f)"""
_STATE_ROWS = f"""(SELECT r.*, e.name, e.category, e.blocks, e.dispellable, e.strips FROM (
  SELECT session, id, a, kind, CASE WHEN kind = 'spell' THEN b WHEN kind = 'status' THEN a WHEN id - aimed_id <= {WITHIN} THEN aimed END AS creature,
         CASE WHEN kind = 'immune' THEN 'Protection From Magical Weapons' ELSE detail END AS what FROM {_STATE_LINKED} l WHERE kind IN ('spell', 'status', 'immune')) r
  LEFT JOIN {_effects_sql()} e ON e.key = lower(r.what))"""
_CLEARS = f"(SELECT session, a AS creature, id, 'all' AS class FROM {_STATE_LINKED} l WHERE kind = 'death' UNION ALL SELECT session, creature, id, strips FROM {_STATE_ROWS} r WHERE category = 'dispel')"
_STANDING = f"""(SELECT session, creature, name, category, CASE kind WHEN 'spell' THEN 'cast' WHEN 'immune' THEN 'probe' ELSE 'effect' END AS source, id FROM {_STATE_ROWS} o
  WHERE category <> 'dispel' AND creature IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_CLEARS} c WHERE c.session = o.session AND c.creature = o.creature AND c.id > o.id
    AND (c.class = 'all' OR (c.class = 'dispellable' AND o.dispellable) OR (c.class = 'spell-protections' AND o.blocks LIKE '%spells%') OR (c.class = 'concealment' AND o.blocks LIKE '%vision%')
         OR (c.class = 'combat-protections' AND (o.blocks LIKE '%melee%' OR o.blocks LIKE '%ranged%' OR o.blocks LIKE '%weapons%' OR o.blocks LIKE '%physical%'))))
  QUALIFY row_number() OVER (PARTITION BY session, creature, name ORDER BY id DESC) = 1)"""
_PARTS = f"(SELECT session, a AS name, id FROM {_STATE_LINKED} l UNION ALL SELECT session, CASE WHEN kind IN ('spell', 'attack') THEN b WHEN kind = 'immune' AND id - aimed_id <= {WITHIN} THEN aimed END, id FROM {_STATE_LINKED} l)"
_PART = "(SELECT p_partkey AS label, p_type AS category, unnest(list_distinct([p_size, CAST(100 + p_partkey % 7 AS INT), CAST(500 + length(p_type) AS INT)])) AS opcode FROM part)"
_PART_KEPT = f"(SELECT * FROM {_PART} x WHERE opcode NOT IN {opcodes.SILENT})"
_RATES = f"(SELECT opcode, c.category, n, size, n / size AS rate FROM (SELECT opcode, category, count(*) AS n FROM {_PART_KEPT} x GROUP BY 1, 2) c JOIN (SELECT p_type AS category, count(*) AS size FROM part GROUP BY 1) s USING (category))"
_VOTES = f"(SELECT opcode, arg_min(category, (-rate, category)) AS category, max(rate) / sum(rate) AS purity, CAST(sum(n) AS BIGINT) AS support FROM {_RATES} r GROUP BY opcode HAVING sum(n) >= 2 AND max(rate) / sum(rate) >= 0.3)"
_WEIGHTS = f"(SELECT label, v.category, sum(purity) AS w FROM {_PART_KEPT} x JOIN {_VOTES} v USING (opcode) GROUP BY 1, 2)"
_GUESS = f"(SELECT label, arg_min(category, (-w, category)) AS best, max(w) / sum(w) AS confidence FROM {_WEIGHTS} w GROUP BY label)"
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x0B]"
_NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\^(?:0x[0-9A-Fa-f]{{8}}|#[0-9A-Fa-f]{{6,8}}|-)', '', 'g'), '[\x00-\x1F\x7F-\x{{9F}}]', ' ', 'g'), '{_SPACE}+', ' ', 'g'), '^ +| +$', '', 'g')"
_LOO = f"""WITH x AS {_PART_KEPT}, c AS (SELECT opcode, category, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT p_type AS category, count(*) AS size FROM part GROUP BY 1),
 r AS (SELECT x.label AS item, x.category AS mine, x.opcode, c.category, c.n - CAST(c.category = x.category AS INT) AS n, s.size - CAST(c.category = x.category AS INT) AS size FROM x JOIN c USING (opcode) JOIN s ON s.category = c.category),
 q AS (SELECT *, n / size AS rate FROM r WHERE n > 0), b AS (SELECT item, opcode, arg_min(category, (-rate, category)) AS category, max(rate) / sum(rate) AS p FROM q GROUP BY 1, 2 HAVING sum(n) >= 2 AND max(rate) / sum(rate) >= 0.3),
 w AS (SELECT item, category, sum(p) AS w FROM b GROUP BY 1, 2), g AS (SELECT item, arg_min(category, (-w, category)) AS best, max(w) / sum(w) AS confidence FROM w GROUP BY 1),
 t AS (SELECT p_type AS category, CASE WHEN confidence >= 0.5 THEN best END AS predicted FROM part LEFT JOIN g ON item = p_partkey)
 SELECT count(*) FILTER (predicted = category) AS correct, count(*) FILTER (predicted <> category) AS wrong, count(*) FILTER (predicted IS NULL) AS abstained FROM t"""

_DENSE_LINKED = f"""(SELECT *, last_value(CASE WHEN event_type = 'signup' AND k % 3 <> 0 THEN id END IGNORE NULLS) {_BEFORE} AS armed,
  last_value(CASE WHEN event_type = 'purchase' THEN id END IGNORE NULLS) {_BEFORE} AS hit,
  last_value(CASE WHEN event_type = 'view' THEN id END IGNORE NULLS) {_BEFORE} AS cast_id, last_value(CASE WHEN event_type = 'view' THEN s END IGNORE NULLS) {_BEFORE} AS cast_s,
  last_value(CASE WHEN event_type = 'click' THEN id END IGNORE NULLS) {_BEFORE} AS aimed_id, last_value(CASE WHEN event_type = 'click' THEN b END IGNORE NULLS) {_BEFORE} AS aimed FROM ({DENSE}) f)"""
_DENSE_ROWS = f"""(SELECT *, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN b WHEN event_type = 'error' AND id - aimed_id <= 12 THEN aimed END AS target,
  CASE WHEN event_type = 'purchase' AND id - armed <= 10 AND (hit IS NULL OR hit < armed) THEN 1 ELSE 0 END AS crit,
  CASE WHEN event_type = 'purchase' AND id - cast_id <= 60 THEN cast_s END AS candidate, CASE WHEN event_type = 'purchase' AND kind_of = 'magic' AND id - cast_id <= 60 THEN cast_s END AS spell FROM {_DENSE_LINKED} l)"""
_PARTY_KIND = "CASE WHEN event_type = 'click' THEN 'attack' WHEN event_type = 'view' THEN 'spell' WHEN event_type = 'purchase' AND k % 5 <> 0 THEN 'damage' WHEN event_type = 'error' THEN 'save' END"
_PARTY_ROWS = f"""(SELECT *, CASE WHEN kind IN ('attack', 'save') THEN a WHEN kind = 'spell' THEN b WHEN kind = 'damage' THEN 'Hero' END AS actor,
  CASE WHEN kind = 'attack' THEN 'Hero' WHEN kind = 'spell' THEN b WHEN kind = 'damage' THEN a END AS target FROM (SELECT *, {_PARTY_KIND} AS kind FROM ({PARTY}) f) p)"""
_PARTY_SIDES = f"""(SELECT DISTINCT session, a AS name, 'opponent' AS side FROM {_PARTY_ROWS} r WHERE kind IN ('attack', 'damage') AND session IN (SELECT session FROM {_PARTY_ROWS} r WHERE kind IS NULL AND event_type = 'purchase')
  UNION ALL SELECT DISTINCT session, 'Hero', 'party' FROM {_PARTY_ROWS} r WHERE kind IS NULL AND event_type = 'purchase')"""
_PARTY_STATS = f"""(SELECT session, id AS ord, coalesce(last_value(CASE WHEN kind IS NOT NULL THEN id END IGNORE NULLS) OVER (PARTITION BY session ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS as_of_id,
  event_type, a AS name, k AS spell, n AS breath FROM {_PARTY_ROWS} r)"""
_WORSE = "min(CASE WHEN FALSE THEN n END)"

_FOLD_RANGE = f"""WITH e AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'attack' WHEN 'view' THEN 'spell' WHEN 'purchase' THEN CASE WHEN k % 5 = 0 THEN NULL ELSE 'damage' END WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'death' ELSE 'cast_start' END ELSE 'save' END AS kind,
   CASE WHEN event_type = 'view' THEN CASE WHEN k % 3 = 0 THEN 'Hero' ELSE b END WHEN event_type = 'purchase' THEN 'Hero' ELSE a END AS actor,
   CASE event_type WHEN 'click' THEN 'Hero' WHEN 'view' THEN b WHEN 'purchase' THEN a END AS target,
   CASE k % 4 WHEN 0 THEN 'Haste' WHEN 1 THEN 'Stoneskin' WHEN 2 THEN 'Mirror Image' ELSE 'Dispel Magic' END AS spell_name,
   CASE WHEN k % 2 = 0 THEN 'Spell' ELSE 'Wand' END AS category FROM ({RANGED}) f),
 s AS (SELECT max(session) AS session FROM e WHERE kind IS NOT NULL),
 bounds AS (SELECT min(id) AS low, max(id) AS high FROM e JOIN s USING (session) WHERE kind IS NOT NULL),
 r AS (SELECT e.* FROM e JOIN s USING (session), bounds WHERE kind IS NOT NULL AND id BETWEEN high - least({RANGE_TO}, high - low) AND high - least({RANGE_FROM}, high - low)),
 listed AS (SELECT count(*) > 0 AS yes FROM e JOIN s USING (session) WHERE kind IS NULL),
 foes AS (SELECT DISTINCT a AS name FROM e JOIN s USING (session) WHERE kind IN ('attack', 'damage')),
 parts AS (SELECT actor AS name, id, 0 AS role FROM r UNION ALL SELECT target, id, 1 FROM r WHERE target IS NOT NULL),
 seen AS (SELECT name, max(id) AS last FROM parts GROUP BY name),
 known AS (SELECT key, any_value(name) AS effect, any_value(e2.category) AS effect_category, any_value(dispellable) AS can FROM {_effects_sql()} e2 GROUP BY key),
 cast_ AS (SELECT r.id, target AS name, effect, effect_category, can FROM r JOIN known ON known.key = lower(spell_name) WHERE kind = 'spell'),
 ends AS (SELECT actor AS name, id, TRUE AS every FROM r WHERE kind = 'death' UNION ALL SELECT name, id, FALSE FROM cast_ WHERE effect_category = 'dispel'),
 standing AS (SELECT name, effect, max(effect_category) AS effect_category, max(id) AS id FROM cast_ c WHERE effect_category <> 'dispel'
   AND NOT EXISTS (SELECT 1 FROM ends x WHERE x.name = c.name AND x.id > c.id AND (x.every OR c.can)) GROUP BY name, effect),
 obs AS (SELECT name, string_agg(concat_ws(':', effect, effect_category, 'cast', CAST(id AS VARCHAR)), ',' ORDER BY id DESC, effect DESC) AS observations FROM standing GROUP BY name),
 rolled AS (SELECT actor AS name, category, count(*) AS c, arg_max(n, id) AS roll, min(n) AS worst, max(id) AS id FROM r WHERE kind = 'save' GROUP BY ALL),
 saves AS (SELECT name, string_agg(concat_ws(':', category, CAST(c AS VARCHAR), CAST(roll AS VARCHAR), CAST(worst AS VARCHAR), CAST(id AS VARCHAR)), ',' ORDER BY id DESC, category DESC) AS saves FROM rolled GROUP BY name),
 begun AS (SELECT name, arg_max(what, o) AS casting FROM (SELECT actor AS name, id * 10 AS o, 'Web' AS what FROM r WHERE kind = 'cast_start' UNION ALL SELECT actor, id * 10 + 1, '' FROM r WHERE kind = 'spell' UNION ALL SELECT name, id * 10 + 2, '' FROM ends) b GROUP BY name),
 hasted AS (SELECT count(*) > 0 AS yes FROM r, listed WHERE listed.yes AND kind = 'spell' AND actor = 'Hero' AND spell_name = 'Haste'),
 called AS (SELECT DISTINCT 'U' || translate(CAST(user_id AS VARCHAR), '0123456789', 'abcdefghij') AS name FROM events WHERE user_id % 4 = 0),
 told AS (SELECT seen.name, last, CASE WHEN NOT (SELECT yes FROM listed) THEN 'neutral' WHEN seen.name = 'Hero' THEN 'party' WHEN seen.name IN (SELECT name FROM foes) THEN 'opponent' ELSE 'neutral' END AS side FROM seen)
 SELECT CASE side WHEN 'opponent' THEN 'opponents' ELSE side END AS view, told.name, side, FALSE AS is_summon, last AS last_seen_id, 1000 * ((SELECT max(id) FROM r) - last) AS age_ms,
  1000 * ((SELECT max(id) FROM r) - last) > 60000 AS stale, nullif(casting, '') AS casting,
  CASE WHEN EXISTS (SELECT 1 FROM r WHERE kind = 'attack' AND actor = told.name) THEN 'attacking Hero' END AS last_action,
  (SELECT max(id) FROM r WHERE kind = 'death' AND actor = told.name) AS died_at_id,
  CASE WHEN side = 'opponent' AND (SELECT yes FROM hasted) AND told.name IN (SELECT name FROM called) THEN 'Haste' END AS also_summoned_by,
  coalesce(observations, '') AS observations, coalesce(saves, '') AS saves
 FROM told LEFT JOIN obs USING (name) LEFT JOIN saves USING (name) LEFT JOIN begun USING (name)"""

ORACLE_SQL: dict[str, str] = {
    "search_events": f"""SELECT id, {_KIND} AS kind, CASE event_type WHEN 'view' THEN s WHEN 'purchase' THEN 'magic' WHEN 'signup' THEN 'Hit' WHEN 'error' THEN 'Spell' END AS detail, {_CANDIDATE} AS spell
 FROM {_LINKED} l WHERE event_type <> 'click' AND (lower(text) LIKE '%fireb_ll%' OR coalesce(lower({_CANDIDATE}), '') LIKE '%fireb_ll%')""",
    "classify_all_rules": "SELECT id, " + ", ".join(f"{_by_kind([chr(39) + x[1] + chr(39) if c == 1 else x[c] for x in KINDS_OF_LINES])} AS {n}" for c, n in enumerate(("", "kind", "actor", "target", "amount", "roll", "resisted", "detail")) if n) + f" FROM ({_BASE}) base",
    "kind_summary": f"SELECT {_by_kind([chr(39) + x[1] + chr(39) for x in KINDS_OF_LINES])} AS kind, count(*) AS n FROM ({_BASE}) base GROUP BY 1",
    "link_default_windows": f"SELECT session, id, target, crit AS critical, spell, candidate AS spell_candidate FROM {_DENSE_ROWS} d",
    "fold_range": _FOLD_RANGE,
    "wire_prefixes": f"""SELECT session, id, CASE WHEN id % {len(PREFIXES)} = 1 THEN '2024-05-06 07:08:09.' || CAST(100 + id % 900 AS VARCHAR) END AS wall_clock, CASE WHEN ticks <> ' ' THEN id * 3 END AS game_ticks, CAST(NULL AS BIGINT) AS clock_ms,
  'day 1' AS game_time, 'world' AS screen, 'x y' AS raw FROM ({PREFIXED}) p WHERE id % {len(PREFIXES)} NOT IN ({", ".join(str(i) for i, x in enumerate(PREFIXES) if not x[1])})""",
    "lasting_statuses": f"""SELECT name, category, 'effect' AS source, count(*) AS n, count(DISTINCT (session, creature)) AS creatures FROM (
  SELECT session, {_by_kind([x[1] for x in STATUSES])} AS name, {_by_kind([x[2] for x in STATUSES])} AS category, CASE WHEN text LIKE 'Hinter %' THEN 'Hinter ' || b ELSE a END AS creature FROM ({STATED}) s) t
 WHERE name IS NOT NULL GROUP BY name, category""",
    "page_accounting": f"""WITH r AS (SELECT session, id, {_by_kind(["'" + x[1] + "'" for x in KINDS_OF_LINES])} AS kind, {_by_kind([x[6] for x in KINDS_OF_LINES])} AS resisted FROM ({_BASE}) base),
 m AS (SELECT * FROM r WHERE kind NOT IN ('pause', 'other'))
 SELECT session, id, resisted, 'resisted' AS empty_column, (SELECT count(resisted) FROM m) AS total, (SELECT count(*) - count(resisted) FROM m) AS hidden_empty, (SELECT count(*) FROM r WHERE kind = 'resync') AS gaps, CAST(30 AS BIGINT) AS "limit"
 FROM m WHERE resisted IS NOT NULL ORDER BY resisted, id DESC LIMIT 30""",
    "search_index": f"SELECT session, id, 'damage' AS kind, a AS actor, text AS raw FROM ({FIGHT}) f WHERE event_type = 'purchase' AND lower(text) LIKE '%damage from ubc%'",
    "group_window_deep": f"SELECT key, events, damage, crits, saves FROM (SELECT a AS key, {_MEASURES} FROM (SELECT * FROM {_WITH_CRIT} c ORDER BY session DESC, id DESC LIMIT 1000000 OFFSET 37) w GROUP BY a) g",
    "events_deep_page": f"""SELECT session, id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN b END AS target, text AS raw FROM ({FIGHT}) f
  ORDER BY CASE WHEN event_type IN ('click', 'view', 'purchase') THEN b END ASC NULLS LAST, text DESC NULLS LAST, session DESC, id DESC LIMIT 50 OFFSET 5000""",
    "observed_counts": f"""WITH k AS (SELECT {_by_kind([chr(39) + x[1] + chr(39) for x in KINDS_OF_LINES])} AS kind FROM ({_BASE}) base)
 SELECT v.key, CASE v.key WHEN 'lines' THEN (SELECT count(*) FROM k) WHEN 'marked' THEN (SELECT count(*) FROM k) WHEN 'errors' THEN 0 WHEN 'unmarked' THEN 0 ELSE (SELECT count(*) FROM k WHERE kind = v.key) END AS n
 FROM (VALUES {", ".join(f"('{k}')" for k in ("lines", "errors", "marked", "unmarked", *KINDS))}) v(key)""",
    "groups_in_order": """SELECT p_partkey, name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY regexp_replace(regexp_replace(name, '([0-9]+)', '000000000000\\1', 'g'), '0*([0-9]{12})', '\\1', 'g'), p_partkey) AS INTEGER) AS place
 FROM (SELECT p_partkey, p_brand, concat_ws(' ', p_type, CAST(p_size AS VARCHAR), p_name) AS name FROM part) p""",
    "archive_spells": """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS level, CASE p_size % 6 WHEN 0 THEN 'special' WHEN 1 THEN 'wizard' WHEN 2 THEN 'priest' WHEN 3 THEN 'psionic' WHEN 4 THEN 'innate' ELSE 'bardsong' END AS type,
  CASE p_size % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'abjurer' WHEN 2 THEN 'conjurer' WHEN 3 THEN 'diviner' WHEN 4 THEN 'enchanter' WHEN 5 THEN 'illusionist' WHEN 6 THEN 'invoker' WHEN 7 THEN 'necromancer' WHEN 8 THEN 'transmuter' ELSE 'generalist' END AS school,
  CAST(3 AS INTEGER) AS feature_reads, CAST(1 AS INTEGER) AS n_features,
  CASE WHEN length(p_type) % 2 = 1 THEN 'dispellable' WHEN p_size % 3 = 1 THEN 'spell-protections' WHEN p_size % 3 = 2 THEN 'combat-protections' END AS strips, p_partkey % 2 = 1 AS dispellable FROM part""",
    "archive_creatures": """SELECT s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS ac_natural, CAST(-s_nationkey AS INTEGER) AS ac_effective, CAST(s_nationkey AS INTEGER) AS death, CAST(s_nationkey - 4 AS INTEGER) AS spells,
  CASE WHEN s_suppkey IN (1, 2, 3) THEN CAST(640 AS BIGINT) END AS asked_bytes FROM supplier""",
    "link_streamed": f"SELECT session, id, target, crit AS critical, spell, candidate AS spell_candidate FROM {_DENSE_ROWS} d",
    "unattributed_damage": f"SELECT kind_of AS detail, candidate AS spell_candidate, count(*) AS n FROM {_DENSE_ROWS} d WHERE candidate IS NOT NULL AND spell IS NULL GROUP BY 1, 2",
    "attribution_by_detail": f"SELECT kind_of AS detail, count(*) AS total, count(candidate) AS after_cast, count(spell) AS attributed FROM {_DENSE_ROWS} d WHERE event_type = 'purchase' GROUP BY 1",
    "groups_by_spell": f"""SELECT coalesce(spell, '(none)') AS key, count(*) AS events, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN n END), 0) AS BIGINT) AS damage, CAST(0 AS BIGINT) AS resisted, CAST(0 AS BIGINT) AS xp,
  CAST(sum(crit) AS BIGINT) AS crits, CAST(coalesce(sum(CASE WHEN crit = 1 THEN n END), 0) AS BIGINT) AS crit_damage, CAST(0 AS BIGINT) AS saves, CAST(0 AS BIGINT) AS failed, {_WORSE} AS worst_save FROM {_DENSE_ROWS} d GROUP BY 1""",
    "events_sorted_page": f"SELECT session, id, n AS amount, b AS target FROM ({FIGHT}) f WHERE event_type = 'purchase' ORDER BY n DESC NULLS LAST, b ASC NULLS LAST, session DESC, id DESC LIMIT 40 OFFSET 7",
    "top_texts": f"SELECT text AS raw, count(*) AS n FROM ({STATE}) f WHERE event_type = 'view' GROUP BY text ORDER BY n DESC, raw LIMIT 25",
    "session_bounds": f"SELECT session, min(id) AS low, max(id) AS high, count(*) AS n FROM ({STATE}) f GROUP BY session",
    "coverage_by_category": f"SELECT category, count(*) AS n FROM {_STANDING} s GROUP BY category",
    "roster_names": f"SELECT session, id AS ord, 'Hero' AS name FROM ({PARTY}) f WHERE event_type = 'purchase' AND k % 5 = 0",
    "stats_targets": f"SELECT session, ord, as_of_id, name, spell, breath FROM {_PARTY_STATS} s WHERE event_type = 'signup'",
    "side_labels": f"""SELECT r.session, id, actor, target, coalesce(x.side, 'neutral') AS actor_side, CASE WHEN target IS NOT NULL THEN coalesce(y.side, 'neutral') END AS target_side, CAST(NULL AS VARCHAR) AS summon, CAST(NULL AS VARCHAR) AS target_summon
 FROM {_PARTY_ROWS} r LEFT JOIN {_PARTY_SIDES} x ON x.session = r.session AND x.name = actor LEFT JOIN {_PARTY_SIDES} y ON y.session = r.session AND y.name = target WHERE kind IS NOT NULL""",
    "save_verdicts": f"""SELECT r.session, r.id, CAST(r.n >= (SELECT arg_max(spell, ord) FROM {_PARTY_STATS} s WHERE s.event_type = 'signup' AND s.session = r.session AND s.name = r.a AND s.as_of_id <= r.id) AS INT) AS saved
 FROM {_PARTY_ROWS} r WHERE kind = 'save'""",
    "fold_casting": f"""SELECT session, creature, casting FROM (
  SELECT session, a AS creature, id, 0 AS step, text AS casting FROM {_STATE_LINKED} l WHERE kind = 'status'
  UNION ALL SELECT session, a, id, 1, NULL FROM {_STATE_LINKED} l WHERE kind = 'spell' UNION ALL SELECT session, creature, id, 2, NULL FROM {_CLEARS} c) x
 QUALIFY row_number() OVER (PARTITION BY session, creature ORDER BY id DESC, step DESC) = 1""",
    "damage_by_actor": f"SELECT a AS key, count(*) AS events, CAST(sum(n) AS BIGINT) AS damage, CAST(sum(crit) AS BIGINT) AS crits, CAST(coalesce(sum(CASE WHEN crit = 1 THEN n END), 0) AS BIGINT) AS crit_damage FROM {_WITH_CRIT} c WHERE kind = 'damage' GROUP BY a",
    "classify_lines": f"SELECT id, {_KIND} AS kind, a AS actor, {_TARGET} AS target, CASE WHEN event_type = 'purchase' THEN n END AS amount, CASE WHEN event_type = 'error' THEN n END AS roll, CASE event_type WHEN 'view' THEN s WHEN 'purchase' THEN 'magic' WHEN 'signup' THEN 'Hit' WHEN 'error' THEN 'Spell' END AS detail FROM ({FIGHT}) f",
    "classify_histogram": f"SELECT {_KIND} AS kind, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS share FROM ({FIGHT}) f GROUP BY 1",
    "link_critical": f"SELECT id, crit AS critical FROM {_WITH_CRIT} c WHERE kind = 'damage'",
    "link_cast": f"SELECT id, {_CANDIDATE} AS spell, {_CANDIDATE} AS spell_candidate FROM {_LINKED} l WHERE kind = 'damage'",
    "link_probe_target": f"SELECT id, a AS actor, CASE WHEN id - aimed_id <= {WITHIN} THEN aimed END AS target FROM {_STATE_LINKED} l WHERE kind = 'immune'",
    "asof_targets": f"SELECT id, n AS roll, needed AS save_target, CAST(n >= needed AS INT) AS made FROM {_LINKED} l WHERE kind = 'save'",
    "group_window_page": f"SELECT kind AS key, {_MEASURES} FROM (SELECT * FROM {_WITH_CRIT} c ORDER BY session DESC, id DESC LIMIT 500 OFFSET 100) w GROUP BY kind",
    "facets_self_excluding": f"""WITH f AS (SELECT session, {_KIND} AS kind, CASE event_type WHEN 'view' THEN s WHEN 'purchase' THEN 'magic' WHEN 'signup' THEN 'Hit' WHEN 'error' THEN 'Spell' END AS detail FROM ({FIGHT}) f)
 SELECT 'session' AS dimension, session AS key, count(*) AS n FROM f WHERE kind = 'damage' AND detail = 'magic' AND kind NOT IN ('save') GROUP BY session
 UNION ALL SELECT 'kind', kind, count(*) FROM f WHERE detail = 'magic' AND kind NOT IN ('save') GROUP BY kind
 UNION ALL SELECT 'detail', detail, count(*) FROM f WHERE kind = 'damage' AND kind NOT IN ('save') GROUP BY detail""",
    "search_any_column": "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%ed%' OR lower(p_brand) LIKE '%ed%' OR lower(p_type) LIKE '%ed%'",
    "sort_nulls_last_page": "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey ORDER BY o_totalprice DESC NULLS LAST, c_custkey ASC NULLS LAST, o_orderkey DESC NULLS LAST LIMIT 200 OFFSET 20",
    "upsert_last_wins": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, {', '.join(c + ' DESC' for c in _LINE if c not in ('l_orderkey', 'l_linenumber', 'l_shipdate'))}) = 1",
    "fold_observations": f"SELECT session, creature, name, category, source, id FROM {_STANDING} s",
    "fold_combatants": f"""SELECT p.session, p.name, max(p.id) AS last_seen_id, max(p.id) * 1000 AS last_seen_clock_ms,
  (SELECT 'attacking ' || arg_max(b, id) FROM {_STATE_LINKED} l WHERE l.session = p.session AND l.a = p.name AND l.kind = 'attack' HAVING count(*) > 0) AS last_action,
  (SELECT max(id) FROM {_STATE_LINKED} l WHERE l.session = p.session AND l.a = p.name AND l.kind = 'death') AS died_at_id,
  (SELECT count(*) FROM {_STANDING} s WHERE s.session = p.session AND s.creature = p.name) AS n_observations
 FROM {_PARTS} p WHERE p.name IS NOT NULL GROUP BY p.session, p.name""",
    "saves_by_category": f"SELECT session, a AS creature, 'Spell' AS category, count(*) AS count, arg_max(n, id) AS roll, max(id) AS id, min(n) AS worst FROM ({FIGHT}) f WHERE event_type = 'error' GROUP BY 1, 2",
    "attribution_audit": f"SELECT 'magic' AS detail, count(*) AS total, count({_CANDIDATE}) AS after_cast, count({_CANDIDATE}) AS attributed FROM {_LINKED} l WHERE kind = 'damage'",
    "edge_weights": f"WITH e AS (SELECT session, a, b, count(*) AS n FROM ({FIGHT}) f WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2, 3) SELECT session, a, b, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT session, a, b, n FROM e UNION ALL SELECT session, b, a, n FROM e) x GROUP BY 1, 2, 3",
    "vote_purity": f"SELECT opcode, category, round(purity, 6) AS purity, support FROM {_VOTES} v",
    "vote_classify": f"SELECT p_partkey AS label, CASE WHEN confidence >= 0.5 THEN best END AS predicted, round(confidence, 6) AS confidence FROM part LEFT JOIN {_GUESS} g ON label = p_partkey",
    "leave_one_out": _LOO,
    "normalise_text": f"SELECT doc_id, md5({_NORMAL}) AS md5, length({_NORMAL}) AS n FROM documents",
    "redaction": "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text || ' /home/user/x 76561234567890123 Steam ID: 123456', '/home/user', '~'), '\\b7656[0-9]{13}\\b', '<account>', 'g'), '(?i)(Steam ID:\\s*)[0-9]{5,}', '\\1<account>', 'g')) AS md5 FROM documents",
    "effect_lookup": f"SELECT l.id, e.name, e.category FROM {_STATE_LINKED} l LEFT JOIN {_effects_sql()} e ON e.key = lower(l.detail) WHERE l.kind IN ('spell', 'status')",
    "declined_anti": f"SELECT DISTINCT detail FROM {_STATE_LINKED} l WHERE kind = 'spell'",
    "priority_resolution": "SELECT resref, name, provenance FROM (SELECT CAST(s_suppkey AS VARCHAR) AS resref, s_name AS name, 'override' AS provenance, 0 AS r FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, 'archive', 1 FROM customer) x QUALIFY row_number() OVER (PARTITION BY resref ORDER BY r) = 1",
    "roster_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
}
