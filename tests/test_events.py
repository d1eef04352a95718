"""Classification, links, sides, folds and the query API on short logs."""

import pytest
from pyspark.sql import functions as F

from strandline.functions.rules import classify
from strandline.operators.fold import fold_state
from strandline.operators.knowledge import declined, known_effects
from strandline.operators.links import link_events, save_targets
from strandline.operators.sides import edge_weights, hostile_edges, resolve_sides
from strandline.plans import api, chains, reports
from strandline.sources.logs import events, read_session_logs, roster, stats
from strandline.streaming.live import capture_raw, derive, derive_live, link_actor, link_stream

# text, kind, actor, target, amount, roll, resisted, detail
LINES = [
    ("Vampire: Takes 13 slashing damage from Tyras", "damage", "Tyras", "Vampire", 13, None, None, "slashing"),
    ("Alarion: Takes 18 crushing damage from Vampire (9 damage bonus)", "damage", "Vampire", "Alarion", 18, None, None, "crushing"),
    ("Jaheira: Takes 2 slashing damage from Goblin (4 damage resisted)", "damage", "Goblin", "Jaheira", 2, None, 4, "slashing"),
    ("Tyras: When the berserk state ends, the character will take 15 damage.", "dialogue", "Tyras", None, None, None, None, None),
    ("Attack Roll 6 + 2 = 8 : Miss", "attack", None, None, None, 8, None, "Miss"),
    ("Goblin: Roll:13 +Luck:0 +SpecialAC:0", "tohit", "Goblin", None, None, 13, None, None),
    ("Goblin: Roll:3 +DamageMod:0", "damageroll", "Goblin", None, None, 3, None, None),
    ("Attacks Lesser Clay Golem", "attack", None, "Lesser Clay Golem", None, None, None, None),
    ("Rurik: Spell Failed: Casting Failure", "miscast", "Rurik", None, None, None, None, "Casting Failure"),
    ("Red Wizard: Casting Mirror Image...", "cast_start", "Red Wizard", None, None, None, None, "Mirror Image"),
    ("Jan: is Casting Improved Invisibility : Anomen", "cast_start", "Jan", "Anomen", None, None, None, "Improved Invisibility"),
    ("Cernd: is Casting : Cat", "cast_start", "Cernd", "Cat", None, None, None, None),
    ("Red Wizard: Casts Mirror Image : Red Wizard", "spell", "Red Wizard", "Red Wizard", None, None, None, "Mirror Image"),
    ("Jaheira: Cambion was immune to my damage.", "immune", "Jaheira", "Cambion", None, None, None, "damage"),
    ("Korgan: Weapon Ineffective.", "immune", "Korgan", None, None, None, None, "weapon"),
    ("Cernd: Save vs. Spell : -1", "save", "Cernd", None, None, -1, None, "Spell"),
    ("Alarion: Yes?", "dialogue", "Alarion", None, None, None, None, None),
    ("Red Wizard: Mirror Imaged", "status", "Red Wizard", None, None, None, None, None),
    ("capture resynced: combatLog was replaced", "resync", None, None, None, None, None, None),
    ("The Party Has Gained Gold: 40", "status", "The Party Has Gained Gold", None, None, None, None, None),
    ("UNPAUSED", "pause", None, None, None, None, None, None),
    ("Auto-Paused: Enemy Sighted", "pause", "Auto-Paused", None, None, None, None, None),
    ("Minsc: Bless : Boo", "effect", "Minsc", "Boo", None, None, None, "Bless"),
    ("Imoen: Level up", "level", "Imoen", None, None, None, None, None),
    ("a line without a speaker", "other", None, None, None, None, None, None),
]


def log(spark, texts, session="s1", extra=()):
    rows = [(session, i, f"A7LOG\t{i + 1}\t{(i + 1) * 60}\t{(i + 1) * 1000}\t\t\t{t}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), "session string, ord int, line string")


def linked(spark, texts, **how):
    return link_events(classify(events(log(spark, texts))), **how)


def test_rules(spark):
    got = classify(events(log(spark, [x[0] for x in LINES]))).orderBy("ord").collect()
    for row, want in zip(got, LINES, strict=True):
        if want[0].startswith("Auto-Paused"):
            assert row.kind in ("pause", "status")
            continue
        assert (row.raw, row.kind, row.actor, row.target, row.amount, row.roll, row.resisted, row.detail) == want


def test_envelope(spark):
    lines = [
        "2026-08-31 00:11:26.976 Game[884:1] INFO: LUA: A7LOG\t5\t\t7000\tnight\tworld\t^0xFF00FF00Minsc:^- \x1b Death\r",
        "\x5eD\b\bA7LOG\t6\t1\t2\t\t\ta\tb",
        "noise A7LOG\t7\t1\t2\t\t\tx",
        "A7LOG\tx\t1\t2\t\t\tx",
        "A7LOG\t8\t1\t2",
    ]
    rows = events(spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, ord int, line string")).orderBy("ord").collect()
    assert [(r.id, r.wall_clock, r.game_ticks, r.clock_ms, r.game_time, r.raw) for r in rows] == [(5, "2026-08-31 00:11:26.976", None, 7000, "night", "Minsc: Death"), (6, None, 1, 2, "", "a b")]


def test_links(spark):
    texts = ["A: Critical Hit", "B: Takes 5 slashing damage from A", "B: Takes 6 slashing damage from A", "A: Casts Fireball : B", "B: Takes 7 magic damage from A", "B: Takes 8 fire damage from A", "A: Attacks C", "A: Weapon Ineffective.", *["x"] * 20, "A: Weapon Ineffective."]
    rows = linked(spark, texts).orderBy("ord").collect()
    assert [r.critical for r in rows[:6]] == [0, 1, 0, 0, 0, 0]
    assert [(r.spell, r.spell_candidate) for r in rows[4:6]] == [("Fireball", "Fireball"), (None, "Fireball")]
    assert rows[7].target == "C" and rows[-1].target is None


def test_stream_linker_agrees(spark):
    import random

    random.seed(3)
    make = [lambda a, b: f"{a}: Critical Hit", lambda a, b: f"{b}: Takes 5 magic damage from {a}", lambda a, b: f"{a}: Casts Fireball : {b}", lambda a, b: f"{a}: Attacks {b}", lambda a, b: f"{a}: Weapon Ineffective."]
    texts = [random.choice(make)(random.choice("AB"), random.choice("CD")) for _ in range(200)]
    flat = classify(events(log(spark, texts)))
    batch = link_events(flat).orderBy("ord").toPandas()
    pdf = flat.toPandas().sort_values("ord")
    state = {a: {} for a in pdf["actor"].unique()}
    parts = [link_actor(own.sample(frac=1, random_state=1), state[a]) for i in range(0, 200, 17) for a, own in pdf.iloc[i : i + 17].groupby("actor")]
    stream = __import__("pandas").concat(parts).sort_values("ord")
    for c in ("target", "critical", "spell", "spell_candidate"):
        assert batch[c].where(batch[c].notna(), None).tolist() == stream[c].where(stream[c].notna(), None).tolist()


def test_sides(spark):
    hits = ["Orc: Takes 1 slashing damage from Hero"] * 9 + ["Hero: Takes 1 slashing damage from Orc"] * 3 + ["Orc: Takes 1 slashing damage from Wolf"] * 4 + ["Hero: Hello."]
    lines = log(spark, hits, extra=[("s1", 99, "A7ROSTER\tHero\t")])
    found = classify(events(lines))
    got = {r.name: (r.side, r.summon) for r in resolve_sides(found, roster(lines)).collect()}
    assert got == {"Hero": ("party", False), "Orc": ("opponent", False), "Wolf": ("party", True)}
    weights = {(r.a, r.b): r.weight for r in edge_weights(hostile_edges(found)).collect()}
    assert weights[("Hero", "Orc")] == weights[("Orc", "Hero")] == 12
    rows = derive(lines).where("actor = 'Wolf'").select("actor_side", "target_side", "summon").distinct().collect()
    assert [tuple(r) for r in rows] == [("party", "opponent", "Wolf")]


def test_save_timeline(spark):
    texts = ["x"] * 9 + ["y"] + ["x"] * 9 + ["A: Save vs. Spell : 9"] + ["x"] * 20 + ["A: Save vs. Spell : 9"]
    lines = log(spark, texts)
    told = [("s1", 9, "A7STATS\tA\tSpell: 12 (3) | Unknown: 4"), ("s1", 30, "A7STATS\tA\tSpell: 8 (3)")]
    rows = [(s, o * 2, line) for s, o, line in lines.collect()] + [(s, o * 2 + 1, line) for s, o, line in told]
    lines = spark.createDataFrame(rows, "session string, ord int, line string")
    known = stats(lines)
    assert sorted((r.as_of_id, r.targets["Spell"]) for r in known.collect()) == [(10, 12), (31, 8)]
    got = save_targets(classify(events(lines)), known).where("kind = 'save'").orderBy("ord").select("save_target", "made").collect()
    assert [tuple(r) for r in got] == [(12, 0), (8, 1)]


def folded(spark, texts):
    nothing = [F.lit(None).cast("string").alias(c) for c in ("actor_side", "target_side", "summon", "target_summon")]
    rows = fold_state(linked(spark, texts).select("*", *nothing), known_effects(spark)).collect()
    return {r.name: r for r in rows}


@pytest.mark.parametrize("removal,left", [("Dispel Magic", {"Spell Turning"}), ("Breach", {"Spell Turning", "Haste", "Invisibility"}), ("Spell Thrust", {"Stoneskin", "Haste", "Invisibility"}), ("True Sight", {"Stoneskin", "Spell Turning", "Haste"})])
def test_removal_matrix(spark, removal, left):
    buffs = ["Stoneskin", "Spell Turning", "Haste", "Invisibility"]
    got = folded(spark, [f"A: Casts {b} : A" for b in buffs] + [f"B: Casts {removal} : A"])
    assert {o.name for o in got["A"].observations} == left


def test_fold(spark):
    got = folded(spark, ["W: Casting Mirror Image...", "W: Casts Mirror Image : W", "W: Mirror Imaged", "W: Save vs. Spell : 9", "W: Save vs. Spell : 3", "W: Save vs. Wand : 5", "W: Attacks X", "Y: Stoneskin", "Y: Death", "Y: Healed", "Your party rests: now", "W: Casting Web..."])
    w = got["W"]
    assert [(o.name, o.source, o.id) for o in w.observations] == [("Mirror Image", "effect", 3)]
    assert [(s.category, s["count"], s.roll, s.worst) for s in w.saves] == [("Wand", 1, 5, 5), ("Spell", 2, 3, 3)]
    assert (w.casting, w.last_action, w.last_seen_id, w.died_at_id) == ("Web", "attacking X", 12, None)
    assert got["Y"].observations == [] and got["Y"].died_at_id == 9 and "Your party rests" not in got


def table(spark):
    texts = ["B: Takes 5 fire damage from A", "B: Takes 7 fire damage from A", "A: Hello.", "capture resynced: lost", "B: Death", "A: Critical Hit"]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("actor_side", "target_side", "summon", "target_summon")]
    return linked(spark, texts).select("*", *nothing, F.lit(None).cast("int").alias("saved"))


def test_pages(spark):
    t = table(spark)
    got = api.events_page(t, api.Query(sort=(("amount", "asc"), ("nonsense", "asc"))), limit="-3")
    assert (got["total"], got["hidden_empty"], got["empty_column"], got["gaps"], got["limit"]) == (2, 4, "amount", 1, 500)
    assert [r.amount for r in got["rows"].collect()] == [5, 7]
    assert api.events_page(t, api.Query(search="DEATH"))["total"] == 1
    with pytest.raises(ValueError):
        api.groups(t, "raw")
    g = api.groups(t, "kind", limit=3)
    assert (g["matched"], g["windowed"]) == (6, 3) and {r.key for r in g["rows"].collect()} == {"critical", "death", "resync"}
    f = api.facets(t, api.Query(equals={"kind": "damage"}, without_kinds=("dialogue",)))
    assert {r.key: r.n for r in f["kinds"].collect()} == {"damage": 2, "resync": 1, "death": 1, "critical": 1}
    c = api.combatants(t, known_effects(spark), back_from=0, back_to=0)
    assert (c["folded"], c["from_id"], c["to_id"]) == (1, 6, 6)
    assert api.combatants(t, known_effects(spark), session="none")["folded"] == 0
    assert api.resolve_range(0, 10_000, 9_000, 1) == (1, 5_001, 4_999, 9_999)


def test_reports(spark):
    t = table(spark)
    by, names = reports.coverage(t, known_effects(spark), declined(spark))
    assert by.count() == 0 and names.count() == 0
    assert {r.kind: r.share for r in reports.kind_histogram(t).collect()}["damage"] == 33.33
    assert reports.session_bounds(t).first().n == 6


def test_chains(spark):
    c = chains.press([], "a")
    c = chains.press(c, "b")
    assert chains.press(c, "a") == [("a", "asc"), ("b", "asc")]
    assert chains.press(chains.press([("a", "asc")], "a"), "a") == []
    rows = spark.createDataFrame([("item10", 1), ("item9", 2), ("", 3), (None, 4)], "k string, n int")
    assert [r.n for r in chains.sorted_groups(rows, [("k", "desc")]).collect()][:2] == [1, 2]
    assert chains.scope_text(5, 5, 0).startswith("all 5")


def test_live(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "s1.log").write_text("noise\nA7LOG\t1\t1\t1\t\t\tB: Takes 5 fire damage from A\nA7LOG\t1\t1\t1\t\t\tB: Takes 6 fire damage from A\nA7LOG\t2\t1\t1\t\t\tB: Death")
    from strandline.sources.logs import read_live_lines

    capture_raw(read_live_lines(spark, str(logs), 0), str(tmp_path / "raw"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 4
    for _ in range(2):
        derive_live(read_live_lines(spark, str(logs), 0), str(tmp_path / "events"), str(tmp_path / "c2")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "events")).orderBy("id").collect()
    assert [(r.id, r.amount) for r in rows] == [(1, 6), (2, None)]
    assert read_session_logs(spark, str(logs)).count() == 4
    (logs / "s 2.log").write_text("A7STATS\tC\tSpell: 8 (3)\nA7LOG\t1\t1\t1\t\t\tC: Save vs. Spell : 9\n")
    derive_live(read_live_lines(spark, str(logs), 0), str(tmp_path / "events"), str(tmp_path / "c2"), verdicts=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "events")).orderBy("session", "id").collect()
    assert [(r.session, r.id, r.saved) for r in rows] == [("s 2", 1, 1), ("s1", 1, None), ("s1", 2, None)]
    linked = link_stream(classify(events(read_live_lines(spark, str(logs), 0).drop("file"))))
    linked.writeStream.format("memory").queryName("linked").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("linked").count() == 4


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        for name, n in (("a", 900), ("b", 40), ("c", 3)):
            (tmp_path / f"{name}.log").write_text("".join(f"{i}\r\n" for i in range(n)))
        rows = read_session_logs(spark, str(tmp_path)).orderBy("session", "ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line for r in rows] == [f"{i}\r" for n in (900, 40, 3) for i in range(n)]


def test_verdicts(spark):
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(["A7STATS\tA\tSpell: 12 (3)", "A7LOG\t1\t1\t1\t\t\tA: Save vs. Spell : 9", "A7LOG\t2\t1\t1\t\t\tB: Save vs. Spell : 9", "A7LOG\t3\t1\t1\t\t\tA: Save vs. Spell : 12"])], "session string, ord int, line string")
    assert [r.saved for r in derive(lines, verdicts=True).orderBy("id").collect()] == [0, None, 1]
    assert [r.saved for r in derive(lines).collect()] == [None] * 3


def test_linked_events_are_written_once_for_sides_and_verdicts(spark):
    from strandline.sources.tables import Work

    lines = log(spark, ["Orc: Takes 1 slashing damage from Hero", "Hero: Save vs. Spell : 9", "no speaker"], extra=[("s1", 99, "A7ROSTER\tHero\t")])
    work = Work(spark)
    try:
        kept = derive(lines, verdicts=True, work=work)
        assert "A7LOG" not in kept._jdf.queryExecution().optimizedPlan().toString().replace("A7STATS", "")
        assert sorted(map(str, kept.collect())) == sorted(map(str, derive(lines, verdicts=True).collect()))
    finally:
        work.drop()


def test_votes_without_an_item_are_derived_by_category(spark):
    from strandline.operators import opcodes

    rows = [(i, "ab"[i % 2], [i % 2, 7]) for i in range(40)]
    tested = opcodes.leave_one_out(spark.createDataFrame(rows, "label long, category string, opcodes array<int>"))
    plan = tested._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [mine" in plan and "Aggregate [item#" in plan and ", mine#" not in plan.split("Aggregate [item#")[1].split("]")[0]
    assert [tuple(r) for r in opcodes.accuracy(tested).collect()] == [(40, 0, 0)]
