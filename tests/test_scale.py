"""Forms that spread one session or one actor over tasks, against the plain forms."""

import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandline.functions.rules import classify
from strandline.operators import sides
from strandline.operators.links import link_events
from strandline.functions.text import contains_folded
from strandline.plans import api, chains, reports, search
from strandline.sources import live, logs
from strandline.operators.upsert import last_write_wins
from strandline.streaming import settle
from strandline.streaming.live import ACTOR_PARTS, derive, link_actors, link_stream

EVENT = "session string, ord long, id long, kind string, actor string, target string, detail string"


def acts(seed, n, actors, gap=4):
    rnd = random.Random(seed)
    rows, at = [], -30
    for i in range(n):
        at += rnd.randint(1, gap)
        kind = rnd.choice(["critical", "damage", "spell", "attack", "immune", "status"])
        detail = {"critical": rnd.choice(["Hit", "hit", "Miss"]), "damage": rnd.choice(["magic", "fire"]), "spell": rnd.choice([None, "Web", "Fireball"])}.get(kind)
        target = rnd.choice([None, "x", "y"]) if kind in ("attack", "immune") else None
        rows.append((rnd.choice(["s", "t"]) if actors > 1 else "s", i, at, kind, rnd.choice([None, *"abcdef"][:actors + 1]) if actors > 1 else "a", target, detail))
    return rows


def told(df):
    return sorted(tuple(r) for r in df.select("session", "ord", "target", "critical", "spell", "spell_candidate").fillna("-").collect())


def test_ranges_link_as_whole_windows(spark):
    for seed, actors, within in ((1, 1, (10, 60, 12)), (2, 3, (10, 60, 12)), (3, 1, (3, 5, 2)), (4, 1, (400, 400, 400))):
        events = spark.createDataFrame(acts(seed, 1500, actors), EVENT)
        by = dict(zip(("critical_within", "spell_within", "target_within"), within))
        whole = told(link_events(events, size=None, **by))
        assert sum(r[3] for r in whole) > 10 and all(told(link_events(events, size=size, **by)) == whole for size in (1, 16, 64, 4096))


def test_one_actor_spreads_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        events = spark.createDataFrame(acts(5, 4000, 1), EVENT)
        linked = link_events(events, size=64)
        sizes = linked.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 1 and "SinglePartition" not in linked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stats_are_pinned_over_parts(spark):
    rnd = random.Random(7)
    rows = []
    for session in ("a", "b", "c"):
        for i in range(300):
            mark = rnd.random()
            line = f"A7LOG\t{i + 5}\t1\t1\t\t\tAnn: hm" if mark < 0.3 and session != "c" else f"A7STATS\tAnn\tSpell: {i}" if mark < 0.5 else "noise"
            rows.append((session, i * rnd.choice([1, 1, 40]) if session == "x" else i * 7, line))
    lines = spark.createDataFrame(rows, "session string, ord long, line string")
    whole = {}
    for session, ord_, line in sorted(rows):
        if line.startswith("A7LOG"):
            whole[session] = int(line.split("\t")[1])
        elif line.startswith("A7STATS"):
            whole.setdefault("told", []).append((session, ord_, whole.get(session, 0)))
    for bits in (2, 5, 20):
        assert sorted((r.session, r.ord, r.as_of_id) for r in logs.stats(lines, part_bits=bits).collect()) == whole["told"]


def test_growing_files(spark, tmp_path):
    logs_, out = tmp_path / "logs", str(tmp_path / "out")
    logs_.mkdir()
    written = {}

    def add(name, text):
        with (logs_ / name).open("ab") as f:
            f.write(text.encode())
        written[name] = written.get(name, "") + text

    def come(idle=60, **options):
        live.register(spark)
        reader = spark.readStream.format(live.NAME).options(path=str(logs_), idle_seconds=idle, **options).load()
        reader.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        rows = sorted((r.session, r.ord, r.line) for r in spark.read.parquet(out).collect())
        assert len(rows) == len({r[:2] for r in rows})  # every line once
        return {s: [r[2] for r in rows if r[0] == s] for s in dict.fromkeys(r[0] for r in rows)}

    add("a.log", "one\ntwo\nthr")
    add("note.tmp", "no log\n")
    assert come() == {"a": ["one", "two"]}
    add("a.log", "ee\nfour é\n\nfive")
    add("b c.log", "x\r\n" + "long " * 300 + "\ny\n")
    assert come(range_bytes=5) == {"a": ["one", "two", "three", "four é", ""], "b c": ["x\r", "long " * 300, "y"]}
    assert come(idle=0)["a"][-1] == "five"  # the last line has no end, and the file is left alone
    add("a.log", " more\nsix\n")
    assert come()["a"][-3:] == ["five", " more", "six"]
    assert come() == come(idle=0)
    assert "".join(come()["b c"]) == written["b c.log"].replace("\n", "")


def test_stream_keeps_links_over_batches(spark, tmp_path):
    rows = acts(11, 400, 3)
    events = spark.createDataFrame(rows, EVENT)
    whole = told(link_events(events, size=None))
    folder = str(tmp_path / "in")
    for i in range(0, 400, 90):
        events.where(f"ord >= {i} and ord < {i + 90}").repartition(2).write.mode("append").parquet(folder)
        stream = link_stream(spark.readStream.schema(events.schema).parquet(folder))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.parquet(str(tmp_path / "out"))) == whole


def test_stream_links_many_actors_at_once(spark):
    rnd = random.Random(13)
    rows = [("s", o, i, k, a and f"{a}{rnd.randrange(40)}", t, d) for _, o, i, k, a, t, d in acts(13, 4000, 6, gap=1)]
    events = spark.createDataFrame(rows, EVENT)
    whole, flat, held, parts = told(link_events(events, size=None)), events.toPandas(), [], []
    for i in range(0, 4000, 900):
        linked, held = link_actors(flat.iloc[i : i + 900].sample(frac=1, random_state=1), held)
        parts += linked[["session", "ord", "target", "critical", "spell", "spell_candidate"]].itertuples(index=False, name=None)
    assert sorted((*r[:2], r[2] or "-", r[3], r[4] or "-", r[5] or "-") for r in parts) == whole
    assert len({r[4] for r in rows}) > 3 * ACTOR_PARTS  # more actors than calls


def fights(seed, sessions, names, n):
    rnd = random.Random(seed)
    rows = []
    for s in range(sessions):
        for i in range(n):
            a, b = (f"n{min(rnd.randrange(names), rnd.randrange(names))}" for _ in "ab")
            kind = rnd.choice(["attack", "damage", "pause", "dialogue"]) if rnd.random() < 0.1 else "attack"
            rows.append((f"s{s}", i, i, kind, a if rnd.random() > 0.03 else None, b, None))
    return rows


def test_waves_settle_as_the_loop(spark):
    for seed, names, n in ((1, 6, 30), (2, 12, 60), (3, 40, 90)):
        events = spark.createDataFrame(fights(seed, 12, names, n), EVENT).where("kind != 'pause' or target < 'n2'")
        roster = spark.createDataFrame([(f"s{i}", "n0") for i in range(0, 12, 2)], "session string, name string")
        got = [sorted(tuple(r) for r in sides.resolve_sides(events, roster, alone=most).collect()) for most in (10**9, -1)]
        assert got[0] == got[1] and {r[2] for r in got[0]} == {"party", "opponent"}


def test_waves_along_a_chain(spark):
    # each name only meets the one before it, met in either direction of the visits
    for step in (1, -1):
        rows = [("s", i, i, "attack", f"n{k}", f"n{k + 1}", None) for i, k in enumerate(range(12)[::step])]
        events = spark.createDataFrame(rows, EVENT)
        roster = spark.createDataFrame([("s", "n0")], "session string, name string")
        got = [sorted(tuple(r) for r in sides.resolve_sides(events, roster, alone=most).collect()) for most in (10**9, 0)]
        assert got[0] == got[1] and len(got[0]) > 5


def test_pages_by_rank(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("abc"), i, i * rnd.choice([1, 1, 3]) - 40, "k", None, rnd.choice([None, "x", "y"]), None) for i in range(400)]
    events = spark.createDataFrame(rows, EVENT)
    order = [F.col("target").asc_nulls_last(), F.col("session").desc(), F.col("ord").desc()]
    everything = [tuple(r) for r in events.orderBy(*order).collect()]
    for limit, offset in ((10, 0), (25, 190), (50, 390), (5, 500)):
        assert [tuple(r) for r in api.deep_page(events, order, limit, offset).collect()] == everything[offset : offset + limit]
    unique = events.dropDuplicates(["session", "id"])
    ranked = sorted((tuple(r) for r in unique.collect()), key=lambda r: (r[0], r[2]), reverse=True)
    for limit, offset, span in ((1, 0, 7), (100, 37, 16), (1000, 20, 64), (30, 10**6, 64), (100, 3, 1 << 16)):
        got = api.newest(unique, limit, offset, span)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(ranked[offset : offset + limit], key=str)


def test_counts_in_passing(spark, tmp_path):
    lines = ["A7LOG\t1\t1\t1\t\t\tA: Attacks B", "noise", "LUA: LUA ERROR: x A7LOG\t", "A7LOG\t2\t1\t1\t\t\tcapture resynced: lost", "A7LOG\t3\t1\t1\t\t\tA: Death"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, ord long, line string")
    raw, kinds = Observation("raw"), Observation("kinds")
    told = reports.observed_kinds(classify(logs.events(reports.observed(df, raw))), kinds)
    told.write.parquet(str(tmp_path / "out"))
    assert raw.get == {"lines": 5, "errors": 1, "marked": 3, "unmarked": 1}
    assert {k: v for k, v in kinds.get.items() if v} == {"attack": 1, "resync": 1, "death": 1}
    df.write.parquet(str(tmp_path / "in"))
    stream = reports.observed_kinds(classify(logs.events(reports.observed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "raw"))), "kinds")
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["observedMetrics"] for p in query.recentProgress if p["numInputRows"]]
    assert seen[0]["raw"]["errors"] == 1 and seen[0]["kinds"]["resync"] == 1


def test_natural_order(spark):
    want = ["a", "A", "á", "a 2", "a 10", "b9", "b10", "b10a", "É", "z"]
    mixed = want[::-1]
    rows = spark.createDataFrame([(w,) for w in mixed], "k string").select("k", chains.natural(F.col("k")).alias("key")).orderBy("key")
    assert [r.k for r in rows.collect()] == want


def test_batches_settle_as_a_full_derivation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(settle, "SPAN", 16)
    rnd = random.Random(8)
    lines, party = [], ["Hero", "Imoen"]
    for i in range(240):
        session = rnd.choice(["s", "t"])
        a, b = (rnd.choice(party + [f"Orc{'abcdefgh'[k]}" for k in range(8)] + [f"Wolf{'abcd'[k]}" for k in range(4)]) for _ in "ab")
        if i < 120 and "Wolf" in a + b:
            a, b = "Wolfa", "Wolfb"  # a pack that meets nobody else at first
        text = rnd.choice([f"{a}: Attacks {b}"] * 6 + [f"{a}: Hello."] + [f"{b}: Takes 3 fire damage from {a}"] * 2)
        lines.append((session, i, f"A7LOG\t{i // 2}\t1\t1\t\t\t{text}" if i % 37 else f"A7LOG\t{i}\t1\t1\t\t\tAuto-Paused: x"))
        if i in (5, 130):
            lines.append((session, 1000 + i, f"A7ROSTER\t{'Hero' if i == 5 else 'Wolfa'}"))
    schema = "session string, ord long, line string"
    folder, done = str(tmp_path / "table"), []
    flat = link_events(classify(logs.events(spark.createDataFrame(lines, schema)))).cache()
    cuts = [0, 100, 140, 160, 240]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        listed = [(s, l.split("\t")[1]) for s, o, l in lines if l.startswith("A7ROSTER") and low <= o - 1000 < high]
        done.append(settle.settle_batch(flat.where(f"ord >= {low} and ord < {high}"), spark.createDataFrame(listed, "session string, name string"), folder, n))
    again = settle.settle_batch(flat.where(f"ord >= {cuts[-2]}"), spark.createDataFrame([], "session string, name string"), folder, len(cuts) - 2)  # a batch tried twice
    roster = spark.createDataFrame([(s, l.split("\t")[1]) for s, o, l in lines if l.startswith("A7ROSTER")], "session string, name string")
    want = last_write_wins(sides.label(flat, sides.resolve_sides(flat, roster)), ["session", "id"], ["ord"])
    columns = ["session", "id", "raw", "actor_side", "target_side", "summon", "target_summon"]
    assert sorted(map(str, spark.read.parquet(f"{folder}/events").select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert [d.added for d in done] == [100, 40, 20, 80] and done[0].rewritten == 0 and again.added == 80
    assert all(0 < d.settled for d in done) and done[2].changed <= done[2].settled + 2 and done[2].rewritten < 140
    # a batch about names apart from all others settles and rewrites nothing else
    apart = link_events(classify(logs.events(spark.createDataFrame([("s", 5000, "A7LOG\t5000\t1\t1\t\t\tRata: Attacks Ratb")], schema))))
    assert settle.settle_batch(apart, spark.createDataFrame([], "session string, name string"), folder, 9) == settle.Done(2, 0, 0, 1)


def test_search_reads_spans_with_all_trigrams(spark, tmp_path):
    rnd = random.Random(12)
    texts = ["Fireball hits", "fire  ball", "BALL of fire", "x", None, "a_b%c", "Iceball"]
    rows = [(rnd.choice("st"), i, i, "status", rnd.choice([None, "Ann", "Bob"]), None, texts[min(rnd.randrange(7), i // 30)]) for i in range(200)]
    events = spark.createDataFrame(rows, EVENT)
    laid = search.lay_out(events, str(tmp_path / "e"), span=16)
    posted = search.postings(laid, ("actor", "detail")).cache()
    for pattern in ("fireball", "FIRE%ball", "ball", "x", "ire__all", "nothing of it", "ann", "", "é"):
        got = search.search(laid, posted, pattern, ("actor", "detail"))
        want = events.where(F.coalesce(contains_folded(F.col("actor"), pattern), F.lit(False)) | F.coalesce(contains_folded(F.col("detail"), pattern), F.lit(False)))
        assert sorted(r.ord for r in got.collect()) == sorted(r.ord for r in want.collect()), pattern
    assert 0 < search.candidates(posted, "iceball").count() < laid.select("session", "span").distinct().count()
    assert search.candidates(posted, "a%b_") is None


def test_spans_share_folders(spark, tmp_path):
    events = spark.createDataFrame([("s", i, i, "status", "Ann", None, f"x{i}") for i in range(-64, 192)], EVENT)
    laid = search.lay_out(events, str(tmp_path / "e"), span=16, block=128)
    assert len(list((tmp_path / "e" / "session=s").glob("block=*"))) == 3 and laid.select("span").distinct().count() == 16
    assert [r.id for r in search.search(laid, search.postings(laid, ("detail",)), "x100", ("detail",)).collect()] == [100]


def test_linking_reads_events_once(spark):
    events = spark.createDataFrame(acts(6, 300, 3), EVENT)
    for size in (None, 64):
        linked = link_events(events, size=size)
        assert linked._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
        assert linked.count() == 300 and {r[0] for r in linked.where("actor is null").select("critical").collect()} == {0}


def test_live_lines_are_settled(spark, tmp_path):
    rnd = random.Random(4)
    names = ["Hero", "Orca", "Orcb", "Wolf", "Ann"]
    shapes = ["{a}: Attacks {b}", "{a}: Critical Hit", "{b}: Takes 5 magic damage from {a}", "{a}: Casts Web : {b}", "{a}: Weapon Ineffective.", "{a}: Hello!", "no speaker"]
    lines = ["A7ROSTER\tHero"] + [f"A7LOG\t{i}\t{i}\t\t\t\t" + rnd.choice(shapes).format(a=rnd.choice(names), b=rnd.choice(names)) for i in range(1, 160)]
    folder = tmp_path / "logs"
    folder.mkdir()
    for part in (lines[:70], lines[70:]):
        with (folder / "s.log").open("a") as f:
            f.write("".join(f"{x}\n" for x in part))
        settle.settle_live(logs.read_live_lines(spark, str(folder)), str(tmp_path / "table"), str(tmp_path / "c")).awaitTermination()
    whole = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session string, ord long, line string")
    columns = ["session", "id", "game_ticks", "clock_ms", "kind", "actor", "target", "amount", "detail", "critical", "spell", "spell_candidate", "actor_side", "target_side", "summon", "target_summon", "raw"]
    got, want = (sorted(map(str, df.select(*columns).collect())) for df in (spark.read.parquet(str(tmp_path / "table" / "events")), derive(whole)))
    assert got == want and len(got) == 159
