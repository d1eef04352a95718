"""Incremental settling of sides: a batch of new events changes only what it must.

A folder holds evidence (hostile pairs, members, who spoke) and sides, each by the batch
that told it, and labelled events by session and span of ids.  A batch writes its own
evidence; names whose evidence it changed are settled again, with all names that can
feel that, those reached over hostile pairs without passing a member, whose side is
fixed.  Other parts of a session cannot change.  Where a side differs from the one
stored, the spans of events that name it are labelled and written again; all other spans
stay as they are.

Each step writes what the batch's number names, so a batch that failed half-way can be
run again.  After any number of batches the table is that of a full derivation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.functions.rules import classify
from strandline.operators import sides
from strandline.operators.upsert import last_write_wins
from strandline.sources.logs import events as parse_events
from strandline.sources.logs import roster as parse_roster
from strandline.sources.tables import Work, stamp
from strandline.streaming.live import conform_with_order, link_stream

SPAN = 1 << 12
_SIDES = "session string, name string, side string, summon boolean, batch long"
_EVIDENCE = "session string, what string, a string, b string, n long, first_ord long, batch long"


@dataclass(frozen=True)
class Done:
    """What a batch did: names settled again, names whose side changed, rows in spans written again, rows added."""

    settled: int
    changed: int
    rewritten: int
    added: int


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if stamp(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _own_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write ``df`` as what this batch told, in place of what a failed try told."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def reached(names: DataFrame, pairs: DataFrame, party: DataFrame, work: Work) -> DataFrame:
    """session, name of all names that the sides of ``names`` can depend on or change, members left out."""
    free = lambda df, c: df.join(party.select("session", F.col("name").alias(c)), ["session", c], "left_anti")
    ways = pairs.select("session", "a", "b").union(pairs.select("session", F.col("b"), F.col("a"))).distinct()
    ways = work.stored(free(free(ways, "a"), "b"))
    # neighbours of members depend on the member's label alone, which only its becoming one changes
    found = fresh = work.stored(free(names.distinct(), "name"))
    while not fresh.isEmpty():
        near = fresh.withColumnRenamed("name", "a").join(ways, ["session", "a"]).select("session", F.col("b").alias("name")).distinct()
        fresh = work.stored(near.join(found, ["session", "name"], "left_anti"))
        found = found.union(fresh)
    return work.stored(found)


def settle_batch(events: DataFrame, roster: DataFrame, folder: str, batch: int) -> Done:
    """Add linked ``events`` of a batch (numbered upwards) and names of roster lines to the table below ``folder``."""
    spark = events.sparkSession
    work = Work(spark)
    try:
        events = work.stored(conform_with_order(events).withColumn("span", F.call_function("div", F.col("id") - F.pmod("id", F.lit(SPAN)), F.lit(SPAN))))
        told = sides.evidence(sides.hostile_edges(events), sides.members(events, roster), sides.spoke(events))
        _own_batch(told, f"{folder}/evidence", batch)
        told = spark.read.parquet(f"{folder}/evidence/batch={batch}")
        touched = work.stored(told.select("session").union(events.select("session")).distinct())
        before = _read(spark, f"{folder}/evidence", _EVIDENCE).where(F.col("batch") <= batch).join(touched, "session", "left_semi")
        now = work.stored(before.groupBy("session", "what", "a", "b").agg(F.when(F.col("what") == "edge", F.sum("n")).otherwise(F.max("n")).alias("n"), F.min("first_ord").alias("first_ord")))
        party = now.where("what = 'member'").select("session", F.col("a").alias("name"))
        pairs = now.where("what = 'edge'")
        joined = told.where("what = 'member'").select("session", F.col("a").alias("name"))
        # who met a new member feels it too
        beside = pairs.join(joined.withColumnRenamed("name", "a"), ["session", "a"]).select("session", F.col("b").alias("name")).union(pairs.join(joined.withColumnRenamed("name", "b"), ["session", "b"]).select("session", F.col("a").alias("name")))
        ends = told.where("what = 'edge'").select("session", F.explode(F.array("a", "b")).alias("name"))
        again = reached(ends.union(beside), pairs, party, work)
        # all pairs of these names, whoever is at the other end, and all members and speakers
        side = lambda c: pairs.join(again.withColumnRenamed("name", c), ["session", c], "left_semi").select(*now.columns)
        evidence = side("a").union(side("b")).distinct().union(now.where("what != 'edge'"))
        settled = work.stored(sides.settled(evidence, work=work))
        stored = _read(spark, f"{folder}/sides", _SIDES).where(F.col("batch") < batch).join(touched, "session", "left_semi")
        old = work.stored(stored.groupBy("session", "name").agg(F.max_by(F.struct("side", "summon"), "batch").alias("o")).select("session", "name", "o.*"))
        # those not settled again keep their side; whether one is a summon also changes when it speaks or is listed
        heard = now.where("what = 'spoke' or what = 'member' and n > 0").select("session", F.col("a").alias("name")).distinct().withColumn("heard", F.lit(True))
        kept = old.join(settled.select("session", "name"), ["session", "name"], "left_anti").join(heard, ["session", "name"], "left")
        kept = kept.select("session", "name", "side", (F.col("summon") & F.col("heard").isNull()).alias("summon"))
        every = work.stored(settled.select("session", "name", "side", "summon").union(kept))
        was = old.withColumnRenamed("side", "was").withColumnRenamed("summon", "was_summon")
        changed = work.stored(every.join(was, ["session", "name"], "left").where("not (side <=> was and summon <=> was_summon)").select("session", "name", "side", "summon"))
        _own_batch(changed, f"{folder}/sides", batch)
        return Done(again.count(), changed.count(), *_write_events(events, changed, every, folder, work))
    finally:
        work.drop()


def _write_events(events: DataFrame, changed: DataFrame, every: DataFrame, folder: str, work: Work) -> tuple[int, int]:
    """Label the new rows and the spans with rows of changed names or of ids that come again; rows written again and added."""
    spark, path = events.sparkSession, f"{folder}/events"
    if stamp(spark, path):
        stored = spark.read.schema(events.schema).parquet(path)
        named = lambda c: stored.join(changed.select("session", F.col("name").alias(c)), ["session", c], "left_semi").select("session", "span")
        again = stored.join(events.select("session", "span", "id"), ["session", "span", "id"], "left_semi").select("session", "span")
        spans = work.stored(named("actor").union(named("target")).union(again).distinct())
        held = work.stored(stored.join(spans, ["session", "span"], "left_semi").select(*events.columns))
    else:
        held = events.limit(0)
    whole = last_write_wins(held.union(events), ["session", "id"], ["ord"])
    labelled = sides.label(whole, every).select(*events.columns)
    if held.isEmpty():
        spans = events.select("session", "span").limit(0)
    full = work.stored(labelled.join(spans.withColumn("_full", F.lit(True)), ["session", "span"], "left"))
    writer = lambda df: df.drop("_full").repartition("session", "span").sortWithinPartitions("session", "span", "id").write.partitionBy("session", "span")
    writer(full.where("_full")).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    writer(full.where("_full is null")).mode("append").parquet(path)
    return held.count(), events.count()


def settle_live(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the table below ``folder`` up to date with a stream of ``read_live_lines``: what is new is linked and settled, nothing derived again."""
    linked = link_stream(classify(parse_events(lines.drop("file"))))
    # roster lines go along as rows of a kind of their own
    listed = parse_roster(lines).select("session", "ord", F.lit("roster").alias("kind"), F.col("name").alias("target"))
    both = linked.unionByName(listed, allowMissingColumns=True)

    def come(batch: DataFrame, number: int) -> None:
        work = Work(batch.sparkSession)
        try:
            told = work.stored(batch)
            settle_batch(told.where("kind != 'roster'"), told.where("kind = 'roster'").select("session", F.col("target").alias("name")), folder, number)
        finally:
            work.drop()

    return both.writeStream.foreachBatch(come).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
