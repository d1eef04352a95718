"""Live capture as Structured Streaming.

Raw lines and derived events are separate queries with their own checkpoints, so a
failure of the second never loses a line.  Derived events of a micro-batch go through
``foreachBatch``: the sessions that it touches are derived again from the raw table
and replace what was stored, which also settles sides that later evidence changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.functions.rules import classify
from strandline.functions.text import redacted
from strandline.operators.links import CRITICAL_WITHIN, SPELL_DAMAGE, SPELL_WITHIN, TARGET_WITHIN, link_events, save_targets
from strandline.operators.sides import label, resolve_sides
from strandline.operators.upsert import import_sessions
from strandline.schema import conform
from strandline.sources.logs import events, read_session_logs, roster, stats
from strandline.sources.tables import Work


def derive(lines: DataFrame, verdicts: bool = False, work: Work | None = None) -> DataFrame:
    """Events of whole sessions, from lines (session, ord, line) to labelled rows; ``ord`` stays for ordering.

    ``saved`` is null unless ``verdicts`` are asked for: then it tells whether a save met
    the number that its actor needed by the stats lines known up to it.  Sides, labels and
    verdicts all read the linked events; with ``work`` these are written once for them, and
    the result is good until it is dropped.
    """
    linked = link_events(classify(events(lines)))
    if work is not None:
        linked = work.stored(linked)
    labelled = label(linked, resolve_sides(linked, roster(lines)))
    if not verdicts:
        return labelled.withColumn("saved", F.lit(None).cast("int"))
    return save_targets(labelled, stats(lines, marks=linked)).withColumnRenamed("made", "saved").drop("save_target")


def capture_raw(lines: DataFrame, path: str, checkpoint: str, home: str | None = None) -> StreamingQuery:
    """Write redacted lines as they come, before anything is made of them."""
    kept = lines.select("session", redacted(F.col("line"), home).alias("line"))
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh(spark: SparkSession, files: list[str], path: str, verdicts: bool = False) -> None:
    """Derive the sessions of the given log files and replace them in the table; other files are not read."""
    if not files:
        return
    work = Work(spark)
    try:
        import_sessions(conform_with_order(derive(read_session_logs(spark, files), verdicts, work)), path)
    finally:
        work.drop()


def conform_with_order(rows: DataFrame) -> DataFrame:
    """The event schema and the line order, which decides between rows with one id."""
    shaped = conform(rows)
    return conform(rows, type(shaped.schema)([*shaped.schema.fields, rows.schema["ord"]]))


def derive_live(lines: DataFrame, path: str, checkpoint: str, verdicts: bool = False) -> StreamingQuery:
    """Keep the event table up to date with a stream of ``read_live_lines``."""

    def touched(batch: DataFrame, _: int) -> None:
        # names of the files that came with this batch, which the stream's offsets list too
        refresh(batch.sparkSession, [r.file for r in batch.select("file").distinct().collect()], path, verdicts)

    return lines.writeStream.foreachBatch(touched).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What the linker adds to an event, or fills.
_LINKS = {"target": "string", "critical": "int", "spell": "string", "spell_candidate": "string"}


#: Parts of a session's actors, by hash; the linker's state and its calls are by part, however many actors there are.
ACTOR_PARTS = 64
#: What is kept of the acts that later rows link with.
_HELD = ("actor", "act", "id", "value")


def link_actors(rows: pd.DataFrame, held: list[tuple]) -> tuple[pd.DataFrame, list[tuple]]:
    """Link rows of any number of actors of a session, in any order, all at once; also the acts held after them.

    ``held`` has the acts before the rows as (actor, act, id, value): ``armed`` a critical
    hit that no damage has used up, ``cast`` the last spell with its name, ``aimed`` the
    last attack with its target.  They stand before their actor's rows like rows of their
    own.  Rows without an actor link with nothing.
    """
    old = pd.DataFrame(held, columns=_HELD)
    n, m = len(old), len(old) + len(rows)
    whole = lambda own, given: np.concatenate([own, given.astype(object).where(given.notna(), None).to_numpy(object)])
    actor = whole(old["actor"].to_numpy(object), rows["actor"])
    code = pd.factorize(actor)[0]
    place = np.concatenate([np.zeros(n, np.int64), rows["ord"].to_numpy()])
    order = np.lexsort((place, np.arange(m) >= n, code))
    act = np.concatenate([old["act"].to_numpy(object), np.full(len(rows), None, object)])[order]
    none, actor, code = np.full(n, None, object), actor[order], code[order]
    kind, target, detail = (whole(none, rows[c])[order] for c in ("kind", "target", "detail"))
    value = np.concatenate([old["value"].to_numpy(object), np.full(len(rows), None, object)])[order]
    ids = np.concatenate([old["id"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)])[order]
    lower = np.array([d.lower() if d is not None else "" for d in detail], dtype=object)
    has = lambda values: np.array([v is not None for v in values], dtype=bool)
    named = code >= 0
    damage = named & (kind == "damage")
    acts = {"armed": (kind == "critical") & (lower == "hit"), "cast": (kind == "spell") & has(detail), "aimed": (kind == "attack") & has(target)}
    acts = {name: named & marks | (act == name) for name, marks in acts.items()}
    told = {"armed": np.full(m, None, object), "cast": np.where(act == "cast", value, detail), "aimed": np.where(act == "aimed", value, target)}
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if m else np.zeros(0, np.int64)
    first = np.repeat(starts, np.diff(np.append(starts, m)))

    def upto(marks: np.ndarray) -> np.ndarray:
        """For each row the last marked row of its actor up to it, -1 where there is none."""
        last = np.maximum.accumulate(np.where(marks, np.arange(m), -1))
        return np.where(last >= first, last, -1)

    last = {name: upto(marks) for name, marks in {**acts, "damage": damage}.items()}
    # the same before each row; the row before the first one is another actor's
    before = {name: np.where(np.arange(m) > first, np.roll(at, 1), -1) for name, at in last.items()}
    near = lambda name, reach: (before[name] >= 0) & (ids - ids[before[name]] <= reach)
    critical = damage & near("armed", CRITICAL_WITHIN) & (before["damage"] < before["armed"])
    candidate = np.where(damage & near("cast", SPELL_WITHIN), told["cast"][before["cast"]], None)
    filled = named & (kind == "immune") & ~has(target) & near("aimed", TARGET_WITHIN)
    ends = np.append(starts[1:], m) - 1 if m else starts
    ends = ends[named[ends]]
    kept = [(at, name) for name in acts for at, hurt in zip(last[name][ends], last["damage"][ends]) if at >= 0 and (name != "armed" or at > hurt)]
    after = [(actor[at], name, int(ids[at]), told[name][at]) for at, name in kept]
    new = order >= n
    out = rows.take(order[new] - n).assign(
        target=np.where(filled, told["aimed"][before["aimed"]], target)[new],
        critical=critical.astype(np.int32)[new],
        spell=np.where(np.isin(lower.astype(str), SPELL_DAMAGE), candidate, None)[new],
        spell_candidate=candidate[new],
    )
    return out.reset_index(drop=True), after


def link_actor(rows: pd.DataFrame, last: dict[str, tuple | None]) -> pd.DataFrame:
    """Link the rows of one actor of a session, in any order; ``last`` has the acts before them and then those after them."""
    actor = rows["actor"].iloc[0]
    out, after = link_actors(rows, [(actor, act, *told) for act, told in last.items() if told])
    last.clear()
    last.update({act: told for _, act, *told in after})
    return out


class ActorLinker(StatefulProcessor):
    """The last acts of a part of a session's actors, as one list that is read and written at once."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "actor string, act string, id long, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        # batches of a key come in no order of their own; a micro-batch's rows of a part are put in order here
        linked, after = link_actors(pd.concat(list(rows)), before)
        yield linked[self.columns]
        if after and sorted(after) != sorted(before):
            self.held.put(after)
        elif before and not after:
            self.held.clear()

    def close(self) -> None:
        pass


def link_stream(events: DataFrame) -> DataFrame:
    """The linker over a stream of classified events that comes in order, with state by session and part of its actors.

    Rows without an actor go along, spread over the parts, so that the stream is read and
    classified once.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = [f for f in events.schema.fields if f.name not in _LINKS]
    names = [*(f.name for f in kept), *_LINKS]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {kind}" for c, kind in _LINKS.items())])
    part = F.pmod(F.hash(F.coalesce("actor", F.col("ord").cast("string"))), F.lit(ACTOR_PARTS))
    return events.withColumn("_part", part).groupBy("session", "_part").transformWithStateInPandas(ActorLinker(names), schema, "Append", "None")
