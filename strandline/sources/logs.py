"""Session logs: text files of mixed lines, one file per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import SPACES, captured, clean, computed_once, lenient_int, name_key, normalise, trimmed
from strandline.sources import live

# Markers of the wire format and the prefix that may stand before them.
EVENT_MARK, ROSTER_MARK, STATS_MARK = "A7LOG", "A7ROSTER", "A7STATS"
PREFIX_MARK, ERROR_MARK = "LUA:", "LUA ERROR:"
# Labels of saves in a stats line.
SAVE_LABELS = {"paralysis / poison / death": "Death", "rod / staff / wand": "Wand", "petrification / polymorph": "Polymorph", "breath weapon": "Breath Weapon", "spell": "Spell"}
_WALL = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+)\s"

_STAT = rf"^{SPACES}*(.+?){SPACES}*:{SPACES}*(-?[0-9]+)"


def _session_of(path: Column) -> Column:
    """The name of a file, given as a URI, without its ending."""
    name = F.url_decode(F.replace(F.element_at(F.split(path, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_session_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """session, ord, line of every line; the session is the file's name, ord rises along the file.

    Large files are split.  A split starts at least as many bytes into its file as any
    partition before it can have rows, so where a line's split starts and its number in
    the partition add up to an order of the file's lines.
    """
    rows = spark.read.option("lineSep", "\n").text(paths)
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(_session_of(F.col("_metadata.file_path")).alias("session"), (F.col("_metadata.file_block_start") + number).alias("ord"), F.col("value").alias("line"))


def read_live_lines(spark: SparkSession, folder: str, idle_seconds: float = 60, session: str = "file", pattern: str = r".*\.(log|txt)") -> DataFrame:
    """A stream of session, ord, line, file over a folder of log files that are added to and still written.

    Each line comes once, in order; ``ord`` is its byte in the file.  A last line without
    an end comes once its file has not been written to for ``idle_seconds``.  The session
    is the file's name, or with ``session="folder"`` that of its folder.
    """
    live.register(spark)
    options = {"path": folder, "idle_seconds": str(idle_seconds), "session": session, "pattern": pattern}
    return spark.readStream.format(live.NAME).options(**options).load()


def _stripped(line: Column) -> Column:
    """Without carriage returns, and without the mark of an ended input and the backspaces that hide it."""
    line = F.replace(line, F.lit("\r"), F.lit(""))
    return F.when(F.startswith(line, F.lit("^D")), F.regexp_replace(line, "^\\^D\b*", "")).otherwise(line)


def _marked(df: DataFrame, mark: str) -> DataFrame:
    """Rows whose line has the marker and a tab, after nothing or a prefix with the platform's mark; adds ``prefix`` and ``fields``."""
    lined = computed_once(df, _l=_stripped(F.col("line")))
    found = computed_once(lined, _at=F.instr("_l", f"{mark}\t")).where("_at > 0")
    parts = computed_once(found, prefix=F.expr("substring(_l, 1, _at - 1)"), fields=F.split(F.expr("substring(_l, _at)"), "\t")).drop("_l", "_at")
    return parts.where((F.col("prefix") == "") | F.col("prefix").contains(PREFIX_MARK))


def events(lines: DataFrame) -> DataFrame:
    """``lines`` that carry an event: its id, clocks, screen and normalised text (``raw``)."""
    wire = _marked(lines, EVENT_MARK).where(F.size("fields") >= 7)
    f = lambda i: F.col("fields")[i]
    out = wire.select(
        *[c for c in lines.columns if c != "line"],
        lenient_int(f(1)).alias("id"),
        captured(F.col("prefix"), _WALL, 1).alias("wall_clock"),
        lenient_int(f(2)).alias("game_ticks"),
        lenient_int(f(3)).alias("clock_ms"),
        f(4).alias("game_time"),
        f(5).alias("screen"),
        normalise(F.array_join(F.slice("fields", 7, 1 << 30), "\t")).alias("raw"),
    )
    return out.where("id is not null")


def roster(lines: DataFrame) -> DataFrame:
    """session, ord, name of every name in a roster line."""
    names = F.filter(F.transform(F.slice("fields", 2, 1 << 30), trimmed), lambda n: n != "")
    return _marked(lines, ROSTER_MARK).select("session", "ord", F.explode(names).alias("name"))


#: Lines of a session whose ``ord`` agrees but for so many bits are one part of it.
PART_BITS = 20


def stats(lines: DataFrame, labels: dict[str, str] | None = None, part_bits: int = PART_BITS, marks: DataFrame | None = None) -> DataFrame:
    """session, ord, as_of_id, name, targets of every stats line.

    ``as_of_id`` is the id of the last event line before it in the session, 0 before any.
    It is looked for among the lines of the same part of the session; each part's last id
    is carried over the parts, of which a session has few, so no task needs a whole one.
    ``targets`` maps save categories to numbers; unknown labels are left out.  ``marks`` are
    the events of ``lines`` where they have been made already.
    """
    known = F.create_map(*[F.lit(x) for pair in (labels or SAVE_LABELS).items() for x in pair])
    parts = F.split(F.col("fields")[2], r"\|")
    pair = lambda p: F.struct(known[name_key(F.regexp_extract(p, _STAT, 1))].alias("k"), F.regexp_extract(p, _STAT, 2).try_cast("bigint").alias("v"))
    good = F.filter(F.transform(parts, pair), lambda s: s["k"].isNotNull() & s["v"].isNotNull())
    found = _marked(lines, STATS_MARK).where(F.size("fields") >= 3).select("session", "ord", clean(F.col("fields")[1]).alias("name"), F.map_from_entries(good).alias("targets"))
    marks = (events(lines) if marks is None else marks).select("session", "ord", "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("map<string,bigint>").alias("targets"))
    both = marks.unionByName(found.where("name is not null"), allowMissingColumns=True).withColumn("_part", F.shiftright("ord", part_bits))
    inside = Window.partitionBy("session", "_part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("_near", F.last("id", True).over(inside)).where("targets is not null and size(targets) > 0")
    parts = both.groupBy("session", "_part").agg(F.max_by("id", F.when(F.col("id").isNotNull(), F.col("ord"))).alias("_last"))
    earlier = Window.partitionBy("session").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_far", F.last("_last", True).over(earlier)).drop("_last")
    pinned = told.join(carried, ["session", "_part"], "left")
    return pinned.select("session", "ord", F.coalesce("_near", "_far", F.lit(0)).alias("as_of_id"), "name", "targets")


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").contains(ERROR_MARK))
