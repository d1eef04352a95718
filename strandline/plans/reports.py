"""Reports over event tables.  The coverage report goes through the same fold as the view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from strandline.functions.text import name_key
from strandline.operators.fold import fold_state
from strandline.schema import KINDS
from strandline.sources.logs import ERROR_MARK, EVENT_MARK


def kind_histogram(events: DataFrame) -> DataFrame:
    """kind, n, share in percent."""
    counted = events.groupBy("kind").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def top_raw(events: DataFrame, kind: str, n: int = 20) -> DataFrame:
    """The most frequent texts of a kind."""
    return events.where(F.col("kind") == kind).groupBy("raw").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "raw").limit(n)


def attribution(events: DataFrame) -> DataFrame:
    """detail, total, after_cast, attributed of damage."""
    return events.where("kind = 'damage'").groupBy(F.coalesce("detail", F.lit("(none)")).alias("detail")).agg(F.count("*").alias("total"), F.count("spell_candidate").alias("after_cast"), F.count("spell").alias("attributed"))


def unattributed(events: DataFrame) -> DataFrame:
    """detail, spell_candidate, n of damage that follows a cast and has no spell."""
    return events.where("kind = 'damage' and spell is null and spell_candidate is not null").groupBy("detail", "spell_candidate").agg(F.count("*").alias("n"))


def capture_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def session_bounds(events: DataFrame) -> DataFrame:
    return events.groupBy("session").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))


def coverage(events: DataFrame, effects: DataFrame, declined: DataFrame, summons: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations by category, and unknown names with counts and whether they were declined."""
    seen = fold_state(events, effects, summons).select(F.explode("observations").alias("o")).select("o.name", "o.category")
    unknown = seen.where("category = 'unknown'").groupBy("name").agg(F.count("*").alias("n")).withColumn("key", name_key(F.col("name")))
    judged = unknown.join(declined, "key", "left").select("name", "n", F.col("reason").isNotNull().alias("declined"), "reason")
    return seen.groupBy("category").agg(F.count("*").alias("n")), judged


def open_names(judged: DataFrame) -> DataFrame:
    """Unknown names that nobody has judged."""
    return judged.where("not declined").select("name", "n").orderBy(F.desc("n"), "name")


def observed(lines: DataFrame, name: str | Observation = "capture") -> DataFrame:
    """``lines`` as they are; the job that reads them also counts them, those that report an error and those that carry an event.

    The counts are metrics of an ``Observation`` for a batch, or under a name in the
    progress of a stream, and cost no scan of their own.
    """
    marked = F.contains("line", F.lit(f"{EVENT_MARK}\t"))
    error = F.contains("line", F.lit(ERROR_MARK))
    return lines.observe(name, F.count(F.lit(1)).alias("lines"), F.count_if(error).alias("errors"), F.count_if(marked & ~error).alias("marked"), F.count_if(~marked & ~error).alias("unmarked"))


def observed_kinds(events: DataFrame, name: str | Observation = "kinds") -> DataFrame:
    """Classified ``events`` as they are; the job that reads them also counts them by kind, gaps (``resync``) among them."""
    return events.observe(name, *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
