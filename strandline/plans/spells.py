"""The spell table: decoded spells with names, learned categories, and what they strip, print and summon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import name_key
from strandline.operators import opcodes
from strandline.sources.binary import name_agreement, named_spells, summoned_names, write_spells

#: Fixed value: the opcode that prints a string, whose number is its first parameter.
PRINT_OPCODE = 139
LEAST_AGREEMENT = 0.5


def effect_texts(read: DataFrame, texts: DataFrame) -> DataFrame:
    """resref, effect_text: the distinct messages that a spell's features print."""
    refs = read.select("resref", F.explode("features").alias("f")).where(F.col("f.opcode") == PRINT_OPCODE).select("resref", F.col("f.param1").alias("strref"))
    return refs.join(texts, "strref").where("text is not null").groupBy("resref").agg(F.array_sort(F.collect_set("text")).alias("effect_text"))


def match_labels(labels: DataFrame, spells: DataFrame) -> DataFrame:
    """The spell of each label (name, alias, category): by name, else by a message equal to the name, else by alias.

    Of several spells the best counts: one with a symbol, by class, with most features.
    """
    by_name = spells.where("name is not null").select("resref", name_key(F.col("name")).alias("key"), F.lit(0).alias("how"))
    by_text = spells.select("resref", F.explode("effect_text").alias("t")).select("resref", name_key(F.col("t")).alias("key"), F.lit(1).alias("how"))
    keys = by_name.union(by_text)
    wanted = labels.select(F.col("name").alias("label"), "category", name_key(F.col("name")).alias("key"), F.lit(0).alias("late")).union(
        labels.where("alias is not null").select(F.col("name").alias("label"), "category", name_key(F.col("alias")).alias("key"), F.lit(2).alias("late"))
    )
    found = wanted.join(keys, "key").withColumn("rank", F.col("how") + F.col("late"))
    nearest = found.groupBy("label").agg(F.min("rank").alias("least"))
    kept = found.join(nearest, "label").where("rank = least").select("label", "category", "resref").distinct()
    return opcodes.best_of(kept.join(spells.select("resref", "symbol", "class_rank", "features"), "resref"), "label")


def labelled_opcodes(matched: DataFrame) -> DataFrame:
    """label, category (protections and buffs as one), opcodes of matched labels: the input of the votes."""
    return matched.select("label", opcodes.merged_category(F.col("category")).alias("category"), F.transform("features", lambda f: f["opcode"]).alias("opcodes"))


def disagreements(matched: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels whose hand-written dispellable or strips differs from what the file says."""
    said = labels.select(F.col("name").alias("label"), F.col("dispellable").alias("said_dispellable"), F.col("strips").alias("said_strips"))
    read = matched.select("label", opcodes.dispellable(F.col("category"), F.col("features")).alias("dispellable"), opcodes.strips(F.col("features")).alias("strips"))
    differ = (F.col("dispellable") != F.col("said_dispellable")) | (F.col("said_strips").isNotNull() & ~F.col("strips").eqNullSafe(F.col("said_strips")))
    return read.join(said, "label").where(differ)


def require_agreement(named: DataFrame, least: float = LEAST_AGREEMENT) -> None:
    """Fails where symbols and names of spells disagree so often that the decoder must be wrong."""
    ratio = name_agreement(named).first().ratio
    if ratio is not None and ratio < least:
        raise ValueError(f"symbols fit names in {ratio:.0%} of the spells only")


def spell_table(read: DataFrame, texts: DataFrame, ids: DataFrame, creatures: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per decoded spell: names, learned category and confidence, strips, dispellable, messages, summons."""
    named = named_spells(read, texts, ids).join(effect_texts(read, texts), "resref", "left").join(summoned_names(read, creatures, texts), "resref", "left")
    named = named.withColumn("effect_text", F.coalesce("effect_text", F.array().cast("array<string>"))).withColumn("summons", F.coalesce("summons", F.array().cast("array<string>")))
    castable = labels.where("not probe_only")
    votes = opcodes.votes(labelled_opcodes(match_labels(castable, named)))
    items = named.select(F.col("resref").alias("label"), F.transform("features", lambda f: f["opcode"]).alias("opcodes"))
    learned = opcodes.classify(items, votes).select(F.col("label").alias("resref"), F.col("predicted").alias("category"), "confidence")
    out = named.join(learned, "resref", "left")
    return out.select("resref", "name", "symbol", "type", "school", "level", "category", "confidence", opcodes.strips(F.col("features")).alias("strips"), opcodes.dispellable(F.coalesce("category", F.lit("")), F.col("features")).alias("dispellable"), "effect_text", "summons")


def derived_spells(stored: DataFrame) -> DataFrame:
    """Rows of the spell table that say something: with a name, and a category or summons."""
    return stored.where("name is not null and (category is not null or size(summons) > 0)")


__all__ = ["derived_spells", "disagreements", "effect_texts", "labelled_opcodes", "match_labels", "require_agreement", "spell_table", "write_spells"]
