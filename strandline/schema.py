"""Schemas and fixed vocabularies of the event plane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of events, sides, evidence sources, categories.
KINDS = "attack damage critical death xp gold save spell cast_start immune miscast effect status action song pause level loot party dialogue tohit damageroll resync other".split()
SIDES = ("party", "opponent", "neutral")
EVIDENCE = ("cast", "effect", "probe")
CATEGORIES = ("protection", "disable", "buff", "dispel", "warded", "unknown")

_TEXT = T.StringType()
_INT = T.LongType()
EVENT = T.StructType(
    [
        T.StructField("session", _TEXT, False),
        T.StructField("id", _INT, False),
        T.StructField("wall_clock", _TEXT),
        T.StructField("game_ticks", _INT),
        T.StructField("clock_ms", _INT),
        T.StructField("game_time", _TEXT),
        T.StructField("screen", _TEXT),
        T.StructField("kind", _TEXT, False),
        T.StructField("actor", _TEXT),
        T.StructField("target", _TEXT),
        T.StructField("amount", _INT),
        T.StructField("roll", _INT),
        T.StructField("resisted", _INT),
        T.StructField("detail", _TEXT),
        T.StructField("critical", T.IntegerType(), False),
        T.StructField("spell", _TEXT),
        T.StructField("spell_candidate", _TEXT),
        T.StructField("actor_side", _TEXT),
        T.StructField("target_side", _TEXT),
        T.StructField("summon", _TEXT),
        T.StructField("target_summon", _TEXT),
        T.StructField("saved", T.IntegerType()),
        T.StructField("raw", _TEXT, False),
    ]
)


def conform(df: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """``df`` with the columns of ``schema`` in order; missing ones are typed nulls, so old tables stay readable."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
