"""The spell table from decoded rows to lookups."""

from pyspark.sql import functions as F

from strandline.operators.knowledge import hand_effects, known_effects, summons
from strandline.plans.spells import derived_spells, disagreements, match_labels, require_agreement, spell_table
from strandline.sources.binary import FEATURE_TYPE, named_spells


def feature(opcode, param1=0, param2=0, resource="", dispel=False):
    return (opcode, 0, 0, param1, param2, 0, int(dispel), dispel, 0, resource, 0)


def test_spell_table(spark):
    rows = [
        ("spwi101", 1, 1, "wizard", "none", 1, [feature(16, dispel=True), feature(139, 9)], 1, 2),
        ("spwi102", 2, 2, "wizard", "none", 1, [feature(16, dispel=True)], 1, 1),
        ("spwi103", 3, 3, "wizard", "none", 1, [feature(58)], 1, 1),
        ("spwi104", 4, 4, "wizard", "none", 1, [feature(58), feature(220, param2=1)], 1, 1),
        ("spwi105", 5, 5, "wizard", "none", 1, [feature(67, resource="wyv")], 1, 1),
        ("spwi106", 6, 6, "wizard", "none", 1, [feature(16, dispel=True)], 1, 1),
    ]
    read = spark.createDataFrame(rows, f"resref string, name_strref bigint, identified_strref bigint, type string, school string, level bigint, features array<{FEATURE_TYPE}>, ability_count int, feature_reads int")
    texts = spark.createDataFrame([(1, "Haste"), (2, "Improved Haste"), (3, "Dispel Magic"), (4, "Spell Thrust"), (5, "Wyvern Call"), (6, "Swift Feet"), (9, "Hasted"), (20, "Wyvern")], "strref bigint, text string")
    ids = spark.createDataFrame([(2101, "WIZARD_HASTE", "spwi101")], "number int, symbol string, resref string")
    made = spark.createDataFrame([("wyv", 20, 20)], "resref string, name_strref bigint, short_name_strref bigint")
    labels = hand_effects(spark)
    got = {r.resref: r for r in spell_table(read, texts, ids, made, labels).collect()}
    assert got["spwi106"].category == "warded" and got["spwi104"].strips == "spell-protections" and got["spwi103"].strips == "dispellable"
    assert got["spwi105"].summons == ["Wyvern"] and got["spwi101"].effect_text == ["Hasted"]
    table = spark.createDataFrame(list(got.values()), spell_table(read, texts, ids, made, labels).schema)
    assert {r.creature for r in summons(derived_spells(table)).collect()} == {"Wyvern"}
    known = {r.key: r.name for r in known_effects(spark, derived_spells(table)).collect()}
    assert known["swift feet"] == "Swift Feet" and known["hasted"] == "Haste"
    named = named_spells(read, texts, ids).withColumn("effect_text", F.array().cast("array<string>"))
    matched = match_labels(labels, named)
    assert {r.label for r in matched.collect()} == {"Haste", "Improved Haste", "Dispel Magic", "Spell Thrust"}
    assert disagreements(matched, labels).count() == 0
    require_agreement(named)
