"""Learning categories of spells from the opcodes of labelled examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Opcodes that say nothing about what a spell does (text, sound, graphics, plumbing).
SILENT = (139, 215, 142, 174, 146, 141, 177, 233, 328)
# Opcodes that remove protections, the classes their second parameter selects, and the dispel opcode.
STRIPPERS, STRIP_CLASS, DISPEL_OPCODE = (220, 221, 230), {1: "spell-protections", 2: "combat-protections", 7: "combat-protections", 5: "concealment"}, 58
SUPPORT, PURITY, CONFIDENCE = 2, 0.6, 0.65


def merged_category(category: Column) -> Column:
    """Protections and buffs as one class."""
    return F.when(category.isin("protection", "buff"), "warded").otherwise(category)


def meaningful(opcodes: Column) -> Column:
    """Distinct opcodes without the silent ones."""
    return F.array_distinct(F.filter(opcodes, lambda o: ~o.isin(*SILENT)))


def _exploded(labelled: DataFrame) -> DataFrame:
    return labelled.select("label", "category", F.explode(meaningful(F.col("opcodes"))).alias("opcode"))


def vote_counts(labelled: DataFrame) -> DataFrame:
    """opcode, category, n (labels of the category with the opcode), size (labels of the category)."""
    sizes = labelled.groupBy("category").agg(F.count("*").alias("size"))
    return _exploded(labelled).groupBy("opcode", "category").agg(F.count("*").alias("n")).join(sizes, "category")


def votes(labelled: DataFrame, support: int = SUPPORT, purity: float = PURITY) -> DataFrame:
    """opcode, category, purity, support of each opcode that speaks for a category.

    The rate of an opcode in a category is n / size; purity is the best rate over the sum
    of rates.  Ties go to the category first in the alphabet.
    """
    counted = vote_counts(labelled).withColumn("rate", F.col("n") / F.col("size"))
    best = counted.groupBy("opcode").agg(F.sum("n").alias("support"), F.sum("rate").alias("rates"), F.max("rate").alias("top"), F.min(F.struct((-F.col("rate")).alias("r"), "category")).alias("b"))
    out = best.select("opcode", F.col("b.category").alias("category"), (F.col("top") / F.col("rates")).alias("purity"), "support")
    return out.where((F.col("support") >= support) & (F.col("purity") >= purity))


def classify(items: DataFrame, voted: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """label, predicted, confidence of items (label, opcodes); predicted is null where the votes do not agree enough."""
    cast = items.select("label", F.explode(meaningful(F.col("opcodes"))).alias("opcode")).join(voted, "opcode")
    summed = cast.groupBy("label", "category").agg(F.sum("purity").alias("weight"))
    best = summed.groupBy("label").agg(F.sum("weight").alias("total"), F.max("weight").alias("top"), F.min(F.struct((-F.col("weight")).alias("w"), "category")).alias("b"))
    sure = best.select("label", F.col("b.category").alias("predicted"), (F.col("top") / F.col("total")).alias("confidence"))
    return items.select("label").join(sure, "label", "left").withColumn("predicted", F.when(F.col("confidence") >= confidence, F.col("predicted")))


def leave_one_out(labelled: DataFrame, support: int = SUPPORT, purity: float = PURITY, confidence: float = CONFIDENCE) -> DataFrame:
    """label, category, predicted: each label classified by the votes of all others.

    An item's own share is taken off the counts of its opcodes.  What is left depends on
    the item's category and the opcode alone, so votes are derived once for each such pair,
    not for each item; items are dealt by label and only add up votes.
    """
    dealt = labelled.repartition("label")
    counts = vote_counts(labelled)
    minus = _exploded(labelled).select(F.col("category").alias("mine"), "opcode").distinct().join(counts, "opcode")
    same = F.col("mine") == F.col("category")
    n, size = F.col("n") - same.cast("int"), F.col("size") - same.cast("int")
    rated = minus.select("mine", "opcode", "category", n.alias("n"), F.when(size > 0, n / size).otherwise(F.lit(0.0)).alias("rate")).where("n > 0")
    best = rated.groupBy("mine", "opcode").agg(F.sum("n").alias("support"), F.sum("rate").alias("rates"), F.max("rate").alias("top"), F.min(F.struct((-F.col("rate")).alias("r"), "category")).alias("b"))
    votes = best.select("mine", "opcode", F.col("b.category").alias("category"), (F.col("top") / F.col("rates")).alias("p"), "support").where((F.col("support") >= support) & (F.col("p") >= purity))
    voted = _exploded(dealt).select(F.col("label").alias("item"), F.col("category").alias("mine"), "opcode").join(F.broadcast(votes), ["mine", "opcode"])
    summed = voted.groupBy("item", "category").agg(F.sum("p").alias("weight"))
    top = summed.groupBy("item").agg(F.sum("weight").alias("total"), F.max("weight").alias("top"), F.min(F.struct((-F.col("weight")).alias("w"), "category")).alias("b"))
    sure = top.select(F.col("item").alias("label"), F.when(F.col("top") / F.col("total") >= confidence, F.col("b.category")).alias("predicted"))
    return dealt.select("label", "category").join(sure, "label", "left")


def accuracy(tested: DataFrame) -> DataFrame:
    """correct, wrong, abstained."""
    hit = F.col("predicted") == F.col("category")
    return tested.agg(F.count_if(hit).alias("correct"), F.count_if(~hit).alias("wrong"), F.count_if(F.col("predicted").isNull()).alias("abstained"))


def strips(features: Column) -> Column:
    """What a spell strips, from its features (opcode, param2): the first remover's class, else dispel, else null."""
    classes = F.create_map(*[F.lit(x) for p in STRIP_CLASS.items() for x in p])
    removers = F.filter(features, lambda f: f["opcode"].isin(*STRIPPERS) & f["param2"].isin(*STRIP_CLASS))
    first = F.try_element_at(removers, F.lit(1))
    return F.when(F.size(removers) > 0, classes[first["param2"].cast("int")]).when(F.exists(features, lambda f: f["opcode"] == DISPEL_OPCODE), "dispellable")


def dispellable(category: Column, features: Column) -> Column:
    """Whether any meaningful feature can be dispelled; null for removals and without such features."""
    kept = F.filter(features, lambda f: ~f["opcode"].isin(*SILENT))
    return F.when((category == "dispel") | (F.size(kept) == 0), F.lit(None).cast("boolean")).otherwise(F.exists(kept, lambda f: f["dispel"]))


def shared_by_two(labelled: DataFrame) -> DataFrame:
    """first, second, opcodes: the opcodes that exactly two labels have in common, by pair of labels."""
    pairs = _exploded(labelled).groupBy("opcode").agg(F.array_sort(F.collect_set("label")).alias("labels")).where("size(labels) = 2")
    return pairs.groupBy(F.col("labels")[0].alias("first"), F.col("labels")[1].alias("second")).agg(F.array_sort(F.collect_list("opcode")).alias("opcodes"))


def best_of(rows: DataFrame, key: str) -> DataFrame:
    """Of several spells for a key: one with a symbol, by class rank, with most features, by resref."""
    order = Window.partitionBy(key).orderBy(F.col("symbol").isNotNull().desc(), F.asc("class_rank"), F.size("features").desc(), F.asc("resref"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
