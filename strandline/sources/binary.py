"""Fixed-layout binary resources: index, archive, string table, spell and creature files.

Files come from Spark's ``binaryFile`` source (or any frame with ``path`` and
``content``); each decoder turns files into rows.  References between them are joins.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of codes and fields in the formats.
SPELL_TYPES = dict(enumerate("special wizard priest psionic innate bardsong".split()))
SCHOOLS = dict(enumerate("none abjurer conjurer diviner enchanter illusionist invoker necromancer transmuter generalist".split()))
SAVES = "death wands polymorph breath spells".split()
RESISTANCES = "fire cold electricity acid magic magicFire magicCold slashing crushing piercing missile".split()
CLASS_PREFIXES = {"1": "sppr", "2": "spwi", "3": "spin", "4": "spcl"}

# Record layouts, little-endian.
KEY_ARCHIVE = np.dtype([("length", "<u4"), ("name_at", "<u4"), ("name_len", "<u2"), ("where", "<u2")])
KEY_ENTRY = np.dtype([("resref", "S8"), ("type", "<u2"), ("locator", "<u4")])
BIF_ENTRY = np.dtype([("locator", "<u4"), ("offset", "<u4"), ("size", "<u4"), ("type", "<u2"), ("unknown", "<u2")])
TLK_ENTRY = np.dtype([("flags", "<u2"), ("sound", "S8"), ("volume", "<u4"), ("pitch", "<u4"), ("offset", "<u4"), ("length", "<u4")])
FEATURE = np.dtype({"names": ["opcode", "target", "power", "param1", "param2", "timing", "dispel_resist", "duration", "resource", "saving_throw"], "formats": ["<u2", "u1", "u1", "<u4", "<u4", "u1", "u1", "<u4", "S8", "<u4"], "offsets": [0x00, 0x02, 0x03, 0x04, 0x08, 0x0C, 0x0D, 0x0E, 0x14, 0x24], "itemsize": 48})
ABILITY = np.dtype({"names": ["count", "index"], "formats": ["<u2", "<u2"], "offsets": [0x1E, 0x20], "itemsize": 40})

FEATURE_TYPE = "struct<opcode: int, target: int, power: int, param1: bigint, param2: bigint, timing: int, dispel_resist: int, dispel: boolean, duration: bigint, resource: string, saving_throw: bigint>"


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, resref, content of files."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.lower(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("resref"), "content")


def _signed(content: bytes, magic: bytes) -> None:
    if content[: len(magic)] != magic:
        raise ValueError(f"not a {magic.decode()} file: it begins with {content[:4]!r}")


def _table(content: bytes, at: int, count: int, kind: np.dtype) -> np.ndarray:
    """The records of a table that are there in full."""
    return np.frombuffer(content, kind, max(0, min(count, (len(content) - at) // kind.itemsize)), at) if at <= len(content) else np.zeros(0, kind)


def _word(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("latin-1").lower()


def key_archives(content: bytes) -> list[tuple[int, str]]:
    """Number and path of each archive that an index lists."""
    _signed(content, b"KEY ")
    count, _, at, _ = struct.unpack_from("<4I", content, 8)
    return [(i, content[r["name_at"] : r["name_at"] + max(0, int(r["name_len"]) - 1)].rstrip(b"\0").decode("latin-1").replace("\\", "/")) for i, r in enumerate(_table(content, at, count, KEY_ARCHIVE))]


def key_entries(content: bytes) -> list[tuple[str, int, int, int]]:
    """resref, type, archive number and file number of each resource; the locator packs them in 12, 6 and 14 bits."""
    _signed(content, b"KEY ")
    _, count, _, at = struct.unpack_from("<4I", content, 8)
    return [(_word(bytes(r["resref"])), int(r["type"]), int(r["locator"]) >> 20, int(r["locator"]) & 0x3FFF) for r in _table(content, at, count, KEY_ENTRY)]


def bif_entries(content: bytes) -> list[tuple[int, int, int, int]]:
    """File number, offset, size, type of each entry of an archive; a cut-off table ends early."""
    _signed(content, b"BIFF")
    count, _, at = struct.unpack_from("<3I", content, 8)
    return [(int(r["locator"]) & 0x3FFF, int(r["offset"]), int(r["size"]), int(r["type"])) for r in _table(content, at, count, BIF_ENTRY)]


def bif_files(content: bytes) -> list[tuple[int, int, bytes]]:
    """File number, type and bytes of each file of an archive that is there in full."""
    return [(n, kind, content[at : at + size]) for n, at, size, kind in bif_entries(content) if at + size <= len(content)]


def tlk_strings(content: bytes) -> list[tuple[int, str | None]]:
    """Number and text of each string; null where it is empty, outside the file or not UTF-8."""
    _signed(content, b"TLK ")
    count, at = struct.unpack_from("<2I", content, 0x0A)
    out: list[tuple[int, str | None]] = []
    for i, r in enumerate(_table(content, 18, count, TLK_ENTRY)):
        start, n = at + int(r["offset"]), int(r["length"])
        try:
            text = content[start : start + n].decode("utf-8") if n and start + n <= len(content) else None
        except UnicodeDecodeError:
            text = None
        out.append((i, text))
    return out


def spell(content: bytes) -> dict:
    """Header and distinct features of a spell: those of casting, then those of each ability."""
    _signed(content, b"SPL ")
    names = struct.unpack_from("<2I", content, 0x08)
    (kind,), (school,), (level,) = struct.unpack_from("<H", content, 0x1C), struct.unpack_from("<B", content, 0x25), struct.unpack_from("<I", content, 0x34)
    ability_at, abilities, feature_at, casting_index, casting_count = struct.unpack_from("<IHIHH", content, 0x64)
    ranges = [(casting_index, casting_count), *[(int(a["index"]), int(a["count"])) for a in _table(content, ability_at, abilities, ABILITY)]]
    read = [f for index, count in ranges for f in _table(content, feature_at + index * FEATURE.itemsize, count, FEATURE)]
    distinct = list({tuple(f.tolist()): f for f in reversed(read)}.values())[::-1]
    features = [{n: int(f[n]) for n in FEATURE.names if n != "resource"} | {"resource": _word(bytes(f["resource"])), "dispel": bool(int(f["dispel_resist"]) & 1)} for f in distinct]
    return {"name_strref": names[0], "identified_strref": names[1], "type": SPELL_TYPES.get(kind, f"type{kind}"), "school": SCHOOLS.get(school, f"school{school}"), "level": level, "features": features, "ability_count": abilities, "feature_reads": len(read)}


def creature(content: bytes) -> dict:
    """Names, numbers, saves and resistances of a creature; armour class, saves and resistances are signed."""
    _signed(content, b"CRE ")
    u32 = lambda at: struct.unpack_from("<I", content, at)[0]
    saves = struct.unpack_from("<5b", content, 0x54)
    resistances = struct.unpack_from("<11b", content, 0x59)
    hp = struct.unpack_from("<2H", content, 0x24)
    ac = struct.unpack_from("<2h", content, 0x46)
    return {
        "name_strref": u32(0x08), "short_name_strref": u32(0x0C), "xp": u32(0x14), "hp": hp[0], "max_hp": hp[1], "ac_natural": ac[0], "ac_effective": ac[1],
        "thac0": content[0x52], "attacks": content[0x53], "saves": dict(zip(SAVES, saves)), "resistances": dict(zip(RESISTANCES, resistances)),
        "levels": list(content[0x234:0x237]), "race": content[0x272], "class": content[0x273],
    }


#: Bytes of files whose rows are given out at once.
BATCH_BYTES = 4 << 20


def _decoded(files: DataFrame, schema: str, rows: Callable[[str, bytes], list[tuple]]) -> DataFrame:
    """Rows that a decoder makes of each file (resref, content), many files to a batch."""
    names = [c.strip().split(" ")[0] for c in _split_schema(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, size = [], 0
            for resref, content in zip(batch["resref"], batch["content"]):
                held += rows(resref, bytes(content))
                size += len(content)
                if size > BATCH_BYTES:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
            yield pd.DataFrame(held, columns=names)

    return files.select("resref", "content").mapInPandas(run, schema)


def _split_schema(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += c in "<(" and 1 or c in ">)" and -1 or 0
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def archives(files: DataFrame) -> DataFrame:
    return _decoded(files, "biff int, archive string", lambda _, b: key_archives(b))


def index(files: DataFrame) -> DataFrame:
    return _decoded(files, "resref string, type int, biff int, file int", lambda _, b: key_entries(b))


def archive_files(files: DataFrame) -> DataFrame:
    """archive (its resref), file, type, content."""
    return _decoded(files, "archive string, file int, type int, content binary", lambda name, b: [(name, *f) for f in bif_files(b)])


def strings(files: DataFrame) -> DataFrame:
    return _decoded(files, "strref bigint, text string", lambda _, b: tlk_strings(b))


def strings_by_file(files: DataFrame) -> DataFrame:
    """resref, strref, text: strings of several tables, each named by its file."""
    return _decoded(files, "resref string, strref bigint, text string", lambda name, b: [(name, *s) for s in tlk_strings(b)])


def spells(files: DataFrame) -> DataFrame:
    schema = f"resref string, name_strref bigint, identified_strref bigint, type string, school string, level bigint, features array<{FEATURE_TYPE}>, ability_count int, feature_reads int"
    return _decoded(files, schema, lambda name, b: [(name, *[told[k] for told in [spell(b)] for k in ("name_strref", "identified_strref", "type", "school", "level", "features", "ability_count", "feature_reads")])])


def creatures(files: DataFrame) -> DataFrame:
    fields = ("name_strref", "short_name_strref", "xp", "hp", "max_hp", "ac_natural", "ac_effective", "thac0", "attacks", "saves", "resistances", "levels", "race", "class")
    schema = "resref string, name_strref bigint, short_name_strref bigint, xp bigint, hp int, max_hp int, ac_natural int, ac_effective int, thac0 int, attacks int, saves map<string,int>, resistances map<string,int>, levels array<int>, race int, class int"
    return _decoded(files, schema, lambda name, b: [(name, *[told[k] for told in [creature(b)] for k in fields])])


def resolved(sources: list[tuple[str, DataFrame]], key: str = "resref") -> DataFrame:
    """Rows of several sources, the first source that has a key (without regard to case) first; ``provenance`` says which."""
    ranked = [df.withColumn(key, F.lower(key)).withColumn("provenance", F.lit(name)).withColumn("_rank", F.lit(i)) for i, (name, df) in enumerate(sources)]
    every = ranked[0]
    for df in ranked[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank"))).where("_n = 1").drop("_n", "_rank")


def override_check(override: DataFrame, archived: DataFrame, key: str = "resref") -> DataFrame:
    """key, in_override, in_archive, same: whether two copies of a resource agree."""
    a = override.select(F.lower(key).alias(key), F.sha2("content", 256).alias("a"))
    b = archived.select(F.lower(key).alias(key), F.sha2("content", 256).alias("b"))
    return a.join(b, key, "full_outer").select(key, F.col("a").isNotNull().alias("in_override"), F.col("b").isNotNull().alias("in_archive"), (F.col("a") == F.col("b")).alias("same"))


def spell_ids(lines: DataFrame) -> DataFrame:
    """number, symbol, resref of the lines of a spell id file (column ``value``)."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    cut = lines.select(F.regexp_extract(text, r"^([1-4][0-9]{3}) (.+)$", 1).alias("n"), F.regexp_extract(text, r"^([1-4][0-9]{3}) (.+)$", 2).alias("symbol")).where("n != ''")
    prefix = F.create_map(*[F.lit(x) for p in CLASS_PREFIXES.items() for x in p])
    return cut.select(F.col("n").cast("int").alias("number"), "symbol", F.concat(prefix[F.substring("n", 1, 1)], F.substring("n", 2, 3)).alias("resref"))


def symbol_fits_name(symbol: Column, name: Column, share: float = 0.6) -> Column:
    """Whether most words of a symbol (longer than two letters, without the class in front) occur in a name."""
    bare = F.regexp_replace(symbol, "^(?:WIZARD|CLERIC|INNATE|BARD|PRIEST|DRUID|PALADIN|RANGER|SHAMAN)_", "")
    words = F.filter(F.split(F.lower(bare), "_"), lambda w: F.length(w) > 2)
    spaced = F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")
    hits = F.filter(words, lambda w: spaced.contains(w) | F.replace(spaced, F.lit(" "), F.lit("")).contains(w))
    return (F.size(words) > 0) & (F.size(hits) / F.greatest(F.size(words), F.lit(1)) >= share)


def class_rank(resref: Column) -> Column:
    return F.when(resref.rlike("^(?:spwi|sppr)"), 0).when(resref.startswith("spin"), 1).when(resref.startswith("spcl"), 2).otherwise(3)


def named_spells(read: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Spells with their name, symbol and class rank; both joins keep spells without a match."""
    named = read.join(texts.withColumnRenamed("strref", "name_strref").withColumnRenamed("text", "name"), "name_strref", "left")
    return named.join(ids.select("resref", "symbol"), "resref", "left").withColumn("class_rank", class_rank(F.col("resref")))


def symbols_without_spell(ids: DataFrame, read: DataFrame) -> DataFrame:
    return ids.join(read.select("resref"), "resref", "left_anti")


def name_agreement(named: DataFrame) -> DataFrame:
    """named, agreeing, ratio: how often a spell's symbol fits its name; spells without a name are left out."""
    both = named.where("name is not null and symbol is not null")
    return both.agg(F.count("*").alias("named"), F.count_if(symbol_fits_name(F.col("symbol"), F.col("name"))).alias("agreeing")).withColumn("ratio", F.col("agreeing") / F.nullif(F.col("named"), F.lit(0)))


def summoned_names(read: DataFrame, made: DataFrame, texts: DataFrame) -> DataFrame:
    """resref, summons: names of the creatures that a spell's features refer to; the short name where there is no other."""
    name, short = texts.select(F.col("strref").alias("name_strref"), F.col("text").alias("long")), texts.select(F.col("strref").alias("short_name_strref"), F.col("text").alias("short"))
    titled = made.join(name, "name_strref", "left").join(short, "short_name_strref", "left").select(F.col("resref").alias("resource"), F.coalesce("long", "short").alias("title")).where("title is not null")
    refs = read.select("resref", F.explode("features").alias("f")).select("resref", F.col("f.resource").alias("resource")).where("resource != ''")
    return refs.join(titled, "resource").groupBy("resref").agg(F.array_sort(F.collect_set("title")).alias("summons"))


def write_spells(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)
