"""Binary decoders on byte strings built here, resource resolution, and opcode votes."""

import io
import struct

import pytest

from strandline.operators import opcodes
from pyspark.sql.datasource import EqualTo, In

from strandline.sources import archives
from strandline.sources import binary as b


def key_file():
    name = b"data\\AREA.bif\0"
    head = b"KEY V1  " + struct.pack("<4I", 1, 1, 24, 36)
    archive = struct.pack("<IIHH", 9, 50, len(name), 1)
    entry = b"SPWI212\0" + struct.pack("<HI", 0x3EE, (3 << 20) | (0x3F << 14) | 1234)
    return head + archive + entry + name


def test_key_and_bif():
    assert b.key_entries(key_file()) == [("spwi212", 0x3EE, 3, 1234)]
    assert b.key_archives(key_file()) == [(0, "data/AREA.bif")]
    table = struct.pack("<IIIHH", (5 << 14) | 7, 60, 3, 1, 0) + struct.pack("<IIIHH", 2, 63, 2, 1, 0)
    bif = (b"BIFFV1  " + struct.pack("<3I", 3, 0, 20) + table).ljust(60, b"\0") + b"abcde"
    assert b.bif_entries(bif)[:2] == [(7, 60, 3, 1), (2, 63, 2, 1)]
    assert dict((n, c) for n, _, c in b.bif_files(bif[:52] + bif[52:]))[7] == b"abc"
    with pytest.raises(ValueError):
        b.bif_entries(b"nonsense")


def test_tlk():
    entries = [(0, 5), (5, 0), (100, 9), (0, 2)]
    body = b"".join(struct.pack("<H8sIIII", 1, b"", 0, 0, o, n) for o, n in entries)
    tlk = b"TLK V1  " + struct.pack("<HII", 0, len(entries), 18 + len(body)) + body + b"hello"
    assert b.tlk_strings(tlk) == [(0, "hello"), (1, None), (2, None), (3, "he")]


def spl_file(n=3):
    head = bytearray(114)
    head[:8] = b"SPL V1  "
    struct.pack_into("<2I", head, 8, 11, 12)
    struct.pack_into("<H", head, 0x1C, 1)
    head[0x25] = 6
    struct.pack_into("<I", head, 0x34, 4)
    struct.pack_into("<IHIHH", head, 0x64, 114, n, 114 + 40 * n, 0, 0)
    ability = bytearray(40)
    struct.pack_into("<2H", ability, 0x1E, 1, 0)
    feature = bytearray(48)
    struct.pack_into("<HBBII", feature, 0, 220, 1, 2, 5, 7)
    feature[0x0D] = 3
    feature[0x14:0x1B] = b"CRE01\0\0"
    return bytes(head) + bytes(ability) * n + bytes(feature)


def test_spell(spark):
    s = b.spell(spl_file())
    assert (s["type"], s["school"], s["level"], s["feature_reads"], len(s["features"])) == ("wizard", "invoker", 4, 3, 1)
    assert s["features"][0]["dispel"] and s["features"][0]["resource"] == "cre01"
    files = spark.createDataFrame([("spwi212", bytearray(spl_file()))], "resref string, content binary")
    row = b.spells(files).select("*", opcodes.strips(b.F.col("features")).alias("strips"), opcodes.dispellable(b.F.lit("protection"), b.F.col("features")).alias("d")).first()
    assert row.strips == "combat-protections" and row.d and row.features[0].param2 == 7


def test_creature():
    raw = bytearray(0x280)
    raw[:8] = b"CRE V1.0"
    struct.pack_into("<2h", raw, 0x46, 5, -4)
    struct.pack_into("<5b", raw, 0x54, -2, 1, 2, 3, 4)
    struct.pack_into("<11b", raw, 0x59, *range(-1, 10))
    c = b.creature(bytes(raw))
    assert (c["ac_effective"], c["saves"]["death"], c["resistances"]["fire"]) == (-4, -2, -1)


def test_resources(spark):
    over = spark.createDataFrame([("A", bytearray(b"1")), ("c", bytearray(b"3"))], "resref string, content binary")
    base = spark.createDataFrame([("a", bytearray(b"2")), ("b", bytearray(b"2"))], "resref string, content binary")
    got = {r.resref: r.provenance for r in b.resolved([("override", over), ("archive", base)]).collect()}
    assert got == {"a": "override", "b": "archive", "c": "override"}
    assert {r.resref: r.same for r in b.override_check(over, base).collect()} == {"a": False, "b": None, "c": None}
    ids = b.spell_ids(spark.createDataFrame([("IDS V1.0",), ("2212 WIZARD_MIRROR_IMAGE",), ("9999 X",)], "value string"))
    assert [tuple(r) for r in ids.collect()] == [(2212, "WIZARD_MIRROR_IMAGE", "spwi212")]
    pair = spark.createDataFrame([("WIZARD_MIRROR_IMAGE", "Mirror Image"), ("WIZARD_HASTE", "Slow")], "s string, n string")
    assert [r[0] for r in pair.select(b.symbol_fits_name(b.F.col("s"), b.F.col("n"))).collect()] == [True, False]


def test_votes(spark):
    rows = [("a", "x", [1, 139]), ("b", "x", [1]), ("c", "y", [2]), ("d", "y", [2, 1])]
    labelled = spark.createDataFrame(rows, "label string, category string, opcodes array<int>")
    got = {r.opcode: (r.category, round(r.purity, 3), r.support) for r in opcodes.votes(labelled).collect()}
    assert got == {1: ("x", 0.667, 3), 2: ("y", 1.0, 2)}

    def loo():
        out = {}
        for label, _, ops in rows:
            rest = spark.createDataFrame([r for r in rows if r[0] != label], labelled.schema)
            out[label] = opcodes.classify(spark.createDataFrame([(label, ops)], "label string, opcodes array<int>"), opcodes.votes(rest)).first().predicted
        return out

    assert {r.label: r.predicted for r in opcodes.leave_one_out(labelled).collect()} == loo()
    assert opcodes.shared_by_two(labelled).first().opcodes == [2]


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    def __init__(self, data):
        super().__init__(data)
        self.given = 0

    def read(self, n=-1):
        out = super().read(n)
        self.given += len(out)
        return out


def test_entries_by_byte_range(spark, tmp_path):
    files = [(1, bytes([i % 251]) * (10_000 + i)) for i in range(200)]
    whole = archives.archive_bytes(files)
    assert [(n, k) for n, k, _ in b.bif_files(whole)] == [(i, 1) for i in range(200)] and b.bif_files(whole)[7][2] == files[7][1]
    for asked in ([], [5], [5, 6], [5, 150], list(range(200)), [999]):
        f = Counted(whole)
        got = dict(archives.read_entries(f, asked))
        assert got == {i: files[i][1] for i in asked if i < 200}
        assert f.given <= 20 + 16 * 200 + sum(len(c) for c in got.values()) + archives.GAP * max(len(asked), 1)
    cut = Counted(whole[:-5000])
    assert 199 not in dict(archives.read_entries(cut, range(190, 200)))
    rows = [(f"r{i}", i % 3, bytearray(bytes([i]) * i)) for i in range(60)]
    index = archives.pack(spark.createDataFrame(rows, "resref string, type int, content binary"), str(tmp_path), per_archive=20)
    read = archives.read_archives(spark, index).collect()
    assert sorted((r.resref, r.type, r.content) for r in read) == sorted(rows) and len({r.biff for r in read}) == 3
    some = archives.read_archives(spark, index).where("resref in ('r7', 'r9', 'nobody') and type = 1 and file >= 0")
    assert [r.resref for r in some.collect()] == ["r7"] and some.rdd.getNumPartitions() == 1
    assert b.key_entries((tmp_path / "index.key").read_bytes())[0][0].startswith("r")


def test_pushed_filters_reach_the_index(spark, tmp_path):
    rows = [(f"r{i}", i % 3, bytearray(b"x")) for i in range(60)]
    index = archives.pack(spark.createDataFrame(rows, "resref string, type int, content binary"), str(tmp_path), per_archive=20)
    reader = archives.ArchiveReader({"path": index})
    assert len(list(reader.pushFilters([EqualTo(("type",), 2), In(("resref",), ("r2", "r5", "r6"))]))) == 2
    assert sorted(e[1] for p in reader.partitions() for e in p.entries) == ["r2", "r5"]


def test_files_are_decoded_once_and_many_to_a_batch(spark, monkeypatch):
    from strandline.sources import binary

    calls = []
    monkeypatch.setattr(binary, "creature", lambda b: calls.append(b) or {k: None for k in ("name_strref", "short_name_strref", "xp", "hp", "max_hp", "ac_natural", "ac_effective", "thac0", "attacks", "saves", "resistances", "levels", "race", "class")})
    made = []

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            pd = __import__("pandas")
            made.extend(run(iter([pd.DataFrame({"resref": ["a", "b", "c"], "content": [b"1", b"2", b"3"]})])))

    binary.creatures(Files())
    assert calls == [b"1", b"2", b"3"] and [len(m) for m in made] == [3]
