"""The Merkle manifest against one built in plain loops."""

import hashlib
import os
import zlib

from strandline.llm import common
from strandline.llm.merkle import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    told = [row[0], row[3], row[2], row[4], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def built(leaves):
    """The root of a list of leaves and the proof of each, as (before, after) by level."""
    proofs, nodes = [[] for _ in leaves], [(d, [i]) for i, d in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for s in range(0, len(nodes), 8):
            run = nodes[s : s + 8]
            for j, (_, under) in enumerate(run):
                for i in under:
                    proofs[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
            above.append((digest(*(d for d, _ in run)), [i for _, under in run for i in under]))
        nodes = above
    return nodes[0][0], proofs


def slowly(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees.append((own, *built([leaf_of(r, r[1]) for r in own])))
    root, tops = built([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, proofs), top in zip(trees, tops):
        for r, proof in zip(own, proofs):
            proof = proof + top
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = text.encode().lower().decode()
            at = leaf_of(r, text)
            for before, after in proof:
                at = digest(before, at, after)
            out.append((r[0], leaf_of(r, r[1]), subroot, root, digest(*(b + a for b, a in proof)), at, at == root))
    return out


def check(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, kids string"
    docs = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], schema)
    got = [tuple(r) for r in manifest(docs.repartition(5)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=str) == sorted(slowly(rows), key=str)
    return got


def test_odd_rows(spark):
    rows = [(i, f"Text {i} É", ("en", "de", None, "", "é", "+en")[i % 6], "s" if i % 5 else None, 3 if i % 7 else None) for i in range(150)]
    rows += [(None, "No id", "en", "s", 1), (None, None, "en", None, None), (3, None, "fr", "s", 0), (4, "", "it", "s", 0), (5, "LONG " * 50_000, "en", "s", 9)]
    rows += [(7, "Twice", "en", "s", 1)] * 9 + [(7, "Other", "en", "s", 1)] * 3
    got = check(spark, rows)
    assert {v[-1] for v in got} == {True, False}


def test_sizes(spark):
    for n in (1, 8, 9, 65):
        check(spark, [(i, f"T{i}", "en", "s", 1) for i in range(n)])
    check(spark, [(i, f"T{i}", f"l{i}", "s", 1) for i in range(10)])  # a tree above of two levels, lone leaves
    check(spark, [])


def test_all_alike(spark):
    check(spark, [(1, "Same", "en", "s", 4)] * 70)


def test_nothing_is_left_behind(spark, monkeypatch):
    folders, real = [], common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda spark: folders.append(real(spark)) or folders[-1])
    out = manifest(spark.createDataFrame([(i, f"T{i}", "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long"))
    assert out.count() == 30 and [os.path.exists(f.replace("file:", "")) for f in folders].count(True) == 1
