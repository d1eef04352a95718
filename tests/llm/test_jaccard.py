"""The Jaccard join against brute force."""

import os
import random
import re

import numpy as np
import pytest

from strandline.llm import jaccard
from strandline.llm.graph import components
from strandline.llm.jaccard import keep_one, key_range, near_duplicates, overlap, signature, spare


def brute(pairs, k, percent):
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = [i for i, _ in pairs]
    top = list(range(len(pairs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    classes = {}
    for x in range(len(pairs)):
        classes.setdefault(find(x), []).append(ids[x])
    return sorted((ids[x], len(sets[x]), min(classes[find(x)])) for x in range(len(pairs)))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 60)])
def test_families(make, k, percent):
    random.seed(k)
    words = [f"w{i}" for i in range(400)]
    pairs = []
    for family in range(8):
        base = random.choices(words, k=random.choice([4, 9, 12, 20, 45, 90, 300]))
        for _ in range(14):
            text = [random.choice(words) if random.random() < random.choice([0, 0.01, 0.03, 0.08]) else w for w in base]
            pairs.append((len(pairs) * 3 % 997, " ".join(text[random.choice([0, 0, 1]) :])))
    pairs += [(2000, ""), (2001, None), (2002, " \n"), (2003, "A b"), (2004, "a B"), (2005, "a b c")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(make(pairs), k, percent, block=4).collect())
    assert got == brute(pairs, k, percent)


def brute_links(pairs, k, percent):
    sets = []
    for _, t in pairs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    link = lambda s, t: bool(s & t) and 100 * len(s & t) >= percent * len(s | t)
    return sorted((pairs[a][0], sum(a != b and link(sets[a], sets[b]) for b in range(len(pairs)))) for a in range(len(pairs)))


@pytest.mark.parametrize("block", [4, 1024])
def test_number_of_links(make, block):
    random.seed(7)
    words = [f"w{i}" for i in range(300)]
    pairs = [(i, "a b c d e f") for i in range(5)] + [(5, ""), (6, None), (7, "alone here by itself")]
    for size in (12, 60, 60, 200):
        base = random.choices(words, k=size)
        for _ in range(12):
            text = [random.choice(words) if random.random() < random.choice([0, 0.01, 0.03]) else w for w in base]
            pairs.append((len(pairs), " ".join(text)))
    got = sorted((r.doc_id, r.n_links) for r in near_duplicates(make(pairs), 3, 80, block=block, links=True).collect())
    assert got == brute_links(pairs, 3, 80)
    assert dict(got)[0] == 4 and max(n for _, n in got) > 5


def test_odd_rows(make, odd):
    got = near_duplicates(make(odd), 3, 90).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[7] == (1, 7) and by[None][1] is None
    assert near_duplicates(make([])).count() == 0
    # one id with two texts: each row has the class of its own text
    two = [(1, "a b c d"), (1, "p q r s"), (9, "p q r s"), (3, "a b c d")]
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(make(two), 3, 90).collect()) == [(1, 1), (1, 1), (3, 1), (9, 1)]


def kept_keys(keys, most, count):
    """The rule of ``rare_keys`` for one set in one tile."""
    c = sorted((count(k) for k in keys), reverse=True)
    return set() if len(keys) <= most and all(x > 1 for x in c) else {k for k in keys if count(k) <= c[min(most, len(c) - 1)]}


def test_keys_lose_no_link():
    rng = np.random.default_rng(1)
    for turn in range(600):
        percent = int(rng.choice([60, 80, 90]))
        n = int(rng.integers(1, 400)) if turn % 2 else int(rng.integers(1, 20))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, n // 8)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 8)))).astype(np.uint64)]))
        both = overlap(a, b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            meet = False
            (own, reach, near, far), (other, across, close, wide) = (key_range(len(x), percent) for x in (a, b))
            for tile in {own, own + 1} & {other, other + 1}:
                if not all(tile == t or r and tile == t + 1 for t, r in ((own, reach), (other, across))):
                    continue
                x = set(a[: near if tile == own else far].tolist())
                y = set(b[: close if tile == other else wide].tolist())
                most = spare(tile, percent)
                for salt in range(3):  # whatever the counts are, as long as both sets go by the same
                    count = lambda k: 2 + (k * (2 * salt + 1) >> 7) % 5
                    assert kept_keys(x, most, count) & kept_keys(y, most, count), (len(a), len(b), both, tile)
                    meet = True
            assert meet
            width = min(len(signature(a, percent)), len(signature(b, percent)))
            x, y = (jaccard.folded(signature(s, percent)[None, :], width)[0] for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both


def test_groups_that_do_not_link(make, monkeypatch):
    """Many texts with one long passage, each too far from the others to link, and some that link after all."""
    random.seed(11)
    passage = " ".join(f"p{i}" for i in range(60))
    pairs = [(i, f"{passage} " + " ".join(f"x{i}y{j}" for j in range(random.choice([7, 9, 11, 13])))) for i in range(40)]
    pairs += [(100 + i, pairs[i][1].replace(f"x{i}y0", "z") + " z") for i in range(0, 40, 3)]
    for closest in (1, 2):
        monkeypatch.setattr(jaccard, "CLOSEST", closest)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(make(pairs), 5, 80, block=8).collect())
        assert got == brute(pairs, 5, 80)


def test_ids_that_are_null_or_repeat(make):
    random.seed(5)
    base = [f"w{i}" for i in range(40)]
    bridge = [" ".join(base), " ".join(base + ["a"] * 4), " ".join(base + ["a"] * 4 + ["b", "c", "d", "e"])]
    docs = make([(7, bridge[0]), (None, bridge[1]), (9, bridge[2]), (None, "only nulls have this text here"), (None, "only nulls have this text here"), (3, "one id and two texts of it"), (3, "another text")])
    got = sorted(((str(r.doc_id), r.component_id) for r in near_duplicates(docs, 5, 80).collect()), key=str)
    assert got == [("3", 3), ("3", 3), ("7", 7), ("9", 7), ("None", 7), ("None", None), ("None", None)]
    kept = sorted((str(r.doc_id), r.text) for r in keep_one(docs).collect())
    assert kept == [("3", "another text"), ("3", "one id and two texts of it"), ("7", bridge[0]), ("None", "only nulls have this text here")]


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(links.limit(0)).count() == 0


def test_keep_one(make):
    docs = make([(3, "a b c d e f"), (1, "A b c d e f"), (2, "other words here now and then"), (4, None)])
    kept = keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4] and kept.columns == docs.columns
    twice = keep_one(docs.union(docs))
    assert sorted(r.doc_id for r in twice.collect()) == [1, 2, 4, 4] and keep_one(docs.limit(0)).count() == 0


def test_nothing_is_left_behind(make, monkeypatch):
    from strandline.llm import common

    folders, real = [], common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda spark: folders.append(real(spark)) or folders[-1])
    near_duplicates(make([(i, f"a b c d e {i // 2}") for i in range(20)]), 5, 80).count()
    assert len(folders) == 3 and [os.path.exists(f.replace("file:", "")) for f in folders].count(True) == 1
