"""Divergence of sources against plain loops."""

import os
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from strandline.llm import common, divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, p long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def slowly(rows, least, most):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in seen[lang].items() if n >= least}
        p = {}
        total = Counter()
        for s in sources:
            n = {t: counts[lang, s][t] for t in kept}
            total.update(n)
            p[s] = {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        q = {t: 1 + 10**9 * (total[t] + 5) // (sum(total.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:top])]
    return sorted(out)


def rows_of(seed, n, sources, words):
    rnd = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)] + ["É", "Straße", "ab"]
    out = []
    for i in range(n):
        text = " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30))).title() if i % 9 else rnd.choice([None, "", "1 2 _", "\x00-\x1f"])
        out.append((rnd.choice([i, 1, None]), text, rnd.choice(["en", "de", "d\x00e", None, ""]), rnd.choice([None, *(f"s{k}" for k in range(sources))])))
    return out


@pytest.mark.parametrize("chunk, tile", [(1 << 11, 256), (7, 2), (3, 3)])
def test_against_loops(spark, chunk, tile, monkeypatch):
    monkeypatch.setattr(op, "CELLS", 40)
    monkeypatch.setattr(op, "COMPACT_ROWS", 50)
    monkeypatch.setattr(op, "WING_BITS", 1)
    rows = rows_of(chunk, 250, 6, 60) + [(5, "hot hot Hot", "en", "s0")] * 60 + [(9, None, "xx", "a"), (9, "few words", "xx", "b"), (1, "lone", "yy", "c")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA).repartition(7)
        got = sorted(tuple(r) for r in op.divergence(docs, least=5, most=4, chunk=chunk, tile=tile).select("lang", "source", "part", "item", "value", "rank").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == slowly(rows, 5, 4)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(op, "PIECE_BYTES", 16)
    texts = ["Straße " * 40 + "x" * 100 + " end", "short Text", "", "a" * 300]
    for given in [[t] for t in texts] + [texts]:
        doc, code, n, terms = op.term_counts(pa.array(given, pa.large_string()))
        got = {(int(d), terms[int(c)].as_py()): int(k) for d, c, k in zip(doc, code, n)}
        assert got == {(i, w): k for i, t in enumerate(given) for w, k in Counter(TERM.findall(lower(t))).items()}


def test_large_counts(spark):
    big = 3 * 10**15
    df = spark.createDataFrame([(big, 7 * 10**15, 10**6)], "n long, total long, terms long").select(op.rate(*map(op.F.col, ("n", "total", "terms"))).alias("p"))
    assert df.first().p == 1 + 10**9 * (big + 5) // (7 * 10**15 + 5 * 10**6)


def test_empty_and_nothing_left_behind(spark, monkeypatch):
    folders, real = [], common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda spark: folders.append(real(spark)) or folders[-1])
    assert op.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [os.path.exists(f.replace("file:", "")) for f in folders].count(True) == 1
