"""Sharding, toxicity, media, chat, personal data, archives, decontamination, pipeline."""

import hashlib
import io
import os
import random
import re
import time
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from strandline.llm import chat, common, media, pii, queries, sharding, warc
from strandline.llm.common import HashFilter
from strandline.llm.decontamination import NUMBER_WORDS, UNITS, best_chain, leaks
from strandline.llm.toxicity import Sentences, fit, toxicity


def test_sharding(make, odd, monkeypatch):
    rows = sharding.shard_documents(make(odd), shards=4).collect()
    n = len(odd)
    assert sorted(r.position for r in rows) == sorted(r.row_number for r in rows) == list(range(n))
    assert all((r.shard, r.slot) == sharding.locate(r.row_number, n, 4, 20240229) for r in rows)
    assert all(sharding.row_at(r.shard, r.slot, n, 4, 20240229) == r.row_number for r in rows)
    by = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    assert by[1] == by[2] == (1, 0) and by[7] == (3001, zlib.crc32(b"x" * 3000))
    assert sharding.shard_documents(make([])).count() == 0
    monkeypatch.setattr(sharding, "_ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(sharding, "_BUCKETS_PER_RANGE", 3)
    many = [(None, "hot")] * 60 + [(9, "hot")] * 30 + [(i, "x" * i) for i in range(50)]
    rows = sharding.shard_documents(make(many), shards=8).collect()
    assert sorted(r.row_number for r in rows) == sorted(r.slot * 8 + r.shard for r in rows) == list(range(len(many)))
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(i), len(t) + 1) for i, t in many)
    for n in (1, 2, 3, 50, 1009):
        assert sorted(s * 8 + h for h, s in (sharding.locate(i, n, 8) for i in range(n))) == list(range(n))


def test_toxicity(spark, make, odd):
    random.seed(2)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        text = ". ".join(" ".join(random.choices(words, k=8)) for _ in range(6)) + "."
        bad = i % 4 == 0
        docs.append((i, text + (" You utter idiot moron." if bad else "")))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(make(docs), table).collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    text = dict(docs)[4]
    span = got[4].offending[0]
    assert text[span.start : span.end] == "You utter idiot moron"
    model = fit(make(docs), table)
    weights = {}
    for w in {w.lower() for _, t in docs[:40] for w in re.findall(r"[A-Za-z0-9']+", t)}:
        h = int(Sentences(pa.array([w], pa.large_string())).words.hash[0])
        at = np.flatnonzero(model.hashes == np.uint64(h))
        if len(at):
            weights[w] = float(model.weights[at[0]])
    for i, t in docs[:40]:  # sentence by sentence, word by word
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", t):
            if found := [weights[w] for w in re.findall(r"[A-Za-z0-9']+", sentence.lower()) if w in weights]:
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(found))))
        assert abs(got[i].score - (1 - clean)) < 1e-9
    twice = table.union(table.where("doc_id < 100")).union(spark.createDataFrame([(0, 0), (None, 1)], table.schema))
    assert fit(make(docs + docs[:50] + [(None, "idiot"), (3, "x" * 70_000)]), twice).weights.tolist() == pytest.approx(model.weights.tolist())
    rows = toxicity(make(odd), table).collect()
    assert len(rows) == len(odd) and {r.doc_id: r.score for r in rows}[2] == 0.0
    assert toxicity(make([]), table).count() == 0
    assert all(r.predicted == 0 for r in toxicity(make(docs[:5]), table.limit(0)).collect())


def test_media(make, odd):
    random.seed(1)
    long = "".join(random.choice("abcdefgh ") for _ in range(60_000))
    docs = [*odd, (20, long), (21, "begin " * 900 + long[1000:]), (22, long), (23, long[:30_000] * 2)]
    got = media.media_columns(make(docs)).collect()
    assert len(got) == len(docs)
    want = {(i, hashlib.sha256(media.payload_of(t or "")).hexdigest()) for i, t in docs}
    assert {(r.doc_id, r.payload_sha256) for r in got} == want
    told = {r.doc_id: r for r in got}
    for i, t in docs:  # each column by itself, with the standard library's writer of such files
        data, r = (t or "").encode(), told[i]
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        file = io.BytesIO()
        with wave.open(file, "wb") as out:
            out.setparams((1, 1, 8000, 0, "NONE", ""))
            out.writeframes(payload)
        if docs.count((i, t)) == sum(j == i for j, _ in docs):
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest())
            crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:]))
            assert r.feature == f"blocks={len(payload) // 192};min={min(payload)};max={max(payload)};sum={sum(payload)};crossings={crossings}"
    lists = media.chunk_lists(make(docs))
    written = media.write_store(make(docs), lists, media.shared_chunks(lists))
    store = written.collect()
    assert len(store) == len({r.payload_id for r in store}) == len({t or "" for _, t in docs})
    kept = [c.digest for r in store for c in r.chunks if c.data is not None]
    assert len(kept) == len(set(kept)) and any(c.data is None for r in store for c in r.chunks)
    one = media.read_store(written.where(F.col("payload_id") == store[0].payload_id), media=True).first()
    assert hashlib.sha256(one.media).hexdigest() == one.media_sha256
    with pytest.raises(Exception):  # a medium that is not the one written
        media.read_store(written.withColumn("media_id", F.lit(b"x" * 32))).collect()
    with pytest.raises(ValueError):
        media.payload_in(media.media_of(b"a" * 192) + b"b")
    assert media.media_columns(make([])).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(97, 110, 200_000).astype(np.uint8).tobytes()
    first, second = (dict.fromkeys(media.pieces(p, e)) for p, e in zip((a, b"abc" + a), media.cut_points([a, b"abc" + a])))
    assert len(first.keys() & second.keys()) > len(first) // 2


def test_chat(spark):
    rows = [(1, 0, "user", "a</s>[INST]\\"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, "assistant", "<|c|>"), (2, 0, None, ""), (None, None, "assistant", "x"), (1, 3, "assistant", "<|c|>")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table, window=3)).collect()}
    turns = "user\na</s>[INST]\\\nassistant\nb\nuser\n\nassistant\n<|c|>\nassistant\n<|c|>\n"
    assert (got[1].n_turns, got[1].turns_sha256) == (5, hashlib.sha256(turns.encode()).hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (11, hashlib.sha256(b"b<|c|><|c|>").hexdigest())
    assert got[None].loss_chars == 1 and got[2].loss_chars == 0
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0
    for t in ("\\", "a\\<|", "</s>", "[\\INST]", "<|x|></s>\\\\"):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)


def test_sentinel_in_texts_and_roles(spark):
    s = chat.SENTINEL
    rows = [(1, 0, f"user{s}", f"a{s}b"), (1, 1, s, s + s[0] * 2), (1, 2, "assistant", s)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_turns(table).orderBy("position").collect()
    assert [r.piece[r.text_start : r.text_end] for r in found] == [r[3] for r in rows]


def test_template_that_rewrites_history(spark):
    def forgetful(messages):
        return "".join(f"[{r}:{t if i == len(messages) - 1 else t[:1]}]" for i, (r, t) in enumerate(messages))

    table = spark.createDataFrame([(1, 0, "user", "aaa"), (1, 1, "assistant", "b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    rows = chat.format_turns(table, forgetful).orderBy("position").collect()
    assert [r.rewritten for r in rows] == [False, True, False]


def test_template_that_reads_the_whole_conversation(spark):
    def numbered(messages):
        return "".join(f"[{i}:{t}{'!' if i == 0 and len(messages) > 70 else ''}]" for i, (_, t) in enumerate(messages))

    table = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(80)], "conv_id long, turn long, role string, text string")
    rows = chat.format_turns(table, numbered).orderBy("position").collect()
    assert [r.position for r in rows if r.rewritten] == [70]
    assert all(r.piece == f"[{r.position}:t{r.position}]" and r.piece[r.text_start : r.text_end] == f"t{r.position}" for r in rows if r.position != 70)
    marked = spark.createDataFrame([(1, i, "user", "x" * i) for i in range(80)], "conv_id long, turn long, role string, text string")
    few, every = (chat.format_turns(marked, window=w).orderBy("position").collect() for w in (3, 200))
    assert few == every


@pytest.mark.parametrize("told", [lambda i, n: f"{i}", lambda i, n: "!" if i > 70 else "", lambda i, n: "first" if i == 0 else ""])
def test_template_that_calls_itself_local(spark, told):
    def template(messages):
        return "".join(f"[{told(i, len(messages))}:{t}]" for i, (_, t) in enumerate(messages))

    table = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(150)], "conv_id long, turn long, role string, text string")
    whole = [r.piece for r in chat.format_turns(table, template).orderBy("position").collect()]
    template.turn_local = True
    try:
        assert [r.piece for r in chat.format_turns(table, template).orderBy("position").collect()] == whole
        assert whole[1:] == [f"[:t{i}]" for i in range(1, 150)]  # only where turns do not depend on those before
    except PythonException as error:
        assert "turn_local" in str(error)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(t)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(t) if all(re.fullmatch("0*[0-9]{1,3}", x) and int(x[-3:]) <= 255 for x in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_plain_identifiers():
    random.seed(1)
    for _ in range(20_000):
        t = "".join(random.choice("a1.@-+ b(0") for _ in range(random.randint(0, 40)))
        assert pii.plain_spans(t) == brute_spans(t), t
    assert pii.plain_spans("x" * 5000 + "@a.b") == [(0, 5004, 0)]


@pytest.mark.parametrize("text", ["0" * 5000 + "1.2.3.4", "9" * 5000 + ".2.3.4", "1.2.3." + "0" * 6000, "1 " * 5000, "+" + "1" * 9000, "٣" * 5000 + ".1.1.1", "one " * 5000 + "at x dot com", "1.2.3.0256 1.2.3.00255"])
def test_long_runs_of_digits(text):
    assert pii.plain_spans(text) == brute_spans(text)
    pii.all_spans(text), pii.redacted(text)


@pytest.mark.parametrize("unit", ["9" * 100, "9" * 90 + "...", "1.2.3.4 ", "1.2.3.", "a@b.cc ", "a" * 99 + " b@", "4111 1111 1111 1111,", "+" + "(" * 50, "１.2.3.4 a@b.cc "])
def test_time_grows_with_length(unit):
    def took(n):
        text = (unit * (n // len(unit) + 1))[:n] + "...é１"
        start = time.perf_counter()
        pii.all_spans(text)
        return time.perf_counter() - start

    assert took(1_000_000) < 20 * max(took(100_000), 0.2)


def test_added_spans_overlap_no_plain_span_of_their_kind():
    random.seed(6)
    for _ in range(3000):
        t = "".join(random.choice(["1", "１", ".", " ", "a", "@", "b.cc", "2.3.4", " at ", " dot ", "+", "[at]"]) for _ in range(random.randint(0, 25)))
        plain, every = pii.all_spans(t)
        rewritten, want = pii.deobfuscated(t), []
        if rewritten:
            mapped = [(*rewritten.source(a, b), k) for a, b, k in brute_spans(rewritten.text)]
            want = [m for m in mapped if not any(k == m[2] and a < m[1] and m[0] < b for a, b, k in plain)]
        assert plain == brute_spans(t) and every == sorted(plain + want, key=lambda s: (s[0], s[2], s[1])), t


@pytest.mark.parametrize("text,found", [
    ("é mail jane.doe [at] example [dot] org now", "jane.doe [at] example [dot] org"), ("jane at example dot com", "jane at example dot com"), ("1９２.168.0.1", "1９２.168.0.1"),
    ("call plus one five five five one two three four five six seven ok", "plus one five five five one two three four five six seven"),
])
def test_disguises(text, found):
    plain, every = pii.all_spans(text)
    assert [text[a:b] for a, b, _ in every if (a, b, _) not in plain] == [found]
    assert found not in pii.redacted(text)


@pytest.mark.parametrize("text", ["JANE AT EXAMPLE DOT COM", "jane At example Dot com", "jane @ EXAMPLE DOT com", "JANE [AT] EXAMPLE [DOT] COM"])
@pytest.mark.parametrize("around", ["{}", "WRITE TO: {}, NOW", "look at this: {}"])
def test_disguises_in_any_case(text, around):
    whole = around.format(text)
    assert [whole[a:b] for a, b, _ in pii.all_spans(whole)[1]] == [text]
    assert pii.redacted(whole) == around.format("[EMAIL]")


def test_pii_rows(make, odd):
    docs = [*odd, (30, "a@b.cc 4111 1111 1111 1111")]
    got = {r.doc_id: r for r in pii.find(make(docs)).collect()}
    assert (got[30].n_email, got[30].n_card, got[30].spans) == (1, 1, "email:0:6,card:7:26")
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    out = pii.redact(make(docs))
    assert out.columns == make(docs).columns and {r.doc_id: r.text for r in out.collect()}[30] == "[EMAIL] [CARD]"
    assert pii.find(make([])).count() == 0


def test_warc(spark):
    same = "<p>" + "same " * 50
    rows = [(5, "http://a", same), (3, "http://b\r\nX", same), (9, None, same), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", same), (7, "u", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload_digest string")
    for dictionary in (b"", warc.train_dictionary(spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("<html><p>words and more words "), F.col("id") * 977).alias("html")), size=2048)):
        archives = warc.write_archives(warc.marked(pages), dictionary, archive_bytes=2000)
        got = {r.page_id: r for r in warc.read_archives(archives).collect()}
        assert len(got) == len(rows)
        assert [(got[i].record_type, got[i].refers_to) for i in (3, 5, 9, 1, 2, 4, None)] == [("response", None), ("revisit", 3), ("revisit", 3)] + [("response", None)] * 3 + [("revisit", 3)]
        assert got[7].payload.decode() == "é" * 100_000 and got[5].payload_bytes == len(same) and got[9].url is None
    content = archives.first().content
    with pytest.raises(Exception):
        list(warc.frames_of(bytes(content[:-3])))
    good = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[4:], good[:-4], good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(Exception):
            warc.parse_record(bad)
    assert warc.read_archives(warc.write_archives(warc.marked(pages.limit(0)), b"")).count() == 0


def test_revisits_without_html(spark, monkeypatch):
    monkeypatch.setattr(warc, "hash_filter", lambda hashes: spark.sparkContext.broadcast(HashFilter(6, np.full(1, 2**64 - 1, np.uint64))))  # lets all rows through
    long = "x" * 200
    rows = [(1, "u", long), (2, "v", long), (2, "w", long), (None, "n", long), (3, None, "y" * 150), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (1, "again", long), (None, "n", "z" * 150), (None, "m", "z" * 150)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, first string")
    told = warc.marked(pages)
    assert all((r.html is None) == (r.refers_to is not None) or r.page_id == 6 for r in told.collect())
    got = sorted((str(r.page_id), r.url, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(told, b""), payload=False).collect())
    later = lambda i, html: html == long and i != 1
    assert got == sorted((str(i), u, len(h or ""), "revisit" if later(i, h) else "response", 1 if later(i, h) else None) for i, u, h in rows)


@pytest.mark.parametrize("name", ["op5_media", "op8_warc", "op10_decontamination"])
def test_nothing_is_left_behind(spark, monkeypatch, name):
    folders, real = [], common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda spark: folders.append(real(spark)) or folders[-1])
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.columns and [os.path.exists(f.replace("file:", "")) for f in folders].count(True) == 1


def test_decontamination(spark, make, odd):
    item = "A train leaves the station with 40 cars at noon and Maria pays 12 dollars for 3 tickets while 40 cars wait behind the old bridge near the river"
    other = item.replace("40", "75").replace("12", "19").replace("Maria", "Otto").replace("tickets while", "tickets while")
    mixed = item.replace("40", "75", 1).replace("dollars for 3", "dollars for 8")
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "too short", "x")], "item_id long, text string, window string")
    docs = make([*odd, (10, "before " + item.upper() + " after"), (11, "xx. " + other), (12, mixed), (13, item[: len(item) // 2]), (14, "noise " * 50)])
    got = {r.doc_id: r for r in leaks(docs, bench).collect()}
    assert set(got) == {10, 11, 12} and got[12].consistent == 0.8  # one of five values stands for two
    assert got[11].changed > 0 and got[11].consistent == 1.0
    assert leaks(make([]), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_one_alignment(spark, make):
    item = "A train leaves the station with 40 cars at noon and then Maria pays 12 dollars for the tickets while 40 cars wait behind the old bridge near the river and Maria waves"
    random.seed(3)

    def like():
        return re.sub("40|12|Maria", lambda m: "Otto" + random.choice("abcdefgh") if m[0] == "Maria" else str(random.randint(100, 999)), item)

    lines = "\n".join(like() for _ in range(20))
    put_in = item.replace("for the tickets", "for all of the nice little tickets")
    far = item.replace("for the tickets", "for " + "quite other words " * 30 + "the tickets")
    docs = {1: item, 2: f"{item}\n{lines}", 3: f"{lines}\n{item}\n{lines}", 4: lines, 5: f"{lines}\n{put_in}\n{lines}", 6: far, 7: f"{lines}\n" + put_in.replace("40", "75").replace("12", "19").replace("Maria", "Otto")}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in leaks(make(list(docs.items())), bench).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7}
    assert all(got[i].changed == 0 and got[i].consistent == 1.0 for i in (1, 2, 3, 5, 6))
    assert got[1].matched == got[2].matched == got[3].matched == got[1].windows and got[7].changed > 0


def test_far_pieces_beside_many_shifts(spark, make):
    item = "Maria counts 40 cars near the bridge while the slow train of 12 wagons waits and then Maria sells 40 tickets behind the old mill where 12 men sleep until Maria calls all of them"
    pieces = [" ".join(item.split()[a:b]) for a, b in ((0, 14), (10, 26), (22, 40))]
    other = [p.replace("Maria", "Berta").replace("40", "77").replace("12", "31") for p in pieces]
    random.seed(4)
    noise = [re.sub("40|12|Maria", lambda m: "Otto" + random.choice("abcdefgh") if m[0] == "Maria" else str(random.randint(100, 9999)), " ".join(item.split()[:22])) for _ in range(200)]

    def between(parts):
        lines = [f"so {n} gap{i}" for i, n in enumerate(noise)]
        for at, part in zip((50, 100, 150), parts):
            lines.insert(at, f"so {part}")
        return "\n".join(lines)

    docs = {1: between(other), 2: between(pieces), 3: between([]), 4: between(other[:2]), 5: between([other[2], other[1], other[0]])}
    got = {r.doc_id: r for r in leaks(make(list(docs.items())), spark.createDataFrame([(1, item)], "item_id long, text string"), coverage=0.8).collect()}
    assert set(got) == {1, 2} and got[1].changed > 0 and got[2].changed == 0 and got[1].consistent == got[2].consistent == 1.0


@pytest.mark.parametrize("seed", range(6))
def test_bound_of_coverage_loses_nothing(seed, monkeypatch):
    from strandline.llm import decontamination as op

    rng = np.random.default_rng(seed)
    for _ in range(60):
        n = int(rng.integers(2, 60))
        position, at = rng.integers(0, 8, n), rng.integers(0, 90, n)
        slots = np.where(rng.random((n, 5)) < 0.3, rng.integers(1, 4, (n, 5)), 0)
        theirs = np.where(slots > 0, rng.integers(1, 4, (n, 5)), 0)
        args = position, at, slots, theirs, int(rng.integers(3, 8)), 0.8
        with_bound = best_chain(*args)
        with monkeypatch.context() as m:
            m.setattr(op.Coverable, "most", lambda self, values, theirs: 1 << 30)
            assert best_chain(*args) == with_bound


def slow_words(text):
    """Words of a text with their kinds, by a pattern and a loop."""
    out, opens, number = [], True, False
    for m in re.finditer(r"[0-9A-Za-z%$\u0080-\uffff]+|[.!?\n]", text):
        w = m[0]
        if w in ".!?\n":
            opens = True
            continue
        kind = "name" if w[0].isupper() and w[1:2].islower() and not opens else ""
        before, number = number, bool(re.search("[0-9]", w)) or w.lower() in NUMBER_WORDS
        kind = "number" if number else kind
        if before and w.lower() in UNITS:
            kind = "unit"
        out.append((kind, w.lower()))
        opens = False
    return out


def slow_windows(words):
    return {i: [k or w for k, w in words[i : i + 5]] for i in range(len(words) - 4) if sum(not k for k, _ in words[i : i + 5]) >= 3}


def slow_leaks(docs, items):
    """All pairs, all shifts: item held if 0.8 of its windows are at one shift and 0.8 of its values stand for one value."""
    out = set()
    for item_id, item in items:
        opening, inner = slow_words(item), slow_words("x " + item)[1:]
        mine, first = slow_windows(opening), slow_windows(inner).get(0)
        for doc_id, text in docs:
            words = slow_words(text or "")
            if not mine:
                n = len(opening)
                if n and any([w for _, w in words[i : i + n]] == [w for _, w in opening] for i in range(len(words) - n + 1)):
                    out.add((doc_id, item_id, 1, 1))
                continue
            theirs = slow_windows(words)
            for shift in range(-len(opening), len(words)):
                hit = [p for p in mine if (got := theirs.get(p + shift)) is not None and (got == mine[p] or p == 0 and got == first)]
                stands = {}
                for p in hit:
                    read = opening if theirs[p + shift] == mine[p] else inner
                    for i in range(5):
                        if read[p + i][0]:
                            stands.setdefault(read[p + i][1], set()).add(words[p + shift + i][1])
                if len(hit) >= -(-8 * len(mine) // 10) and (not stands or np.mean([len(v) == 1 for v in stands.values()]) >= 0.8):
                    out.add((doc_id, item_id, len(mine), len(hit)))
    return out


def test_decontamination_against_all_pairs(spark, make):
    random.seed(9)
    small = "red blue green stone river house walks sings eats under over with and the of to".split()
    pick = lambda n: " ".join(random.choice(small) if random.random() < 0.75 else random.choice(["Anna", "Otto", "Ödön", "Иван", "12", "drei", "40", "5 km", "seven"]) for _ in range(n))
    items = [(i, pick(random.choice([3, 6, 12, 20, 40]))) for i in range(24)] + [(90, "Anna Otto 12"), (91, "7 8 9 10 11 12 13"), (92, "zebra"), (93, ""), (94, items_of := "red Anna " + pick(14)), (95, items_of)]
    docs = [(i, pick(random.randint(0, 60))) for i in range(40)]
    for i in range(60):
        item = random.choice(items)[1]
        if random.random() < 0.5:
            item = re.sub("Anna|12", lambda m: {"Anna": "Karl", "12": "77"}[m[0]], item)
        elif random.random() < 0.3:
            item = re.sub("Anna|Otto|40", lambda m: random.choice(["Karl", "Emil", "99", "Ines"]), item)
        docs.append((100 + i, f"{pick(random.randint(0, 9))}. {item} {pick(random.randint(0, 9))}"))
    docs += [(100, docs[50][1]), (300, None), (301, "")] + docs[60:63]
    table = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, window string")
    got = {(r.doc_id, r.item_id): (r.windows, r.matched) for r in leaks(make(docs), table).collect()}
    want = {}
    for d, i, n, m in slow_leaks(docs, items):
        want[d, i] = max(want.get((d, i), (0, 0)), (n, m))
    assert want.keys() <= got.keys() and all(got[k] == v for k, v in want.items())
    # what else is found goes on at another shift, so no single one has enough
    assert len(want) > 40 and all(got[k][1] >= 0.8 * got[k][0] for k in got.keys() - want.keys())
    assert {k[1] for k in want} >= {90, 91, 94, 95} or len({k[1] for k in want}) > 15


def test_rows_with_equal_and_null_ids(spark, make):
    from strandline.llm.decontamination import decontaminate

    item = "a train leaves the station with 40 cars at noon and then Maria pays 12 dollars for the tickets"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (1, "a clean text"), (None, f"so {item}"), (None, "clean too"), (2, item), (2, item), (3, None), (4, "")]
    kept = decontaminate(make(rows), bench)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "a clean text"), ("3", "None"), ("4", ""), ("None", "clean too")]
    assert len(leaks(make(rows), bench).collect()) == 3
    assert decontaminate(make(rows), bench.limit(0)).count() == len(rows) and decontaminate(make([]), bench).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, out, "/root/testdata/sf0.001").cache()
        assert kept.columns == docs.columns and kept.join(out, "doc_id", "left_anti").count() == 0, name
        out = kept
    assert 0 < out.count() < docs.count()
    assert not any(brute_spans(r.text) for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").count() == out.count()


def test_pipeline_with_odd_rows(spark, make, odd, tmp_path):
    """Each stage on nulls, blanks, a long text, repeated rows and ids, clashing names; and on an empty table."""
    import corpus_pipeline

    random.seed(4)
    prose = lambda n: " ".join(random.choice("stone river green house walks under".split()) + str(random.randint(0, 99)) for _ in range(n)) + "."
    item = "a train leaves the station with 40 cars at noon and then Maria pays 12 dollars for the tickets"
    clean = [(100 + i, prose(30)) for i in range(60)]
    toxic = [(200 + i, prose(20) + " You utter idiot moron.") for i in range(20)]
    copies = [(300, prose(60)), (301, ""), (302, None)]
    copies += [(303, copies[0][1]), (None, copies[0][1]), (299, copies[0][1].replace("stone", "stone ", 1)), (304, clean[5][1])]
    long = (400, prose(120_000) + " jane@example.org")
    leaked = [(500, f"so {item} and"), (None, item), (501, item.replace("40", "77"))]
    rows = [*odd, *clean, *toxic, *copies, long, *leaked, (600, "one"), (600, "two"), (None, "nobody 10.0.0.1")]
    spark.createDataFrame([(i, int(i >= 200), 1) for i, _ in clean + toxic], "doc_id long, toxic int, text int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item, 5)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, kept = make(rows), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path)).cache()
        kept[name] = sorted((str(r.doc_id), r.text) for r in out.collect() if r.text != long[1]) if name != "personal_data" else out.collect()
        assert out.columns == make([]).columns
        assert stage(spark, make([]), str(tmp_path)).count() == 0
    # by hand: what each stage drops
    told = lambda pairs: sorted((str(i), t) for i, t in pairs if t != long[1])
    left = [r for r in rows if r not in toxic]
    assert [r for r in kept["toxicity"] if r[1] is None or "idiot" not in r[1]] == kept["toxicity"] and len(kept["toxicity"]) == len(left) - 1
    for gone in (copies[0], copies[3], copies[4], copies[6], (5, odd[4][1]), leaked[1]):  # the last is a near copy of the leak before it
        left.remove(gone)
    assert sorted(map(str, kept["near_copies"])) == sorted(map(str, told(r for r in left)))
    left = [r for r in left if r not in leaked]
    assert sorted(map(str, kept["decontamination"])) == sorted(map(str, told(left)))
    final = {str(r.doc_id): r for r in kept["personal_data"]}
    assert final["400"].text.endswith("[EMAIL]") and final["400"].n_chars == len(final["400"].text) and final["302"].text is None
    assert any(r.text == "nobody [IP]" for r in kept["personal_data"])
    ids = {str(r.doc_id): r.n_tokens for r in corpus_pipeline.encode(spark, out, "").collect()}
    assert ids["1"] == ids["301"] == 0 and ids["400"] > 120_000
