"""Files of id planes against the tokenizer library and exact round trips."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import common, id_planes as op

MODEL = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(MODEL))
ENCODER = op.Encoder(MODEL, 0)
SIGNS = "ab'strvel d mABÉß漢é12²½٣!?.-_\n\t\r\x00\x1c\x85  　᠎​😀  "


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def same(texts):
    ids, offsets = ENCODER.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library_ids(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(SIGNS), st.characters(blacklist_categories=["Cs"])), max_size=40), max_size=5))
def test_any_text(texts):
    same(texts)


def test_random_signs():
    rnd = random.Random(3)
    for _ in range(20):
        same(["".join(rnd.choices(SIGNS, k=rnd.randint(0, 60))) for _ in range(300)])


def test_specials_strange_and_long_texts(monkeypatch):
    monkeypatch.setattr(op, "SEGMENT_CHARS", 50)
    monkeypatch.setattr(op, "REMEMBERED", 20)
    texts = ["a b<|endoftext|>c d's " * 9, "", "word " * 200, "x" * 300, "it's  the 'llama' we've  \n\n seen " * 30]
    same(texts)
    ENCODER.kinds[ord("w")] = op.STRANGE  # as if the library cut there in its own way
    try:
        same([*texts, "wow"])
    finally:
        ENCODER.kinds[ord("w")] = op.UNKNOWN


def test_other_vocabularies_go_whole():
    other = op.Encoder("word_bpe_49k.json", 7)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, offsets = other.batch(["Some Words here", ""])
    assert not other.by_pieces and ids[offsets[0] : offsets[1]].tolist() == [*library.encode("Some Words here", add_special_tokens=False).ids, 7] and ids[-1] == 7


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_file_round_trip(bits, kind):
    rnd = np.random.default_rng(5)
    for lengths in ([1], [5, 0, 1000, 3], [64] * 8, []):
        ids = rnd.integers(0, np.iinfo(kind).max, sum(lengths), dtype=kind) % 60_000
        names = [None, *range(-1, len(lengths) - 2)][: len(lengths)]
        content = op.pack_file(names, lengths, ids, bits, block=64)
        file = op.PlaneFile(content)
        assert file.lengths.tolist() == lengths and file.read(0, 10**9).tolist() == ids.tolist()
        assert [i if k else None for i, k in zip(file.doc_ids.tolist(), file.known)] == names
        for a, b in ((0, 1), (63, 65), (100, 100), (130, 700)):
            assert file.read(a, b).tolist() == ids[a:b].tolist()
        for broken in (content[:-1], content[1:], content[:40] + bytes([content[40] ^ 1]) + content[41:], b""):
            with pytest.raises(ValueError):
                op.PlaneFile(broken)


def test_documents(spark, make, odd, monkeypatch):
    monkeypatch.setattr(op, "FILE_IDS", 500)
    pairs = odd + [(i, f"document {i} " * (i % 50)) for i in range(200, 20, -3)] + [(7, "again")] * 5
    got = [tuple(r) for r in op.token_files(make(pairs).repartition(4), MODEL).collect()]
    want, start = [], 0
    rows = [(i, library_ids(t)) for i, t in pairs]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), crc(r[1]))):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)
    files = op.written(common.stored(op.encoded(make(pairs), MODEL)), bits=True, block=64, file_ids=500)
    assert files.count() > 5 and sum(r.n_tokens for r in op.read_documents(files).collect()) == start
    assert op.token_files(make([]), MODEL).count() == 0


def test_nothing_is_left_behind(make, monkeypatch):
    folders, real = [], common.shared_dir
    monkeypatch.setattr(common, "shared_dir", lambda spark: folders.append(real(spark)) or folders[-1])
    assert op.token_files(make([(1, "a b")]), MODEL).count() == 1
    assert [os.path.exists(f.replace("file:", "")) for f in folders].count(True) == 1


class Counting:
    """A library that counts the texts or lists of pieces it encodes apart."""

    def __init__(self, library):
        self.library, self.n = library, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode_batch_fast(self, texts, **how):
        self.n += len(texts)
        return self.library.encode_batch_fast(texts, **how)


def test_new_pieces_are_encoded_together():
    own = op.Encoder(MODEL, 0)
    own.library = Counting(own.library)
    texts = [f"word{i} {i * 7919} é漢{i} it's\n\n 😀{i}" for i in range(2000)]
    want = [library_ids(t) for t in texts]
    ids, offsets = own.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert own.library.n < 10  # one for each new piece made thousands
    own._forget()
    own.id_bytes[ids[len(ids) // 2]] += 1  # bytes do not add up: each piece apart
    ids, offsets = own.batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want and own.library.n > 1000
