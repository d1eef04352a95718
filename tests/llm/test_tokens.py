"""Piece encoding and token counts against the library."""

import hashlib
import random

import pytest

from strandline.llm import pieces
from strandline.llm.piece_vocab import processor, segments, vocabulary
from strandline.llm.pieces import Codec, agenda_encode, agenda_encode_many, encode_documents
from strandline.llm.token_counts import token_counts

MODEL = "piece_bpe_32k.model"


def test_documents(make, odd):
    sp = processor(MODEL)
    got = encode_documents(make(odd), MODEL).collect()
    assert len(got) == len(odd)
    want = {(i, ",".join(map(str, sp.encode(t or "")))): t or "" for i, t in odd}
    for r in got:
        ids = ",".join(map(str, r.ids))
        assert (r.doc_id, ids) in want and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(ids.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(list(r.ids)).encode()).hexdigest()
    assert encode_documents(make([]), MODEL).count() == 0


def test_random_texts():
    sp, codec, vocab = processor(MODEL), Codec(MODEL, most=50), vocabulary(MODEL)
    random.seed(5)
    texts = ["".join(random.choice("ab  the\n▁é漢😀.") for _ in range(random.randint(0, 40))) for _ in range(1500)]
    assert [codec.encode(t) for t in texts] == sp.encode(texts)
    short = Codec(MODEL, check_chars=3, most_chars=500)
    assert [[int(i) for i in ids.split(",") if i] for k in range(0, 1500, 100) for ids, _ in short.batch(texts[k : k + 100])] == sp.encode(texts)
    with pytest.raises(ValueError):
        short.check(["ab the"], [("1,2", "ab the")])
    with pytest.raises(ValueError):
        short.check(["ab the"], [(",".join(map(str, sp.encode("ab the"))), "ab  the")])
    assert [codec.decode(i) for i in sp.encode(texts)] == sp.decode(sp.encode(texts))
    words = ["▁" + "".join(random.choice("abcdefgh") for _ in range(random.randint(1, 90))) for _ in range(300)]
    assert agenda_encode_many(words, vocab) == [agenda_encode(w, vocab) for w in words]


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):
        Codec("byte_bpe_50k.json")


def test_counts(make, odd):
    sp = processor(MODEL)
    for chars in (5, 1 << 16):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(make(odd), MODEL, limit=100, segment_chars=chars, batch_bytes=1000).collect())
        assert got == sorted((i or 0, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in odd)
    assert token_counts(make([]), MODEL).count() == 0
    assert "".join(segments("ab cd  ef gh", 1)) == "abcd  efgh"


def test_json_vocabulary(make):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "", "été"]
    got = {r.doc_id: r.n_tokens for r in token_counts(make(list(enumerate(texts))), "byte_bpe_50k.json").collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_chunks_end_where_no_piece_goes_on(monkeypatch):
    sp, given, real = processor(MODEL), [], pieces.agenda_encode_many
    monkeypatch.setattr(pieces, "agenda_encode_many", lambda texts, vocab: given.extend(texts) or real(texts, vocab))
    texts = [f"No. {n},{n + 7};漢{n}字 ({n}).\n\n" for n in range(3000)]
    codec = Codec(MODEL)
    assert [[int(i) for i in ids.split(",")] for ids, _ in codec.batch(texts)] == sp.encode(texts)
    assert [text for _, text in codec.batch(texts)] == texts
    assert len(given) < 100  # a chunk for each number made thousands
    kinds, beside = codec.vocab.neighbours
    for p in codec.vocab.ids:
        assert all(beside[kinds[ord(a)], kinds[ord(b)]] for a, b in zip(p, p[1:]))


def test_long_texts_in_parts(monkeypatch, odd):
    monkeypatch.setattr(pieces, "SEGMENT_CHARS", 40)
    sp, texts = processor(MODEL), [t or "" for _, t in odd] + ["one 漢字 two\x00 é " * 60, " ", "▁", "▁▁ x", ""]
    assert [[int(i) for i in ids.split(",") if i] for ids, _ in Codec(MODEL).batch(texts)] == sp.encode(texts)
    assert [text for _, text in Codec(MODEL, most=5).batch(texts)] == sp.decode(sp.encode(texts))
    assert Codec(MODEL).batch([]) == []
