"""Operator 7: personal data, also where it is disguised.

Plain identifiers (e-mail, IP, payment card, phone) are found in the text as it is.
Then transducers rewrite a text: look-alike letters and digits of other scripts become
ASCII, spelled digits become digits, "at" and "dot" disguises become signs.  Each
character of the rewritten text knows the source characters it stands for, so what is
detected there maps back to spans of the source.  Spans found that way are added
where they overlap no plain span of their kind; plain spans never change.

Spans count code points, the end is exclusive.  Null texts count as empty; both give
no spans.  Equal rows give equal results, one each; empty tables give empty tables;
other columns are not read (``redact`` keeps them).  Texts are read whole: a text of
any length is one pass per kind, in time proportional to its length.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import by_bytes, text_column

BATCH_BYTES = 1 << 22
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, position in KINDS

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOTTED = re.compile(r"[0-9][0-9.]*")
#: Digits are taken whole and never from their middle on, so a run of any length is read once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_ANY_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain: before each @ the run of local characters, after it a dotted name.

    A local part cannot hold an @, so looking at each @ finds what a scan from the
    left finds, without trying every character of the text as a start.
    """
    at, done = text.find("@"), 0
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            width = 64
            while True:  # the local part, looked for in ever larger windows before the @
                low = max(done, at - width)
                start = low + len(text[low:at].rstrip(_LOCAL))
                if start > low or low == done:
                    break
                width *= 8
            if start < at:
                yield start, domain.end(), 0
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(q) <= 3 and int(q or 0) <= 255 for q in [p.lstrip("0") for p in m.groups()]):
                    yield m.start(), m.end(), 1


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end(), 2


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.start(), m.end(), 3


def plain_spans(text: str) -> list[Span]:
    """Identifiers in the text as it is, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _ANY_DIGIT.search(text):
        if "." in text:
            found.extend(_ips(text))
        found.extend(_cards(text))
        if "+" in text:
            found.extend(_phones(text))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


# Letters of other scripts that look like ASCII ones, each above the letter it looks like.
_LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТХУавеѕіјкмнорстхуԁԛԝ", "ABESIJKMHOPCTXYabesijkmhopctxydqw"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρ", "ABEZHIKMNOPTYXaovp"),
)
#: Digits of other scripts start at these code points and follow each other.
_DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0xFF10)
_SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "－": "-", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " "}
_SAME = {ord(a): b for ours, ascii_ in _LOOKALIKES for a, b in zip(ours, ascii_, strict=True)}
_SAME |= {zero + i: str(i) for zero in _DIGIT_ZEROS for i in range(10)}
_SAME |= {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_SAME |= {ord(a): b for a, b in _SIGNS.items()}
_HAS_SAME = re.compile("[" + "".join(re.escape(chr(c)) for c in _SAME) + "]")

# Digit words.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_DIGIT = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
#: Six or more digit words (or single digits among them), with "plus" before and "dot" between allowed.
_SPELLED = re.compile(rf"(?<!\w)(?:(plus)[ -]+)?((?:{_DIGIT})(?:[ ,-]{{1,2}}(?:{_DIGIT}|dot|point|[0-9])(?!\w)){{5,}})", re.I)
_SPELLED_PART = re.compile(r"\w+")
_LETTERS = re.compile("[a-zéü]+")
_BRACKETED = re.compile(r" ?[\[({<] ?(at|dot|@|\.) ?[\])}>] ?", re.I)
_WORDED = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}( at | @ )(?:[\w-]{1,63}(?: dot | ?\. ?))*[\w-]{1,63}( dot | ?\. ?)[A-Za-z]{2,24}\b", re.I)
_WORD_SIGN = re.compile(r" (at|@|dot) | ?\. ?", re.I)


class Rewritten:
    """A text after replacements, with the source span of each of its characters as arrays."""

    def __init__(self, text: str):
        self.text = text
        self.start = self.end = None  # arrays once something has been replaced

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Put other characters in place of spans; changes are in order and do not overlap."""
        if not changes:
            return
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        out, start, end, done = [], [], [], 0
        for a, b, new in changes:
            if a < done:
                continue
            out += [self.text[done:a], new]
            start += [self.start[done:a], np.full(len(new), self.start[a])]
            end += [self.end[done:a], np.full(len(new), self.end[b - 1])]
            done = b
        out.append(self.text[done:])
        self.text, self.start, self.end = "".join(out), np.concatenate([*start, self.start[done:]]), np.concatenate([*end, self.end[done:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a]), int(self.end[b - 1]))


def deobfuscated(text: str) -> Rewritten | None:
    """The text after all transducers, or None where none applies."""
    out = Rewritten(text)
    same = text.isascii() or _HAS_SAME.search(text) is None
    if not same:
        out.text = text.translate(_SAME)  # one character for one, so positions stay
    now = out.text
    changes = []
    if not _DIGIT_WORDS.keys().isdisjoint(_LETTERS.findall(now.lower())):
        for m in _SPELLED.finditer(now):
            spelled = "".join("." if w.lower() in ("dot", "point") else _DIGIT_WORDS.get(w.lower(), w) for w in _SPELLED_PART.findall(m[2]))
            changes.append((m.start(), m.end(), ("+" if m[1] else "") + spelled))
        out.replace(changes)
        now = out.text
    signs = {"at": "@", "@": "@", "dot": ".", ".": "."}
    bracketed = [(m.start(), m.end(), signs[m[1].lower()]) for m in _BRACKETED.finditer(now)] if "[" in now or "(" in now or "{" in now or "<" in now else []
    out.replace(bracketed)
    now = out.text
    worded = []
    lower = now.lower()
    if " at " in lower or " @ " in lower:
        for m in _WORDED.finditer(now):
            if " dot " in m[0].lower() or " @ " in m[0]:
                worded += [(s.start(), s.end(), signs[(s[1] or "dot").lower()]) for s in _WORD_SIGN.finditer(now, m.start(), m.end())]
    out.replace(worded)
    return None if same and not changes and not bracketed and not worded else out


def added_spans(text: str, plain: list[Span]) -> list[Span]:
    """Source spans of identifiers that only the rewritten text shows."""
    rewritten = deobfuscated(text)
    if rewritten is None:
        return []
    # plain spans of a kind do not overlap, so their ends are in the order of their starts
    starts, ends = ([[s[side] for s in plain if s[2] == k] for k in range(len(KINDS))] for side in (0, 1))
    found = []
    for a, b, kind in plain_spans(rewritten.text):
        start, end = rewritten.source(a, b)
        i = bisect_right(ends[kind], start)  # the first that ends behind the start
        if i == len(ends[kind]) or starts[kind][i] >= end:
            found.append((start, end, kind))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and plain and added ones together, each by start, then kind."""
    plain = plain_spans(text)
    added = added_spans(text, plain)
    return plain, sorted(plain + added, key=lambda s: (s[0], s[2], s[1])) if added else plain


def _joined(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of plain spans by kind, the digest of the plain spans, and all spans.

    A span is written kind:start:end; ``spans`` joins them by commas.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in by_bytes(batches, BATCH_BYTES):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for text in text_column(batch).to_pylist():
                plain, every = all_spans(text)
                for k, column in enumerate(counts):
                    column.append(sum(s[2] == k for s in plain))
                digests.append(hashlib.sha256(_joined(plain).encode()).hexdigest() if plain else nothing)
                spans.append(_joined(every))
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(text: str) -> str:
    """The text with every span, plain or added, replaced by its kind in brackets; overlapping spans as one."""
    spans = all_spans(text)[1]
    if not spans:
        return text
    out, done = [], 0
    merged: list[list[int]] = []
    for a, b, kind in sorted(spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all other columns as they were, null texts null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            i = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
