"""Operator 4: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has the score sigmoid(w . words + b), or 0
if it has no word that the model knows, so that many sentences which say nothing do not
add up; a document has the noisy-or of its sentences: 1 - prod(1 - score).  Only documents carry
labels, and the sentence model is fitted through the noisy-or, so it learns which
sentences make a document toxic and can point at them afterwards.

The fit takes at most ``sample`` labelled documents, those with the smallest hashed
ids, leaves out texts above ``longest`` bytes, and uses the words whose share among
toxic documents differs most clearly from that among others, at most ``most_words``.
Spark counts the words; only sentences as lists of those words reach the driver.  Labels
may be wrong in a share ``noise`` of the cases either way.  Scoring reads every whole
text, in Arrow batches, by whole-array operations.

Null and empty texts have no sentences and the score 0.  Documents that occur twice,
in the input or in the labels, are scored once per row and learned from once (by the
text with the smallest hash); of several labels of an id the largest counts.  Without usable labels every score is near 0.  Empty tables give
empty tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ASCII_LOWER, Scratch, Words, by_bytes, byte_view, text_column

BATCH_BYTES = 1 << 20
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class SentenceModel:
    """Word hashes in order, their weights, and the bias of a sentence."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


class Sentences:
    """Words of a batch grouped by sentence: runs of words with no sentence end between them."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = byte_view(texts)
        self.words = words = Words(self.data, self.offsets, _WORD, ASCII_LOWER)
        ends = np.concatenate([[0], np.cumsum(_END[self.data])])
        at = ends[words.start]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (words.doc[1:] != words.doc[:-1])
        self.first = np.flatnonzero(new)  # first word of each sentence
        self.of_word = np.cumsum(new) - 1
        self.doc = words.doc[self.first]


def split_side(doc_id: str = "doc_id"):
    """The remainder by which documents are held out (2) or learned from."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def _sample(docs: DataFrame, labels: DataFrame, most: int, longest: int) -> DataFrame:
    """doc_id, toxic, text of the documents to learn from: one row an id."""
    marked = labels.where("doc_id is not null and toxic is not null").where(split_side() != 2)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` short rows
    short = docs.where(F.octet_length("text") <= longest).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of each document and the sentence of each word."""
    for batch in by_bytes(batches, BATCH_BYTES):
        found = Sentences(text_column(batch))
        cuts = np.searchsorted(found.words.doc, np.arange(batch.num_rows + 1))
        rows = [(found.words.hash[a:b].tobytes(), (found.of_word[a:b] - found.of_word[a : a + 1]).astype(np.int32).tobytes()) for a, b in zip(cuts, cuts[1:])]
        columns = [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "words", "sentences"])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.unique(np.frombuffer(w.as_buffer(), np.int64)) for w in batch.column(1)]
        toxic = np.repeat(batch.column(0).to_numpy(), [len(w) for w in words])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)), pa.array(toxic)], ["word", "toxic"])


def _telling_words(bags: DataFrame, n: int, share: float, least: int, clear: float, most: int) -> np.ndarray:
    """Hashes of the words that tell the classes apart, in order."""
    seen = bags.select("toxic", "words").mapInArrow(_distinct_words, "word long, toxic int").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    z = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = seen.where(F.col("n") >= least).select("word", z.alias("z")).where(F.col("z") >= clear).orderBy(F.desc("z"), "word").limit(most)
    return np.sort(np.array([r.word for r in best.collect()], dtype=np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8192, longest: int = 1 << 16, least: int = 5, clear: float = 4.0, most_words: int = 4096, noise: float = 0.02, rounds: int = 200, decay: float = 1e-3) -> SentenceModel:
    """Fit the sentence model; ``least``: documents that must have a word, ``clear``: its z-score."""
    nothing = SentenceModel(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    work = Scratch(docs.sparkSession)
    try:
        bags = work.stored(_sample(docs, labels, sample, longest).mapInArrow(_bags, "doc_id long, toxic int, words binary, sentences binary"))
        n, share = bags.agg(F.count("*"), F.avg("toxic")).first()
        if not n or share in (0.0, 1.0):
            return nothing
        vocabulary = _telling_words(bags, n, share, least, clear, most_words)
        if not len(vocabulary):
            return nothing

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The kept words of each document and their sentences."""
            for batch in batches:
                sentence, feature = [], []
                for w, s in zip(batch.column(2), batch.column(3)):
                    w, s = np.frombuffer(w.as_buffer(), np.uint64), np.frombuffer(s.as_buffer(), np.int32)
                    at = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
                    hit = vocabulary[at] == w
                    sentence.append(s[hit].tobytes())
                    feature.append(at[hit].astype(np.int32).tobytes())
                columns = [batch.column(0), batch.column(1), pa.array(sentence, pa.binary()), pa.array(feature, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "sentence", "feature"])

        # at most ``sample`` rows of at most ``longest`` bytes each
        rows = sorted(bags.mapInArrow(features, "doc_id long, toxic int, sentence binary, feature binary").collect(), key=lambda r: r.doc_id)
    finally:
        work.drop()
    place = np.concatenate([np.frombuffer(r.sentence, np.int32).astype(np.int64) + (i << 32) for i, r in enumerate(rows)])
    feature = np.concatenate([np.frombuffer(r.feature, np.int32) for r in rows])
    if not len(place):
        return nothing
    each, sentence = np.unique(place, return_inverse=True)
    return _descend(each >> 32, sentence, feature, np.array([r.toxic for r in rows], dtype=float), vocabulary, noise, rounds, decay)


def _descend(doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, y: np.ndarray, vocabulary: np.ndarray, noise: float, rounds: int, decay: float) -> SentenceModel:
    """Gradient steps on the log-likelihood of the document labels, with step sizes by Adam."""
    k, n = len(vocabulary), len(doc)
    theta = np.concatenate([np.zeros(k), [-6.0]])
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        score = np.bincount(sentence, weights=theta[feature], minlength=n) + theta[k]
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        clean = np.exp(-np.bincount(doc, weights=np.logaddexp(0, score), minlength=len(y)))  # prod(1 - p)
        seen = noise + (1 - 2 * noise) * (1 - clean)
        slope = (1 - 2 * noise) * np.where(y > 0, -1 / seen, 1 / (1 - seen)) * clean
        each = p * slope[doc] / len(y)
        g = np.concatenate([np.bincount(feature, weights=each[sentence], minlength=k), [each.sum()]])
        g[:k] += decay * theta[:k] / k
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return SentenceModel(vocabulary, theta[:k], float(theta[k]))


def scored_batch(batch: pa.RecordBatch, model: SentenceModel) -> tuple[Sentences, np.ndarray, np.ndarray]:
    """The sentences of a batch, their log-odds, and the score of each document."""
    found = Sentences(text_column(batch))
    odds = np.full(len(found.first), -np.inf)
    if len(model.hashes):
        at = np.minimum(np.searchsorted(model.hashes, found.words.hash), len(model.hashes) - 1)
        hit = model.hashes[at] == found.words.hash
        summed = np.bincount(found.of_word, weights=np.where(hit, model.weights[at], 0.0), minlength=len(odds)) + model.bias
        known = found.of_word[hit]
        odds[known] = summed[known]
    return found, odds, -np.expm1(-np.bincount(found.doc, weights=np.logaddexp(0, odds), minlength=batch.num_rows))


def score(docs: DataFrame, model: SentenceModel, threshold: float = 0.3, sentence_threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences.

    ``offending``: start and end (code points, of the first to the last word) and score
    of each sentence with at least ``sentence_threshold``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            found, s, doc_score = scored_batch(batch, model)
            words = found.words
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            last = np.append(found.first[1:], len(words.start)) - 1
            for j in np.flatnonzero(p >= sentence_threshold):
                d = int(found.doc[j])
                head = found.data[found.offsets[d] : words.start[found.first[j]]]
                body = found.data[words.start[found.first[j]] : words.end[last[j]]]
                start = int(((head & 0xC0) != 0x80).sum())
                spans[d].append({"start": start, "end": start + int(((body & 0xC0) != 0x80).sum()), "score": float(p[j])})
            columns = [batch.column(0), pa.array(doc_score), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "offending"])

    schema = "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>"
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    held = F.coalesce(split_side() == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Fit on the labelled documents that are not held out, then score all documents."""
    return score(docs, fit(docs, labels, **how))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; rows are dropped in the scan, nothing is shuffled."""
    model = fit(docs, labels, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, BATCH_BYTES):
            yield batch.filter(pa.array(scored_batch(batch, model)[2] < threshold))

    return docs.mapInArrow(run, docs.schema)
