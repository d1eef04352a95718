"""Operator 9: token counts from batch encoding, lengths only.

Texts go to the tokenizer library in Arrow batches cut by bytes, so that a batch
costs about the same whatever its texts are; texts above a bound are first split
where no token can cross.  Token lists are dropped as soon as they are counted.

Nulls count as empty texts and give 0 tokens, as does the empty text.  Repeated
rows and equal ids give one row each.  An empty table gives an empty table.  Other
columns of the input are not read, so their names do not matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import by_bytes, text_column
from strandline.llm.piece_vocab import processor, resolve, segments, vocabulary

BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 16


@functools.lru_cache(maxsize=4)
def _tokenizer(model: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(resolve(model))
    out.no_truncation()
    out.no_padding()
    return out


def batch_lengths(texts: list[str], model: str, segment_chars: int = SEGMENT_CHARS) -> np.ndarray:
    """Token counts of a list of texts."""
    if model.endswith(".json"):
        found = _tokenizer(model).encode_batch(texts, add_special_tokens=False)
        return np.array([len(x.ids) for x in found], dtype=np.int64)
    # without the guarantee that tokens stop at spaces, texts stay whole
    cut = [segments(t, segment_chars) for t in texts] if vocabulary(model).separable else [[t] for t in texts]
    flat = [s for parts in cut for s in parts]
    lengths = np.fromiter(map(len, processor(model).encode(flat, num_threads=1)), np.int64, len(flat))
    ends = np.cumsum([len(parts) for parts in cut])
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[ends] - total[ends - [len(parts) for parts in cut]]


def token_counts(docs: DataFrame, model: str, limit: int = 4096, batch_bytes: int = BATCH_BYTES, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is above ``limit``.

    ``model``: a tokenizer file (.json for tokenizers, .model for sentencepiece), by
    path or by its name among the public tokenizers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, batch_bytes):
            texts = text_column(batch)
            n = batch_lengths(texts.to_pylist(), model, segment_chars)
            size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
