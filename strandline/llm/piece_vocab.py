"""What a merge-type SentencePiece model file holds, and where its texts may be cut."""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def resolve(model: str) -> str:
    """A path as it is, or the file of that name among the installed public tokenizers."""
    return model if os.path.sep in model else public_tokenizers.path(model)


@functools.lru_cache(maxsize=4)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=resolve(model))


@functools.lru_cache(maxsize=4)
def vocabulary(model: str) -> "PieceVocab":
    return PieceVocab(resolve(model))


class PieceVocab:
    """Pieces, scores and byte ids of a model, read once per Python worker.

    ``separable``: no piece has a space mark after another character and the
    normaliser is the identity with a leading space.  Then no merge crosses from
    a non-space to a space, and a text may be cut at any such place.
    """

    def __init__(self, path: str):
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        order = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True))}
        #: the better the score, the lower the rank; equal scores share a rank
        self.rank = {p: order[model.pieces[i].score] for p, i in self.ids.items()}
        self._joins: tuple[np.ndarray, np.ndarray] | None = None
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = self.types.index(UNKNOWN)
        spec = model.normalizer_spec
        self.merges = model.trainer_spec.model_type == 2
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        odd = {USER, UNUSED} & set(self.types)
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.supported = bool(self.merges and plain and not odd and len(self.byte_id) == 256)
        self.separable = self.supported and not inner


    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys ``left << 32 | right`` of all pairs of pieces that form a piece, and ``rank << 32 | piece`` of each."""
        if self._joins is None:
            ids = self.ids
            found = {
                ids[p[:k]] << 32 | ids[p[k:]]: self.rank[p] << 32 | i
                for p, i in ids.items()
                for k in range(1, len(p))
                if p[:k] in ids and p[k:] in ids
            }
            keys = np.fromiter(found.keys(), np.int64, len(found))
            order = np.argsort(keys)
            self._joins = keys[order], np.fromiter(found.values(), np.int64, len(found))[order]
        return self._joins

    @functools.cached_property
    def char_ids(self) -> np.ndarray:
        """Piece of each code point, -1 where the vocabulary has none."""
        out = np.full(0x110000, -1, dtype=np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                out[ord(p)] = i
        return out

    @functools.cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each code point, and for two numbers whether a piece holds such characters side by side.

        Characters that no piece holds beside another have the number 0; a space has that of the space mark.
        """
        sides = np.array(sorted({(ord(a), ord(b)) for p in self.ids for a, b in zip(p, p[1:])}), dtype=np.int64).reshape(-1, 2)
        known = np.unique(sides)
        kinds = np.zeros(0x110000, dtype=np.int32)
        kinds[known] = np.arange(1, len(known) + 1)
        beside = np.zeros((len(known) + 1, len(known) + 1), dtype=bool)
        beside[kinds[sides[:, 0]], kinds[sides[:, 1]]] = True
        kinds[ord(" ")] = kinds[ord(SPACE)]
        return kinds, beside

    @functools.cached_property
    def decimals(self) -> pa.Array:
        """Each id as a decimal with a comma behind."""
        return pa.array([f"{i}," for i in range(len(self.pieces))], pa.large_binary())

    @functools.cached_property
    def raw(self) -> pa.Array:
        """The bytes of text that each id stands for."""
        return pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)], pa.large_binary())


#: A space between two characters that are neither a space nor the space mark.
_CUT = re.compile(f"(?<=[^ {SPACE}]) (?=[^ {SPACE}])")


def segments(text: str, most: int) -> list[str]:
    """Pieces of about ``most`` characters whose token lists joined are those of the text.

    A cut falls on a single space, which is left out: the library puts a space
    mark of its own before each piece.  Where there is no such space the piece
    stays as long as it is, so the result is exact for any text.
    """
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.end()
    out.append(text[at:])
    return out
