"""Operator 6: chat formatting by rendering ever longer prefixes of a conversation.

A template is a black box: a function from a list of (role, text) to a string.  For
each turn the operator renders the turns up to it, and the same without it; what the
longer string adds is the turn's span.  Where the shorter string is not a prefix of the
longer one, the template has rewritten history, and the turn is marked.  Where the
text sits inside its span is found by rendering the turn once more with a sentinel
as its text.  All earlier turns are rendered, so a turn costs as much as its prefix is
long and a conversation is held whole.  A template that renders each turn in the same
way whatever stands before it may say so with a true attribute ``turn_local``: then at
most ``window`` turns are rendered together, which gives the same spans at a bounded
cost per turn, and no conversation is held whole.  Such a template is not taken at its
word: once the window has left turns behind, each turn is rendered after the last one
alone too, and one turn in each window after twice as many turns as the window holds; a
turn that adds something else then is an error.

Null texts and roles are empty.  Turns with equal numbers are ordered by role, then
text; null turn numbers come first, and rows without a conv_id form one conversation.
No rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = tuple[str, str]
Template = Callable[[list[Message]], str]
WINDOW = 64
SENTINEL = "\ue000\ue001"

#: The control strings of the template, and those of common ones that a text might imitate.
CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"(?:<s>)?<\|(.*?)\|>(.*?)</s>", re.S)


def escape(text: str) -> str:
    """Double backslashes, and break each control string with a backslash after its first character."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(messages: list[Message]) -> str:
    """The default template: a start mark, then each turn with its role and an end mark."""
    return "<s>" + "".join([f"<|{escape(role)}|>{escape(text)}</s>" for role, text in messages])


marked_turns.turn_local = True


def span(before: list[Message], turn: Message, template: Template, shorter: str | None = None) -> tuple[str, int, int, bool, str]:
    """What ``turn`` adds after ``before``, where its text begins and ends in that, whether history changed, and the render.

    ``shorter`` is the render of ``before`` where that is known.
    """
    if shorter is None:
        shorter = template(before) if before else ""
    longer = template([*before, turn])
    rewritten = not longer.startswith(shorter)
    cut = len(shorter)
    if rewritten:  # the common prefix is all that can be told
        cut = next((i for i, (a, b) in enumerate(zip(shorter, longer)) if a != b), min(len(shorter), len(longer)))
    piece = longer[cut:]
    sentinel = SENTINEL
    while sentinel in longer:  # a text or role has it too
        sentinel += SENTINEL[0] * len(sentinel)
    probe = template([*before, (turn[0], sentinel)])[cut:]
    head = probe.find(sentinel)
    if head < 0:  # the template leaves such texts out
        return piece, 0, 0, rewritten, longer
    tail = len(probe) - head - len(sentinel)
    return piece, head, len(piece) - tail, rewritten, longer


def check_local(before: list[Message], turn: Message, piece: str, template: Template) -> None:
    """Raises if ``turn`` adds something other than ``piece`` after these turns."""
    shorter, longer = template(before), template([*before, turn])
    if longer != shorter + piece:
        raise ValueError("the template calls itself turn_local, but what a turn adds depends on what stands before it")


def format_turns(conversations: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",), window: int = WINDOW) -> DataFrame:
    """One row per turn, in order within partitions: conv_id, position, piece, text_start, text_end, in_loss, rewritten.

    ``piece`` is the formatted text that the turn adds; all pieces of a conversation in
    order are the formatted conversation, unless a turn is ``rewritten``.  ``window``
    bounds the turns of a render for templates that are ``turn_local`` only.  The text between text_start and text_end
    (code points of the piece) is under the loss mask where ``in_loss``.
    """

    held = max(window - 1, 1) if getattr(template, "turn_local", False) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        before: list[Message] = []
        left: deque[Message] = deque(maxlen=held)  # turns that the window has left behind
        position, last = 0, None
        for batch in batches:
            rows = []
            for conv, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if at != (conv,):
                    at, position, last = (conv,), 0, None
                    before.clear()
                    left.clear()
                turn = (role or "", text or "")
                *found, last = span(before, turn, template, last)
                if left:
                    check_local(before[-1:], turn, found[0], template)
                    if position % held == 0:
                        check_local([*left, *before], turn, found[0], template)
                rows.append((conv, position, *found, turn[0] in loss_roles))
                before.append(turn)
                position += 1
                if held is not None and len(before) > held:  # the oldest goes, so the next prefix is rendered anew
                    left.append(before.pop(0))
                    last = None
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            names = ["conv_id", "position", "piece", "text_start", "text_end", "rewritten", "in_loss"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, position long, piece string, text_start long, text_end long, rewritten boolean, in_loss boolean"
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the pieces alone: turns, their digest, the text under the loss mask.

    Pieces stream through in the order ``format_turns`` leaves them in; digests are
    updated turn by turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_turns"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        at: tuple = ()
        n = loss = chars = rewritten = 0
        turns, masked = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def close() -> None:
            if at:
                done.append((at[0], n, turns.hexdigest(), loss, masked.hexdigest(), chars, rewritten))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            done.clear()
            return out

        for batch in batches:
            for conv, piece, start, end, changed, in_loss in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if at != (conv,):
                    close()
                    at = (conv,)
                    n = loss = chars = rewritten = 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                m = _TURN.fullmatch(piece)
                if m is None:
                    raise ValueError(f"conversation {conv}: not a marked turn: {piece[:80]!r}")
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if in_loss:
                    text = unescape(piece[start:end])
                    masked.update(text.encode())
                    loss += len(text)
                n += 1
                chars += len(piece)
                rewritten += changed
            yield flush()
        close()
        yield flush()

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_turns long"
    return formatted.select("conv_id", "piece", "text_start", "text_end", "rewritten", "in_loss").mapInArrow(run, schema)
