"""Text functions on columns.  White space is spelled out, since regex dialects differ on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space: what counts as such in lines, of ASCII and beyond.
WHITE = " \t\n\x0b\f\r" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
SPACES = "[" + "".join(f"\\u{ord(c):04X}" for c in WHITE) + "]"
_OTHER_SPACES = "[" + "".join(f"\\u{ord(c):04X}" for c in WHITE[1:]) + "]"
_BLANKS = SPACES[:-1] + r"\u0000-\u001F\u007F-\u009F]"
_OTHER_BLANKS = _OTHER_SPACES[:-1] + r"\u0000-\u001F\u007F-\u009F]"
_MARKUP = r"\^(?:0x[0-9A-Fa-f]{8}|#[0-9A-Fa-f]{6,8}|-)"
_NAME = r"[A-Za-z][A-Za-z'\- ]{0,29}"
_SPEAKER = rf"^({_NAME}): ?(.+)$"


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once: the optimizer does not copy expressions across a generator."""
    return df.select(*[F.col(c) for c in df.columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def squeezed(c: Column) -> Column:
    """Trimmed, with runs of white space as one space; single spaces, which are most of it, match nothing."""
    return trimmed(F.regexp_replace(c, f" {SPACES}+|{_OTHER_SPACES}{SPACES}*", " "))


def normalise(c: Column) -> Column:
    """Without colour markup, control characters as spaces, runs of spaces as one, trimmed; in that order.

    Texts without a caret have no markup to look for.  Controls and spaces go in one pass,
    which a single plain space, most of what there is, does not match.
    """
    plain = F.when(F.contains(c, F.lit("^")), F.regexp_replace(c, _MARKUP, "")).otherwise(c)
    return trimmed(F.regexp_replace(plain, f" {_BLANKS}+|{_OTHER_BLANKS}{_BLANKS}*", " "))


def name_key(c: Column) -> Column:
    """Lookup key of a name: small letters, single spaces."""
    return squeezed(F.lower(c))


def clean(c: Column) -> Column:
    """Trimmed, with the empty text as null."""
    return F.nullif(trimmed(c), F.lit(""))


def captured(c: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null where nothing or the empty text matched."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def lenient_int(c: Column) -> Column:
    """Leading integer of a text, null where it has none."""
    return F.regexp_extract(c, rf"^{SPACES}*([+-]?[0-9]+)", 1).try_cast("bigint")


def speaker(text: Column) -> Column:
    """Who speaks, for texts of the form 'Name: rest'."""
    return clean(captured(text, _SPEAKER, 1))


def body(text: Column) -> Column:
    """The rest after the speaker, or the whole text."""
    return F.coalesce(captured(text, _SPEAKER, 2), text)


def body_after_speaker(text: Column) -> Column:
    """The rest after the speaker, null without one."""
    return captured(text, _SPEAKER, 2)


def without_known_speaker(text: Column, *names: Column) -> Column:
    """The rest after the speaker where the speaker is one of ``names``, else the text."""
    known = reduce(lambda a, b: a | b, [speaker(text).eqNullSafe(n) & n.isNotNull() for n in names])
    return F.when(known, body_after_speaker(text)).otherwise(text)


def like_effect_name(c: Column) -> Column:
    """Short enough for the name of an effect, and not a sentence."""
    return (F.length(c) <= 48) & (F.size(F.split(c, f"{SPACES}+")) <= 6) & ~c.rlike("[.!?,;]")


def not_a_creature(c: Column) -> Column:
    """Broadcasts that only look like a speaker."""
    return c.rlike(r"(?i)^(?:your |the party |hint(?![A-Za-z0-9_]))")


# Beginnings (and whole texts) of status lines that say nothing lasting.
_PASSING_WORDS = ("detecting", "stopped detecting", "trap", "lockpick", "lock pick", "healed", "damage taken", "unaffected", "evades", "resisted", "immune", "strength modification", "spell caster level", "casting", "attacks", "is attacking", "critical")
_PASSING_STARTS = ("quick save", "locked", "spell failed", "attack roll", "roll:", "save vs", "weapon ineffective", "auto-paused", "autopaused")
_PASSING_WHOLE = ("death", "paused", "unpaused")


def passing(c: Column) -> Column:
    """Texts that report a single event, not a state that lasts."""
    words = "|".join(_PASSING_WORDS)
    return c.rlike(rf"(?i)^(?:(?:{words})(?![A-Za-z0-9_])|(?:{'|'.join(_PASSING_STARTS)})|(?:{'|'.join(_PASSING_WHOLE)})$)")


def gone(c: Column) -> Column:
    return F.lower(c) == "unsummoned"


def redacted(c: Column, home: str | None = None) -> Column:
    """Without the home path, 17-digit account numbers and the number after 'Steam ID:'."""
    if home:
        c = F.replace(c, F.lit(home), F.lit("~"))
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9_])7656[0-9]{13}(?![A-Za-z0-9_])", "<account>")
    return F.regexp_replace(c, r"(?i)(Steam ID:\s*)[0-9]{5,}", "$1<account>")


def contains_folded(c: Column, wanted: str) -> Column:
    """LIKE '%wanted%' without regard to the case of A-Z; % and _ in ``wanted`` are wildcards."""
    fold = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, fold, fold.lower()).like(f"%{wanted.translate(str.maketrans(fold, fold.lower()))}%")


def session_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def html_escaped(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c
