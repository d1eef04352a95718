"""The ordered rule list that classifies a line, as data, and its expression on columns.

A rule has a kind, a pattern, the names of the pattern's groups in order, and a detail
for lines whose pattern captures none.  The first matching rule counts.  Patterns see
normalised text, so white space is a single space.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import body, clean, computed_once, lenient_int, speaker

#: Word boundaries over ASCII letters, digits and underscore, alike in every Java version.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_SENTENCE = r"[.!?—–…][\"')\]]?$"
_RESYNC = rf"(?i)^capture resynced{_E}"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    groups: tuple[str, ...] = field(default=())
    detail: str | None = None
    #: In small letters, what a text must begin with, or hold, one of them at least; nothing where that cannot be told.
    begins: tuple[str, ...] = ()
    holds: tuple[str, ...] = ()


def _any_case(kind: str, pattern: str, *groups: str, detail: str | None = None, begins: tuple[str, ...] = (), holds: tuple[str, ...] = ()) -> Rule:
    return Rule(kind, f"(?i){pattern}", groups, detail, begins, holds)


# What the lines look like, in the order in which they are tried.
RULES: tuple[Rule, ...] = (
    _any_case("pause", "^(?:un)?paused$", begins=("paused", "unpaused")),
    _any_case("pause", "^auto-?paused ?: ?(.+)$", "detail", begins=("auto",)),
    Rule("action", r"^\*(.+)\*$", ("detail",), begins=("*",)),
    _any_case("song", "^(?:stopped )?singing (.+)$", "detail", begins=("singing", "stopped")),
    _any_case("damage", r"^takes ([0-9]+) ([a-z]+) damage from (.+?)(?: ?\((?:([0-9]+) damage resisted|[^)]*)\))?$", "amount", "detail", "source", "resisted", begins=("takes",)),
    _any_case("damage", "^damage taken ?[:=] ?([0-9]+)", "amount", begins=("damage",)),
    _any_case("damage", f"^(?:take|suffer|receive)s? ([0-9]+) (?:points? of )?damage{_E}", "amount", begins=("take", "suffer", "receive")),
    _any_case("immune", f"^(.+?) was immune to my damage{_E}", "target", detail="damage", holds=("was immune",)),
    _any_case("immune", f"^weapon ineffective{_E}", detail="weapon", begins=("weapon",)),
    _any_case("attack", "^attack roll -?[0-9]+ ?[-+] ?[0-9]+ ?= ?(-?[0-9]+) ?: ?([a-z]+)$", "roll", "detail", begins=("attack roll",)),
    _any_case("attack", "^attack roll ?[:=]? ?(-?[0-9]+)", "roll", begins=("attack roll",)),
    _any_case("tohit", r"^roll:(-?[0-9]+) ?\+luck:", "roll", begins=("roll:",)),
    _any_case("damageroll", r"^roll:(-?[0-9]+) ?\+damagemod:", "roll", begins=("roll:",)),
    _any_case("attack", "^attacks (.+)$", "target", begins=("attacks",)),
    _any_case("attack", "^is attacking (.+)$", "target", begins=("is attacking",)),
    _any_case("critical", "^critical (.+)$", "detail", begins=("critical",)),
    _any_case("save", r"^save vs\.? ?([a-z][a-z .]*?) ?: ?(-?[0-9]+)$", "detail", "roll", begins=("save vs",)),
    _any_case("save", f"{_B}sav(?:e|ing) throw{_E}", holds=("throw",)),
    _any_case("death", "^death$", begins=("death",)),
    _any_case("death", f"{_B}(?:has died|has been killed|is dead|dies|slain){_E}", holds=("died", "killed", "dead", "dies", "slain")),
    _any_case("cast_start", r"^casting (.+?) ?\.{2,}$", "detail", begins=("casting",)),
    _any_case("cast_start", "^is casting ?([^:]*?) ?: ?(.+)$", "detail", "target", begins=("is casting",)),
    _any_case("cast_start", "^is casting (.+)$", "detail", begins=("is casting",)),
    _any_case("spell", "^casts? (.+?) : (.+)$", "detail", "target", begins=("cast",)),
    _any_case("spell", "^casts? (.+)$", "detail", begins=("cast",)),
    _any_case("miscast", "^spell failed ?: ?(.+)$", "detail", begins=("spell failed",)),
    _any_case("level", f"{_B}level(?:ed|led)? ?up{_E}|{_B}gained a level{_E}", holds=("level",)),
    _any_case("xp", f"{_B}experience{_E}[^0-9]{{0,24}}([0-9]+)", "amount", holds=("experience",)),
    _any_case("xp", f"([0-9]+) experience{_E}", "amount", holds=("experience",)),
    _any_case("gold", f"([0-9]+) gold{_E}", "amount", holds=("gold",)),
    _any_case("loot", f"{_B}you (?:found|acquired|received|obtained){_E}", holds=("you ",)),
    _any_case("party", f"{_B}(?:gather your party|joined the party){_E}", holds=("party",)),
    Rule("effect", r"^([A-Za-z][A-Za-z'\- ]{0,30}?) : (.+)$", ("detail", "target"), holds=(" : ",)),
)


#: Stands between the captured groups; normalised text has no such character.
_CUT = "\x01"


def _whole(pattern: str) -> str:
    """The pattern so widened that it matches a whole text where it is found anywhere in it."""
    flag, core = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return flag + (core if core.startswith("^") else f"^.*?(?:{core})") + ("" if core.endswith("$") else ".*$")


def _matches(rule: Rule) -> Column:
    """Whether the rule matches the body; the pattern is tried only where the small letters (``_low``) let it."""
    found = F.col("body").rlike(rule.pattern)
    hints = [F.startswith("_low", F.lit(w)) for w in rule.begins] + [F.contains("_low", F.lit(w)) for w in rule.holds]
    return reduce(lambda a, b: a | b, hints) & found if hints else found


def _captured(rules: tuple[Rule, ...]) -> Column:
    """All groups of the rule that matched, cut out by one match of its pattern."""
    out = F.lit(None).cast("array<string>")
    for i, r in reversed(list(enumerate(rules))):
        if r.groups:
            given = F.regexp_replace("body", _whole(r.pattern), _CUT.join(f"${k}" for k in range(1, len(r.groups) + 1)))
            out = F.when(F.col("rule") == i, F.split(given, _CUT)).otherwise(out)
    return out


def _group(rules: tuple[Rule, ...], name: str) -> Column:
    """A named group among those cut out, null where the rule has none of that name or it is empty."""
    places = F.array(*[F.lit(r.groups.index(name) if name in r.groups else -1) for r in rules])
    at = F.when(F.col("rule") >= 0, F.element_at(places, F.col("rule") + 1))
    return F.when(at >= 0, F.nullif(F.get("_groups", at), F.lit("")))


def classify(df: DataFrame, text: str = "raw", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with kind, actor, target, amount, roll, resisted, detail of a normalised text column.

    The number of the matching rule is made once; only that rule's groups are extracted,
    all by one match.
    """
    t = F.col(text)
    resync = t.rlike(_RESYNC)
    split = computed_once(computed_once(df, _resync=resync, _speaker=F.when(~resync, speaker(t)), body=body(t)), _low=F.lower("body"))
    number = F.when(F.col("_resync"), F.lit(-2))
    for i, r in enumerate(rules):
        number = number.when(_matches(r), F.lit(i))
    numbered = computed_once(split, rule=number.otherwise(F.lit(-1)))
    parts = computed_once(
        computed_once(numbered, _groups=_captured(rules)),
        **{f"_{n}": clean(_group(rules, n)) for n in ("target", "source", "detail")},
        **{f"_{n}": lenient_int(_group(rules, n)) for n in ("amount", "roll", "resisted")},
    )
    by_rule = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.greatest(F.col("rule"), F.lit(0)) + 1)
    fallback = F.when(F.col("_speaker").isNull(), "other").when(F.col("body").rlike(_SENTENCE), "dialogue").otherwise("status")
    literal = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        if r.detail is not None:
            literal = F.when(F.col("rule") == i, F.lit(r.detail)).otherwise(literal)
    flipped = F.col("_source").isNotNull()
    done = computed_once(
        parts,
        kind=F.when(F.col("rule") == -2, "resync").when(F.col("rule") == -1, fallback).otherwise(by_rule),
        actor=F.when(flipped, F.col("_source")).otherwise(F.col("_speaker")),
        target=F.when(flipped, F.col("_speaker")).otherwise(F.col("_target")),
        amount=F.col("_amount"),
        roll=F.col("_roll"),
        resisted=F.col("_resisted"),
        detail=F.coalesce("_detail", literal),
    )
    return done.select(*df.columns, "kind", "actor", "target", "amount", "roll", "resisted", "detail")
