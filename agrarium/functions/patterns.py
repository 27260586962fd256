"""What a regular expression must contain, so that an index of short strings can find the rows worth trying."""

from __future__ import annotations

import re
from re import _constants as codes  # the standard library's own parse of its expressions
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
#: Letters that match an ASCII letter when case is ignored, though lower() leaves them apart: fixed values.
ALIKE = "ſıİK", "siik"
#: Escapes that Java reads as Python does, given the flags in JAVA.
SHARED = re.compile(r"(?:[^\\\[\](){}?*+|^$.]|\\[dDwWsSbB]|\\[^A-Za-z0-9]|\[\^?\]?(?:[^\\\[\]&~|-]|\\[dDwWsS]|\\[^A-Za-z0-9]|-(?!-))*\]|\(\?[:=!]|\((?!\?)|\)|(?:[*+?]|\{\d+(?:,\d*)?\})\??(?![*+?{])|[|^$.])*")
JAVA = "(?iuUd)"


def folded(text: Column) -> Column:
    """Text as it is looked up: lower case, and letters that match others counted as those."""
    return F.lower(F.translate(text, *ALIKE))


def literals(pattern: str) -> list[str] | None:
    """Strings in lower case of which each match holds one at least; None if there are none to tell, or the pattern isn't valid."""
    try:
        found = _needed(parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError):
        return None
    return sorted({x.translate(str.maketrans(*ALIKE)).lower() for x in found}) if found else None


def _needed(tree: parser.SubPattern) -> list[str] | None:
    """The best set of strings of a sequence: that whose shortest string is longest."""
    sets: list[list[str]] = []
    run = ""
    for op, value in [*tree, (None, None)]:
        if op is codes.LITERAL:
            run += chr(value)
            continue
        if run:
            sets.append([run])
            run = ""
        inner = None
        if op is codes.SUBPATTERN:
            inner = _needed(value[3])
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _needed(value[2])
        elif op is codes.ATOMIC_GROUP:
            inner = _needed(value)
        elif op is codes.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            inner = [x for own in each for x in own] if all(each) else None
        if inner:
            sets.append(inner)
    return max(sets, key=lambda own: min(map(len, own)), default=None)


def plan_of(pattern: str | None) -> tuple[bool, bool, list[str]]:
    """(valid, shared, grams) of an expression: whether Java reads it alike, and strings of up to GRAM letters of which each match has one ("" if none is sure)."""
    try:
        re.compile(pattern or "", re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return False, False, []
    if not pattern:
        return False, False, []
    return True, SHARED.fullmatch(pattern) is not None, sorted({x[:GRAM] for x in literals(pattern) or [""]})
