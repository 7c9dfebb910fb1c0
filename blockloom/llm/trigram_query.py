"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser as parser

MAX_STRINGS = 64  # alternatives of one stretch that are followed before it is closed


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def conjunction(pattern: str) -> list[list[frozenset[str]]]:
    """For every mandatory stretch of ``pattern`` its trigram sets, one of which is inside each
    match, in lower case; a match satisfies all stretches.

    Empty if the pattern has no mandatory trigram. A stretch that another one implies, because
    each of its sets is within one of the other's, is left out.
    """
    stretches = _Stretches()
    stretches.walk(parser.parse(pattern))
    stretches.close()
    out: list[list[frozenset[str]]] = []
    for strings in stretches.found:
        if min(map(len, strings)) < 3:
            continue
        sets = {trigrams(text) for text in strings}
        least = sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)
        if least not in out:
            out.append(least)
    implied = [a for a in out if any(b is not a and all(any(s <= t for s in a) for t in b) for b in out)]
    return [a for a in out if a not in implied]


def clauses(pattern: str) -> list[frozenset[str]] | None:
    """The stretch of ``conjunction`` with the longest strings: the most selective one alone.

    None if the pattern has no mandatory trigram: its matches can only be found by a scan.
    Stretches of literal characters are followed through groups, alternatives and single
    optional characters; of all mandatory stretches the one with the longest shortest
    alternative is asked for.
    """
    stretches = _Stretches()
    stretches.walk(parser.parse(pattern))
    stretches.close()
    best = max(stretches.found, key=lambda s: min(map(len, s)), default=None)
    if best is None or min(map(len, best)) < 3:
        return None
    sets = {trigrams(text) for text in best}
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


class _Stretches:
    """Collects the sets of strings one of which each match must contain."""

    def __init__(self):
        self.current, self.found = {""}, []

    def close(self) -> None:
        self.found.append(self.current)
        self.current = {""}

    def follow(self, strings: set[str]) -> None:
        if len(self.current) * len(strings) > MAX_STRINGS:
            self.close()
        self.current = {a + b for a in self.current for b in strings}

    def walk(self, items) -> None:
        for op, value in items:
            strings = _strings([(op, value)])
            if strings is not None:
                self.follow(strings)
            elif op is ops.SUBPATTERN:
                self.walk(value[3])
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] >= 1:
                self.close()
                self.walk(value[2])
                self.close()
            elif op is not ops.AT:
                self.close()


def _strings(items) -> set[str] | None:
    """All strings, in lower case, that a part can match, if they are few."""
    out = {""}
    for op, value in items:
        if op is ops.LITERAL:
            part = {chr(value).lower()}
        elif op is ops.SUBPATTERN:
            part = _strings(value[3])
        elif op is ops.BRANCH:
            parts = [_strings(branch) for branch in value[1]]
            part = None if None in parts else set().union(*parts)
        elif op is ops.IN and len(value) <= 8 and all(kind is ops.LITERAL for kind, _ in value):
            part = {chr(code).lower() for _, code in value}
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[0] == value[1] and value[1] <= 8:
            part = _strings(list(value[2]) * value[0])
        elif op is ops.MAX_REPEAT and value[:2] == (0, 1):
            part = _strings(value[2])
            part = {"", *part} if part is not None and len(part) == 1 else None
        else:
            part = None
        if part is None or len(out) * len(part) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def matches_somewhere(pattern: str, text: str) -> bool:
    """Whether the query of ``pattern`` admits ``text``; a pattern without one admits all."""
    have = trigrams(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return all(any(clause <= have for clause in stretch) for stretch in conjunction(pattern))
