"""Patterns ``A.*B.*C``, matched in time linear in the line.

A backtracking engine tries every A with every B and every C.  For segments whose matches neither
continue nor contain one another, the first A, the first B after it and any C after that decide whether there is a
match; it begins at the first A and ends with the last C of the line, whatever is between.  So a
pattern becomes three: one that finds out, anchored and without a way back; one for the text; one for the start.
``A[^;]*B[^;]*C`` is the same within each stretch of a line that holds no ``;``.

Whether segments are such is decided here, once per pattern, on their sets of positions (which
character may follow which).  Patterns that are not stay as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

_parser = re._parser
#: Characters that count one by one; all others are one more, the last.
_ASCII = 128
_EVERY = frozenset(range(_ASCII + 1))
_LONGEST_REPEAT = 64
#: Syntax that Python reads in another way, or not at all.
_UNREAD = ("[:", "\\Q", "\\p", "\\P", "\\z")
_FIXED_CLASSES = {
    "CATEGORY_DIGIT": r"[0-9]", "CATEGORY_SPACE": r"[ \t\n\f\r]", "CATEGORY_WORD": r"[0-9A-Za-z_]",
}


#: A character at the end of a segment that may be there more often, or not at all.
_LOOSE_END = re.compile(r"(?<!\\)(\\[sSwWdD]|\[\^?[^\]\\\[]+\])([*+?])$")


class Chain(NamedTuple):
    """``exists``: a match is there; ``text``, ``group``: what it is; ``start``: where, if it is known by itself."""

    exists: str
    text: str
    group: int
    start: str | None


class _Unsure(Exception):
    """Something whose matches are not known well enough."""


def _cut(pattern: str, begin: int, gap: str) -> list[str] | None:
    """The parts between gaps outside of groups; None for alternatives and for gaps of another kind."""
    parts, depth, at = [], 0, begin
    while at < len(pattern):
        ch, end = pattern[at], at + 1
        if ch == "\\":
            end = at + 2
        elif ch == "[":
            end += 2 if pattern[end : end + 1] == "^" else 1
            while pattern[end : end + 1] not in ("]", ""):
                end += 2 if pattern[end] == "\\" else 1
            end += 1
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and not depth:
            return None
        if not depth and pattern[at:end] == gap and pattern[end : end + 1] == "*":
            if pattern[end + 1 : end + 2] in ("?", "+"):
                return None
            parts.append(pattern[begin:at])
            begin = end = end + 1
        at = end
    return [*parts, pattern[begin:]]


def segments(pattern: str) -> tuple[str, str, list[str]] | None:
    """Flags, what gaps are made of (``.`` or a class like ``[^;]``) and the parts between gaps."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    for gap in [".", *dict.fromkeys(re.findall(r"\[\^[^\]\\\[a-zA-Z-]+\](?=\*)", pattern))]:
        parts = _cut(pattern, len(flags), gap)
        if parts is None:
            return None
        if len(parts) > 1:
            parts[:-1] = [_without_loose_end(part, gap) for part in parts[:-1]]
            return (flags, gap, parts) if all(parts) else None
    return None


def _without_loose_end(part: str, gap: str) -> str:
    """What the gap behind can take as well is left to it."""
    while loose := _LOOSE_END.search(part):
        if gap != "." and not _Positions(loose[1], False).chars[0] <= _Positions(gap, False).chars[0]:
            break
        part = part[: loose.start()] + (loose[1] if loose[2] == "+" else "")
    return part


class _Positions:
    """Places of a segment where a character is read: what may begin, follow and end a match."""

    def __init__(self, segment: str, fold: bool):
        self.fold = fold
        self.chars: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.first, self.last, self.empty = self.sequence(_parser.parse(segment))

    def one(self, chars: set[int]):
        if self.fold:
            both = {ord(f(chr(c))) for c in chars if c < _ASCII for f in (str.lower, str.upper)}
            chars = chars | {c for c in both if c < _ASCII}
        self.chars.append(frozenset(chars))
        self.follow.append(set())
        here = {len(self.chars) - 1}
        return here, here, False

    def sequence(self, items):
        first, last, empty = set(), set(), True
        for item in items:
            f, l, e = self.item(item)
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def item(self, item):
        kind, value = str(item[0]), item[1]
        if kind == "LITERAL":
            return self.one({min(value, _ASCII)})
        if kind == "NOT_LITERAL":
            return self.one(set(_EVERY - {value}))
        if kind == "ANY":
            return self.one(set(_EVERY))
        if kind == "IN":
            return self.one(self.charset(value))
        if kind == "AT":  # takes no character; without it there are more matches, not fewer
            return set(), set(), True
        if kind == "SUBPATTERN" and not value[1] and not value[2]:
            return self.sequence(value[3])
        if kind == "BRANCH":
            sides = [self.sequence(side) for side in value[1]]
            return set().union(*[s[0] for s in sides]), set().union(*[s[1] for s in sides]), any(s[2] for s in sides)
        if kind in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, body = value
            endless = most == _parser.MAXREPEAT
            if max(least, 0 if endless else most) > _LONGEST_REPEAT:
                raise _Unsure
            return self.repeat(body, least, None if endless else most)
        raise _Unsure

    def repeat(self, body, least: int, most: int | None):
        copies = max(least, 1) if most is None else most
        first, last, empty = set(), set(), True
        for n in range(copies):
            f, l, e = self.sequence(body)
            if most is None and n == copies - 1:
                for p in l:
                    self.follow[p] |= f
            e = e or n >= least
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def charset(self, parts) -> set[int]:
        found, negated = set(), False
        for kind, value in parts:
            kind = str(kind)
            if kind == "NEGATE":
                negated = True
            elif kind == "LITERAL":
                found.add(min(value, _ASCII))
            elif kind == "RANGE":
                found |= {min(c, _ASCII) for c in range(value[0], min(value[1], _ASCII) + 1)} or {_ASCII}
            elif kind == "CATEGORY":
                name = str(value)
                inside = _FIXED_CLASSES[name.replace("_NOT", "")]
                known = {c for c in range(_ASCII) if re.match(inside, chr(c))}
                found |= set(_EVERY) - known if "_NOT" in name else known
            else:
                raise _Unsure
        if not negated:
            return found
        if self.fold:
            found |= {ord(f(chr(c))) for c in found if c < _ASCII for f in (str.lower, str.upper)} & set(range(_ASCII))
        # Which of the characters beyond ASCII are left out does not matter: too many are no harm.
        return set(_EVERY) - found | {_ASCII}

    def goes_on(self, starts) -> bool:
        """Can the second of two readings of the same characters end before the first?"""
        seen, todo = set(), list(starts)
        while todo:
            outer, inner = todo.pop()
            if (outer, inner) in seen or not self.chars[outer] & self.chars[inner]:
                continue
            seen.add((outer, inner))
            if inner in self.last and self.follow[outer]:
                return True
            todo.extend((o, i) for o in self.follow[outer] for i in self.follow[inner])
        return False

    def first_is_earliest(self) -> bool:
        """Each start has one end, and a later start never an earlier end."""
        later = set().union(*self.follow) if self.follow else set()
        return not self.empty and not self.goes_on(
            [(o, i) for o in self.first for i in self.first] + [(o, i) for o in later for i in self.first]
        )


@lru_cache(maxsize=None)
def chain(pattern: str) -> Chain | None:
    """The three patterns, None if ``pattern`` has to stay whole.  For texts without line feeds."""
    if any(mark in pattern for mark in _UNREAD) or "(?" in pattern.removeprefix("(?i)").replace("(?:", ""):
        return None
    try:
        cut = segments(pattern)
        if cut is None:
            return None
        flags, gap, parts = cut
        read = [_Positions(part, bool(flags)) for part in parts]
        free = _Positions(gap, False).chars[0]
        if not all(r.first_is_earliest() and all(c <= free for c in r.chars) for r in read[:-1]) or read[-1].empty:
            return None
    except (_Unsure, KeyError, re.error, RecursionError):
        return None
    if parts[0].startswith("^"):
        return None  # one start: nothing to win
    first, last = parts[0], parts[-1]
    rest = "".join(f"(?>{gap}*?{part})" for part in parts[1:])
    if gap == ".":
        return Chain(f"{flags}\\A(?>.*?{first}){rest}", f"{flags}{first}.*{last}", 0, flags + first)
    groups = 1 + re.compile(first).groups + sum(re.compile(part).groups for part in parts)
    border = f"{flags}(?<!{gap})"
    return Chain(
        f"{border}(?>{gap}*?{first}){rest}",
        f"{border}(?>{gap}*?(?={first}))(?=(?>{first}){rest})({first}{gap}*{last})", groups, None,
    )
