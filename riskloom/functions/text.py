"""String helpers with the scanner's meaning, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from riskloom.functions.dialect import to_java

# Unicode white space, what "trimmed" means for a source line.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def clipped(text: Column, size: int) -> Column:
    """Text cut to ``size`` characters, with an ellipsis if something was lost."""
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))
    ).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(to_java(pattern)))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of an RE2 pattern, ``''`` if there is none."""
    return F.regexp_extract(text, to_java(pattern), group)


def match_start(text: Column, pattern: str) -> Column:
    """1-based start of the first match, 0 if there is none."""
    return F.regexp_instr(text, F.lit(to_java(pattern)))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(to_java(pattern)), F.lit(0))


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last extension with its dot, lower case; ``''`` if the name has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def glob_to_regex(pattern: str) -> str | None:
    """Anchored regex for a shell glob; ``None`` for a malformed one.

    ``*`` and ``?`` stay inside one path component.
    """
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            body = body[1:] if negated else body
            body = body.replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{'^/' if negated else ''}{body}]")
            i = end
        elif ch == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def glob_regex(pattern: Column) -> Column:
    """:func:`glob_to_regex` for globs that are data; NULL for a malformed one."""
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)\[.[^\]]*\]|\\.|."), F.lit(0))
    plain = lambda t: F.regexp_replace(t, r"([\x00-/:-@\[-^`{-\x7f])", r"\\$1")

    def translated(t: Column) -> Column:
        body = F.substr(t, F.lit(2), F.length(t) - 2)
        negated = F.startswith(body, F.lit("^"))
        inner = F.replace(F.replace(
            F.when(negated, F.substr(body, F.lit(2))).otherwise(body), F.lit("["), F.lit("\\[")
        ), F.lit("&"), F.lit("\\&"))
        whole = F.length(t) > 1
        return (
            F.when(t == "*", F.lit("[^/]*")).when(t == "?", F.lit("[^/]"))
            .when(F.startswith(t, F.lit("[")) & whole, F.concat(
                F.lit("["), F.when(negated, F.lit("^/")).otherwise(F.lit("")), inner, F.lit("]")
            ))
            .when(F.startswith(t, F.lit("\\")) & whole, plain(F.substr(t, F.lit(2))))
            .when(t.isin("[", "\\"), F.lit(None).cast("string"))
            .otherwise(plain(t))
        )

    parts = F.transform(tokens, translated)
    return F.when(
        ~F.exists(parts, lambda t: t.isNull()),
        F.concat(F.lit("^"), F.array_join(parts, ""), F.lit("$")),
    )
