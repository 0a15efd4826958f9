"""Regular expressions written for RE2, made to mean the same in Spark.

Spark evaluates Java regular expressions.  Four things differ for our patterns:
``.`` and ``$`` line ends, ``\\s`` (Java adds the vertical tab), ``\\S`` and
``\\b`` (Java counts non-ASCII letters as word characters).
"""

from __future__ import annotations

import re

_SPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"
_BOUNDARY = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"


_NAMED = re.compile(r"\(\?P?<[A-Za-z_]\w*>")
# POSIX names and their Java classes.
_POSIX_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}",
    "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}",
    "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}",
    "word": r"\p{Alnum}_", "xdigit": r"\p{XDigit}",
}
_POSIX = re.compile(r"\[:(\^?)(" + "|".join(_POSIX_CLASSES) + r"):\]")


def to_java(pattern: str) -> str:
    """Java equivalent of an RE2 pattern."""
    out, i, in_class = ["(?d)"], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("\\Q", i) and not in_class:
            end = pattern.find("\\E", i + 2)
            end = len(pattern) if end < 0 else end + 2
            out.append(pattern[i:end])
            i = end
            continue
        if not in_class and (named := _NAMED.match(pattern, i)):
            out.append("(")  # names are not used, numbers stay
            i = named.end()
            continue
        if in_class and (posix := _POSIX.match(pattern, i)):
            out.append(_POSIX_CLASSES[posix[2]].replace("\\p", "\\P" if posix[1] else "\\p"))
            i = posix.end()
            continue
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif nxt == "S" and not in_class:
                out.append(f"[^{_SPACE}]")
            elif nxt == "b" and not in_class:
                out.append(_boundary(pattern, i))
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[":
            # Java reads a bare "[" inside a class as a nested class.
            out.append("\\[" if in_class else "[")
            in_class = True
        elif ch == "]" and in_class:
            out.append("]")
            in_class = False
        elif ch == "&" and in_class:
            out.append("\\&")
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def _boundary(pattern: str, at: int) -> str:
    """ASCII word boundary, in its one-sided form next to a literal letter."""
    before, after = pattern[:at], pattern[at + 2 : at + 3]
    if after.isalnum() and after.isascii():
        return f"(?<![{_WORD}])"
    if before[-1:].isalpha() and before[-1:].isascii() and before[-2:-1] != "\\":
        return f"(?![{_WORD}])"
    return _BOUNDARY


def sql_string(text: str) -> str:
    """Spark SQL literal for ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
