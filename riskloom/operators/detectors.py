"""Detectors that look at several lines or at the whole file.

Each function gives an array of ``(line_no, rule, match, description)`` for one
file row with ``lines``; ``rule`` is an index into :data:`DETECTOR_RULES`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import first_match, match_start, matches
from riskloom.model import (
    CONF_HIGH, CONF_LOW, CONF_MEDIUM, HIGH, LOW, MEDIUM, Rule,
)
from riskloom.rules import advice
from riskloom.rules import multiline as M

# Rules reported only by detectors, with their confidence.
DETECTOR_RULES: list[tuple[Rule, int]] = [
    (
        Rule("RACE-001", "Race Condition", MEDIUM, "CWE-367", "",
             recommendation=advice.for_category("Race Condition")),
        CONF_MEDIUM,
    ),
    (
        Rule("CSRF-002", "CSRF", HIGH, "CWE-352", "",
             "POST form without an anti-forgery token leads to a data change",
             advice.for_category("CSRF")),
        CONF_HIGH,
    ),
    (
        Rule("CSRF-003", "CSRF", LOW, "CWE-352", "",
             "POST form without a visible anti-forgery token",
             advice.for_category("CSRF")),
        CONF_LOW,
    ),
    (
        Rule("SESSION-003", "Insecure Session", HIGH, "CWE-613", "",
             recommendation=advice.for_category("Insecure Session")),
        CONF_MEDIUM,
    ),
] + [
    (
        Rule(rule_id, f"Missing Header: {header}", severity, cwe, "",
             f"Page is sent without a {header} header",
             f"Send a {header} header with every page"),
        CONF_LOW,
    )
    for rule_id, header, severity, cwe, _ in M.HEADERS
]
_RACE, _FORM_WRITE, _FORM, _LOGOUT, _FIRST_HEADER = range(5)


def _candidate(line_no, rule: Column | int, match: Column, description: Column) -> Column:
    return F.struct(
        line_no.cast("int").alias("line_no"),
        (F.lit(rule) if isinstance(rule, int) else rule).alias("rule"),
        match.alias("match"),
        description.cast("string").alias("description"),
    )


def _numbered_lines(word: str) -> Column:
    """Lines that contain a lower-case word, with their numbers."""
    return F.filter(
        F.transform("lines", lambda t, i: F.struct((i + 1).alias("line_no"), t.alias("text"))),
        lambda x: F.contains(F.lower(x["text"]), F.lit(word)),
    )


def check_then_use() -> Column:
    """``file_exists($x)`` and a file operation on ``$x`` in the next three lines."""

    def checked(x: Column) -> Column:
        variable = first_match(x["text"], M.FILE_CHECK, 1)
        uses = F.transform(
            F.slice("lines", x["line_no"] + 1, F.lit(M.CHECK_REACH)),
            lambda t: matches(t, M.FILE_OPERATION) & F.contains(t, variable),
        )
        return F.struct(
            x["line_no"].alias("line_no"),
            variable.alias("variable"),
            F.array_position(uses, F.lit(True)).alias("distance"),
        )

    hits = F.filter(
        F.transform(_numbered_lines("file_exists"), checked),
        lambda c: (c["variable"] != "") & (c["distance"] > 0),
    )

    def report(c: Column) -> Column:
        used_at = (c["line_no"] + c["distance"]).cast("string")
        before_var, rest = M.CHECK_MATCH.split("{var}")
        middle, after = rest.split("{line}")
        return _candidate(
            c["line_no"],
            _RACE,
            F.concat(F.lit(before_var), c["variable"], F.lit(middle), used_at, F.lit(after)),
            F.concat(
                F.lit("Existence of "), c["variable"], F.lit(" is checked on line "),
                c["line_no"].cast("string"), F.lit(" and the file is used on line "), used_at,
            ),
        )

    return F.transform(hits, report)


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _form_letters() -> Column:
    """A letter per line: T token word, E end of form, W data change, B both of these, - none."""

    def letter(text: Column) -> Column:
        ends, writes = matches(text, M.FORM_END), matches(text, M.STATE_CHANGE)
        return (
            F.when(matches(text, M.TOKEN_WORD), F.lit("T"))
            .when(ends, F.when(writes, F.lit("B")).otherwise(F.lit("E")))
            .when(writes, F.lit("W")).otherwise(F.lit("-"))
        )

    return F.array_join(F.transform("lines", letter), "")


# The rest of a form: up to the line with its token or its end, or as far as one looks.
_FORM_REST = "[-W]*[TEB]?"


def unprotected_forms(reach: int | None = None) -> Column:
    """POST forms without a token word in the lines after them, up to the form's end.

    ``reach`` is how many lines a form looks ahead, as a rule any number.  Other forms in
    between do not matter.  Every line is judged once, whatever the number of forms.
    """
    forms = F.transform(
        F.filter(_numbered_lines("<form"), lambda x: matches(x["text"], M.POST_FORM)),
        lambda x: x["line_no"],
    )
    bounded = reach is not None

    def rests(letters: Column) -> Column:
        """For each line, what a form on the line before it would see (without a reach)."""
        runs = F.regexp_extract_all(letters, F.lit("[-W]*[TEB]|[-W]+"), F.lit(0))

        def outcomes(run: Column) -> Column:
            last_write = F.length(F.regexp_extract(run, "^.*[WB]", 0))
            token = F.endswith(run, F.lit("T"))
            return F.transform(
                F.sequence(F.lit(1), F.length(run)),
                lambda k: F.when(token, F.lit("T")).when(k <= last_write, F.lit("W")).otherwise(F.lit("-")),
            )

        return F.flatten(F.transform(runs, outcomes))

    def verdict(seen: Column, line_no: Column) -> Column:
        if not bounded:
            return F.coalesce(F.get(seen, line_no), F.lit("-"))
        rest = F.regexp_extract(F.substr(seen, line_no + 1, F.lit(reach)), f"^{_FORM_REST}", 0)
        return (
            F.when(F.endswith(rest, F.lit("T")), F.lit("T"))
            .when(F.rlike(rest, F.lit("[WB]")), F.lit("W")).otherwise(F.lit("-"))
        )

    def judged(at: Column) -> Column:
        seen = _form_letters() if bounded else rests(_form_letters())
        return F.when(
            F.size(at) > 0,
            _bound(seen, lambda s: F.transform(
                at, lambda n: F.struct(n.alias("line_no"), verdict(s, n).alias("saw"))
            )),
        )

    open_forms = F.filter(_bound(forms, judged), lambda f: f["saw"] != "T")

    def report(f: Column) -> Column:
        writes = f["saw"] == "W"
        return _candidate(
            f["line_no"],
            F.when(writes, F.lit(_FORM_WRITE)).otherwise(F.lit(_FORM)),
            F.when(writes, F.lit(M.FORM_WRITE_MATCH)).otherwise(F.lit(M.FORM_MATCH)),
            F.lit(None),
        )

    return F.coalesce(
        F.transform(open_forms, report),
        F.array().cast("array<struct<line_no: int, rule: int, match: string, description: string>>"),
    )


def incomplete_logout() -> Column:
    """Session entries are unset but the file never destroys the session."""
    unsets = F.transform(
        F.filter(_numbered_lines("$_session"), lambda x: matches(x["text"], M.SESSION_UNSET)),
        lambda x: x["line_no"],
    )
    destroyed = F.exists(
        "lines",
        lambda t: F.contains(F.lower(t), F.lit("session_destroy"))
        & matches(t, M.SESSION_DESTROY),
    )
    return F.transform(
        F.when(~destroyed, F.slice(unsets, 1, 1)).otherwise(F.array().cast("array<int>")),
        lambda n: _candidate(
            n,
            _LOGOUT,
            F.lit(M.LOGOUT_MATCH),
            F.concat(
                F.lit("Session is left alive after "),
                F.size(unsets).cast("string"),
                F.lit(" unset call(s) on session entries"),
            ),
        ),
    )


def missing_headers() -> Column:
    """One candidate per response header that a page-producing file never sends."""
    # A line without any of these is no output and sets no header; most lines are passed over by them.
    def is_output(text: Column) -> Column:
        low = F.lower(text)
        words = F.contains(text, F.lit("<")) | F.contains(low, F.lit("echo")) | F.contains(low, F.lit("print"))
        return words & matches(text, M.PAGE_OUTPUT)

    def sent_header(sending: Column, pattern: str) -> Column:
        return F.exists(sending, lambda t: matches(t, pattern))

    def candidates(sending: Column) -> Column:
        options = []
        for n, (_, header, _, _, pattern) in enumerate(M.HEADERS):
            options.append(
                F.when(
                    ~sent_header(sending, pattern),
                    _candidate(
                        F.lit(1), _FIRST_HEADER + n,
                        F.lit(M.HEADER_MATCH.format(header=header)), F.lit(None),
                    ),
                )
            )
        return F.filter(F.array(*options), lambda c: c.isNotNull())

    sending = F.filter("lines", lambda t: F.contains(F.lower(t), F.lit("header")))
    return F.when(F.exists("lines", is_output), _bound(sending, candidates)).otherwise(
        F.array().cast("array<struct<line_no: int, rule: int, match: string, description: string>>")
    )


def file_level_matches(with_lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of patterns that span lines: first match per file, at the line it starts on.

    Not part of a normal scan.
    """
    df = with_lines.select("project", "path", F.array_join("lines", "\n").alias("body"))
    options = [
        F.when(
            matches(F.col("body"), r.pattern),
            F.struct(
                F.lit(r.rule_id).alias("rule_id"),
                first_match(F.col("body"), r.pattern).alias("match_text"),
                match_start(F.col("body"), r.pattern).alias("at"),
            ),
        )
        for r in rules
    ]
    rows = df.select("project", "path", "body", F.explode_outer(F.array(*options)).alias("h"))
    line_no = F.size(F.split(F.expr("left(body, h.at - 1)"), "\n", -1))
    return rows.where(F.col("h").isNotNull()).select(
        "project", "path", line_no.alias("line_no"), "h.rule_id", "h.match_text"
    )
