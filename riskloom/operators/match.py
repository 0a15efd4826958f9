"""Lines against rules: where each rule hits first, and what softens a hit."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import sqltext
from riskloom.functions.sqltext import any_of
from riskloom.functions.text import contains_any, first_match, trimmed
from riskloom.model import (
    CONF_HIGH, CONF_LOW, CONF_MEDIUM, HIGH, Rule,
)
from riskloom.operators import words
from riskloom.operators.comments import surely_skipped
from riskloom.rules import exemptions as X
from riskloom.rules.chains import Chain, chain
from riskloom.rules.literals import required_literals
from riskloom.rules.sanitizers import SANITIZERS

LOOKBACK_LINES = 5
# Signs that case folding leaves alone, rare ones first.
GATES = ("$_", "$", "`", "://", "_", "<", "(", "=", "-")
# Rules of one branch of the choice of a rule; about the root of their number is asked least.
BRANCH = 12
_SANITIZED_CATEGORIES = {category for category, _, _ in SANITIZERS}
POSSIBLE = "ARRAY<STRUCT<line: INT, rules: ARRAY<INT>>>"
cloudpickle.register_pickle_by_value(words)


def gate(rule: Rule) -> str:
    """A sign that every line the rule hits has, '' if none is known; it is asked for before the pattern."""
    needed = [hint for hint in rule.hints if "|" not in hint or len(hint) == 1]
    needed += [words[0] for words in required_literals(rule.pattern) if len(words) == 1]
    return next((sign for sign in GATES if any(sign in word for word in needed)), "")


def needs(rule: Rule) -> list[list[str]]:
    """Words that every line the rule hits has, one of each list; "a|b" is one hint of two forms."""
    hints = [hint.split("|") if len(hint) > 1 else [hint] for hint in rule.hints]
    found = [sorted(hint) for hint in hints] + required_literals(rule.pattern)
    # Signs of one character are in too many lines to be looked up; the pattern asks for them.
    telling = [need for need in found if min(map(len, need)) > 1 or need == ["`"]]
    return [list(need) for need in dict.fromkeys(map(tuple, telling))]


def possible_rules(rules: list[tuple[int, list[list[str]]]]) -> Column:
    """Per file: lines with the numbers of rules whose required words they have, as :data:`POSSIBLE`."""
    search, ready = words.possible_rules, []

    def found(lines):
        if not ready:
            ready.append(words.Needs(rules))
        return search(lines, ready[0])

    return F.arrow_udf(found, POSSIBLE)("lines")


def _chain_match(text: str, parts: Chain) -> tuple[str, str]:
    """SQL for text and start of a match that is known to exist."""
    whole = sqltext.extract(text, parts.text, parts.group)
    if parts.start:
        return whole, sqltext.start(text, parts.start)
    stretch = f"length({sqltext.extract(text, parts.text)})"
    return whole, f"{sqltext.start(text, parts.text)} + {stretch} - length({whole})"


def rule_hit(text: str, number: str, rules: list[Rule]) -> str:
    """SQL for the hit of the rule with a number on a line: ``(rule_ord, match, pos)``, its first match.

    ``pos`` is only needed, and only filled, where sanitizers exist.
    """
    cases = []
    for rule_ord, rule in enumerate(rules, 1):
        sign = gate(rule)
        conditions = [any_of(text, [sign])] if sign else []
        if rule.unless:
            conditions.append(f"NOT {sqltext.rlike(text, rule.unless)}")
        whole, start = sqltext.extract(text, rule.pattern), sqltext.start(text, rule.pattern)
        if parts := chain(rule.pattern):
            conditions.append(sqltext.rlike(text, parts.exists))
            whole, start = _chain_match(text, parts)
        pos = "0"
        if rule.category in _SANITIZED_CATEGORIES:
            if not parts:
                conditions.append(sqltext.rlike(text, rule.pattern))
            pos = start
        hit = f"named_struct('rule_ord', {rule_ord}, 'match', {whole}, 'pos', {pos})"
        cases.append(f"WHEN {rule_ord} THEN if({' AND '.join(conditions) or 'true'}, {hit}, NULL)")
    branches = [
        f"WHEN {number} <= {min(first + BRANCH, len(cases))} THEN CASE {number} {' '.join(cases[first : first + BRANCH])} END"
        for first in range(0, len(cases), BRANCH)
    ]
    return f"CASE {' '.join(branches)} END"


def with_hits(df: DataFrame, rules: list[Rule], masked: bool = True) -> DataFrame:
    """Adds ``hits``: ``(line_no, in_comment, text, rule_ord, match, pos)`` per hit.

    Needs ``lines`` and, unless ``masked`` is off, ``in_comment``.  Patterns are run on lines that have
    the words they require.
    """
    if not rules:
        none = F.array().cast(
            "ARRAY<STRUCT<line_no: INT, in_comment: STRING, text: STRING, rule_ord: INT, match: STRING, pos: INT>>"
        )
        return df.withColumn("hits", none)
    state = (lambda i: F.get("in_comment", i)) if masked else (lambda i: F.lit("0"))
    prepared = F.transform(
        "_possible",
        lambda x: F.struct(
            (x["line"] + 1).alias("line_no"),
            state(x["line"]).alias("in_comment"),
            F.get("lines", x["line"]).alias("text"),
            x["rules"].alias("rules"),
        ),
    )
    if masked:
        prepared = F.filter(
            prepared, lambda x: ~surely_skipped(x["text"], x["in_comment"])
        )
    hits = F.expr(
        "flatten(transform(_prepared, x -> transform("
        f"filter(transform(x.rules, n -> {rule_hit('x.text', 'n', rules)}), h -> h IS NOT NULL AND h.match <> '')"
        ", h -> named_struct('line_no', x.line_no, 'in_comment', x.in_comment, "
        "'text', x.text, 'rule_ord', h.rule_ord, 'match', h.match, 'pos', h.pos))))"
    )
    possible = possible_rules([(number, needs(rule)) for number, rule in enumerate(rules, 1)])
    return (
        df.withColumn("_possible", possible).withColumn("_prepared", prepared).withColumn("hits", hits)
        .drop("_possible", "_prepared")
    )


def first_variable(text: Column) -> Column:
    return first_match(text, X.VARIABLE)


# -- exemptions ------------------------------------------------------------------


def uses_prepare(category: Column, text: Column) -> Column:
    return (category == X.PREPARE_CATEGORY) & F.contains(text, F.lit(X.PREPARE_CALL))


def echo_is_encoded(rule_id: Column, text: Column, low: Column | None = None) -> Column:
    return (rule_id == X.ECHO_RULE) & contains_any(F.lower(text) if low is None else low, X.ECHO_ENCODERS)


def credential_name_is_safe(rule_id: Column, variable: Column) -> Column:
    # Ids that merely start with one of the two count as well.
    concerned = F.lit(False)
    for rule in X.CREDENTIAL_RULES:
        concerned = concerned | F.startswith(rule_id, F.lit(rule))
    ends = F.lit(False)
    for suffix in X.CREDENTIAL_SAFE_SUFFIXES:
        ends = ends | F.endswith(F.lower(variable), F.lit(suffix))
    return concerned & ends


def variable_name_is_safe(rule_id: Column, variable: Column) -> Column:
    return rule_id.isin(X.GENERIC_RULES) & contains_any(F.lower(variable), X.SAFE_NAME_PARTS)


def exempt(rule_id: Column, category: Column, text: Column, low: Column, variable: Column) -> Column:
    """``low`` is ``text`` in lower case, computed once by the caller."""
    return (
        uses_prepare(category, text)
        | echo_is_encoded(rule_id, text, low)
        | credential_name_is_safe(rule_id, variable)
        | variable_name_is_safe(rule_id, variable)
    )


# -- suppression -----------------------------------------------------------------


def suppression_comment(text: Column, low: Column | None = None) -> Column:
    """The comment that silences a line, NULL if there is none; ``low`` is the line in lower case if it is known."""
    low = F.lower(text) if low is None else low
    marks = [
        F.when(
            F.contains(low, F.lit(mark)),
            _trim_after(text, low, mark),
        )
        for mark in X.SUPPRESS_MARKS
    ]
    tag = F.when(contains_any(low, X.SUPPRESS_TAGS), F.lit(X.SUPPRESS_TAG_LABEL))
    return F.coalesce(*marks, tag)


def _trim_after(text: Column, low: Column, mark: str) -> Column:
    return trimmed(F.substr(text, F.locate(mark, low)))


def suppresses_rule(comment: Column, rule_id: Column) -> Column:
    """A comment with a dash that does not name the rule leaves it active."""
    named = F.contains(F.lower(comment), F.lower(rule_id))
    return comment.isNotNull() & (named | ~F.contains(comment, F.lit("-")))


# -- confidence ------------------------------------------------------------------


def confidence(low: Column, rule_id: Column, severity: Column, sanitized: Column) -> Column:
    """``low`` is the line in lower case."""
    return (
        F.when(sanitized, F.lit(CONF_LOW))
        .when(contains_any(low, X.HIGH_CONFIDENCE_WORDS), F.lit(CONF_HIGH))
        .when(rule_id.isin(X.GENERIC_RULES), F.lit(CONF_LOW))
        .when(severity >= HIGH, F.lit(CONF_MEDIUM))
        .otherwise(F.lit(CONF_LOW))
    )
