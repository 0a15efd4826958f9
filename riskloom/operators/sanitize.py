"""Was the value made safe: on the same line, just before, or earlier in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions import sqltext
from riskloom.functions.dialect import sql_string, to_java
from riskloom.functions.sqltext import any_of, first_known
from riskloom.rules.exemptions import VARIABLE
from riskloom.rules.sanitizers import SANITIZER_HINTS, SANITIZERS

_ENTRIES = [(c, p, name, hint) for (c, p, name), hint in zip(SANITIZERS, SANITIZER_HINTS)]
_CATEGORIES = list(dict.fromkeys(c for c, _, _ in SANITIZERS))
_HINTS = list(dict.fromkeys(SANITIZER_HINTS))


def _name_if(low: str, hint: str, condition: str, name: str) -> str:
    return f"if({any_of(low, [hint])} AND {condition}, {sql_string(name)}, NULL)"


def same_line_sanitizer() -> Column:
    """First sanitizer of the category that starts at or before the match.

    Reads the columns ``text``, ``low`` (the text in lower case), ``category`` and ``pos``.
    """
    low = "low"
    options = first_known(
        _name_if(
            low, hint,
            f"category = {sql_string(c)} AND {sqltext.start('text', p)} BETWEEN 1 AND pos", name,
        )
        for c, p, name, hint in _ENTRIES
    )
    return F.expr(f"if({any_of(low, _HINTS)}, {options}, NULL)")


def lookback_sanitizer(count: int) -> Column:
    """Earliest of the last ``count`` lines that assigns the variable through a sanitizer.

    Within a line the category's own sanitizers come before all others.  Reads
    ``before``, ``variable`` and ``category``.
    """
    own = first_known(
        _name_if("x.low", hint,
                 f"category = {sql_string(c)} AND {sqltext.rlike('x.text', p)}", name)
        for c, p, name, hint in _ENTRIES
    )
    other = first_known(
        _name_if("x.low", hint, sqltext.rlike("x.text", p), name) for _, p, name, hint in _ENTRIES
    )
    recent = f"slice(before, greatest(size(before) - {count}, 0) + 1, {count})"
    mentions = f"filter({recent}, b -> contains(b.text, '=') AND contains(b.text, variable))"
    assigning = (
        f"filter(transform({mentions}, b -> named_struct('text', b.text, 'low', lower(b.text))), "
        f"x -> {any_of('x.low', _HINTS)})"
    )
    names = f"filter(transform({assigning}, x -> coalesce({own}, {other})), n -> n IS NOT NULL)"
    return F.expr(f"if(variable <> '', concat(get({names}, 0), ' (context)'), NULL)")


def with_cleaned_variables(df: DataFrame) -> DataFrame:
    """Adds ``cleaned``: where each variable first meets a sanitizer, per category.

    One ``(category, variable, line_no, func)`` per category and variable, sorted;
    the list grows with the variables of a file, not with its lines.
    """
    per_category = ", ".join(
        f"named_struct('category', {sql_string(category)}, 'func', "
        + first_known(
            _name_if("x.low", hint, sqltext.rlike("x.text", p), name)
            for c, p, name, hint in _ENTRIES
            if c == category
        )
        + ")"
        for category in _CATEGORIES
    )
    numbered = (
        "transform(lines, (t, i) -> named_struct('line_no', i + 1, 'text', t, 'low', lower(t)))"
    )
    relevant = f"filter({numbered}, x -> contains(x.text, '$') AND {any_of('x.low', _HINTS)})"
    variables = (
        f"array_distinct(regexp_extract_all(x.text, {sql_string(to_java(VARIABLE))}, 0))"
    )
    entries = (
        f"transform({relevant}, x -> flatten(transform("
        f"filter(array({per_category}), e -> e.func IS NOT NULL), "
        f"e -> transform({variables}, v -> named_struct("
        "'category', e.category, 'variable', v, 'line_no', x.line_no, 'func', e.func)))))"
    )

    def first_of_its_kind(e: Column, i: Column) -> Column:
        previous = F.get("_entries", i - 1)
        return (
            (i == 0)
            | (previous["category"] != e["category"])
            | (previous["variable"] != e["variable"])
        )

    return (
        df.withColumn("_entries", F.expr(f"sort_array(flatten({entries}))"))
        .withColumn("cleaned", F.filter("_entries", first_of_its_kind))
        .drop("_entries")
    )


def file_level_sanitizer(
    cleaned: Column, variable: Column, category: Column, line_no: Column
) -> Column:
    """Earliest earlier line of the file that mentions the variable with a sanitizer.

    "Mentions" is a substring test, so ``$id`` is also found in ``$identity``:
    on variables that is a prefix test.
    """
    earlier = F.filter(
        cleaned,
        lambda e: (e["category"] == category)
        & F.startswith(e["variable"], variable)
        & (e["line_no"] < line_no),
    )
    first = F.array_min(
        F.transform(earlier, lambda e: F.struct(e["line_no"], e["func"].alias("func")))
    )
    return F.when(variable != "", F.concat(first["func"], F.lit(" (file-level)")))
