"""Rules written for a structural matcher, converted to line patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.text import base_name

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
LANGUAGE = "php"
ESCAPED = "()[]{}+.|^?*"
METAVARIABLE = r"\$[A-Z][A-Z0-9_]*"
METAVARIABLE_PATTERN = r"[^\s;]+"
ELLIPSIS_PATTERN = ".*"
SPACE_PATTERN = r"\s+"
SEVERITY_NAMES = {"error": "critical", "warning": "high", "info": "medium"}
OTHER_SEVERITY = "medium"
DEFAULT_CATEGORY = "Semgrep Import"
DEFAULT_CWE = "CWE-Unknown"
DEFAULT_ID = "SEMGREP-%03d"
SOURCE_PREFIX = "semgrep:"
RECOMMENDATION = "Review finding and apply recommended fix"
# End of fixed values.


def line_pattern(pattern: Column) -> Column:
    """Line pattern for a structural one; ``''`` if there is none."""
    bare = F.trim(pattern)
    # Metavariables never contain a quoted character and an ellipsis is three of
    # them, so one pass quotes and the later ones see unambiguous text.
    quoted = F.regexp_replace(bare, r"([()\[\]{}+.|^?*])", r"\\$1")
    named = F.regexp_replace(quoted, METAVARIABLE, r"[^\\s;]+")
    open_ended = F.replace(named, F.lit(r"\.\.\."), F.lit(ELLIPSIS_PATTERN))
    spaced = F.regexp_replace(open_ended, r"[\t\n\f\r ]+", r"\\s+")
    return F.when(pattern != "", F.concat(F.lit("(?i)"), spaced)).otherwise(F.lit(""))


def severity_name(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SEVERITY_NAMES.items() for x in kv])
    return F.coalesce(names[F.lower(F.trim(text))], F.lit(OTHER_SEVERITY))


def convert_rules(ext_rules: DataFrame) -> DataFrame:
    """``(ord, id, message, severity, pattern, languages, cwe, category, source_file)`` →
    rule rows in the shape rule files use."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = ext_rules.where(
        F.exists("languages", lambda lang: F.lower(lang) == LANGUAGE)
    ).withColumn("_pattern", line_pattern(text("pattern")))
    or_default = lambda name, default: F.coalesce(
        F.nullif(F.col(name), F.lit("")), F.lit(default)
    )
    return rows.where(F.col("_pattern") != "").select(
        F.coalesce(
            F.nullif(F.col("id"), F.lit("")), F.format_string(DEFAULT_ID, F.col("ord"))
        ).alias("id"),
        or_default("category", DEFAULT_CATEGORY).alias("category"),
        severity_name(text("severity")).alias("severity"),
        F.array(F.col("_pattern")).alias("patterns"),
        text("message").alias("description"),
        F.lit(RECOMMENDATION).alias("recommendation"),
        or_default("cwe", DEFAULT_CWE).alias("cwe"),
        F.concat(F.lit(SOURCE_PREFIX), base_name(F.col("source_file"))).alias("source"),
    )


def save_rules(rules: DataFrame, location: str) -> None:
    """Writes converted rules so that the custom-rule reader can load them.

    Every line is a complete rule file with one rule.
    """
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    "id", "category", "severity", "cwe", "description", "patterns",
                    "recommendation", F.array(F.col("source")).alias("tags"),
                )
            ).alias("rules")
        )
    )
    rules.select(body.alias("value")).write.mode("overwrite").text(location)
