"""Shared constants and schemas: severities, confidences, findings, settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, functions as F

# Ordered scales.
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
CONF_LOW, CONF_MEDIUM, CONF_HIGH = range(3)

SEVERITY_LABELS = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONFIDENCE_LABELS = ["LOW", "MEDIUM", "HIGH"]
SARIF_LEVELS = ["note", "note", "warning", "error", "error"]
SEVERITY_BY_NAME = {name.lower(): rank for rank, name in enumerate(SEVERITY_LABELS)}

# Flags and display widths only: nothing is dropped or matched by them.  Distances that define an
# operator (lines looked back, lines to a use, context) stand with their operators.
LONG_LINE_BYTES = 1024 * 1024  # a flag only, like the next
LARGE_FILE_BYTES = 10 * 1024 * 1024
SHOWN_LINE_CHARS = 200
SHOWN_MATCH_CHARS = 100
SHOWN_STEP_CHARS = 120

FILES_SCHEMA = "project STRING, path STRING, content STRING"

CONTEXT_TYPE = "ARRAY<STRUCT<number: INT, text: STRING>>"
FLOW_TYPE = (
    "ARRAY<STRUCT<file: STRING, line: INT, code: STRING, "
    "operation: STRING, variable: STRING>>"
)

# One row per finding; every operator that reports produces these columns.
FINDING_COLUMNS = {
    "project": "STRING",
    "path": "STRING",
    "line_no": "INT",
    "rule_id": "STRING",
    "category": "STRING",
    "severity": "INT",
    "confidence": "INT",
    "cwe": "STRING",
    "description": "STRING",
    "recommendation": "STRING",
    "source": "STRING",
    "line_text": "STRING",
    "match_text": "STRING",
    "suppressed": "BOOLEAN",
    "suppressed_by": "STRING",
    "sanitized": "BOOLEAN",
    "sanitizer_func": "STRING",
    "is_taint": "BOOLEAN",
    "context_before": CONTEXT_TYPE,
    "context_after": CONTEXT_TYPE,
    "flow_steps": FLOW_TYPE,
    "pass_ord": "INT",
    "emit_ord": "BIGINT",
}


@dataclass(frozen=True)
class Rule:
    """One line rule: what it is called, what it matches and how it is worded."""

    rule_id: str
    category: str
    severity: int
    cwe: str
    pattern: str
    description: str = ""
    recommendation: str = ""
    tags: tuple[str, ...] = ()
    source: str = "builtin"
    pack: str | None = None
    unless: str | None = None
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class ScanSettings:
    """Options of one scan.  ``None`` means "not given", see ``merge_settings``."""

    min_severity: int = LOW
    exclude_patterns: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    context_lines: int = 3
    show_suppressed: bool = False
    custom_rules: tuple[Rule, ...] = field(default=())
    framework_packs: bool = True
    # Severity and id selection concerns line rules only, unless this is on.
    filter_all_passes: bool = False
    # Also treat ``$row = $stmt->fetch()`` as a database fetch.
    extended_fetch: bool = False
    # Lines that a form looks ahead for its token; None: to the form's end.
    form_reach: int | None = None

    def __post_init__(self):
        if self.context_lines == 0:  # not given, like in a configuration file
            object.__setattr__(self, "context_lines", 3)

    def but(self, **changes) -> "ScanSettings":
        return replace(self, **changes)


def label(rank: Column, names: list[str]) -> Column:
    """Text for an ordered code (0-based position in ``names``)."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank + 1)


def severity_label(rank: Column) -> Column:
    return label(rank, SEVERITY_LABELS)


def confidence_label(rank: Column) -> Column:
    return label(rank, CONFIDENCE_LABELS)


def parse_severity(text: Column) -> Column:
    """Severity rank of a free-text name; anything unknown counts as LOW."""
    names = F.create_map(*[F.lit(x) for kv in SEVERITY_BY_NAME.items() for x in kv])
    return F.coalesce(names[F.lower(F.trim(text))], F.lit(LOW))


def finding_row(**columns: Column) -> list[Column]:
    """Select list of a findings DataFrame; missing columns get neutral values."""
    neutral = {
        "suppressed": F.lit(False),
        "suppressed_by": F.lit(""),
        "sanitized": F.lit(False),
        "sanitizer_func": F.lit(""),
        "is_taint": F.lit(False),
        "context_before": F.array(),
        "context_after": F.array(),
        "flow_steps": F.array(),
        "source": F.lit("builtin"),
        "emit_ord": F.lit(0),
    }
    return [
        columns.get(name, neutral.get(name, F.col(name))).cast(kind).alias(name)
        for name, kind in FINDING_COLUMNS.items()
    ]


def findings_ddl() -> str:
    return ", ".join(f"{name} {kind}" for name, kind in FINDING_COLUMNS.items())
