"""Rule lists: built-in, framework packs, custom; selection and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.model import Rule, ScanSettings, SEVERITY_LABELS
from riskloom.rules import advice
from riskloom.rules.catalog import (
    CORE_RULES,
    EXTRA_RULES,
    RULE_DESCRIPTIONS,
    RULE_HINTS,
    RULE_UNLESS,
)
from riskloom.rules.packs import FILE_LEVEL_RULES, PACK_RULES

RULE_TABLE_SCHEMA = (
    "rule_ord INT, rule_id STRING, category STRING, severity INT, cwe STRING, "
    "pattern STRING, description STRING, recommendation STRING, "
    "tags ARRAY<STRING>, source STRING, pack STRING"
)


def _rule(row, pack: str | None = None) -> Rule:
    rule_id, category, severity, cwe, pattern = row
    return Rule(
        rule_id, category, severity, cwe, pattern,
        description=RULE_DESCRIPTIONS[rule_id],
        recommendation=advice.for_category(category),
        tags=(pack,) if pack else (),
        pack=pack,
        unless=RULE_UNLESS.get(rule_id),
        hints=tuple(RULE_HINTS.get(rule_id, ())),
    )


def builtin_rules() -> list[Rule]:
    return [_rule(r) for r in CORE_RULES + EXTRA_RULES]


def pack_rules() -> list[Rule]:
    """Rules of all framework packs that work line by line."""
    return [
        _rule(r, pack)
        for pack, rows in PACK_RULES.items()
        for r in rows
        if r[0] not in FILE_LEVEL_RULES
    ]


def file_level_rules() -> list[Rule]:
    return [
        _rule(r, pack)
        for pack, rows in PACK_RULES.items()
        for r in rows
        if r[0] in FILE_LEVEL_RULES
    ]


def all_rules(settings: ScanSettings = ScanSettings()) -> list[Rule]:
    """Every known rule in scan order, before selection."""
    rules = builtin_rules() + list(settings.custom_rules)
    return rules + pack_rules() if settings.framework_packs else rules


def select_rules(rules: list[Rule], settings: ScanSettings) -> list[Rule]:
    """Drop rules below the minimum severity and rules switched off by id."""
    off = {rule_id.strip().upper() for rule_id in settings.disabled_rules}
    return [
        r for r in rules
        if r.severity >= settings.min_severity and r.rule_id.upper() not in off
    ]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [
        (n, r.rule_id, r.category, r.severity, r.cwe, r.pattern, r.description,
         r.recommendation, list(r.tags), r.source, r.pack)
        for n, r in enumerate(rules, 1)
    ]
    return spark.createDataFrame(rows, RULE_TABLE_SCHEMA)


def rules_hash_text(rules: list[Rule]) -> str:
    """What the rule-set hash is taken over: one line per rule, in order."""
    return "".join(
        f"{r.rule_id}:{r.pattern}:{SEVERITY_LABELS[r.severity]}\n" for r in rules
    )
