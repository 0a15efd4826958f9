"""The whole scan: files in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.model import ScanSettings
from riskloom.operators import findings as O
from riskloom.operators import custom_match
from riskloom.operators.custom_match import code_lines, custom_candidates, custom_hits, hits_of_few, rule_bytes
from riskloom.operators.lines import with_lines
from riskloom.rules.custom import checked_table, rule_index, usable_rules
from riskloom.rules.ruleset import all_rules, select_rules
from riskloom.sources.corpus import excluded_by, scannable
from riskloom.sources.settings import directory_of, directory_settings, rule_is_on


def raw_findings(
    files: DataFrame, settings: ScanSettings = ScanSettings(), frameworks: DataFrame | None = None
) -> DataFrame:
    """Findings of all passes before de-duplication.

    One narrow pass over the file contents.  Only candidates leave it, and pack
    rules are matched everywhere and then kept where the project uses the
    framework, so file contents never take part in a join.
    """
    use_packs = settings.framework_packs and frameworks is not None
    settings = settings.but(framework_packs=use_packs)
    book = O.RuleBook(select_rules(all_rules(settings), settings))
    df = O.file_columns(with_lines(files), book.rules, settings)
    found = O.judged(O.exploded(df, O.all_candidates(book, settings)), book, settings)
    if settings.filter_all_passes:
        off = [rule_id.strip().upper() for rule_id in settings.disabled_rules]
        found = found.where(
            (F.col("severity") >= settings.min_severity) & ~F.upper("rule_id").isin(off)
        )
    return keep_own_packs(found, frameworks) if use_packs else found.drop("pack")


def keep_own_packs(findings: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Keeps pack findings only for projects that use the framework."""
    own = frameworks.select("project", F.col("name").alias("_framework"))
    return (
        findings.join(own, "project", "left")
        .where(F.col("pack").isNull() | (F.col("pack") == F.col("_framework")))
        .drop("pack", "_framework")
    )


def scan(
    files: DataFrame, settings: ScanSettings = ScanSettings(), frameworks: DataFrame | None = None
) -> DataFrame:
    """Findings as reported: filtered files, all passes, one per line and category."""
    chosen = scannable(files, settings.exclude_patterns)
    found = O.deduplicated(raw_findings(chosen, settings, frameworks))
    return O.visible_findings(found, settings.show_suppressed)


def scan_by_config(
    files: DataFrame, configs: DataFrame, given: dict | None = None,
    settings: ScanSettings = ScanSettings(), frameworks: DataFrame | None = None,
) -> DataFrame:
    """One scan of many projects, each directory under its nearest configuration file.

    ``configs`` as from :func:`riskloom.sources.settings.config_files`; ``given`` holds options that win
    over every file.  All rules are matched in one pass over the contents.  What leaves it, the
    candidates, meets the settings of its directory: rules that are on, excluded paths, context, and
    whether suppressed findings show.  One number goes to the driver, the widest context asked for.
    """
    use_packs = settings.framework_packs and frameworks is not None
    rules = all_rules(settings.but(framework_packs=use_packs))
    book = O.RuleBook(rules)
    chosen = scannable(files)
    own = directory_settings(chosen, configs, rules, given)
    widest = own.agg(F.max("context_lines")).first()[0] or settings.context_lines
    wide = settings.but(context_lines=widest)
    df = O.file_columns(with_lines(chosen), rules, wide)
    candidates = O.exploded(df, O.all_candidates(book, wide)).withColumn("dir", directory_of())
    is_rule = F.col("pass_ord") == O.PASS_RULES
    kept = candidates.join(own, ["project", "dir"]).where(
        ~excluded_by(F.col("path"), F.col("excludes")) & (~is_rule | rule_is_on(F.col("rules_on"), F.col("rule_ord")))
    )
    found = O.judged(kept, book, wide, F.col("context_lines"), keep=("show_suppressed",))
    found = keep_own_packs(found, frameworks) if use_packs else found.drop("pack")
    return O.deduplicated(found).where(~F.col("suppressed") | F.col("show_suppressed")).drop("show_suppressed")


def scan_custom(
    files: DataFrame, rule_rows: DataFrame, settings: ScanSettings = ScanSettings(),
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Findings of custom rules alone; ``rule_rows`` as from :func:`riskloom.rules.custom.parse_rule_files`.

    For rule sets of any size.  Rules that cannot be used are left out, see
    :func:`riskloom.rules.custom.checked_table` for them and their reasons.
    """
    off = [rule_id.strip().upper() for rule_id in settings.disabled_rules]
    checked = checked_table(rule_rows).where(
        (F.col("severity") >= settings.min_severity) & ~F.upper("rule_id").isin(off)
    )
    rules, chosen = usable_rules(checked), scannable(files, settings.exclude_patterns)
    if rule_bytes(rules) <= custom_match.BROADCAST_BYTES:
        hits = hits_of_few(chosen, rules, settings)
    else:
        hits = custom_hits(code_lines(chosen, settings), rule_index(rules, frequencies))
    found = O.judged(custom_candidates(hits), None, settings).drop("pack")
    return O.visible_findings(O.deduplicated(found), settings.show_suppressed)
