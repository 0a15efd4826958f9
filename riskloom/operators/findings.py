"""From hits, flows and detector candidates to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.plan import computed_once
from riskloom.functions.sqltext import constant_list, constant_rows
from riskloom.functions.text import clipped, trimmed
from riskloom.model import (
    CONF_HIGH,
    CONTEXT_TYPE,
    FINDING_COLUMNS,
    FLOW_TYPE,
    Rule,
    SHOWN_LINE_CHARS,
    ScanSettings,
    finding_row,
)
from riskloom.operators import detectors, match, sanitize, taint
from riskloom.operators.comments import with_comment_state, with_visible_part
from riskloom.rules import exemptions as X
from riskloom.rules.multiline import FILE_LEVEL_TEXT

PASS_RULES, PASS_TAINT, PASS_RACE, PASS_FORM, PASS_LOGOUT, PASS_HEADERS = range(1, 7)

# Gives each line its own range of positions in the emission order.
ORDER_STEP = 1_000_000

CANDIDATE_TYPE = (
    "ARRAY<STRUCT<pass_ord: INT, emit_ord: BIGINT, line_no: INT, rule_ord: INT, "
    "match: STRING, pos: INT, in_comment: STRING, text: STRING, description: STRING, "
    "advice: STRING, steps: " + FLOW_TYPE + ", file_func: STRING, "
    "before: " + CONTEXT_TYPE + ", after: " + CONTEXT_TYPE + ">>"
)


#: Columns of findings that counts and orders do not read.
WIDE_COLUMNS = (
    "line_text", "match_text", "description", "recommendation", "context_before", "context_after", "flow_steps",
)


# -- context lines ---------------------------------------------------------------


def lines_before(line_no: Column, count: int) -> Column:
    """Up to ``count`` whole lines before a line, with their numbers."""
    start = F.greatest(line_no - count, F.lit(1))
    return F.transform(
        F.slice("lines", start, F.least(line_no - 1, F.lit(count))),
        lambda t, i: F.struct((start + i).cast("int").alias("number"), t.alias("text")),
    )


def lines_after(line_no: Column, count: int) -> Column:
    return F.transform(
        F.slice("lines", line_no + 1, F.lit(count)),
        lambda t, i: F.struct((line_no + i + 1).cast("int").alias("number"), t.alias("text")),
    )


def shown_context(context: Column) -> Column:
    return F.transform(
        context,
        lambda c: F.struct(c["number"], clipped(c["text"], SHOWN_LINE_CHARS).alias("text")),
    )


def nearest(context: Column, count: int | Column) -> Column:
    """The last ``count`` entries of a context array."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.slice(context, F.greatest(F.size(context) - count, F.lit(0)) + 1, count)


# -- candidates ------------------------------------------------------------------


def _candidate(pass_ord: int, fields: dict[str, Column], context: tuple[int, int]) -> Column:
    line_no = fields["line_no"]
    none = F.lit(None).cast("string")
    before, after = context
    return F.struct(
        F.lit(pass_ord).alias("pass_ord"),
        fields["emit_ord"].cast("bigint").alias("emit_ord"),
        line_no.cast("int").alias("line_no"),
        fields["rule_ord"].cast("int").alias("rule_ord"),
        fields["match"].alias("match"),
        fields.get("pos", F.lit(0)).alias("pos"),
        fields.get("in_comment", F.lit("0")).alias("in_comment"),
        fields.get("text", F.get("lines", line_no - 1)).alias("text"),
        fields.get("description", none).alias("description"),
        fields.get("advice", none).alias("advice"),
        fields.get("steps", F.array().cast(FLOW_TYPE)).alias("steps"),
        fields.get("file_func", none).alias("file_func"),
        (lines_before(line_no, before) if before else F.array().cast(CONTEXT_TYPE)).alias("before"),
        (lines_after(line_no, after) if after else F.array().cast(CONTEXT_TYPE)).alias("after"),
    )


def _category_of(rule_ord: Column, rules: list[Rule]) -> Column:
    return F.element_at(constant_list(r.category for r in rules), rule_ord)


def rule_candidates(rules: list[Rule], context_lines: int, file_level: bool = True) -> Column:
    def build(h: Column) -> Column:
        fields = {
            name: h[name] for name in ("line_no", "rule_ord", "match", "pos", "in_comment", "text")
        }
        fields["emit_ord"] = h["line_no"].cast("bigint") * ORDER_STEP + h["rule_ord"]
        if file_level:
            fields["file_func"] = sanitize.file_level_sanitizer(
                F.col("cleaned"),
                match.first_variable(h["match"]),
                _category_of(h["rule_ord"], rules),
                h["line_no"],
            )
        return _candidate(
            PASS_RULES, fields, (max(context_lines, match.LOOKBACK_LINES), context_lines)
        )

    return F.transform("hits", build)


def taint_candidates(first_rule: int, context_lines: int) -> Column:
    return F.transform(
        taint.flow_candidates(),
        lambda f, i: _candidate(
            PASS_TAINT,
            {
                "emit_ord": i,
                "line_no": f["line_no"],
                "rule_ord": f["rule"] + first_rule,
                "match": f["match"],
                "description": f["description"],
                "advice": f["advice"],
                "steps": f["steps"],
            },
            (context_lines, context_lines),
        ),
    )


def detector_candidates(
    pass_ord: int, found: Column, first_rule: int, context_lines: int
) -> Column:
    def build(d: Column) -> Column:
        fields = {
            "emit_ord": d["line_no"].cast("bigint") * ORDER_STEP + d["rule"],
            "line_no": d["line_no"],
            "rule_ord": d["rule"] + first_rule,
            "match": d["match"],
            "description": d["description"],
        }
        if pass_ord == PASS_HEADERS:
            fields["text"] = F.lit(FILE_LEVEL_TEXT)
            return _candidate(pass_ord, fields, (0, 0))
        return _candidate(pass_ord, fields, (context_lines, context_lines))

    return F.transform(found, build)


# -- findings --------------------------------------------------------------------


class RuleBook:
    """Rules, sinks and detectors of one scan under one numbering."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.first_sink = len(rules) + 1
        self.first_detector = self.first_sink + len(taint.SINK_RULES)
        self.entries = (
            [(r, None) for r in rules]
            + [(r, CONF_HIGH) for r in taint.SINK_RULES]
            + list(detectors.DETECTOR_RULES)
        )

    def lookup(self, rule_ord: Column) -> Column:
        """Struct with the fixed attributes of a rule."""
        table = constant_rows(
            [
                {
                    "rule_id": r.rule_id,
                    "category": r.category,
                    "severity": r.severity,
                    "cwe": r.cwe,
                    "description": r.description,
                    "recommendation": r.recommendation,
                    "source": r.source,
                    "pack": r.pack,
                    "confidence": conf,
                }
                for r, conf in self.entries
            ],
            "rule_id: STRING, category: STRING, severity: INT, cwe: STRING, "
            "description: STRING, recommendation: STRING, source: STRING, "
            "pack: STRING, confidence: INT",
        )
        return F.element_at(table, rule_ord)


def exploded(df: DataFrame, candidates: Column) -> DataFrame:
    """One row per candidate, fields as columns."""
    # The outer form keeps Catalyst from evaluating the array a second time for
    # a size filter below the generator.
    return (
        df.select("project", "path", candidates.alias("candidates"))
        .select("project", "path", F.explode_outer("candidates").alias("c"))
        .where(F.col("c").isNotNull())
        .select("project", "path", "c.*")
    )


def judged(
    candidates: DataFrame, book: RuleBook | None, settings: ScanSettings, context_lines: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Exemptions, sanitizers, suppression and confidence; gives findings columns.

    The extra column ``pack`` names the framework a pack rule belongs to.  ``context_lines`` is
    for candidates with different settings, ``keep`` names columns to pass on.  Without a book
    the candidates carry their rule as ``r``.
    """
    is_rule = F.col("pass_ord") == PASS_RULES
    df = candidates if book is None else candidates.withColumn("r", book.lookup(F.col("rule_ord")))
    df = df.select("*", "r.rule_id", "r.category", "r.severity", "r.cwe", "r.source", "r.pack")
    df = computed_once(
        with_visible_part(df).withColumnRenamed("visible", "_visible"),
        variable=F.when(is_rule, match.first_variable(F.col("match"))),
        visible=F.col("_visible"),
        low=F.lower("text"),
    ).drop("_visible")
    df = df.where(
        ~is_rule
        | (
            F.col("visible").isNotNull()
            & ~F.col("rule_id").isin(X.REPLACED_RULES)
            & ~match.exempt(
                F.col("rule_id"), F.col("category"), F.col("text"), F.col("low"), F.col("variable")
            )
        )
    )
    # A step of its own: with a walk over lines in it, Spark would interpret the next one instead of compiling it.
    df = df.withColumn("_above", F.when(is_rule, sanitize.lookback_sanitizer(match.LOOKBACK_LINES)))
    df = computed_once(
        df,
        near_func=F.when(is_rule, F.coalesce(sanitize.same_line_sanitizer(), F.col("_above"))),
        comment=F.when(is_rule, match.suppression_comment(F.col("text"), F.col("low"))),
    ).drop("_above")
    near = F.col("near_func").isNotNull()
    df = df.where(~(near & F.col("rule_id").isin(X.DROP_WHEN_SANITIZED)))
    confidence = F.coalesce(
        F.col("r.confidence"),
        match.confidence(F.col("low"), F.col("rule_id"), F.col("severity"), near),
    )
    func = F.coalesce("near_func", "file_func")
    count = F.lit(settings.context_lines) if context_lines is None else context_lines
    return df.select(
        *finding_row(
            confidence=confidence,
            description=F.coalesce(F.col("description"), F.col("r.description")),
            recommendation=F.coalesce(F.col("advice"), F.col("r.recommendation")),
            source=F.col("source"),
            line_text=F.when(is_rule, clipped(F.col("visible"), SHOWN_LINE_CHARS)).otherwise(
                trimmed(F.col("text"))
            ),
            match_text=F.col("match"),
            suppressed=F.coalesce(
                match.suppresses_rule(F.col("comment"), F.col("rule_id")), F.lit(False)
            ),
            suppressed_by=F.coalesce("comment", F.lit("")),
            sanitized=func.isNotNull(),
            sanitizer_func=F.coalesce(func, F.lit("")),
            is_taint=F.col("pass_ord") == PASS_TAINT,
            context_before=shown_context(nearest(F.col("before"), count)),
            context_after=shown_context(
                F.col("after") if context_lines is None else F.slice("after", F.lit(1), count)
            ),
            flow_steps=F.col("steps"),
            emit_ord=F.col("emit_ord"),
        ),
        "pack", *keep,
    )


def file_columns(with_lines_df: DataFrame, rules: list[Rule], settings: ScanSettings) -> DataFrame:
    """All per-file arrays a scan needs, built side by side from one read."""
    df = with_comment_state(with_lines_df)
    df = match.with_hits(df, rules)
    df = sanitize.with_cleaned_variables(df)
    return taint.with_flows(taint.with_facts(df, settings.extended_fetch)).drop("facts")


def all_candidates(book: RuleBook, settings: ScanSettings) -> Column:
    n = settings.context_lines
    found = [
        (PASS_RACE, detectors.check_then_use()),
        (PASS_FORM, detectors.unprotected_forms(settings.form_reach)),
        (PASS_LOGOUT, detectors.incomplete_logout()),
        (PASS_HEADERS, detectors.missing_headers()),
    ]
    return F.concat(
        rule_candidates(book.rules, n).cast(CANDIDATE_TYPE),
        taint_candidates(book.first_sink, n).cast(CANDIDATE_TYPE),
        *[
            detector_candidates(p, array, book.first_detector, n).cast(CANDIDATE_TYPE)
            for p, array in found
        ],
    )


# -- one row per line and category -------------------------------------------------


def deduplicated(findings: DataFrame) -> DataFrame:
    """Best finding per line and category; suppressed if any member was.

    Best: confidence, then flow before rule, then severity, then first emitted.
    An aggregate instead of a window, so equal keys are combined before the
    shuffle and no group is ever collected.  Wide columns are values of their own:
    what a reader of the findings does not ask for is neither sorted nor shuffled.
    """
    key = ["project", "path", "line_no", "category"]
    payload = [c for c in findings.columns if c not in key]
    rank = F.struct(
        F.col("confidence"),
        F.col("is_taint"),
        F.col("severity"),
        -F.col("pass_ord"),
        -F.col("emit_ord"),
    )
    wide = [[c] for c in WIDE_COLUMNS if c in payload]
    parts = [[c for c in payload if [c] not in wide], *wide]
    best = findings.groupBy(*key).agg(
        *[F.max_by(F.struct(*part), rank).alias(f"best_{n}") for n, part in enumerate(parts)],
        F.bool_or("suppressed").alias("any_suppressed"),
        F.max(F.when(F.col("suppressed"), F.col("suppressed_by"))).alias("any_by"),
    )
    values = {c: F.col(f"best_{n}")[c] for n, part in enumerate(parts) for c in part}
    values["suppressed"] = F.col("any_suppressed")
    values["suppressed_by"] = F.coalesce("any_by", values["suppressed_by"])
    return best.select(
        *[F.col(c) if c in key else values[c].alias(c) for c in findings.columns]
    )


def visible_findings(findings: DataFrame, show_suppressed: bool = False) -> DataFrame:
    return findings if show_suppressed else findings.where(~F.col("suppressed"))


def report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(
        F.desc("severity"), F.desc("confidence"), "path", "line_no", "category", "rule_id",
        "project",
    )


FINDING_NAMES = list(FINDING_COLUMNS)
