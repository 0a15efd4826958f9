"""One query per operator family, over the check corpus."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import corpus as C
from riskloom.functions.text import clipped, extension
from riskloom.model import HIGH, MEDIUM, LOW, ScanSettings, confidence_label
from riskloom.operators import (
    baseline as B, comments, detectors, findings as O, incremental as I, lines as L, match as M,
    report as R, sanitize, summary as S, taint,
)
from riskloom.plans.incremental import incremental_scan as scan_changes
from riskloom.plans.scan import raw_findings, scan, scan_by_config as scan_configured, scan_custom
from riskloom.rules import custom, exemptions as X
from riskloom.rules.convert import convert_rules
from riskloom.rules.ruleset import (
    all_rules, builtin_rules, rule_table, rules_hash_text, select_rules,
)
from riskloom.sources import corpus as sources, manifests, settings as conf

DEFAULTS = ScanSettings()
RULES = select_rules(builtin_rules(), DEFAULTS)
PLAIN = DEFAULTS.but(framework_packs=False)
EXCLUDES = ("vendor/*", "*.module", "p1?/tests/*", "tests*")
RULES_TAG = "rules-1"


# -- shared inputs ---------------------------------------------------------------


def files(spark, sf) -> DataFrame:
    return sources.scannable(C.all_files(spark, sf))


def code(spark, sf) -> DataFrame:
    return sources.scannable(C.code_files(spark, sf))


def lined(spark, sf) -> DataFrame:
    return L.with_lines(files(spark, sf))


def hits(spark, sf, rules=RULES, masked=False, source=files) -> DataFrame:
    """Raw rule hits with rule attributes, one row each."""
    df = L.with_lines(source(spark, sf))
    df = comments.with_comment_state(df) if masked else df
    df = M.with_hits(df, rules, masked)
    book = O.RuleBook(rules)
    rows = df.select("project", "path", F.explode_outer("hits").alias("h")).where("h IS NOT NULL")
    return rows.select("project", "path", "h.*").withColumn(
        "r", book.lookup(F.col("rule_ord"))
    ).select("*", "r.rule_id", "r.category", "r.severity").drop("r")


def judged_hits(spark, sf) -> DataFrame:
    """Rule findings only, after exemptions and sanitizers."""
    df = L.with_lines(files(spark, sf))
    df = sanitize.with_cleaned_variables(M.with_hits(comments.with_comment_state(df), RULES))
    book = O.RuleBook(RULES)
    return O.judged(
        O.exploded(df, O.rule_candidates(RULES, 3).cast(O.CANDIDATE_TYPE)), book, PLAIN
    ).drop("pack")


def all_findings(spark, sf) -> DataFrame:
    """Every finding, suppressed ones included, without framework packs."""
    return scan(C.all_files(spark, sf), PLAIN.but(show_suppressed=True))


def shown_findings(spark, sf) -> DataFrame:
    return scan(C.all_files(spark, sf), PLAIN)


# -- lines and comments ------------------------------------------------------------


def lines_split(spark, sf):
    rows = L.explode_lines(lined(spark, sf))
    return rows.select(
        "project", "path", "line_no", F.length("text").alias("n_chars"),
        F.md5("text").alias("text_md5"),
    )


def rejected(spark, sf):
    return L.rejected_files(files(spark, sf))


def file_overview(spark, sf):
    return sources.file_overview(C.all_files(spark, sf))


def comment_mask(spark, sf):
    df = comments.with_comment_state(lined(spark, sf))
    rows = df.where(F.size("lines") > 0).select(
        "path", F.posexplode_outer("in_comment").alias("pos", "state")
    )
    return rows.select(
        "path", (F.col("pos") + 1).alias("line_no"), F.col("state").cast("int").alias("in_comment")
    )


def comment_skip(spark, sf):
    df = comments.with_comment_state(lined(spark, sf)).select(
        "path", F.posexplode_outer(F.arrays_zip("lines", "in_comment")).alias("pos", "x")
    ).where("pos IS NOT NULL")
    df = df.select(
        "path", (F.col("pos") + 1).alias("line_no"), F.col("x.lines").alias("text"),
        F.col("x.in_comment").alias("in_comment"),
    )
    shown = comments.with_visible_part(df)
    return shown.select(
        "path", "line_no", F.col("visible").isNull().alias("skipped"),
        F.md5(F.coalesce("visible", F.lit(""))).alias("visible_md5"),
    )


def suppression_mark(spark, sf):
    rows = L.explode_lines(lined(spark, sf))
    rows = rows.withColumn("comment", M.suppression_comment(F.col("text")))
    return rows.where(F.col("comment").isNotNull()).select("path", "line_no", "comment")


# -- rules -------------------------------------------------------------------------


def rule_severity_filter(spark, sf):
    rules = select_rules(builtin_rules(), DEFAULTS.but(min_severity=HIGH))
    return hits(spark, sf, rules).groupBy("rule_id").agg(F.count("*").alias("n"))


def rule_disable(spark, sf):
    rules = select_rules(
        builtin_rules(), DEFAULTS.but(disabled_rules=("xss-004", " SQL-005 ", "info-007"))
    )
    return hits(spark, sf, rules).groupBy("rule_id").agg(F.count("*").alias("n"))


def rule_match(spark, sf):
    return hits(spark, sf).select(
        "path", "line_no", "rule_id", F.md5("match").alias("match_md5"),
        clipped(F.col("match"), 100).alias("match_text"),
    )


def rule_match_pos(spark, sf):
    df = hits(spark, sf).where(F.col("pos") > 0)
    return df.select("path", "line_no", "rule_id", "pos")


def first_variable(spark, sf):
    variable = M.first_variable(F.col("match"))
    return hits(spark, sf).select("path", "line_no", "rule_id", variable.alias("variable"))


def _exempted(condition):
    def query(spark, sf):
        df = hits(spark, sf).withColumn("variable", M.first_variable(F.col("match")))
        return df.where(condition()).select("path", "line_no", "rule_id", "variable")

    return query


exempt_prepare = _exempted(lambda: M.uses_prepare(F.col("category"), F.col("text")))
exempt_echo_wrap = _exempted(lambda: M.echo_is_encoded(F.col("rule_id"), F.col("text")))
exempt_credential_name = _exempted(
    lambda: M.credential_name_is_safe(F.col("rule_id"), F.col("variable"))
)
exempt_safe_var = _exempted(
    lambda: M.variable_name_is_safe(F.col("rule_id"), F.col("variable"))
)


def rule_suppression(spark, sf):
    df = judged_hits(spark, sf).where(F.col("suppressed_by") != "")
    return df.select("path", "line_no", "rule_id", "suppressed", "suppressed_by")


def confidence_score(spark, sf):
    return judged_hits(spark, sf).select("path", "line_no", "rule_id", "confidence", "sanitized")


def _sanitized(mark):
    def query(spark, sf):
        df = judged_hits(spark, sf).where(mark(F.col("sanitizer_func")))
        return df.select("path", "line_no", "rule_id", "sanitizer_func")

    return query


san_same_line = _sanitized(
    lambda f: (f != "") & ~f.endswith(" (context)") & ~f.endswith(" (file-level)")
)
san_lookback = _sanitized(lambda f: f.endswith(" (context)"))
san_file_level = _sanitized(lambda f: f.endswith(" (file-level)"))


def _as_text(context):
    return F.array_join(
        F.transform(context, lambda c: F.concat_ws(":", c["number"].cast("string"), c["text"])), "\n"
    )


def context_lines(spark, sf):
    return judged_hits(spark, sf).select(
        "path", "line_no", "rule_id", "line_text", "match_text",
        _as_text(F.col("context_before")).alias("before_text"),
        _as_text(F.col("context_after")).alias("after_text"),
    )


# -- detectors ---------------------------------------------------------------------


def _detected(found):
    def query(spark, sf):
        rules = F.array(*[F.lit(r.rule_id) for r, _ in detectors.DETECTOR_RULES])
        df = lined(spark, sf).select("path", F.explode_outer(found()).alias("d"))
        return df.where("d IS NOT NULL").select(
            "path", "d.line_no", F.element_at(rules, F.col("d.rule") + 1).alias("rule_id"),
            F.col("d.match").alias("match_text"),
        )

    return query


toctou = _detected(detectors.check_then_use)
csrf_form = _detected(detectors.unprotected_forms)
csrf_form_whole = _detected(lambda: detectors.unprotected_forms(None))
insecure_logout = _detected(detectors.incomplete_logout)
missing_headers = _detected(detectors.missing_headers)


# -- data flow ---------------------------------------------------------------------


def taint_facts(spark, sf):
    df = taint.with_facts(lined(spark, sf)).select("path", F.explode_outer("facts").alias("f"))
    names = lambda c: F.array_join(c, ",")
    return df.where("f IS NOT NULL").select(
        "path", "f.line_no", "f.target", names(F.col("f.rest_vars")).alias("rest_vars"),
        "f.src_key", "f.fetch_var", "f.row_to", "f.row_from", "f.cleans",
        names(F.transform("f.sinks", lambda n: n.cast("string"))).alias("sinks"),
        names(F.col("f.line_vars")).alias("line_vars"),
    )


def taint_sources(spark, sf):
    df = taint_facts(spark, sf).where((F.col("src_key") != "") | (F.col("fetch_var") != ""))
    return df.groupBy("src_key", (F.col("fetch_var") != "").alias("is_fetch")).agg(
        F.count("*").alias("n")
    )


def taint_flows(spark, sf):
    df = taint.with_flows(taint.with_facts(lined(spark, sf)), every_path=True)
    spelled = lambda s: F.concat_ws(":", s["line_no"].cast("string"), s["operation"], s["variable"])
    flows = df.select("path", F.transform("edges", spelled).alias("e"), F.explode_outer("flows").alias("f")).where("f IS NOT NULL")
    sink = F.concat_ws(":", F.col("f.line_no").cast("string"), F.lit("sink"), "f.variable")
    steps = F.array_join(F.concat(F.transform("f.path", lambda n: F.get("e", n)), F.array(sink)), "|")
    return flows.select(
        "path", "f.line_no", "f.sink", "f.variable", "f.src_var", "f.src_key", "f.src_line",
        steps.alias("steps"),
    )


def taint_edges(spark, sf):
    """Edges on the way of some flow, each once."""
    df = taint.with_flows(taint.with_facts(lined(spark, sf)), every_path=True)
    used = df.withColumn("used", F.array_distinct(F.flatten(F.transform("flows", lambda f: f["path"]))))
    edges = taint.flow_edges(used)
    kept = used.select("project", "path", F.explode("used").alias("edge"))
    return edges.join(kept, ["project", "path", "edge"]).select(
        "path", "line_no", "operation", "variable", F.coalesce("previous_line", F.lit(0)).alias("previous_line"),
        F.coalesce("previous_variable", F.lit("")).alias("previous_variable"),
    )


def taint_findings(spark, sf):
    df = taint.with_flows(taint.with_facts(lined(spark, sf)))
    book = O.RuleBook([])
    rows = O.judged(
        O.exploded(
            df.withColumn("cleaned", F.array()),
            O.taint_candidates(book.first_sink, 3).cast(O.CANDIDATE_TYPE),
        ),
        book, PLAIN,
    )
    return rows.select(
        "path", "line_no", "rule_id", "category", "severity", "cwe", "match_text", "line_text"
    )


# -- findings ----------------------------------------------------------------------


def dedup_findings(spark, sf):
    return all_findings(spark, sf).select(
        "project", "path", "line_no", "category", "rule_id", "severity", "confidence", "is_taint",
        "suppressed", "suppressed_by", "sanitized", "sanitizer_func", "line_text", "match_text",
    )


def active_findings(spark, sf):
    return shown_findings(spark, sf).groupBy("rule_id", "source").agg(F.count("*").alias("n"))


def sev_counts(spark, sf):
    return S.severity_counts(shown_findings(spark, sf))


def cat_counts(spark, sf):
    return S.category_counts(shown_findings(spark, sf))


def conf_counts(spark, sf):
    return S.confidence_counts(shown_findings(spark, sf))


def scan_totals(spark, sf):
    totals = S.file_totals(lined(spark, sf)).join(
        S.suppressed_totals(all_findings(spark, sf)), "project", "left"
    )
    return totals.fillna(0, ["suppressed", "active"])


def summary_pivot(spark, sf):
    return S.severity_summary(shown_findings(spark, sf))


def distinct_rules(spark, sf):
    return S.distinct_rules(shown_findings(spark, sf)).select("rule_id", "category", "severity", "cwe", "n")


def quality_gate(spark, sf):
    return S.quality_gate(shown_findings(spark, sf))


def report_order(spark, sf):
    return O.report_order(shown_findings(spark, sf)).select(
        "severity", "confidence", "path", "line_no", "category", "rule_id"
    )


def report_json(spark, sf):
    return R.json_findings(all_findings(spark, sf))


def report_summary(spark, sf):
    return R.json_summary(all_findings(spark, sf), S.file_totals(lined(spark, sf)), len(RULES))


def report_sarif(spark, sf):
    return R.sarif_results(all_findings(spark, sf))


def report_sarif_rules(spark, sf):
    return R.sarif_rules(all_findings(spark, sf)).drop("first_at")


def report_sarif_parts(spark, sf):
    return R.sarif_parts(all_findings(spark, sf))


def pack_findings(spark, sf):
    """Scan with framework packs: findings of pack rules, kept for their projects."""
    found = raw_findings(files(spark, sf), DEFAULTS, frameworks(spark, sf))
    packs = F.array(*[F.lit(r.rule_id) for r in all_rules() if r.pack])
    return found.where(F.array_contains(packs, F.col("rule_id"))).select(
        "project", "path", "line_no", "rule_id", "match_text"
    )


# -- baseline and increments ---------------------------------------------------------


def fingerprint(spark, sf):
    return B.with_fingerprint(judged_hits(spark, sf)).select("path", "line_no", "rule_id", "fingerprint")


def _baseline(findings):
    """An earlier state: files with an odd number were not there, some lines moved."""
    number = F.expr(r"try_cast(regexp_extract(path, r'/f(\d+)\.', 1) AS BIGINT)")
    old = findings.where(number % 2 == 0)
    return B.as_baseline(
        old.withColumn(
            "line_no", F.when(F.col("line_no") % 7 == 0, F.col("line_no") + 1000).otherwise(F.col("line_no"))
        )
    )


def _compared(spark, sf):
    """What a comparison needs of the rule findings: scanned once, read by both of its sides."""
    return _saved(judged_hits(spark, sf).select("project", "path", "line_no", "rule_id", "match_text"))


def baseline_new(spark, sf):
    found = _compared(spark, sf)
    return B.new_findings(found, _baseline(found)).select("project", "path", "line_no", "rule_id", "fingerprint")


def baseline_fixed(spark, sf):
    found = _compared(spark, sf)
    return B.fixed_fingerprints(found, _baseline(found)).select("project", "fingerprint")


def baseline_saved(spark, sf):
    found = judged_hits(spark, sf)
    per_file = B.baseline_by_file(B.as_baseline(found))
    return per_file.select(
        "project", "path", F.array_join("fingerprints", ",").alias("fingerprints")
    )


def _moved_baseline(findings):
    """As ``_baseline``, without the findings on every fifth line."""
    number = F.expr(r"try_cast(regexp_extract(path, r'/f(\d+)\.', 1) AS BIGINT)")
    line = F.when(F.col("line_no") % 7 == 0, F.col("line_no") + 1000).otherwise(F.col("line_no"))
    return findings.where((number % 2 == 0) & (F.col("line_no") % 5 != 0)).withColumn("line_no", line)


def baseline_moved(spark, sf):
    """Findings that are neither known nor known ones that moved."""
    found = _compared(spark, sf)
    beyond = B.unmatched_findings(found, B.as_moving_baseline(_moved_baseline(found)))
    return beyond.select("project", "path", "line_no", "rule_id", "moving")


def _older(spark, sf):
    """An earlier state: some files missing, some with other content."""
    number = F.coalesce(
        F.expr(r"try_cast(regexp_extract(path, r'(\d+)[.][a-zA-Z]+$', 1) AS BIGINT)"), F.lit(0)
    )
    return files(spark, sf).where(number % 5 != 0).withColumn(
        "content",
        F.when(number % 7 == 0, F.concat("content", F.lit("\n// older"))).otherwise(F.col("content")),
    )


def _cache(spark, sf):
    return I.file_hashes(_older(spark, sf), RULES_TAG)


def incremental_changed(spark, sf):
    return I.changed_paths(files(spark, sf), _cache(spark, sf), RULES_TAG).select(
        "project", "path", "sha256"
    )


def incremental_reused(spark, sf):
    found = judged_hits(spark, sf).select("project", "path", "line_no", "rule_id")
    return I.kept_findings(found, files(spark, sf), _cache(spark, sf), RULES_TAG)


def _log(spark, sf):
    """Two scans: an earlier state of the corpus, then the present one without every third file."""
    state = _saved(_cache(spark, sf).withColumn("version", F.lit(1).cast("bigint")))
    number = F.coalesce(
        F.expr(r"try_cast(regexp_extract(path, r'(\d+)[.][a-zA-Z]+$', 1) AS BIGINT)"), F.lit(0)
    )
    later = files(spark, sf).where(number % 3 != 0)
    return state.withColumn("removed", F.lit(False)).unionByName(I.log_entries(later, state, RULES_TAG, 2))


def cache_state(spark, sf):
    return I.cache_state(_log(spark, sf)).select("project", "path", "sha256", "version")


def cache_removed(spark, sf):
    return I.latest_entries(_log(spark, sf)).where("removed").select("project", "path", "sha256", "version")


def _saved(df: DataFrame) -> DataFrame:
    """What a scan left: written to the shared folder of spark.checkpoint.dir and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def incremental_scan(spark, sf):
    """Earlier findings of unchanged files and a scan of the others: equal to a full scan."""
    cache = _saved(_cache(spark, sf))
    earlier = _saved(scan(_older(spark, sf), PLAIN))
    found = scan_changes(files(spark, sf), cache, earlier, RULES_TAG, PLAIN)
    return found.select("project", "path", "line_no", "category", "rule_id", "severity", "confidence")


def rules_hash(spark, sf):
    rules = rule_table(spark, select_rules(all_rules(), DEFAULTS))
    applied = manifests.rules_for_projects(
        rules, C.all_files(spark, sf), frameworks(spark, sf)
    )
    return I.rules_fingerprint(applied, "project")


# -- projects ------------------------------------------------------------------------


def frameworks(spark, sf):
    return manifests.detect_frameworks(C.manifest_files(spark, sf))


def framework_detect(spark, sf):
    return frameworks(spark, sf)


def rule_packs(spark, sf):
    rules = rule_table(spark, select_rules(all_rules(), DEFAULTS))
    return manifests.rules_for_projects(
        rules, C.all_files(spark, sf), frameworks(spark, sf)
    ).select("project", "rule_id")


def _targets(spark, sf):
    return C.all_files(spark, sf).select(
        "project", F.regexp_replace("path", "/[^/]*$", "").alias("dir")
    ).distinct()


def config_nearest(spark, sf):
    found = conf.nearest_config(_targets(spark, sf), conf.config_files(C.config_files(spark, sf)))
    return found.where("config_dir IS NOT NULL").select("project", "dir", "config_dir", F.col("config.min_severity").alias("min_severity"))


def config_merge(spark, sf):
    found = conf.nearest_config(_targets(spark, sf), conf.config_files(C.config_files(spark, sf)))
    merged = conf.merged_settings(found, {"json_output": True})
    return merged.select(
        "project", "dir", "min_severity",
        F.array_join("exclude_patterns", ",").alias("exclude_patterns"),
        F.array_join("disabled_rules", ",").alias("disabled_rules"),
        "output_dir", "no_html", "json_output", "sarif_output", "show_suppressed",
        "concurrency", "context_lines",
    )


def scan_by_config(spark, sf):
    """One scan of all projects, each directory under its own configuration file."""
    found = scan_configured(
        C.relative_files(spark, sf), conf.config_files(C.scan_configs(spark, sf)), settings=PLAIN
    )
    return found.select(
        "project", "path", "line_no", "category", "rule_id", "severity", "confidence", "suppressed",
        F.size("context_before").alias("n_before"), F.size("context_after").alias("n_after"),
    )


def custom_findings(spark, sf):
    """A scan with a rule set that grows with the corpus."""
    rules = custom.parse_rule_files(C.scan_rule_files(spark, sf))
    found = scan_custom(C.all_files(spark, sf), rules, PLAIN.but(show_suppressed=True))
    return found.select(
        "project", "path", "line_no", "category", "rule_id", "severity", "confidence", "suppressed",
        "sanitizer_func", F.md5("match_text").alias("match_md5"), F.size("context_before").alias("n_before"),
    )


def custom_rejected(spark, sf):
    rules = custom.checked_table(custom.parse_rule_files(C.scan_rule_files(spark, sf)))
    return rules.where("reason IS NOT NULL").select("source", "rule_id", "pattern", "reason")


def custom_rules(spark, sf):
    rows = custom.parse_rule_files(C.rule_files(spark, sf))
    return rows.select(
        "source", "rule_no", "pattern_no", "rule_id", "category", "severity", "cwe", "pattern",
        F.array_join("tags", ",").alias("tags"),
    )


def convert_ext_rules(spark, sf):
    rows = convert_rules(C.external_rules(spark, sf))
    return rows.select(
        "id", "category", "severity", F.element_at("patterns", 1).alias("pattern"),
        "description", "cwe", "source",
    )


# -- file selection ------------------------------------------------------------------


def exclude_filter(spark, sf):
    return C.all_files(spark, sf).where(
        ~sources.is_excluded(F.col("path"), EXCLUDES)
    ).select("project", "path")


def ext_filter(spark, sf):
    return C.all_files(spark, sf).where(
        sources.has_scanned_extension(F.col("path"))
    ).select("path", extension(F.col("path")).alias("ext"))


def dir_prune(spark, sf):
    return C.all_files(spark, sf).where(~sources.in_skipped_dir(F.col("path"))).select("path")


QUERIES = {
    f.__name__ if name is None else name: f
    for name, f in [
        (None, lines_split), ("rejected_files", rejected), (None, file_overview),
        (None, comment_mask), (None, comment_skip), (None, suppression_mark),
        (None, rule_severity_filter), (None, rule_disable), (None, rule_match),
        (None, rule_match_pos), (None, first_variable),
        ("exempt_prepare", exempt_prepare), ("exempt_echo_wrap", exempt_echo_wrap),
        ("exempt_credential_name", exempt_credential_name), ("exempt_safe_var", exempt_safe_var),
        (None, rule_suppression), (None, confidence_score),
        ("san_same_line", san_same_line), ("san_lookback", san_lookback),
        ("san_file_level", san_file_level), (None, context_lines),
        ("toctou", toctou), ("csrf_form", csrf_form), ("csrf_form_whole", csrf_form_whole),
        ("insecure_logout", insecure_logout),
        ("missing_headers", missing_headers),
        (None, taint_facts), (None, taint_sources), (None, taint_flows), (None, taint_edges), (None, taint_findings),
        (None, dedup_findings), (None, active_findings), (None, sev_counts), (None, cat_counts),
        (None, conf_counts), (None, scan_totals), (None, summary_pivot), (None, distinct_rules),
        (None, quality_gate), (None, report_order), (None, report_json), (None, report_summary),
        (None, report_sarif), (None, report_sarif_rules), (None, report_sarif_parts),
        (None, pack_findings),
        (None, fingerprint), (None, baseline_new), (None, baseline_fixed), (None, baseline_saved),
        (None, baseline_moved), (None, cache_state), (None, cache_removed),
        (None, incremental_changed), (None, incremental_reused), (None, incremental_scan), (None, rules_hash),
        (None, framework_detect), (None, rule_packs), (None, config_nearest), (None, config_merge), (None, scan_by_config),
        (None, custom_rules), (None, custom_findings), (None, custom_rejected), ("convert_rules", convert_ext_rules),
        (None, exclude_filter), (None, ext_filter), (None, dir_prune),
    ]
}
