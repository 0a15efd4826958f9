import json

from pyspark.sql import functions as F

from riskloom.model import CRITICAL, LOW, ScanSettings, findings_ddl
from riskloom.operators import baseline as B, findings as O, incremental as I, report as R, summary as S
from riskloom.operators.lines import with_lines
from riskloom.plans.scan import scan
from riskloom.sources.baseline import read_baseline, read_cache, write_baseline

CODE = "\n".join([
    "<?php", "$id = $_GET['id'];", "mysql_query($id);", "system($_GET['c']); // nosec",
    "echo $id;", "print 'x';", "$password = 'hunter2';",
])


def _finding(spark, **changes):
    row = dict(
        project="p", path="f", line_no=1, rule_id="R", category="c", severity=2, confidence=1,
        cwe="", description="", recommendation="", source="", line_text="", match_text="",
        suppressed=False, suppressed_by="", sanitized=False, sanitizer_func="", is_taint=False,
        context_before=[], context_after=[], flow_steps=[], pass_ord=1, emit_ord=0,
    )
    return tuple({**row, **changes}.values())


def _best(spark, *changes):
    rows = [_finding(spark, **{"emit_ord": n, **c}) for n, c in enumerate(changes)]
    return O.deduplicated(spark.createDataFrame(rows, findings_ddl())).collect()


def test_dedup_order(spark):
    one = lambda *rows: _best(spark, *rows)[0].rule_id
    assert one({"rule_id": "A", "severity": 4}, {"rule_id": "B", "confidence": 2}) == "B"
    assert one({"rule_id": "A", "severity": 4}, {"rule_id": "B", "is_taint": True, "pass_ord": 2}) == "B"
    assert one({"rule_id": "A"}, {"rule_id": "B", "severity": 3}) == "B"
    assert one({"rule_id": "A"}, {"rule_id": "B"}) == "A"
    assert len(_best(spark, {"category": "x"}, {"category": "y"})) == 2
    row = _best(spark, {"confidence": 2}, {"suppressed": True, "suppressed_by": "// nosec"})[0]
    assert (row.suppressed, row.suppressed_by) == (True, "// nosec")


def test_scan_end_to_end(spark, make_files):
    files = make_files(CODE)
    rows = O.report_order(scan(files)).collect()
    got = {(r.line_no, r.category): r for r in rows}
    assert got[3, "SQL Injection"].rule_id == "TAINT-SQLInjection"
    assert got[3, "SQL Injection"].match_text == "$id -> mysql_query()"
    assert [s.operation for s in got[3, "SQL Injection"].flow_steps] == ["source", "sink"]
    assert (4, "Command Injection") not in got
    assert got[7, "Authentication & Credentials"].rule_id == "AUTH-001"
    assert sum(r.rule_id.startswith("HEADER-") for r in rows) == 4
    assert [r.severity for r in rows] == sorted((r.severity for r in rows), reverse=True)
    shown = scan(files, ScanSettings(show_suppressed=True)).where("suppressed").collect()
    assert [(r.line_no, r.suppressed_by) for r in shown] == [(4, "// nosec")]
    strict = scan(files, ScanSettings(min_severity=CRITICAL, filter_all_passes=True)).collect()
    assert {r.severity for r in strict} == {CRITICAL}
    assert S.quality_gate(scan(files)).collect()[0].failed


def test_reports_are_valid_json(spark, make_files, tmp_path):
    found = scan(make_files(CODE), ScanSettings(show_suppressed=True)).cache()
    parts = R.sarif_parts(found)
    ordered = parts.orderBy("project", "section", *R._ORDER).collect()
    doc = json.loads("".join(r.text for r in ordered))
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["results"]) == found.count()
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert len(ids) == len(set(ids)) == found.select("rule_id").distinct().count()
    flow = next(r for r in run["results"] if r["ruleId"] == "TAINT-SQLInjection")
    steps = flow["codeFlows"][0]["threadFlows"][0]["locations"]
    assert steps[0]["message"]["text"] == "[SOURCE] $id" and flow["level"] == "error"
    summary = R.json_summary(found, S.file_totals(with_lines(make_files(CODE))), 133)
    top = json.loads(summary.collect()[0].summary)
    assert top["suppressed"] == 1 and top["by_severity"]["info"] == 0
    assert top["total_findings"] == sum(top["by_category"].values())
    R.write_json(found, summary, str(tmp_path / "json"))
    lines = spark.read.text(str(tmp_path / "json/findings")).collect()
    assert len(lines) == top["total_findings"]
    assert {"rule_id", "severity", "file"} <= set(json.loads(lines[0].value))
    R.write_parts(parts, str(tmp_path / "sarif"))
    found.unpersist()


def test_baseline_round_trip(spark, make_files, tmp_path):
    found = scan(make_files(CODE))
    moved = scan(make_files("\n" + CODE))
    write_baseline(found, str(tmp_path / "b"))
    stored = read_baseline(spark, str(tmp_path / "b"), "p", multi_line=False)
    assert stored.count() == found.count()
    assert B.new_findings(found, stored).count() == 0
    assert B.fixed_fingerprints(found, stored).count() == 0
    # Fingerprints hold the line, so moving code makes line findings new.
    new = B.new_findings(moved, stored).count()
    assert new == B.fixed_fingerprints(moved, stored).count() == found.where("line_no > 1").count()
    doc = {"scan_date": "2024-01-01", "findings": {"a": ["x", "y"], "b": ["x"]}}
    (tmp_path / "old.json").write_text(json.dumps(doc, indent=2))
    old = read_baseline(spark, str(tmp_path / "old.json"), "p")
    assert sorted(map(tuple, old.collect())) == [("p", "a", "x"), ("p", "a", "y"), ("p", "b", "x")]
    assert B.fixed_fingerprints(found, old).count() == 2


def test_incremental(spark, make_files, tmp_path):
    files = make_files("one", "two", "three")
    cache = I.file_hashes(make_files("one", "TWO"), "r1")
    assert sorted(r.path for r in I.changed_paths(files, cache, "r1").collect()) == ["p/f1.php", "p/f2.php"]
    assert I.changed_paths(files, cache, "r2").count() == 3
    found = spark.createDataFrame([("p", f"p/f{n}.php", "R") for n in range(4)], "project STRING, path STRING, rule_id STRING")
    kept = I.kept_findings(found, files, cache, "r1").collect()
    assert [r.path for r in kept] == ["p/f0.php"]
    gone = spark.createDataFrame([("p", "p/f3.php")], "project STRING, path STRING")
    assert I.without_files(found, gone).count() == 3
    doc = {"version": "1.0.0", "rules_hash": "r1", "file_hashes": {"a": "h"},
           "findings": {"a": [{"rule_id": "R", "line_number": 3, "line_text": "t", "match_text": "m"}]}}
    (tmp_path / "cache.json").write_text(json.dumps(doc))
    hashes, cached = read_cache(spark, str(tmp_path / "cache.json"), "p")
    assert hashes.collect()[0].sha256 == "h" and cached.collect()[0].line_no == 3


def test_watch(spark, make_files, tmp_path):
    from riskloom.streaming.watch import watch

    where = {n: str(tmp_path / n) for n in ("in", "hashes", "found", "check")}
    run = lambda: watch(spark, where["in"], where["hashes"], where["found"], where["check"], "r1").awaitTermination()
    make_files("<?php\nphpinfo();").write.parquet(where["in"])
    run()
    first = spark.read.parquet(where["found"]).count()
    make_files("<?php\nphpinfo();", "eval($_GET['x']);").write.mode("append").parquet(where["in"])
    run()
    rows = spark.read.parquet(where["found"]).where("batch = 1").collect()
    assert first > 0 and {r.path for r in rows} == {"p/f1.php"}
