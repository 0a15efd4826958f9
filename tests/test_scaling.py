"""Work that must not grow with the square of a file, stand in one task or swell the plan."""

import re

from checks import corpus as C, oracle, queries
from riskloom.model import ScanSettings
from riskloom.operators import comments, detectors as D, lines as L, match as M, taint, walk
from riskloom.plans.scan import scan
from riskloom.rules.ruleset import all_rules

TEXTS = [
    "mysql_query(\"SELECT $x\"); md5($pass)", "echo $_GET['a'];", "// TODO: password is x", "plain text",
    "debug=true", "mysql://a:b@c", "ghp_" + "a" * 36, "-----BEGIN PRIVATE KEY-----", "setcookie('a');",
    "<form method='post'>", "$x = `ls $_GET[a]`;", "phpinfo ()", "INSERT INTO t (card_number, cvv) VALUES ('1')",
]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gated_rules_hit_the_same_lines(spark, make_files, monkeypatch):
    rules, files = all_rules(), make_files("\n".join(TEXTS))
    found = lambda: M.with_hits(L.with_lines(files), rules, masked=False).select("hits").first()[0]
    gated = found()
    monkeypatch.setattr(M, "GATES", ())
    assert gated and gated == found()


def test_a_gate_is_part_of_what_its_rule_matches():
    found = {r.rule_id: M.gate(r) for r in all_rules()}
    assert found["XSS-001"] == "$_" and found["CRYPTO-003"] == "(" and found["INFO-007"] == ""
    for rule in all_rules():
        hits = [t for t in TEXTS if re.search(rule.pattern, t)]
        assert all(found[rule.rule_id] in t for t in hits), rule.rule_id


def test_comment_state_is_computed_once_a_file(spark, make_files):
    files = make_files("/*\na\n*/ b\nc")
    df = M.with_hits(comments.with_comment_state(L.with_lines(files)), all_rules())
    assert "in_comment, in_comment#" in _plan(df.select("hits"))  # a column, not its expression


def test_readers_of_lines_are_not_copied_for_each_source(spark, make_files):
    one = make_files("a", "b")
    df = M.with_hits(L.with_lines(one.unionByName(make_files("c")).unionByName(make_files("d"))), all_rules(), masked=False)
    assert _plan(df).count("mysql_real_escape_string") == _plan(
        M.with_hits(L.with_lines(one), all_rules(), masked=False)
    ).count("mysql_real_escape_string")


def test_lines_and_line_ends(spark, make_files):
    texts = ["", "\n", "a", "a\n", "a\r\n", "a\r\r\n", "a\r", "a\n\n", "a\r\nb\n\r", "\r"]
    wanted = [[], [""], ["a"], ["a"], ["a"], ["a\r"], ["a"], ["a", ""], ["a", "b", ""], [""]]
    got = {r.path: r.lines for r in L.with_lines(make_files(*texts)).collect()}
    assert [got[p] for p in sorted(got, key=lambda p: int(re.sub(r"\D", "", p)))] == wanted


def _customers(spark, tmp_path, count: int) -> str:
    rows = spark.range(1, count + 1).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_code_files_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("CHECK_PARTITIONS", raising=False)
    monkeypatch.setattr(C, "FILES_PER_TASK", 10)
    files = C.code_files(spark, _customers(spark, tmp_path, 600))
    assert files.rdd.getNumPartitions() == 61 and files.count() == 600


def test_long_line_is_not_part_of_the_plan(spark, tmp_path):
    files = C.code_files(spark, _customers(spark, tmp_path, 600))
    assert len(_plan(files)) < 200_000
    long = files.where("path LIKE '%/f17.%' OR path LIKE '%/f517.%'").selectExpr("max(length(content))", "count(*)").first()
    assert long[0] > 1048576 and long[1] == 2


def test_a_scan_reads_forms_to_their_end(spark, make_files):
    form = ["<form method='post'>"] + ["x"] * 40
    files = make_files("\n".join(form + ["csrf", "</form>"]), "\n".join(form + ["INSERT", "</form>"]))
    found = scan(files, ScanSettings(framework_packs=False)).where("category = 'CSRF' AND line_no = 1")
    assert [(r.path, r.rule_id) for r in found.collect()] == [("p/f1.php", "CSRF-002")]


def test_saved_state_is_read_not_computed_again(spark):
    saved = queries._saved(spark.range(3).selectExpr("id * 2 AS x"))
    assert "parquet" in _plan(saved) and "Range" not in _plan(saved)
    assert sorted(r.x for r in saved.collect()) == [0, 2, 4]


def test_a_hit_is_lower_cased_once_and_judged_in_compiled_steps(spark, make_files):
    plan = _plan(queries.scan(make_files("echo $a; // nosec"), queries.PLAIN))
    assert len(re.findall(r"lower\(text#", plan)) <= 1
    steps = [line for line in plan.split("\n") if "near_func" in line and line.lstrip(" +-:").startswith("Generate")]
    assert steps and not any("lambda" in line for line in steps)


def test_a_comparison_scans_once(spark, tmp_path, monkeypatch):
    scans = []
    monkeypatch.setattr(queries, "judged_hits", lambda s, sf, f=queries.judged_hits: scans.append(sf) or f(s, sf))
    for query in (queries.baseline_new, queries.baseline_fixed, queries.baseline_moved):
        df = query(spark, "/root/testdata/sf0.001")
        assert "mysql_query" not in _plan(df) and df.count() > 0  # rules are not matched again
    assert len(scans) == 3


def test_forms_have_no_reach_in_the_sql_of_any_report():
    texts = oracle.all_sql()
    for name in ("active_findings", "sev_counts", "cat_counts", "conf_counts", "scan_totals", "summary_pivot",
                 "distinct_rules", "quality_gate", "report_order", "report_json", "report_summary", "report_sarif",
                 "report_sarif_parts", "csrf_form"):
        assert oracle.CTES["d2_whole"] in texts[name] and "f.line_no + 30" not in texts[name], name


def test_runs_of_a_line_meet_the_index_in_a_compiled_join(spark):
    plan = _plan(queries.custom_findings(spark, "/root/testdata/sf0.001"))
    joins = [line for line in plan.split("\n") if "Join Inner" in line and "literal#" in line]
    assert joins and all("Contains(low#" in line and "lambda" not in line for line in joins)


def test_lines_are_split_without_a_pattern(spark, make_files):
    plan = _plan(L.with_lines(make_files("a\r\nb\r\r\nc\rd", "x")))
    assert "split(" in plan and "?" not in plan.split("split(")[1]
    assert L.with_lines(make_files("a\r\nb\r\r\nc\rd")).first().lines == ["a", "b\r", "c\rd"]


def test_headers_are_looked_up_in_output_files_and_few_lines(spark, make_files):
    texts = ["plain", "header('X-Frame-Options: A');", "ECHO 1;\nHeader('x-frame-options: A');", "a ?> b <", "Print x", "printed", "?>"]
    rows = L.with_lines(make_files(*texts)).select("path", D.missing_headers().alias("d"))
    assert _plan(rows).count("lower(") <= 3  # two for output, one for headers, however many there are
    assert {r.path: len(r.d) for r in rows.collect()} == {
        f"p/f{n}.php": k for n, k in enumerate([0, 0, 3, 4, 4, 0, 0])
    }


def test_a_line_is_lower_cased_for_all_cleaning_names_at_once(spark, make_files):
    df = taint.with_facts(L.with_lines(make_files("$a = INTVAL($b);", "$a = $b; // intval", "# $a = 1;\n / $a = 'c/#';")))
    assert _plan(df).count("lower(") <= 2
    found = {r.path: [(f.line_no, f.target, f.cleans) for f in r.facts] for r in df.collect()}
    assert found == {"p/f0.php": [(1, "$a", True)], "p/f1.php": [(1, "$a", True)], "p/f2.php": [(2, "$a", False)]}


def test_walk_takes_the_columns_of_many_files_and_keeps_them_apart():
    facts = {
        "line_no": [1, 2, 1, 2], "target": ["$a", "", "$b", ""], "rest_vars": [[], [], ["$a"], []],
        "src_key": ["$_GET[", "", "", ""], "fetch_var": [""] * 4, "row_to": [""] * 4, "row_from": [""] * 4,
        "cleans": [False] * 4, "sinks": [[], [0, 1], [], [0]], "line_vars": [["$a"], ["$a"], ["$b", "$a"], ["$a"]],
    }
    edges, flows = walk.walk(facts, [0, 2, 2, 4], "db", set(), [("x", 1), ("x", 2)])
    assert edges["ends"] == [0, 1, 1, 1] and flows["ends"] == [0, 2, 2, 2]
    assert flows["sink"] == [0, 1] and flows["path"] == [None, [0]] and flows["src_line"] == [1, 1]
