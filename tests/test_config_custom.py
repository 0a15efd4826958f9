"""Settings that act on a scan, and custom rules through the index of their literals."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions.dialect import to_java
from riskloom.functions.text import glob_regex, glob_to_regex
from riskloom.model import CRITICAL, ScanSettings
from riskloom.operators import custom_match
from riskloom.plans.scan import scan, scan_by_config, scan_custom
from riskloom.rules import custom
from riskloom.rules.literals import grams, required_literals
from riskloom.rules.ruleset import all_rules
from riskloom.sources.settings import config_files

GLOBS = ["*", "a/*", "f?.php", "[a-c]x", "[^a]b", "[]a]", "[a", "x\\*y", "x\\", "a.b+c", "é*", "[[&]", "", "a{2}|b"]


def test_globs_as_data(spark):
    got = spark.createDataFrame([(g,) for g in GLOBS], "g string").select("g", glob_regex(F.col("g"))).collect()
    names = ["", "a/b", "f1.php", "bx", "ab", "bb", "]", "[", "&", "x*y", "a.b+c", "aXbbc", "élan", "a{2}|b", "a/b/c"]
    for glob, regex in got:
        wanted = glob_to_regex(glob)
        assert (regex is None) == (wanted is None), glob
        if regex:
            assert [bool(re.search(regex, n)) for n in names] == [bool(re.search(wanted, n)) for n in names], glob


def _files(spark, *rows):
    return spark.createDataFrame(list(rows), "project STRING, path STRING, content STRING")


def _configs(spark, **by_path):
    rows = [(*p.split(":"), json.dumps(c)) for p, c in by_path.items()]
    return config_files(spark.createDataFrame(rows, "project STRING, path STRING, content STRING"))


def test_each_directory_has_its_own_settings(spark):
    text = "a\nb\nc\n$x = $_GET['q']; echo $_GET['q']; // nosec\necho $_GET['q'];\nd\n"
    files = _files(spark, *[(p, d + "f.php", text) for p in ("p", "q") for d in ("", "src/", "src/deep/", "out/")])
    name = ".scan-config.json"
    configs = _configs(
        spark, **{f"p:{name}": {"min_severity": "critical", "context_lines": 1},
                  f"p:src/{name}": {"exclude_patterns": ["src/deep/*"], "show_suppressed": True},
                  f"q:out/{name}": {"disabled_rules": ["xss-001", " XSS-004 "]}},
    )
    settings = ScanSettings(framework_packs=False)
    found = scan_by_config(files, configs, settings=settings).collect()

    def alone(folder, **changes):
        plain = scan(_files(spark, ("x", f"{folder}f.php", text)), settings.but(**changes)).collect()
        return sorted((r.path, r.line_no, r.category, r.rule_id, r.suppressed, len(r.context_before)) for r in plain)

    def here(project, folder):
        return sorted(
            (r.path, r.line_no, r.category, r.rule_id, r.suppressed, len(r.context_before))
            for r in found if r.project == project and r.path == f"{folder}f.php"
        )

    assert here("p", "") == alone("", min_severity=CRITICAL, context_lines=1)
    assert here("p", "out/") == alone("out/", min_severity=CRITICAL, context_lines=1)
    assert here("p", "src/") == alone("src/", show_suppressed=True) and here("p", "src/deep/") == []
    assert here("q", "src/") == alone("src/") and here("q", "out/") == alone("out/", disabled_rules=("xss-001", "XSS-004"))
    # what is given wins over every file
    given = scan_by_config(files, configs, {"min_severity": CRITICAL, "disabled_rules": ()}, settings).collect()
    assert not [r for r in given if r.rule_id.startswith("INFO")] and len(given) <= len(found)


def test_every_match_has_a_required_literal():
    lines = ["eval($_GET['x']);", "mysql_query('SELECT ' . $id)", "MD5($password) == 'x'", "header('Location: ' . $u)"]
    for rule in all_rules():
        needs = required_literals(rule.pattern)
        assert needs, rule.pattern
        for line in lines:
            try:
                hit = re.search(rule.pattern, line, re.ASCII)
            except re.error:
                continue
            if hit:
                assert all(any(x in hit[0].lower() for x in need) for need in needs), (rule.pattern, line)
    assert grams("abcab") == ["abc", "bca", "cab"] and grams("ab") == ["ab"]
    assert required_literals("(a|)b?") == [] and required_literals("((") == []


RULES = [
    ("(?i)legacy_call\\s*\\(", "A"), ("b+", "B"), ("^[0-9]{3}$", "C"), ("(?i)(foo|quux)bar", "A"), ("x(", "D"),
    ("(?=x)", "D"), ("\\$v\\s*=.*\\$_GET", "SQL Injection"), ("Éa", "E"), ("\\Qa.b\\E", "E"), ("z{0,2}q", "F"), ("  ", "G"),
]


def _rule_rows(spark):
    rules = [{"id": f"R{n:02d}", "category": c, "severity": "high", "patterns": [p]} for n, (p, c) in enumerate(RULES)]
    files = [(f"r/{n}.json", json.dumps({"rules": rules[n::2]})) for n in (0, 1)]
    return custom.parse_rule_files(spark.createDataFrame(files, "path string, content string"))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_index_finds_what_one_expression_per_rule_finds(spark, monkeypatch, limit):
    monkeypatch.setattr(custom_match, "BROADCAST_BYTES", limit)
    rng = random.Random(8)
    parts = ["Legacy_Call (", "bb", "123", "quuxBAR foobar", "$v = 1; $_GET['a']", "Éa", "éA", "a.b", "axb", "q", "// x", "  ", "/*", "*/", "# bb"]
    text = ["\n".join(rng.choice(parts) + rng.choice(["", " ", rng.choice(parts)]) for _ in range(40)) for _ in range(6)]
    text.append("$v = intval($_GET['a']);\n$v = $_GET['b'];\n" + "x" * 200_000 + "legacy_call(\n\n")
    files = _files(spark, *[("p", f"p/{n}.php", t) for n, t in enumerate(text)], ("p", "p/empty.php", ""))
    rows = _rule_rows(spark)
    rules, rejected = custom.checked_rules(rows)
    settings = ScanSettings(framework_packs=False, show_suppressed=True)
    columns = ["path", "line_no", "category", "rule_id", "confidence", "sanitizer_func", "match_text", "line_text"]
    ours = scan_custom(files, rows, settings).select(*columns).collect()
    own = {r.rule_id for r in rules}
    # line by line and rule by rule, without the index
    every = [r for r in scan(files, settings.but(custom_rules=tuple(rules))).select(*columns).collect() if r.rule_id in own]
    assert set(every) <= set(ours)
    builtin = {(r.path, r.line_no, r.category) for r in scan(files, settings).collect()}
    assert all((r.path, r.line_no, r.category) in builtin for r in set(ours) - set(every))
    why = {r.rule_id: r.reason for r in custom.checked_table(rows).where("reason IS NOT NULL").collect()}
    assert set(why) == {r.rule_id for r in rejected.collect()} == {"R04", "R05"}


def test_no_rules_and_no_files(spark):
    rows = _rule_rows(spark)
    assert scan_custom(_files(spark, ("p", "p/a.php", "bb")), rows.limit(0)).count() == 0
    assert scan_custom(_files(spark, ("p", "p/a.php", "bb")).limit(0), rows).count() == 0
    assert to_java("a") == "(?d)a"
