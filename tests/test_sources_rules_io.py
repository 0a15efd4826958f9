import json

import pytest
from pyspark.sql import functions as F

from riskloom.model import ScanSettings
from riskloom.plans.scan import raw_findings, scan
from riskloom.rules import convert, custom
from riskloom.functions.dialect import to_java
from riskloom.operators import baseline as B
from riskloom.plans.incremental import incremental_scan, write_cache
from riskloom.sources import corpus, manifests, settings, settings as conf
from riskloom.streaming.watch import current_findings, watch


def test_read_tree_and_selection(spark, tmp_path):
    for name in ("a.php", "b.PHTML", "c.js", "sub/d.inc", ".git/e.php", "node_modules/x/f.php", "vendor/g.php"):
        path = tmp_path / "proj" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("<?php\nphpinfo();")
    files = corpus.read_tree(spark, str(tmp_path / "proj"))
    assert sorted(r.path for r in files.collect()) == ["a.php", "b.PHTML", "sub/d.inc", "vendor/g.php"]
    kept = corpus.scannable(files, ["vendor/*"])
    assert sorted(r.path for r in kept.collect()) == ["a.php", "b.PHTML", "sub/d.inc"]
    one = corpus.single_file(spark, str(tmp_path / "proj/a.php"))
    assert [(r.path, r.content) for r in one.collect()] == [("a.php", "<?php\nphpinfo();")]
    with pytest.raises(ValueError):
        corpus.single_file(spark, str(tmp_path / "proj/c.js"))


def test_exclude_patterns(spark):
    df = spark.createDataFrame([("a/myvendor/x.php",), ("a/b.php",), ("t1.php",)], "path STRING")
    out = lambda *p: [r[0] for r in df.select(corpus.is_excluded(F.col("path"), p)).collect()]
    assert out("vendor/*") == [True, False, False]
    assert out("*") == [True, True, True]
    assert out("t?.php") == [False, False, True]
    assert out("a/*.php") == [False, True, False]
    assert out("[") == [False, False, False]


def test_frameworks_and_packs(spark):
    rows = [
        ("l", "composer.json", '{"require":{"yiisoft/yii2":"2","laravel/framework":"^9"}}'),
        ("w", "wp-content/x.php", ""), ("w", "composer.json", '{"require":{"laravel/framework":"1"}}'),
        ("n", "sub/composer.json", '{"require":{"laravel/framework":"1"}}'),
        ("b", "composer.json", "{oops"),
    ]
    files = spark.createDataFrame(rows, "project STRING, path STRING, content STRING")
    found = manifests.detect_frameworks(files)
    assert sorted(map(tuple, found.collect())) == [("l", "laravel", "^9"), ("w", "wordpress", "")]
    code = spark.createDataFrame(
        [(p, f"{p}/a.php", "whereRaw('a' . $x);") for p in "lwn"], "project STRING, path STRING, content STRING"
    )
    hits = raw_findings(code, ScanSettings(), found).where("rule_id LIKE 'LARAVEL%'").collect()
    assert [(r.project, r.rule_id) for r in hits] == [("l", "LARAVEL-002")]


def test_nearest_config(spark):
    files = spark.createDataFrame(
        [("p", "p/.scan-config.json", '{"context_lines": 5, "min_severity": "high"}'),
         ("p", "p/a/b/.scan-config.json", '{"context_lines": 0}')],
        "project STRING, path STRING, content STRING",
    )
    targets = spark.createDataFrame([("p", "p/a/b/c"), ("p", "p/ab"), ("q", "q")], "project STRING, dir STRING")
    near = conf.nearest_config(targets, conf.config_files(files))
    got = {r.dir: (r.min_severity, r.context_lines) for r in conf.merged_settings(near).collect()}
    assert got == {"p/a/b/c": (1, 3), "p/ab": (3, 5), "q": (1, 3)}
    given = conf.merged_settings(near, {"context_lines": 9}).collect()
    assert {r.context_lines for r in given} == {9}


def test_custom_rules_in_a_scan(spark, make_files, tmp_path):
    doc = {"rules": [
        {"id": "MY-1", "category": "Mine", "severity": "High", "patterns": ["(?i)legacy_call\\(", "(?=x)", "("]},
        {"id": "", "category": "c", "patterns": ["x"]}, {"id": "N", "category": "c", "patterns": []},
    ]}
    (tmp_path / "d").mkdir()
    (tmp_path / "d/mine.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "d/bad.json").write_text("{")
    rules = custom.to_rules(custom.read_rule_dir(spark, str(tmp_path)))
    assert [(r.rule_id, r.severity, r.source) for r in rules] == [("MY-1", 3, "yaml:mine.json")]
    found = scan(make_files("Legacy_Call(1);"), ScanSettings(custom_rules=tuple(rules))).collect()
    assert [(r.rule_id, r.match_text) for r in found] == [("MY-1", "Legacy_Call(")]


def test_convert_and_load_again(spark, tmp_path):
    rows = [
        (1, "", "m", "ERROR", "eval($X, ...)", ["PHP"], "", "", "d/r.yaml"),
        (2, "b", "m", "nope", "a...b...c...d", ["php"], "", "", "d/r.yaml"),
        (3, "c", "m", "info", "x( 1 )", ["js"], "", "", "d/r.yaml"),
        (4, "d", "m", "info", "$lower[0]  + $A_1", ["php"], "CWE-9", "Cat", "d/r.yaml"),
    ]
    ext = spark.createDataFrame(
        rows, "ord INT, id STRING, message STRING, severity STRING, pattern STRING, "
        "languages ARRAY<STRING>, cwe STRING, category STRING, source_file STRING")
    out = convert.convert_rules(ext).orderBy("id").collect()
    assert [(r.id, r.severity, r.category, r.cwe, r.patterns[0]) for r in out] == [
        ("SEMGREP-001", "critical", "Semgrep Import", "CWE-Unknown", r"(?i)eval\([^\s;]+,\s+.*\)"),
        ("b", "medium", "Semgrep Import", "CWE-Unknown", "(?i)a.*b.*c.*d"),
        ("d", "medium", "Cat", "CWE-9", r"(?i)$lower\[0\]\s+\+\s+[^\s;]+"),
    ]
    convert.save_rules(convert.convert_rules(ext), str(tmp_path / "rules"))
    loaded = spark.read.text(str(tmp_path / "rules")).select(
        F.lit("x.json").alias("path"), F.col("value").alias("content"))
    assert custom.parse_rule_files(loaded).count() == 3


def test_custom_patterns_are_translated_or_rejected_with_a_reason(spark):
    good = [r"foo\((?P<arg>[a-z]+)\)", r"[[:alpha:]]+\(", r"foo(?i)BAR", r"\pL+x", r"a\z", r"\Qa.b\E"]
    bad = [r"a(?#note)", r"(?=x)", r"(a)\1", r"(?U)a+", "["]
    rows = spark.createDataFrame(
        [("f", 0, n, f"R{n}", "c", 1, "", p, "", "", ["t"], "s") for n, p in enumerate(good + bad)],
        "path STRING, rule_no INT, pattern_no INT, rule_id STRING, category STRING, severity INT, cwe STRING, "
        "pattern STRING, description STRING, recommendation STRING, tags ARRAY<STRING>, source STRING",
    )
    rules, rejected = custom.checked_rules(rows)
    assert [r.pattern for r in rules] == good
    assert {r.pattern for r in rejected.collect()} == set(bad) and rejected.where("reason = ''").count() == 0
    text = spark.createDataFrame([("foo(bar) a.b",)], "t STRING")
    hits = [text.where(F.rlike("t", F.lit(to_java(p)))).count() for p in good]
    assert hits == [1, 1, 0, 0, 0, 1]


def test_same_paths_in_two_projects_are_told_apart(spark):
    files = spark.createDataFrame(
        [(p, "index.php", "<?php\nsystem($_GET['a']);\n") for p in "ab"], "project STRING, path STRING, content STRING"
    )
    found = scan(files).cache()
    stored = B.as_baseline(found.where("project = 'a'"))
    new = B.new_findings(found, stored)
    assert {r.project for r in new.collect()} == {"b"} and new.count() == stored.count() > 0
    assert B.fixed_fingerprints(found.where("project = 'b'"), stored).count() == stored.count()


def test_incremental_scan_equals_a_full_one(spark, tmp_path):
    code = "<?php\nsystem($_GET['a']);\n"
    make = lambda *rows: spark.createDataFrame(list(rows), "project STRING, path STRING, content STRING")
    before = make(("p", "a.php", code), ("p", "b.php", code), ("p", "gone.php", code))
    after = make(("p", "a.php", code), ("p", "b.php", code + "eval($_POST['x']);\n"), ("q", "a.php", code))
    hashes, kept = str(tmp_path / "hashes"), str(tmp_path / "findings")
    write_cache(before, scan(before), "r", hashes, kept)
    got = incremental_scan(after, spark.read.parquet(hashes), spark.read.parquet(kept), "r")
    key = lambda df: sorted(map(str, df.select("project", "path", "line_no", "rule_id", "category").collect()))
    assert key(got) == key(scan(after))


def test_watch_rescans_content_that_comes_back(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    for n, code in enumerate(["<?php system($_GET['a']);", "<?php echo 1;", "<?php system($_GET['a']);"]):
        row = spark.createDataFrame([("p", "a.php", code)], "project STRING, path STRING, content STRING")
        row.write.mode("append").parquet(at("landing"))
        watch(spark, at("landing"), at("hashes"), at("findings"), at("state"), "r").awaitTermination()
        now = current_findings(spark, at("hashes"), at("findings")).where("rule_id LIKE 'CMD%'").count()
        assert (now > 0) == (n != 1)


def test_directories_without_configuration_get_defaults(spark):
    files = spark.createDataFrame([("p", "a/.scan-config.json", '{"context_lines": 5}')], "project STRING, path STRING, content STRING")
    targets = spark.createDataFrame([("p", "a/b"), ("p", "c")], "project STRING, dir STRING")
    merged = settings.merged_settings(settings.nearest_config(targets, settings.config_files(files)))
    assert {r.dir: r.context_lines for r in merged.collect()} == {"a/b": 5, "c": 3}
    assert ScanSettings(context_lines=0).context_lines == 3
