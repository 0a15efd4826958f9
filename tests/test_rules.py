from dataclasses import replace

from pyspark.sql import functions as F

from checks.templates import TEMPLATES
from riskloom.model import HIGH, INFO, ScanSettings
from riskloom.operators import findings as O, match as M, sanitize
from riskloom.operators.comments import with_comment_state
from riskloom.operators.lines import with_lines
from riskloom.rules.ruleset import all_rules, builtin_rules, pack_rules, select_rules

PLAIN = ScanSettings(framework_packs=False)


def _rules(*ids):
    return [r for r in builtin_rules() + pack_rules() if r.rule_id in ids]


def _judge(files, rules, settings=PLAIN):
    df = sanitize.with_cleaned_variables(M.with_hits(with_comment_state(with_lines(files)), rules))
    rows = O.exploded(df, O.rule_candidates(rules, 3).cast(O.CANDIDATE_TYPE))
    return O.judged(rows, O.RuleBook(rules), settings).orderBy("path", "line_no").collect()


def test_catalogue_size_and_selection():
    rules = builtin_rules()
    assert len(rules) == 134 and len(pack_rules()) == 15
    assert len(select_rules(rules, PLAIN)) == 133  # one INFO rule is off by default
    assert len(select_rules(rules, PLAIN.but(min_severity=INFO))) == 134
    assert all(r.severity >= HIGH for r in select_rules(rules, PLAIN.but(min_severity=HIGH)))
    assert len(select_rules(rules, PLAIN.but(disabled_rules=("xss-004 ",)))) == 132


def test_hints_never_change_hits(spark, make_files):
    """Hints are only a speed-up: same hits with and without them, for every rule."""
    lines = TEMPLATES + [t.upper() for t in TEMPLATES] + [t.lower() for t in TEMPLATES]
    df = with_lines(make_files("\n".join(lines)))
    rules = select_rules(all_rules(), ScanSettings(min_severity=INFO))
    bare = [replace(r, hints=()) for r in rules]

    def pairs(chosen):
        rows = M.with_hits(df, chosen, masked=False).select(F.explode_outer("hits").alias("h"))
        return {(r.h.line_no, r.h.rule_ord, r.h.match, r.h.pos) for r in rows.collect()}

    assert pairs(rules) == pairs(bare)


def test_exemptions(spark, make_files):
    code = "\n".join([
        '$s = $db->prepare("SELECT " . "x" . $_GET["a"]);',
        "echo $a . htmlentities($b);",
        "$db_password_hash = 'abc';", "$password = 'abcd';",
        "$db->query($pageSql);", "$db->query($sql);",
    ])
    rules = _rules("SQL-006", "XSS-004", "AUTH-001", "SQL-005")
    assert [(r.line_no, r.rule_id) for r in _judge(make_files(code), rules)] == [
        (4, "AUTH-001"), (6, "SQL-005"),
    ]


def test_suppression(spark, make_files):
    code = "\n".join([
        "system($_GET['a']); // nosec", "system($_GET['a']); // nosec CMD-002 ok",
        "system($_GET['a']); // nosec XSS-001", "system($_GET['a']); // nosec - intended",
        "system($_GET['a']); # NOSEC because", "$x->y; system($_GET['a']); /* nosec $x->y */",
        "system($_GET['a']); // @SuppressWarnings", "system($_GET['a']);",
    ])
    got = [(r.suppressed, r.suppressed_by) for r in _judge(make_files(code), _rules("CMD-002"))]
    assert [s for s, _ in got] == [True, True, False, False, True, False, True, False]
    assert got[3][1] == "// nosec - intended" and got[6][1] == "phpcs:ignore"


def test_sanitizers(spark, make_files):
    gap = ["$q = 1;"] * 4
    func = lambda lines, rule="FI-002": _judge(make_files("\n".join(lines)), _rules(rule))[0].sanitizer_func
    code = ["$id = basename($_GET['i']);"] + gap + ["include($id);"]
    assert func(code) == "basename() (context)"
    assert func(code[:1] + gap[:1] + code[1:]) == "basename() (file-level)"
    # The match shows one letter of the name, and "mentions" is a substring test.
    assert func(["if (in_array($identity, $l)) {"] + gap * 2 + ["include($id);"]) == (
        "in_array() whitelist (file-level)"
    )
    assert func(["if (in_array($other, $l)) {"] + gap * 2 + ["include($id);"]) == ""
    # Position on the line decides: before the match counts, after it does not.
    row = _judge(make_files("intval($a); mysql_query($q);"), _rules("SQL-002"))[0]
    assert row.sanitizer_func == "intval()"
    row = _judge(make_files("mysql_query($q); intval($a);"), _rules("SQL-002"))[0]
    assert row.sanitizer_func == ""
    # Another category's sanitizer counts in the lines just before, not further up.
    assert func(["$id = intval($x);", "include($id);"]) == "intval() (context)"
    assert func(["$id = intval($x);"] + gap * 2 + ["include($id);"]) == ""
    # A match without a variable name is only checked on its own line.
    assert func(["$q = intval($x);", "mysql_query($q);"], "SQL-002") == ""


def test_dropped_when_sanitized_and_context(spark, make_files):
    code = "\n".join(["one", "$v = (int) $w;", "$db->query($v);", "x" * 300, "five", "six", "seven"])
    assert _judge(make_files(code), _rules("SQL-005")) == []
    code = "\n".join(["one", "two", "$db->query($v);", "x" * 300, "five", "six", "seven"])
    row = _judge(make_files(code), _rules("SQL-005"))[0]
    assert [(c.number, c.text) for c in row.context_before] == [(1, "one"), (2, "two")]
    assert [c.number for c in row.context_after] == [4, 5, 6]
    assert row.context_after[0].text == "x" * 200 + "..."


def test_whole_lines_are_matched(spark, make_files):
    lines = ["a" * 4090 + " phpinfo();", "b" * (1 << 20) + " phpinfo();", "$x = $_GET['" + "k" * 300 + "'];"]
    got = _judge(make_files("\n".join(lines)), _rules("INFO-001"))
    assert [r.line_no for r in got] == [1, 2]


def test_word_that_cancels_a_rule(spark, make_files):
    code = "$a = $_POST['x'];\n$a = $_POST['x']; wp_verify_nonce($n);"
    assert [r.line_no for r in _judge(make_files(code), _rules("WP-003"))] == [1]
