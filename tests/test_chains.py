import random
import time

import pytest
from pyspark.sql import functions as F

from checks.templates import TEMPLATES
from riskloom.model import INFO, ScanSettings
from riskloom.operators import match as M
from riskloom.operators.lines import with_lines
from riskloom.rules.chains import chain, segments
from riskloom.rules.ruleset import all_rules, select_rules

RULES = select_rules(all_rules(), ScanSettings(min_severity=INFO))
PIECES = (
    "mysql_query(|mysqli_query (|'|\"|.|$|$_|$_GET|$_POST|$_request['a']|SELECT |insert into |values (|exec(|"
    "shell_exec  (|system(|`|addslashes(|)|;|echo |echo\t'|$a|$_b |print |<form |method='post'|>|md5 (|pass|password|"
    "sha1(|curl_setopt(|CURLOPT_URL|file_get_contents('http://|header('Location: |setcookie(|); |copy(|fopen(|"
    "unserialize(|$_COOKIE[|token| = |is|=|abcd|where | and |// |#|/*|secret|api key|htmlspecialchars(|ENT_COMPAT|"
    "innerHTML=|document.write(|->query('|include('|preg_replace(|/e|cvv'|ssn,|card_number |é|K|  |\t|x"
).split("|")


def _lines(count: int) -> list[str]:
    rnd = random.Random(7)
    made = ["".join(rnd.choices(PIECES, k=rnd.randint(1, 24))) for _ in range(count)]
    for _ in range(count // 2):  # two known lines, cut and joined
        a, b = rnd.choice(TEMPLATES), rnd.choice(TEMPLATES)
        made.append(a[rnd.randint(0, len(a)):] + rnd.choice(PIECES) + b + a)
    return [line.replace("\n", " ").replace("\r", " ") for line in made]


def _hits(df, rules):
    rows = M.with_hits(df, rules, masked=False).select(F.explode_outer("hits").alias("h")).where("h IS NOT NULL")
    return {(r.h.line_no, rules[r.h.rule_ord - 1].rule_id, r.h.match, r.h.pos) for r in rows.collect()}


def test_same_matches_as_whole_patterns(spark, make_files, monkeypatch):
    df = with_lines(make_files("\n".join(_lines(1500))))
    ours = _hits(df, RULES)
    monkeypatch.setattr(M, "chain", lambda pattern: None)
    theirs = _hits(df, RULES)
    assert ours == theirs
    seen = {rule_id for _, rule_id, _, _ in theirs}
    covered = {r.rule_id for r in RULES if chain(r.pattern)}
    assert len(covered) >= 70 and len(covered & seen) >= 40


def test_long_line_of_trigger_words(spark, make_files):
    """A megabyte of beginnings without ends: seconds, where trying all pairs takes hours."""
    unit = " ".join(p for p in PIECES if p not in (";", "$_GET", "$_POST", "$_request['a']"))
    line = unit * (1_000_000 // len(unit))
    started = time.time()
    _hits(with_lines(make_files(line)), RULES)
    assert time.time() - started < 60


@pytest.mark.parametrize("pattern", [
    r"(?i)a.*b|c",          # alternatives outside of groups
    r"a.*?b", r".*b", r"a.*", r"^a.*b",
    r"a+.*b[^)]*\d?.*c?",   # may end with nothing
    r"ab?.*c",              # one start, two ends
    r"(abcd|b).*x",         # "b" begins later and ends earlier
    r"a[^;]*;b[^;]*c",      # a part crosses the border
    r"(?P<n>a).*b", r"[[:alpha:]].*b", r"a.*b\z",
])
def test_patterns_that_stay_whole(pattern):
    assert chain(pattern) is None


def test_loose_ends_and_borders():
    assert segments(r"(?i)a\s+[']?.*b\s*.*c") == ("(?i)", ".", [r"a\s", "b", "c"])
    assert segments(r"a[;x]?[^;]*b\w*[^;]*;") == ("", "[^;]", ["a[;x]?", "b", ";"])
    found = chain(r"(?i)(exec|popen)\s*\([^)]*\$[a-z]")
    assert found.exists == r"(?i)(?<![^)])(?>[^)]*?(exec|popen)\s*\()(?>[^)]*?\$[a-z])" and found.start is None
    assert found.group == 3
