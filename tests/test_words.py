import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.model import ScanSettings
from riskloom.operators import match as M, summary as S, words as W
from riskloom.operators.lines import with_lines
from riskloom.plans.scan import scan
from riskloom.rules.literals import required_literals
from riskloom.rules.ruleset import all_rules

SIGNS = "abcABC$é_ (("


def _low(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


@pytest.mark.parametrize("chunk", [1, 7, 50, 1 << 20])
def test_possible_rules_are_those_whose_words_are_on_the_line(monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK_BYTES", chunk)
    rng = random.Random(chunk)

    def text(size):
        return "".join(rng.choice(SIGNS) for _ in range(size))

    for _ in range(60):
        need = lambda: [_low(text(rng.choice([1, 2, 3, 4, 7, 8, 9, 17]))) for _ in range(rng.choice([1, 2, 3]))]
        rules = [(n + 1, [need() for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for n in range(rng.choice([0, 1, 5, 30]))]
        known = [w for _, needs in rules for words in needs for w in words] or ["a"]
        piece = lambda: rng.choice([rng.choice(SIGNS), rng.choice(known), rng.choice(known).upper()])
        files = [
            ["".join(piece() for _ in range(rng.choice([0, 0, 3, 10]))) for _ in range(rng.choice([0, 0, 1, 4]))]
            for _ in range(6)
        ]
        lists = pa.array([["a b", "c"], *files], pa.list_(pa.string())).slice(1)
        expected = [
            [
                {"line": n, "rules": own}
                for n, line in enumerate(lines)
                if (own := [r for r, needs in rules if all(any(w in _low(line) for w in words) for words in needs)])
            ]
            for lines in files
        ]
        assert W.possible_rules(lists, W.Needs(rules)).to_pylist() == expected


def test_patterns_run_only_on_lines_with_their_words(spark, make_files):
    rules = all_rules()
    numbered = [(n, M.needs(r)) for n, r in enumerate(rules, 1)]
    assert all(needs for _, needs in numbered)
    text = "plain words and $one = $two;\nmysql_query(\"SELECT \" . $_GET['x']);\n" + "prose without a call\n" * 50
    found = with_lines(make_files(text)).select(F.explode(M.possible_rules(numbered)).alias("p")).select("p.*").collect()
    assert [r.line for r in found] == [1] and len(found[0].rules) < len(rules) / 5


def test_signs_next_to_a_run_are_required_with_it():
    spaces = "\t\n\f\r "
    assert required_literals(r"st\s+the") == [sorted("st" + s for s in spaces), sorted(s + "the" for s in spaces)]
    assert required_literals("(x)?hea{1,2} der") == [["hea"], ["a der"]]
    assert required_literals(r"a\s*b") == [["a"], ["b"]] and required_literals(r"\s+") == []
    assert required_literals(r"a+b?c") == [["a"], ["c"]] and required_literals(r"a+(b)") == [["a"], ["b"]]


def test_counts_do_not_aggregate_the_wording_of_findings(spark, make_files):
    found = scan(make_files("<?php\necho $_GET['a'];\n", "c.php"), ScanSettings(framework_packs=False))
    for frame in (S.severity_counts(found), S.severity_summary(found), S.quality_gate(found)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        aggregate = next(x for x in plan.splitlines() if "Aggregate [project" in x and "category" in x)
        assert not any(name in aggregate for name in ("context_after", "recommendation", "flow_steps")), aggregate
