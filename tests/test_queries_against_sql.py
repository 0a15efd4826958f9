"""Registered queries against DuckDB on the smallest tables."""

import pytest

from checks.compare import compare, duck
from checks.oracle import all_sql
from checks.queries import QUERIES
from tests.conftest import SF_DIR

SOME = [
    "lines_split", "rejected_files", "comment_skip", "suppression_mark", "rule_match",
    "first_variable", "confidence_score", "san_lookback", "toctou", "csrf_form", "missing_headers",
    "taint_facts", "taint_flows", "dedup_findings", "incremental_changed", "rules_hash",
    "config_merge", "custom_rules", "convert_rules", "exclude_filter",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(all_sql()) == set(QUERIES)


@pytest.mark.parametrize("name", SOME)
def test_equal(spark, con, name):
    verdict = compare(spark, con, SF_DIR, name, QUERIES[name], all_sql()[name])
    assert verdict.startswith("ok"), verdict
