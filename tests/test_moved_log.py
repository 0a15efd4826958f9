from pyspark.sql import functions as F

from checks import queries
from riskloom.operators import baseline as B, incremental as I


def _beyond(found, stored):
    rows = B.unmatched_findings(found, stored).orderBy("line_no", "rule_id").collect()
    return [(r.line_no, r.rule_id) for r in rows]


def test_findings_that_moved_or_were_copied(spark):
    def found(*rows):
        rows = [("p", "a.php", line, rule, match) for line, rule, match in rows]
        return spark.createDataFrame(
            rows, "project STRING, path STRING, line_no INT, rule_id STRING, match_text STRING"
        ).coalesce(1)

    first = found((2, "E", "exec($a)"), (4, "V", "eval($b)"))
    stored = B.as_moving_baseline(first)
    assert _beyond(first, stored) == []
    # A line above: all lines are others, nothing is new.
    assert _beyond(found((3, "E", "exec($a)"), (5, "V", "eval($b)")), stored) == []
    # A second copy, below or above: the known line stays known.
    below = found((2, "E", "exec($a)"), (3, "E", "exec($a)"), (4, "V", "eval($b)"))
    assert _beyond(below, stored) == [(3, "E")]
    above = found((1, "E", "exec($a)"), (2, "E", "exec($a)"), (4, "V", "eval($b)"))
    assert _beyond(above, stored) == [(1, "E")]
    # The other side: what there was more of; empty sides.
    assert _beyond(first, B.as_moving_baseline(below)) == []
    assert _beyond(first, B.as_moving_baseline(found())) == [(2, "E"), (4, "V")]
    assert _beyond(found(), stored) == []


def test_cache_log(spark):
    def files(**contents):
        rows = [("p", name, text) for name, text in contents.items()]
        return spark.createDataFrame(rows, "project STRING, path STRING, content STRING")

    def state(log):
        return {(r.path, r.sha256, r.version) for r in I.cache_state(log).collect()}

    def digest(text):
        return spark.range(1).select(I.file_hash(F.lit(text))).first()[0]

    schema = "project STRING, path STRING, sha256 STRING, rules_hash STRING, version BIGINT, removed BOOLEAN"
    log = spark.createDataFrame([], schema)
    for version, now in enumerate([
        files(a="1", b="2", c="3"), files(a="1", b="changed"), files(a="1", b="changed", c="3", d="4"),
    ], 1):
        log = log.unionByName(I.log_entries(now, I.cache_state(log), "r", version))
    rows = [(r.path, r.version, r.removed) for r in log.orderBy("version", "path").collect()]
    assert rows == [
        ("a", 1, False), ("b", 1, False), ("c", 1, False), ("b", 2, False), ("c", 2, True),
        ("c", 3, False), ("d", 3, False),
    ]
    present = {("a", digest("1"), 1), ("b", digest("changed"), 2), ("c", digest("3"), 3), ("d", digest("4"), 3)}
    assert state(log) == present and state(log.unionByName(log)) == present
    for up_to in range(5):
        assert state(I.compacted(log, up_to)) == present
    assert I.compacted(log, 2).where("removed").count() == 0 and I.compacted(log, 3).count() == 4
    # Other rules: all files are scanned and entered again.
    again = I.log_entries(files(a="1"), I.cache_state(log), "other", 4)
    assert {(r.path, r.removed) for r in again.collect()} == {("a", False), ("b", True), ("c", True), ("d", True)}


def test_a_union_of_sources_is_joined_once(spark, make_files):
    files = make_files("a").unionByName(make_files("b")).unionByName(make_files("c"))
    state = I.file_hashes(files, "r").withColumn("version", F.lit(1).cast("bigint"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(I.changed_paths(files, state, "r")).count("Join LeftAnti") == 1
    assert plan(I.log_entries(files, state, "r", 2)).count("Join LeftAnti") == 2


def test_the_log_reads_a_saved_state(spark):
    plan = queries._log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "older" not in plan  # the earlier corpus is hashed once, for the saved state
