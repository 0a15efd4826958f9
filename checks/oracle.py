"""The same queries in DuckDB SQL, written independently of the Spark plans.

Everything works on a table of single lines: comment state by running windows,
neighbours by range joins, data flow by a recursive query over one state map.
"""

from __future__ import annotations

import re

from checks.templates import TEMPLATES
from riskloom.functions.text import WHITE_SPACE, glob_to_regex
from riskloom.model import HIGH, SARIF_LEVELS, ScanSettings, SEVERITY_BY_NAME, SEVERITY_LABELS
from riskloom.operators.detectors import DETECTOR_RULES
from riskloom.operators.report import SARIF_SCHEMA, SARIF_VERSION, TOOL_NAME, TOOL_VERSION
from riskloom.operators.taint import SINK_RULES
from riskloom.rules import exemptions as X, flows as V, multiline as ML
from riskloom.rules.packs import FRAMEWORK_PACKAGES
from riskloom.rules.ruleset import all_rules, builtin_rules, select_rules
from riskloom.rules.sanitizers import SANITIZERS

DEFAULTS = ScanSettings()
RULES = select_rules(builtin_rules(), DEFAULTS)
EVERY_RULE = select_rules(all_rules(), DEFAULTS)
SAN_CATEGORIES = sorted({c for c, _, _ in SANITIZERS})


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def trim(text: str) -> str:
    return f"trim({text}, {q(WHITE_SPACE)})"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def ex(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {group})"


def pos(text: str, pattern: str) -> str:
    return f"length(regexp_extract({text}, {q('(?s)^(.*?)(?:' + pattern + ')')}, 1)) + 1"


def clip(text: str, size: int) -> str:
    return f"CASE WHEN length({text}) > {size} THEN substr({text}, 1, {size}) || '...' ELSE {text} END"


VAR = X.VARIABLE
COUNT = len(TEMPLATES)

CTES: dict[str, str] = {}


def hits_cte(rules) -> str:
    items = []
    for n, r in enumerate(rules, 1):
        m = ex("text", r.pattern)
        if r.unless:
            m = f"CASE WHEN {rx('text', r.unless)} THEN '' ELSE {m} END"
        p = "0"
        if r.category in SAN_CATEGORIES:
            p = f"CASE WHEN {rx('text', r.pattern)} THEN {pos('text', r.pattern)} ELSE 0 END"
        items.append(f"{{o: {n}, m: {m}, pos: {p}}}")
    return (
        "SELECT project, path, line_no, text, h.o AS rule_ord, h.m AS match, h.pos AS pos FROM "
        f"(SELECT *, unnest([{', '.join(items)}]) AS h FROM scan) WHERE h.m <> ''"
    )


def rules_cte(rules, packs: bool = False) -> str:
    rows = ", ".join(
        f"({n}, {q(r.rule_id)}, {q(r.category)}, {r.severity}, {q(r.cwe)}, {q(r.description)}, "
        f"{q(r.recommendation)}, {q(r.source)}, {q(r.pack or '')}, {q(r.pattern)})"
        for n, r in enumerate(rules, 1)
    )
    return (
        f"SELECT * FROM (VALUES {rows}) AS t(rule_ord, rule_id, category, severity, cwe, "
        "description, recommendation, source, pack, pattern)"
    )


CTES["tmpl"] = (
    f"SELECT unnest(range(1, {COUNT + 1})) AS id, unnest([{', '.join(q(t) for t in TEMPLATES)}]) AS t"
)
CTES["cust"] = f"""
SELECT c_custkey AS k, c_nationkey AS nk,
       CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 1 + (c_custkey * 7) % ({COUNT} - 1) END AS st
FROM customer"""
CTES["code_text"] = f"""
SELECT k, nk, string_agg(replace(replace(t, '{{v}}', '$v' || ((k + i) % 5)), '{{w}}',
              '$v' || ((k + i * 2) % 5)), chr(10) ORDER BY i) AS body
FROM (SELECT *, unnest(range(1, 21 + k % 41)) AS i FROM cust)
JOIN tmpl ON tmpl.id = (k * 37 + i * st) % {COUNT} + 1 GROUP BY k, nk"""
CTES["code_files"] = """
SELECT project, project || '/' || folder || '/f' || k || ext AS path,
       CASE WHEN k % 10 = 4 THEN replace(body, chr(10), chr(13) || chr(10)) ELSE body END AS content
FROM (SELECT 'p' || nk AS project, k,
  CASE k % 20 WHEN 3 THEN 'vendor/lib' WHEN 7 THEN 'node_modules/m' WHEN 11 THEN 'tests'
       WHEN 13 THEN '.git/hooks' ELSE 'src/m' || (k % 4) END AS folder,
  CASE k % 12 WHEN 5 THEN '.PHTML' WHEN 6 THEN '.inc' WHEN 9 THEN '.js' WHEN 10 THEN '.module'
       ELSE '.php' END AS ext,
  body
  || CASE WHEN k % 50 = 9 THEN chr(10) || 'echo $v1; // ' || repeat('a', 5000) || ' phpinfo();' ELSE '' END
  || CASE WHEN k % 50 = 11 THEN chr(10) || '  $v2 = $_GET[''' || repeat('k', 300) || ''']; echo $v2;' ELSE '' END
  || CASE WHEN k % 500 = 17 THEN chr(10) || repeat('x', 1048576) ELSE '' END
  || CASE WHEN k % 3 = 0 THEN chr(10) ELSE '' END AS body
  FROM code_text)"""
CTES["all_files"] = """
SELECT project, path, content FROM code_files
UNION ALL SELECT 'documents', 'documents/' || doc_id || '.inc', text FROM documents
UNION ALL SELECT 'pages', 'pages/' || page_id || '.phtml', html FROM pages
UNION ALL SELECT 'conversations', 'conversations/' || conv_id || '-' || turn || '.inc', text FROM conversations
UNION ALL SELECT 'benchmark', 'benchmark/' || item_id || '.inc', text FROM benchmark"""
CTES["doc_rule"] = r"""
SELECT 'b' || k || '.json' AS file, 'ITEM' || k || '-' || p AS rule_id, p, kind,
  CASE WHEN kind = 5 THEN 'SQL Injection' ELSE 'Words ' || p % 2 END AS category,
  CASE p % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS severity,
  CASE kind WHEN 0 THEN '(?i)\b' || a || '\s+' || b || '\b' WHEN 1 THEN a || '[a-z]*[^a-z]+(' || b || '|' || c || ')'
    WHEN 2 THEN CASE WHEN k % 3 = 0 THEN '(?=' || b || ')' ELSE b || '(' END
    WHEN 3 THEN '(x' || c || ')?' || a || '{1,2} ' || b WHEN 4 THEN '\Q' || a || ' ' || b || '\E'
    WHEN 5 THEN '\$v' || k % 5 || '\s*=.*\$_(GET|POST)' ELSE '^[A-Z][0-9]{3}\b' END AS pattern,
  CASE kind WHEN 5 THEN '$_' WHEN 6 THEN '' WHEN 4 THEN lower(a || ' ' || b) WHEN 3 THEN lower(a) ELSE lower(a) END AS part
FROM (SELECT k, p, w[p + 1] AS a, w[p + 2] AS b, w[p + 3] AS c,
    CASE WHEN p = 3 AND k % 10 = 7 THEN 5 WHEN p = 4 AND k % 20 = 9 THEN 6 ELSE p % 5 END AS kind
  FROM (SELECT k, w, unnest(range(0, len(w) - 3)) AS p FROM (
    SELECT item_id AS k, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) >= 4))"""
_skipped = "(^|/)(" + "|".join(d.replace(".", "\\.") for d in X.SKIPPED_DIRS) + ")/"
_ext = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
CTES["files"] = f"""
SELECT * FROM all_files WHERE NOT {rx('path', _skipped)} AND {_ext} IN {in_list(X.SCANNED_EXTENSIONS)}"""
CTES["parts"] = "SELECT *, string_split(content, chr(10)) AS p FROM files WHERE content IS NOT NULL"
CTES["bad"] = """
SELECT DISTINCT project, path, content FROM
(SELECT project, path, content, unnest(p) AS t FROM parts) WHERE strlen(t) >= 1048576"""
CTES["lines"] = """
SELECT project, path, line_no::INTEGER AS line_no,
       CASE WHEN ends_with(t, chr(13)) THEN left(t, length(t) - 1) ELSE t END AS text
FROM (SELECT project, path, content, len(p) AS n, unnest(range(1, len(p) + 1)) AS line_no, unnest(p) AS t
      FROM parts)
WHERE NOT (line_no = n AND (content = '' OR ends_with(content, chr(10))))"""
CTES["scan"] = "SELECT project, path, line_no, text FROM lines"

# Comment state: constant or flipping functions of the state before.
_f0 = "(instr({0}, '/*') > 0 AND instr(substr({0}, instr({0}, '/*')), '*/') = 0)"
CTES["effects"] = f"""
SELECT *, {_f0.format('text')} AS f0,
  CASE WHEN instr(text, '*/') = 0 THEN true
       ELSE {_f0.format("substr(text, instr(text, '*/') + 2)")} END AS f1 FROM scan"""
CTES["flips"] = """
SELECT *, sum(CASE WHEN f0 AND NOT f1 THEN 1 ELSE 0 END) OVER w AS flips FROM effects
WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["last_const"] = """
SELECT *, last_value(CASE WHEN f0 = f1 THEN {v: f0, n: flips} END IGNORE NULLS) OVER w AS base,
  coalesce(lag(flips) OVER (PARTITION BY path ORDER BY line_no), 0) AS flips_before FROM flips
WINDOW w AS (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
CTES["mask"] = """
SELECT project, path, line_no, text,
  ((CASE WHEN base IS NULL THEN 0 ELSE base.v::INTEGER END
    + flips_before - CASE WHEN base IS NULL THEN 0 ELSE base.n END) % 2)::INTEGER AS st
FROM last_const"""
CTES["vis1"] = f"""
SELECT *, CASE WHEN st = 0 THEN s WHEN instr(s, '*/') > 0 THEN substr(s, instr(s, '*/') + 2) END AS r1
FROM (SELECT *, {trim('text')} AS s FROM mask)"""
CTES["vis2"] = f"""
SELECT *, coalesce({_f0.format('r1')}, false) AS opens,
  CASE WHEN {_f0.format('r1')} THEN substr(r1, 1, instr(r1, '/*') - 1) ELSE r1 END AS r2 FROM vis1"""
CTES["vis"] = f"""
SELECT project, path, line_no, text, st, CASE WHEN r1 IS NULL OR (st = 1 AND {trim('r1')} = '')
  OR (opens AND {trim('r2')} = '') OR starts_with(r2, '//') OR starts_with(r2, '#')
  THEN NULL ELSE r2 END AS visible FROM vis2"""

CTES["rules"] = rules_cte(RULES)
CTES["hits"] = hits_cte(RULES)
CTES["low_scan"] = "SELECT *, lower(text) AS low FROM scan"
CTES["doc_pair"] = """
SELECT l.project, l.path, l.line_no, l.text, l.low, r.* FROM low_scan l
JOIN (SELECT *, row_number() OVER (ORDER BY 'rules/' || file, p) AS rule_ord FROM doc_rule WHERE kind <> 2) r
  ON contains(l.low, r.part) WHERE r.severity >= 1"""
CTES["doc_hit"] = f"""
SELECT project, path, line_no, text, rule_ord, {{match}} AS match, {{pos}} AS pos,
  rule_id, category, severity, '' AS cwe, '' AS description, '' AS recommendation, 'yaml:' || file AS source, '' AS pack,
  pattern, {ex('match', VAR)} AS variable, low
FROM doc_pair WHERE regexp_matches(text, pattern)""".replace(
    "{match}", "regexp_extract(text, pattern)"
).replace("{pos}", "length(regexp_extract(text, '(?s)^(.*?)(?:' || pattern || ')', 1)) + 1")
CTES["hit_rules"] = f"""
SELECT h.*, r.* EXCLUDE (rule_ord), {ex('match', VAR)} AS variable, lower(text) AS low
FROM hits h JOIN rules r USING (rule_ord)"""

_exempt = {
    "prepare": f"(category = {q(X.PREPARE_CATEGORY)} AND contains(text, {q(X.PREPARE_CALL)}))",
    "echo": f"(rule_id = {q(X.ECHO_RULE)} AND {any_in('low', X.ECHO_ENCODERS)})",
    "credential": "((" + " OR ".join(f"starts_with(rule_id, {q(r)})" for r in X.CREDENTIAL_RULES)
    + ") AND (" + " OR ".join(f"ends_with(lower(variable), {q(s)})" for s in X.CREDENTIAL_SAFE_SUFFIXES) + "))",
    "safe": f"(rule_id IN {in_list(X.GENERIC_RULES)} AND {any_in('lower(variable)', X.SAFE_NAME_PARTS)})",
}
CTES["kept"] = f"""
SELECT h.*, v.visible FROM hit_rules h JOIN (SELECT path, line_no, visible FROM vis) v USING (path, line_no)
WHERE v.visible IS NOT NULL AND rule_id NOT IN {in_list(X.REPLACED_RULES)}
  AND NOT ({' OR '.join(_exempt.values())})"""
CTES["sant"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {q(c)}, {q(f)})" for n, (c, _, f) in enumerate(SANITIZERS, 1)
) + ") AS t(o, san_category, func)"
CTES["san_scan"] = (
    "SELECT path, line_no, s.o AS o, s.pos AS san_pos FROM (SELECT path, line_no, unnest(["
    + ", ".join(
        f"{{o: {n}, pos: CASE WHEN {rx('text', p)} THEN {pos('text', p)} END}}"
        for n, (_, p, _) in enumerate(SANITIZERS, 1)
    ) + "]) AS s FROM scan) WHERE s.pos IS NOT NULL"
)
CTES["san_full"] = (
    "SELECT path, line_no AS san_line, text AS san_text, s.o AS o FROM (SELECT path, line_no, text, unnest(["
    + ", ".join(f"{{o: {n}, y: {rx('text', p)}}}" for n, (_, p, _) in enumerate(SANITIZERS, 1))
    + "]) AS s FROM lines) WHERE s.y"
)
CTES["j2"] = """
SELECT k.path, k.line_no, k.rule_ord, arg_min(func, o) AS func2
FROM kept k JOIN san_scan s USING (path, line_no) JOIN sant t USING (o)
WHERE t.san_category = k.category AND s.san_pos <= k.pos GROUP BY ALL"""
CTES["j3"] = """
SELECT k.path, k.line_no, k.rule_ord,
  arg_min(func, san_line * 1000 + CASE WHEN t.san_category = k.category THEN 0 ELSE 500 END + o) AS func3
FROM kept k JOIN san_full s ON s.path = k.path AND s.san_line BETWEEN k.line_no - 5 AND k.line_no - 1
JOIN sant t USING (o)
WHERE k.variable <> '' AND contains(s.san_text, k.variable) AND contains(s.san_text, '=') GROUP BY ALL"""
CTES["j4"] = """
SELECT k.path, k.line_no, k.rule_ord, arg_min(func, san_line * 1000 + o) AS func4
FROM kept k JOIN san_full s ON s.path = k.path AND s.san_line < k.line_no JOIN sant t USING (o)
WHERE k.variable <> '' AND t.san_category = k.category AND contains(s.san_text, k.variable) GROUP BY ALL"""
CTES["near"] = """
SELECT k.*, coalesce(func2, func3 || ' (context)') AS near_func, func4
FROM kept k LEFT JOIN j2 USING (path, line_no, rule_ord) LEFT JOIN j3 USING (path, line_no, rule_ord)
LEFT JOIN j4 USING (path, line_no, rule_ord)"""


def comment_sql(text: str, low: str) -> str:
    marks = [
        f"WHEN contains({low}, {q(m)}) THEN {trim(f'substr({text}, instr({low}, {q(m)}))')}"
        for m in X.SUPPRESS_MARKS
    ]
    return (
        "CASE " + " ".join(marks)
        + f" WHEN {any_in(low, X.SUPPRESS_TAGS)} THEN {q(X.SUPPRESS_TAG_LABEL)} END"
    )


CTES["judged"] = f"""
SELECT project, path, line_no, rule_ord, rule_id, category, severity, cwe, description, recommendation,
  source,
  CASE WHEN near_func IS NOT NULL THEN 0 WHEN {any_in('low', X.HIGH_CONFIDENCE_WORDS)} THEN 2
       WHEN rule_id IN {in_list(X.GENERIC_RULES)} THEN 0 WHEN severity >= 3 THEN 1 ELSE 0 END AS confidence,
  {clip('visible', 200)} AS line_text, match AS match_text,
  coalesce(comment IS NOT NULL AND (contains(lower(comment), lower(rule_id)) OR NOT contains(comment, '-')), false)
    AS suppressed,
  coalesce(comment, '') AS suppressed_by,
  coalesce(near_func, func4) IS NOT NULL AS sanitized,
  coalesce(near_func, func4 || ' (file-level)', '') AS sanitizer_func
FROM (SELECT *, {comment_sql('text', 'low')} AS comment FROM near)
WHERE NOT (near_func IS NOT NULL AND rule_id IN {in_list(X.DROP_WHEN_SANITIZED)})"""
_ctx = clip("text", 200)
CTES["context"] = f"""
SELECT path, line_no, concat_ws(chr(10), lag(c, 3) OVER w, lag(c, 2) OVER w, lag(c) OVER w) AS before_text,
  concat_ws(chr(10), lead(c) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w) AS after_text,
  concat_ws(chr(10), lag(t, 3) OVER w, lag(t, 2) OVER w, lag(t) OVER w) AS before_plain,
  concat_ws(chr(10), lead(t) OVER w, lead(t, 2) OVER w, lead(t, 3) OVER w) AS after_plain,
  least(line_no - 1, 3) AS n_before, least(count(*) OVER (PARTITION BY path) - line_no, 3) AS n_after
FROM (SELECT path, line_no, {_ctx} AS t, line_no || ':' || {_ctx} AS c FROM lines)
WINDOW w AS (PARTITION BY path ORDER BY line_no)"""

# Detectors.
CTES["d1"] = f"""
SELECT c.path, c.line_no, min(u.line_no) AS use_line, c.v FROM
  (SELECT path, line_no, {ex('text', ML.FILE_CHECK, 1)} AS v FROM lines) c
JOIN (SELECT * FROM lines WHERE {rx('text', ML.FILE_OPERATION)}) u
  ON u.path = c.path AND u.line_no BETWEEN c.line_no + 1 AND c.line_no + 3 AND contains(u.text, c.v)
WHERE c.v <> '' GROUP BY ALL"""
def forms_sql(reach: str) -> str:
    """Lines after a POST form are read in order: a token protects it, a data change counts, its end is the last one read."""
    return f"""
SELECT path, line_no, CASE WHEN bool_or(w) THEN 'CSRF-002' ELSE 'CSRF-003' END AS rule_id
FROM (SELECT f.path, f.line_no, coalesce({rx('l.text', ML.TOKEN_WORD)}, false) AS t,
        coalesce({rx('l.text', ML.STATE_CHANGE)}, false) AS w,
        coalesce(bool_or({rx('l.text', ML.FORM_END)}) OVER (PARTITION BY f.path, f.line_no ORDER BY l.line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after_end
      FROM (SELECT path, line_no FROM lines WHERE {rx('text', ML.POST_FORM)}) f
      LEFT JOIN lines l ON l.path = f.path AND l.line_no > f.line_no {reach})
WHERE NOT after_end GROUP BY path, line_no HAVING NOT bool_or(t)"""


CTES["d2"] = forms_sql("")
CTES["d2_whole"] = forms_sql("")
CTES["d3"] = f"""
SELECT path, min(line_no) FILTER (WHERE u) AS line_no, count(*) FILTER (WHERE u) AS n FROM
(SELECT path, line_no, {rx('text', ML.SESSION_UNSET)} AS u, {rx('text', ML.SESSION_DESTROY)} AS d FROM lines)
GROUP BY path HAVING bool_or(u) AND NOT bool_or(d)"""
CTES["d4"] = (
    "SELECT path, 1 AS line_no, unnest([" + ", ".join(
        f"CASE WHEN NOT h{n} THEN {q(r)} END" for n, (r, *_) in enumerate(ML.HEADERS)
    ) + f"]) AS rule_id FROM (SELECT path, bool_or({rx('text', ML.PAGE_OUTPUT)}) AS o, "
    + ", ".join(f"bool_or({rx('text', p)}) AS h{n}" for n, (*_, p) in enumerate(ML.HEADERS))
    + " FROM lines GROUP BY path) WHERE o"
)
_b, _rest = ML.CHECK_MATCH.split("{var}")
_m, _a = _rest.split("{line}")
CTES["detected"] = f"""
SELECT path, line_no, 'RACE-001' AS rule_id, 3 AS pass_ord,
  {q(_b)} || v || {q(_m)} || use_line || {q(_a)} AS match_text,
  'Existence of ' || v || ' is checked on line ' || line_no || ' and the file is used on line ' || use_line AS description
FROM d1
UNION ALL SELECT path, line_no, rule_id, 4, CASE rule_id WHEN 'CSRF-002' THEN {q(ML.FORM_WRITE_MATCH)}
  ELSE {q(ML.FORM_MATCH)} END, NULL FROM d2
UNION ALL SELECT path, line_no, 'SESSION-003', 5, {q(ML.LOGOUT_MATCH)},
  'Session is left alive after ' || n || ' unset call(s) on session entries' FROM d3
UNION ALL SELECT path, line_no, rule_id, 6, CASE rule_id """ + " ".join(
    f"WHEN {q(r)} THEN {q(ML.HEADER_MATCH.format(header=h))}" for r, h, *_ in ML.HEADERS
) + " END, NULL FROM d4 WHERE rule_id IS NOT NULL"
CTES["drules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({q(r.rule_id)}, {q(r.category)}, {r.severity}, {q(r.cwe)}, {q(r.description)}, "
    f"{q(r.recommendation)}, {c})" for r, c in DETECTOR_RULES
) + ") AS t(rule_id, category, severity, cwe, d_description, recommendation, confidence)"

# Data flow.
_clean_names = list(dict.fromkeys(n.lower() for v in V.FLOW_SANITIZERS.values() for n in v))
_sinks = []
for _n, (_f, _c, _, _) in enumerate(V.SINKS):
    _cond = f"contains(low, {q(_f.lower())})"
    if _f == "header":
        _cond += f" AND {rx('text', V.HEADER_CALL)}"
    if _c == "File Inclusion":
        _cond += f" AND {rx('text', V.INCLUDE_CALL)} AND NOT {rx('text', V.OUTPUT_STRING)}"
    _cond += f" AND NOT {any_in('low', [n.lower() for n in V.FLOW_SANITIZERS[_c]])}"
    _sinks.append(f"CASE WHEN {_cond} THEN {_n} END")
CTES["facts0"] = f"""
SELECT *, lower(text) AS low, {ex('text', V.ASSIGNMENT, 1)} AS target, {ex('text', V.ASSIGNMENT, 2)} AS rest,
  {ex('text', V.DB_FETCH, 1)} AS fetch_var
FROM lines WHERE contains(text, '$') AND NOT {rx(trim('text'), '^(//|#|/[*])')}"""
CTES["facts1"] = f"""
SELECT path, line_no, text, target, regexp_extract_all(rest, {q(VAR)}) AS rest_vars,
  coalesce({', '.join(f"nullif({ex('rest', p)}, '')" for p in V.SOURCES)}, '') AS src_key, fetch_var,
  CASE WHEN fetch_var = '' THEN {ex('text', V.ROW_COLUMN, 1)} ELSE '' END AS row_to,
  CASE WHEN fetch_var = '' THEN {ex('text', V.ROW_COLUMN, 2)} ELSE '' END AS row_from,
  target <> '' AND {any_in('lower(rest)', _clean_names)} AS cleans,
  list_filter([{', '.join(_sinks)}], lambda x: x IS NOT NULL) AS sinks,
  regexp_extract_all(text, {q(VAR)}) AS line_vars FROM facts0"""
CTES["facts"] = "SELECT * FROM facts1 WHERE target <> '' OR fetch_var <> '' OR len(sinks) > 0"
CTES["facts_n"] = "SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS rn FROM facts"
_info = "{{v: {v}, k: {k}, l: {l}, s: {s}, p: {p}}}"
_put = "map_concat({m}, map([{key}], [{val}]))"


def _moved(state: str, ref: str, to: str) -> str:
    return _put.format(m=state, key=to, val=_info.format(
        v=f"{state}[{ref}].v", k=f"{state}[{ref}].k", l=f"{state}[{ref}].l", s="false",
        p=f"{state}[{ref}].p || '|' || line_no || ':assignment:' || {to}"))


_new = lambda state, var, key: _put.format(m=state, key=var, val=_info.format(
    v=var, k=key, l="line_no", s="false", p=f"line_no || ':source:' || {var}"))
CTES["RECURSIVE fold"] = f"""
SELECT path, 0::BIGINT AS rn,
  MAP {{}}::MAP(VARCHAR, STRUCT(v VARCHAR, k VARCHAR, l INTEGER, s BOOLEAN, p VARCHAR)) AS st
FROM (SELECT DISTINCT path FROM facts_n)
UNION ALL
SELECT path, rn, CASE WHEN cleans AND r5 IS NOT NULL THEN {_put.format(m='s3', key='target', val=_info.format(
    v='s3[r5].v', k='s3[r5].k', l='s3[r5].l', s='true', p='s3[r5].p'))} ELSE s3 END
FROM (SELECT *, list_filter(rest_vars, lambda x: s3[x] IS NOT NULL)[1] AS r5
FROM (SELECT *, CASE WHEN target <> '' AND r4 IS NOT NULL AND (s2[target] IS NULL OR s2[target].l <> line_no)
    THEN {_moved('s2', 'r4', 'target')} ELSE s2 END AS s3
FROM (SELECT *, list_filter(rest_vars, lambda x: s2[x] IS NOT NULL AND NOT s2[x].s)[1] AS r4
FROM (SELECT *, CASE WHEN fetch_var <> '' THEN {_new('s1', 'fetch_var', q(V.DB_FETCH_KEY))}
    WHEN row_to <> '' AND s1[row_from] IS NOT NULL THEN {_moved('s1', 'row_from', 'row_to')} ELSE s1 END AS s2
FROM (SELECT f.*, CASE WHEN src_key <> '' THEN {_new('fold.st', 'target', 'src_key')} ELSE fold.st END AS s1
FROM fold JOIN facts_n f ON f.path = fold.path AND f.rn = fold.rn + 1)))))"""
_xss = ", ".join(str(n) for n, s in enumerate(V.SINKS) if s[1] == "Cross-Site Scripting")
CTES["flow_rows"] = """
SELECT path, line_no, text, st, sink, unnest(range(1, len(line_vars) + 1)) AS vo, unnest(line_vars) AS variable
FROM (SELECT f.path, f.line_no, f.text, fold.st, f.line_vars, unnest(f.sinks) AS sink
      FROM fold JOIN facts_n f ON f.path = fold.path AND f.rn = fold.rn)"""
CTES["flows"] = f"""
SELECT path, line_no, text, sink, vo, variable, st[variable].v AS src_var, st[variable].k AS src_key,
  st[variable].l AS src_line, st[variable].p || '|' || line_no || ':sink:' || variable AS steps
FROM flow_rows WHERE st[variable] IS NOT NULL AND NOT st[variable].s
  AND NOT (st[variable].k = {q(V.DB_FETCH_KEY)} AND sink NOT IN ({_xss}))"""
CTES["srules"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {q(V.SINKS[n][0])}, {q(r.rule_id)}, {q(r.category)}, {r.severity}, {q(r.cwe)})"
    for n, r in enumerate(SINK_RULES)
) + ") AS t(sink, function, rule_id, category, severity, cwe)"
CTES["taint_found"] = f"""
SELECT f.*, r.*, src_var || ' -> ' || function || '()' AS match_text, {trim('text')} AS line_text,
  'Untrusted data: ' || src_var || ' set from ' || src_key || ' (line ' || src_line || ') reaches '
    || function || '() (line ' || line_no || ')' AS description,
  'Clean ' || src_var || ' before it reaches ' || function || '()' AS recommendation,
  sink * 1000000 + vo AS emit_ord
FROM flows f JOIN srules r USING (sink)"""

# Union, de-duplication.
CTES["project_of"] = "SELECT DISTINCT project, path FROM files"
CTES["united"] = f"""
SELECT project, path, line_no, rule_id, category, severity, cwe, description, recommendation, source,
  confidence, line_text, match_text, suppressed, suppressed_by, sanitized, sanitizer_func,
  false AS is_taint, 1 AS pass_ord, rule_ord AS emit_ord, '' AS steps FROM judged
UNION ALL
SELECT p.project, t.path, line_no, rule_id, category, severity, cwe, description, recommendation,
  'taint-analysis', 2, line_text, match_text, false, '', false, '', true, 2, emit_ord, steps
FROM taint_found t JOIN project_of p USING (path)
UNION ALL
SELECT p.project, d.path, d.line_no, d.rule_id, category, severity, cwe,
  coalesce(d.description, d_description), recommendation, 'builtin', confidence,
  CASE WHEN pass_ord = 6 THEN {q(ML.FILE_LEVEL_TEXT)} ELSE {trim('l.text')} END,
  match_text, false, '', false, '', false, pass_ord, 0, ''
FROM detected d JOIN drules USING (rule_id) JOIN project_of p ON p.path = d.path
LEFT JOIN lines l ON l.path = d.path AND l.line_no = d.line_no"""
CTES["ranked"] = """
SELECT *, row_number() OVER (PARTITION BY path, line_no, category
    ORDER BY confidence DESC, is_taint DESC, severity DESC, pass_ord, emit_ord) AS place,
  bool_or(suppressed) OVER g AS any_suppressed,
  max(CASE WHEN suppressed THEN suppressed_by END) OVER g AS any_by
FROM united WINDOW g AS (PARTITION BY path, line_no, category)"""
CTES["final"] = """
SELECT * EXCLUDE (suppressed, suppressed_by, place, any_suppressed, any_by), any_suppressed AS suppressed,
  coalesce(any_by, suppressed_by) AS suppressed_by FROM ranked WHERE place = 1"""
CTES["shown"] = "SELECT * FROM final WHERE NOT suppressed"

# Projects, configuration, custom rules.
CTES["manifests"] = """
SELECT 'p' || n_nationkey AS project, n_nationkey % 6 AS kind FROM nation"""
CTES["frameworks"] = """
SELECT project, CASE kind WHEN 0 THEN 'laravel' WHEN 1 THEN 'wordpress' WHEN 2 THEN 'symfony'
    WHEN 3 THEN 'codeigniter' ELSE 'laravel' END AS name,
  CASE kind WHEN 0 THEN '^10.0' WHEN 1 THEN '' WHEN 2 THEN '6.*' WHEN 3 THEN '4.1' ELSE '^9' END AS version
FROM manifests WHERE kind < 5"""
CTES["scan_cfg"] = """
SELECT 'p' || n_nationkey AS project, '' AS cfg_dir, CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS least,
  'XSS-004' AS off, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 5 ELSE 3 END AS ctx, false AS shows
FROM nation WHERE n_nationkey % 3 <> 1
UNION ALL SELECT 'p' || n_nationkey, 'src', 1, 'INFO-007', 3, false FROM nation WHERE n_nationkey % 5 = 2
UNION ALL SELECT 'p' || n_nationkey, 'src/m1', 4, 'SQL-005', 3, true FROM nation WHERE n_nationkey % 2 = 0"""
CTES["file_cfg"] = """
SELECT f.project, f.path, f.n_lines, substr(f.path, length(f.project) + 2) AS rel, max(c.cfg_dir) AS cfg_dir
FROM (SELECT project, path, count(*) AS n_lines FROM lines GROUP BY ALL) f LEFT JOIN scan_cfg c ON c.project = f.project
  AND (c.cfg_dir = '' OR starts_with(f.path, f.project || '/' || c.cfg_dir || '/')) GROUP BY ALL"""
CTES["configured"] = """
SELECT f.*, coalesce(least, 1) AS least, coalesce(off, '') AS off, coalesce(ctx, 3) AS ctx, coalesce(shows, false) AS shows
FROM file_cfg f LEFT JOIN scan_cfg c ON c.project = f.project AND c.cfg_dir = f.cfg_dir
WHERE NOT coalesce((f.cfg_dir = 'src' AND (contains(rel, 'src/m2/') OR contains(rel, '.module')
    OR regexp_matches(rel, '(^|/)[^/a-f][^/][.]php$') OR contains(rel, '[^a-f]?.php')))
  OR (f.cfg_dir = 'src/m1' AND (regexp_matches(rel, '(^|/)f1[^/]*$') OR contains(rel, 'f1'))), false)"""
CTES["every_rule"] = rules_cte(EVERY_RULE)
CTES["applied"] = """
SELECT p.project, r.* FROM (SELECT DISTINCT project FROM all_files) p
LEFT JOIN frameworks f USING (project) JOIN every_rule r ON r.pack = '' OR r.pack = f.name"""
CTES["every_hit"] = hits_cte(EVERY_RULE)
_sev_case = "CASE lower(trim({0})) " + " ".join(
    f"WHEN {q(n)} THEN {r}" for n, r in SEVERITY_BY_NAME.items()) + " ELSE 1 END"
CTES["targets"] = "SELECT DISTINCT project, regexp_replace(path, '/[^/]*$', '') AS dir FROM all_files"
CTES["configs"] = """
SELECT 'p' || n_nationkey AS project, 'p' || n_nationkey AS config_dir, 0 AS depth, n_nationkey AS n
FROM nation WHERE n_nationkey % 3 <> 1
UNION ALL SELECT 'p' || n_nationkey, 'p' || n_nationkey || '/src', 1, n_nationkey FROM nation WHERE n_nationkey % 2 = 0"""
CTES["nearest"] = """
SELECT t.project, t.dir, arg_max(c.config_dir, depth) AS config_dir, max(depth) AS depth, any_value(n) AS n
FROM targets t LEFT JOIN configs c ON c.project = t.project AND (t.dir = c.config_dir OR starts_with(t.dir, c.config_dir || '/'))
GROUP BY ALL"""


def with_ctes(body: str, instead: dict[str, str] | None = None) -> str:
    """``body`` preceded by the named queries it uses, in order of definition; some may be replaced."""
    if instead:
        own = CTES.copy()
        try:
            CTES.update(instead)
            return with_ctes(body)
        finally:
            CTES.clear()
            CTES.update(own)
    names = {key.split()[-1]: key for key in CTES}
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in needed and re.search(rf"(?<![\w.']){name}(?![\w'(])", text):
                needed.add(name)
                todo.append(CTES[names[name]])
    picked = [key for key in CTES if key.split()[-1] in needed]
    recursive = "RECURSIVE " if any(key.startswith("RECURSIVE") for key in picked) else ""
    parts = [
        f"{key.split()[-1]} AS {'' if key.startswith('RECURSIVE') else 'MATERIALIZED '}({CTES[key]})"
        for key in picked
    ]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body if parts else body


def _label(column: str, names) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {n} THEN {q(t)}" for n, t in enumerate(names)) + " END"


_SEV = _label("severity", SEVERITY_LABELS)
_CONF = _label("confidence", ["LOW", "MEDIUM", "HIGH"])
_FP = "left(sha256(concat_ws(':', rule_id, path, line_no, match_text)), 16)"
_number = "try_cast(regexp_extract(path, '(\\d+)[.][a-zA-Z]+$', 1) AS BIGINT)"
_OLD = f"""(SELECT project, path, {_FP} AS fingerprint FROM (SELECT project, rule_id, path, match_text,
  CASE WHEN line_no % 7 = 0 THEN line_no + 1000 ELSE line_no END AS line_no FROM judged
  WHERE try_cast(regexp_extract(path, '/f(\\d+)\\.', 1) AS BIGINT) % 2 = 0))"""
_FREE = "left(sha256(concat_ws(':', rule_id, path, match_text)), 16)"
_MOVED = f"""SELECT * FROM (WITH now AS (SELECT project, path, line_no, rule_id, {_FP} AS fp, {_FREE} AS moving FROM judged),
old AS (SELECT project, {_FP} AS fp, {_FREE} AS moving FROM (SELECT project, rule_id, path, match_text,
  CASE WHEN line_no % 7 = 0 THEN line_no + 1000 ELSE line_no END AS line_no FROM judged WHERE line_no % 5 <> 0
  AND try_cast(regexp_extract(path, '/f(\\d+)\\.', 1) AS BIGINT) % 2 = 0)),
stay AS (SELECT *, (project, fp) IN (SELECT (project, fp) FROM old) AS same FROM now)
SELECT project, path, line_no, rule_id, moving FROM stay AS s
WHERE (SELECT count(*) FROM old AS o WHERE o.project = s.project AND o.moving = s.moving)
  <= (SELECT count(*) FROM stay AS t WHERE t.project = s.project AND t.moving = s.moving
      AND (t.same > s.same OR (t.same = s.same AND t.line_no < s.line_no))))"""
_LOG = f"""SELECT project, path, sha256(CASE WHEN n % 5 <> 0 AND n % 3 = 0 AND n % 7 = 0 THEN content || chr(10) || '// older'
  ELSE content END) AS sha256, CAST(CASE WHEN n % 3 = 0 OR n % 5 = 0 OR n % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, n
  FROM (SELECT *, coalesce({_number}, 0) AS n FROM files)"""
_CHANGED = f"""SELECT project, path, sha256(content) AS sha256 FROM files
WHERE coalesce({_number}, 0) % 5 = 0 OR coalesce({_number}, 0) % 7 = 0"""


def _exempt_sql(name: str) -> str:
    return f"SELECT path, line_no, rule_id, variable FROM hit_rules WHERE {_exempt[name]}"


def _steps_json() -> str:
    """Steps text to a list of structs, with the code of each line."""
    return """(SELECT s.path, s.line_no, s.rule_id, s.match_text, s.emit_ord,
  list({file: s.path, line: l.line_no, code: """ + clip("l.code", 120) + """,
        operation: s.op, variable: s.va} ORDER BY s.o) AS flow_steps
FROM (SELECT path, line_no, rule_id, match_text, emit_ord, o, split_part(x, ':', 1)::INTEGER AS sl,
        split_part(x, ':', 2) AS op, split_part(x, ':', 3) AS va
      FROM (SELECT path, line_no, rule_id, match_text, emit_ord,
              unnest(range(1, len(string_split(steps, '|')) + 1)) AS o, unnest(string_split(steps, '|')) AS x
            FROM final WHERE is_taint)) s
JOIN (SELECT path, line_no, """ + trim("text") + """ AS code FROM lines) l ON l.path = s.path AND l.line_no = s.sl
GROUP BY ALL)"""


def _json_body() -> str:
    return f"""
SELECT project, f.path, f.line_no, json_merge_patch('{{}}', to_json({{
  rule_id: f.rule_id, category: category, severity: {_SEV}, confidence: {_CONF}, file: f.path,
  line: f.line_no, code: line_text, match: {clip('f.match_text', 100)}, description: description,
  recommendation: recommendation, cwe: cwe, sanitized: CASE WHEN sanitized THEN true END,
  sanitizer_func: nullif(sanitizer_func, ''), source: nullif(source, ''), flow_steps: t.flow_steps,
  is_taint_flow: CASE WHEN is_taint THEN true END}}))::VARCHAR AS finding
FROM final f LEFT JOIN {_steps_json()} t
  ON f.is_taint AND t.path = f.path AND t.line_no = f.line_no AND t.rule_id = f.rule_id
WHERE NOT suppressed"""


def _sarif_body(more: str = "") -> str:
    level = _label("severity", SARIF_LEVELS)
    return f"""
SELECT project, f.path, f.line_no, {more} json_merge_patch('{{}}', to_json({{
  ruleId: f.rule_id, level: {level},
  message: {{text: description || ' [' || cwe || '] ' || recommendation}},
  locations: [json_merge_patch('{{}}', to_json({{physicalLocation: {{
    artifactLocation: {{uri: f.path}},
    region: {{startLine: f.line_no, snippet: {{text: line_text}}}},
    contextRegion: CASE WHEN pass_ord <> 6 AND n_before + n_after > 0 THEN {{
      startLine: greatest(f.line_no - n_before, 1), endLine: f.line_no + n_after,
      snippet: {{text: CASE WHEN n_before > 0 THEN before_plain || chr(10) ELSE '' END || line_text
                      || CASE WHEN n_after > 0 THEN chr(10) || after_plain ELSE '' END}}}} END}}}}))],
  codeFlows: CASE WHEN t.flow_steps IS NOT NULL THEN [{{threadFlows: [{{locations: list_transform(t.flow_steps,
    lambda s: {{location: {{physicalLocation: {{artifactLocation: {{uri: s.file}},
      region: {{startLine: s.line, snippet: {{text: s.code}}}}}}}},
      message: {{text: '[' || upper(s.operation) || '] ' || s.variable}}}})}}]}}] END,
  properties: {{confidence: {_CONF}, cwe: cwe}}}}))::VARCHAR AS result
FROM final f LEFT JOIN context c ON c.path = f.path AND c.line_no = f.line_no
LEFT JOIN {_steps_json()} t
  ON f.is_taint AND t.path = f.path AND t.line_no = f.line_no AND t.rule_id = f.rule_id"""


def _sarif_rules(more: str = "") -> str:
    level = _label("severity", SARIF_LEVELS)
    return f"""
SELECT project, rule_id, {more} to_json({{
  id: rule_id, name: rule_id, shortDescription: {{text: description}}, fullDescription: {{text: recommendation}},
  help: {{text: description || chr(10) || chr(10) || 'CWE: ' || cwe || chr(10) || 'Recommendation: ' || recommendation}},
  defaultConfiguration: {{level: {level}}}, properties: {{tags: [category, cwe, 'security', 'php']}}}})::VARCHAR AS rule
FROM (SELECT *, row_number() OVER (PARTITION BY project, rule_id
        ORDER BY severity DESC, confidence DESC, path, line_no, category) AS nth FROM final)
WHERE nth = 1"""


def _sarif_parts() -> str:
    place = "o_severity, o_confidence, path, line_no, category, rule_id"

    def items(section: int, column: str, body: str) -> str:
        return f"""SELECT project, {section} AS section, {place},
  CASE WHEN row_number() OVER (PARTITION BY project ORDER BY {place}) = 1 THEN '' ELSE ',' END || {column} AS text
FROM ({body})"""

    def fixed(section: int, text: str) -> str:
        return (f"SELECT DISTINCT project, {section} AS section, 0 AS o_severity, 0 AS o_confidence, '' AS path, "
                f"0 AS line_no, '' AS category, '' AS rule_id, {q(text)} AS text FROM final")

    head = (
        f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":{{'
        f'"name":"{TOOL_NAME}","version":"{TOOL_VERSION}","rules":['
    )
    sort_keys = "-severity AS o_severity, -confidence AS o_confidence,"
    return " UNION ALL ".join([
        fixed(0, head),
        items(1, "rule", _sarif_rules(f"{sort_keys} path, line_no, category,")),
        fixed(2, ']}},"results":['),
        items(3, "result", _sarif_body(f"{sort_keys} category, f.rule_id,")),
        fixed(4, '],"invocations":[{"executionSuccessful":true}]}]}'),
    ])


def _convert_sql() -> str:
    escaped = "regexp_replace(trim(pattern), '([()\\[\\]{}+.|^?*])', '\\\\\\1', 'g')"
    metas = f"regexp_replace({escaped}, '\\$[A-Z][A-Z0-9_]*', '[^\\\\s;]+', 'g')"
    open_ended = f"replace({metas}, '\\.\\.\\.', '.*')"
    spaced = f"regexp_replace({open_ended}, '\\s+', '\\\\s+', 'g')"
    return f"""
SELECT CASE WHEN k % 4 = 0 THEN printf('SEMGREP-%03d', k + 1) ELSE 'ext-' || k END AS id,
  CASE WHEN k % 3 = 1 THEN p_type ELSE 'Semgrep Import' END AS category,
  CASE k % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
  '(?i)' || {spaced} AS pattern, p_name AS description,
  CASE WHEN k % 2 = 0 THEN 'CWE-5' ELSE 'CWE-Unknown' END AS cwe,
  'semgrep:' || p_brand || '.yaml' AS source
FROM (SELECT p_partkey AS k, *, CASE p_partkey % 6 WHEN 0 THEN 'f($X, ...,  $VAR_1[' || p_name || '])'
    WHEN 1 THEN 'a(...)+b(...){{ ... }}' WHEN 2 THEN '' WHEN 3 THEN '  $lower->query($SQL . $id) ^ c|d? '
    WHEN 4 THEN 'eval(...); ' || p_brand ELSE '$A = $B...$C' END AS pattern FROM part)
WHERE k % 5 <> 0 AND pattern <> ''"""


def _excluded(patterns) -> str:
    conds = []
    for p in patterns:
        r = glob_to_regex(p)
        conds += [rx("path", r), rx("regexp_extract(path, '[^/]*$')", r)]
        conds.append(f"contains(path, {q(p.removesuffix('*').removeprefix('*'))})")
    return "(" + " OR ".join(conds) + ")"


def all_sql() -> dict[str, str]:
    from checks.queries import EXCLUDES

    high = select_rules(builtin_rules(), DEFAULTS.but(min_severity=HIGH))
    few = select_rules(
        builtin_rules(), DEFAULTS.but(disabled_rules=("xss-004", " SQL-005 ", "info-007")))
    counted = lambda rules: (
        f"SELECT rule_id, count(*) AS n FROM ({hits_cte(rules)}) JOIN ({rules_cte(rules)}) "
        "USING (rule_ord) GROUP BY ALL"
    )
    detected = lambda n: (
        f"SELECT path, line_no, rule_id, match_text FROM detected WHERE pass_ord = {n}"
    )
    detected_whole = f"""SELECT path, line_no, rule_id, CASE rule_id WHEN 'CSRF-002' THEN {q(ML.FORM_WRITE_MATCH)}
        ELSE {q(ML.FORM_MATCH)} END AS match_text FROM d2_whole"""
    judged = lambda cols, cond="true": f"SELECT {cols} FROM judged WHERE {cond}"
    func = "sanitizer_func"
    bodies = {
        "lines_split": "SELECT project, path, line_no, length(text) AS n_chars, md5(text) AS text_md5 FROM lines",
        "rejected_files": "SELECT project, path, strlen(content) AS size_bytes FROM bad",
        "file_overview": f"""SELECT project, path, {_ext} AS ext, strlen(content) AS size_bytes,
            strlen(content) > 10485760 AS is_large, sha256(content) AS sha256 FROM all_files""",
        "comment_mask": "SELECT path, line_no, st AS in_comment FROM mask",
        "comment_skip": "SELECT path, line_no, visible IS NULL AS skipped, md5(coalesce(visible, '')) AS visible_md5 FROM vis",
        "suppression_mark": f"""SELECT * FROM (SELECT path, line_no,
            {comment_sql('text', 'lower(text)')} AS comment FROM scan) WHERE comment IS NOT NULL""",
        "rule_severity_filter": counted(high),
        "rule_disable": counted(few),
        "rule_match": f"""SELECT path, line_no, rule_id, md5(match) AS match_md5,
            {clip('match', 100)} AS match_text FROM hit_rules""",
        "rule_match_pos": """SELECT path, line_no, rule_id, pos FROM hit_rules
            WHERE pos > 0""",
        "first_variable": "SELECT path, line_no, rule_id, variable FROM hit_rules",
        "exempt_prepare": _exempt_sql("prepare"),
        "exempt_echo_wrap": _exempt_sql("echo"),
        "exempt_credential_name": _exempt_sql("credential"),
        "exempt_safe_var": _exempt_sql("safe"),
        "rule_suppression": judged("path, line_no, rule_id, suppressed, suppressed_by", "suppressed_by <> ''"),
        "confidence_score": judged("path, line_no, rule_id, confidence, sanitized"),
        "san_same_line": judged(f"path, line_no, rule_id, {func}",
            f"{func} <> '' AND NOT ends_with({func}, ' (context)') AND NOT ends_with({func}, ' (file-level)')"),
        "san_lookback": judged(f"path, line_no, rule_id, {func}", f"ends_with({func}, ' (context)')"),
        "san_file_level": judged(f"path, line_no, rule_id, {func}", f"ends_with({func}, ' (file-level)')"),
        "context_lines": """SELECT path, line_no, rule_id, line_text, match_text, before_text, after_text
            FROM judged JOIN context USING (path, line_no)""",
        "toctou": detected(3), "csrf_form": detected(4), "csrf_form_whole": detected_whole, "insecure_logout": detected(5),
        "missing_headers": detected(6),
        "taint_facts": """SELECT path, line_no, target, array_to_string(rest_vars, ',') AS rest_vars, src_key,
            fetch_var, row_to, row_from, cleans, array_to_string(sinks, ',') AS sinks,
            array_to_string(line_vars, ',') AS line_vars FROM facts""",
        "taint_sources": """SELECT src_key, fetch_var <> '' AS is_fetch, count(*) AS n FROM facts
            WHERE src_key <> '' OR fetch_var <> '' GROUP BY ALL""",
        "taint_flows": "SELECT path, line_no, sink, variable, src_var, src_key, src_line, steps FROM flows",
        "taint_edges": """SELECT DISTINCT path, split_part(s, ':', 1)::INTEGER AS line_no, split_part(s, ':', 2) AS operation,
            split_part(s, ':', 3) AS variable, coalesce(nullif(split_part(b, ':', 1), ''), '0')::INTEGER AS previous_line,
            split_part(b, ':', 3) AS previous_variable
            FROM (SELECT path, unnest(p) AS s, unnest(list_prepend('', p)) AS b
              FROM (SELECT path, string_split(steps, '|') AS p FROM flows))
            WHERE s IS NOT NULL AND split_part(s, ':', 2) <> 'sink'""",
        "taint_findings": """SELECT path, line_no, rule_id, category, severity, cwe, match_text, line_text
            FROM taint_found""",
        "dedup_findings": """SELECT project, path, line_no, category, rule_id, severity, confidence, is_taint,
            suppressed, suppressed_by, sanitized, sanitizer_func, line_text, match_text FROM final""",
        "active_findings": "SELECT rule_id, source, count(*) AS n FROM shown GROUP BY ALL",
        "sev_counts": f"SELECT {_SEV} AS severity, count(*) AS n FROM shown GROUP BY 1",
        "cat_counts": "SELECT category, count(*) AS n FROM shown GROUP BY 1 ORDER BY n DESC, category",
        "conf_counts": f"SELECT {_CONF} AS confidence, count(*) AS n FROM shown GROUP BY 1",
        "scan_totals": """SELECT * REPLACE (coalesce(suppressed, 0) AS suppressed, coalesce(active, 0) AS active)
            FROM (SELECT project, count(DISTINCT path) AS files_scanned, count(*) AS total_lines
            FROM lines GROUP BY 1) LEFT JOIN (SELECT project, count(*) FILTER (WHERE suppressed) AS suppressed,
            count(*) FILTER (WHERE NOT suppressed) AS active FROM final GROUP BY 1) USING (project)""",
        "summary_pivot": "SELECT project, count(*) AS total, " + ", ".join(
            f"count(*) FILTER (WHERE severity = {n}) AS {t.lower()}" for n, t in enumerate(SEVERITY_LABELS)
        ) + " FROM shown GROUP BY 1",
        "distinct_rules": """SELECT rule_id, first(category ORDER BY severity DESC, confidence DESC, path, line_no, category)
            AS category, max(severity) AS severity,
            first(cwe ORDER BY severity DESC, confidence DESC, path, line_no, category) AS cwe,
            count(*) AS n FROM shown GROUP BY 1""",
        "quality_gate": """SELECT project, bool_or(severity >= 3) AS failed,
            count(*) FILTER (WHERE severity >= 3) AS blocking FROM shown GROUP BY 1""",
        "report_order": """SELECT severity, confidence, path, line_no, category, rule_id FROM shown
            ORDER BY severity DESC, confidence DESC, path, line_no, category, rule_id""",
        "report_json": _json_body(),
        "report_sarif": _sarif_body(),
        "report_sarif_rules": _sarif_rules(),
        "report_sarif_parts": _sarif_parts(),
        "report_summary": f"""
SELECT project, to_json({{files_scanned: files_scanned, total_lines: total_lines,
  total_findings: coalesce(total, 0), suppressed: coalesce(suppressed, 0), rules_loaded: {len(RULES)},
  by_severity: {{critical: coalesce(s4, 0), high: coalesce(s3, 0), medium: coalesce(s2, 0), low: coalesce(s1, 0), info: coalesce(s0, 0)}},
  by_category: coalesce(by_category, MAP {{}}::MAP(VARCHAR, BIGINT)),
  by_confidence: {{high: coalesce(c2, 0), medium: coalesce(c1, 0), low: coalesce(c0, 0)}}}})::VARCHAR AS summary
FROM (SELECT project, count(DISTINCT path) AS files_scanned, count(*) AS total_lines FROM lines GROUP BY 1)
LEFT JOIN (SELECT project, count(*) FILTER (WHERE NOT suppressed) AS total,
  count(*) FILTER (WHERE suppressed) AS suppressed, """ + ", ".join(
            [f"count(*) FILTER (WHERE NOT suppressed AND severity = {n}) AS s{n}" for n in range(5)]
            + [f"count(*) FILTER (WHERE NOT suppressed AND confidence = {n}) AS c{n}" for n in range(3)]
        ) + """ FROM final GROUP BY 1) USING (project)
LEFT JOIN (SELECT project, map(list(category ORDER BY category), list(n ORDER BY category)) AS by_category
  FROM (SELECT project, category, count(*) AS n FROM shown GROUP BY ALL) GROUP BY 1) USING (project)""",
        "pack_findings": f"""
SELECT h.project, h.path, h.line_no, r.rule_id, match AS match_text
FROM every_hit h JOIN every_rule r USING (rule_ord) JOIN frameworks f ON f.project = h.project AND f.name = r.pack
JOIN vis v ON v.path = h.path AND v.line_no = h.line_no
WHERE v.visible IS NOT NULL AND NOT (r.category = {q(X.PREPARE_CATEGORY)} AND contains(h.text, {q(X.PREPARE_CALL)}))""",
        "fingerprint": f"SELECT path, line_no, rule_id, {_FP} AS fingerprint FROM judged",
        "baseline_new": f"""SELECT * FROM (SELECT project, path, line_no, rule_id, {_FP} AS fingerprint FROM judged)
            WHERE (project, fingerprint) NOT IN (SELECT (project, fingerprint) FROM {_OLD})""",
        "baseline_fixed": f"""SELECT DISTINCT project, fingerprint FROM {_OLD}
            WHERE (project, fingerprint) NOT IN (SELECT (project, {_FP}) FROM judged)""",
        "baseline_moved": _MOVED,
        "cache_state": f"SELECT project, path, sha256, version FROM ({_LOG}) WHERE n % 3 <> 0",
        "cache_removed": f"SELECT project, path, sha256, version FROM ({_LOG}) WHERE n % 3 = 0 AND n % 5 <> 0",
        "baseline_saved": f"""SELECT project, path, string_agg(fp, ',' ORDER BY fp) AS fingerprints
            FROM (SELECT project, path, {_FP} AS fp FROM judged) GROUP BY ALL""",
        "incremental_changed": _CHANGED,
        "incremental_scan": "SELECT project, path, line_no, category, rule_id, severity, confidence FROM shown",
        "incremental_reused": f"""SELECT project, path, line_no, rule_id FROM judged
            WHERE path NOT IN (SELECT path FROM ({_CHANGED}))""",
        "rules_hash": f"""SELECT project, sha256(string_agg(rule_id || ':' || pattern || ':' || {_SEV} || chr(10), ''
            ORDER BY rule_ord)) AS rules_hash, count(*) AS rules FROM applied GROUP BY 1""",
        "framework_detect": "SELECT * FROM frameworks",
        "rule_packs": "SELECT project, rule_id FROM applied",
        "config_nearest": """SELECT project, dir, config_dir, CASE WHEN depth = 1 THEN ''
            WHEN n % 4 = 0 THEN ' High ' ELSE 'bogus' END AS min_severity FROM nearest WHERE depth IS NOT NULL""",
        "config_merge": """SELECT project, dir, CASE WHEN depth = 0 AND n % 4 = 0 THEN 3 ELSE 1 END AS min_severity,
            CASE WHEN depth = 0 THEN 'a/*,b' ELSE '' END AS exclude_patterns,
            CASE WHEN depth = 1 THEN 'X-1' ELSE '' END AS disabled_rules,
            CASE WHEN depth = 1 THEN 'out' ELSE './report' END AS output_dir, coalesce(depth = 0, false) AS no_html,
            true AS json_output, false AS sarif_output, false AS show_suppressed,
            CASE WHEN depth = 0 AND n % 3 = 2 THEN 1 ELSE 0 END AS concurrency,
            CASE WHEN depth = 1 AND n % 5 > 0 THEN n % 5 ELSE 3 END AS context_lines FROM nearest""",
        "scan_by_config": """
SELECT project, rel AS path, line_no, category, rule_id, severity, confidence, any_suppressed AS suppressed,
  CASE WHEN pass_ord = 6 THEN 0 ELSE least(line_no - 1, ctx) END AS n_before,
  CASE WHEN pass_ord = 6 THEN 0 ELSE least(n_lines - line_no, ctx) END AS n_after
FROM (SELECT *, row_number() OVER (PARTITION BY path, line_no, category
    ORDER BY confidence DESC, is_taint DESC, severity DESC, pass_ord, emit_ord) AS place,
    bool_or(suppressed) OVER (PARTITION BY path, line_no, category) AS any_suppressed
  FROM united JOIN configured USING (project, path)
  WHERE pass_ord <> 1 OR (severity >= least AND rule_id <> off))
WHERE place = 1 AND (shows OR NOT any_suppressed)""",
        "custom_rules": """
SELECT 'yaml:part' || k || '.json' AS source, 0 AS rule_no, pattern_no, 'PART-' || k AS rule_id, p_type AS category,
  CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS severity, 'CWE-1' AS cwe,
  CASE pattern_no WHEN 0 THEN '(?i)' || p_name ELSE 'b+' END AS pattern, 't1,t2' AS tags
FROM (SELECT p_partkey AS k, *, unnest([0, 1]) AS pattern_no FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0)""",
        "convert_rules": _convert_sql(),
        "exclude_filter": f"SELECT project, path FROM all_files WHERE NOT {_excluded(EXCLUDES)}",
        "ext_filter": f"SELECT path, {_ext} AS ext FROM all_files WHERE {_ext} IN {in_list(X.SCANNED_EXTENSIONS)}",
        "dir_prune": f"SELECT path FROM all_files WHERE NOT {rx('path', _skipped)}",
    }
    own_rules = """SELECT project, path, line_no, category, rule_id, severity, confidence, any_suppressed AS suppressed,
          sanitizer_func, md5(match_text) AS match_md5, least(line_no - 1, 3) AS n_before
        FROM (SELECT *, row_number() OVER (PARTITION BY path, line_no, category ORDER BY confidence DESC, severity DESC, rule_ord) AS place,
          bool_or(suppressed) OVER (PARTITION BY path, line_no, category) AS any_suppressed FROM judged) WHERE place = 1"""
    bodies["custom_rejected"] = """SELECT 'yaml:' || file AS source, rule_id, pattern,
        CASE WHEN starts_with(pattern, '(?=') THEN 'look-around or atomic group' ELSE 'not a valid pattern' END AS reason
        FROM doc_rule WHERE kind = 2"""
    out = {name: with_ctes(body) for name, body in bodies.items()}
    out["custom_findings"] = with_ctes(own_rules, {"hit_rules": CTES["doc_hit"]})
    return out
