import random
import re

from pyspark.sql import functions as F

from riskloom.operators import detectors as D, taint
from riskloom.operators.lines import with_lines
from riskloom.rules import flows as V
from riskloom.rules.ruleset import file_level_rules


def _found(files, array):
    rows = with_lines(files).select("path", F.explode_outer(array).alias("d")).where("d IS NOT NULL")
    return [
        (r.path[-5], r.d.line_no, D.DETECTOR_RULES[r.d.rule][0].rule_id, r.d.match)
        for r in rows.orderBy("path", "d.line_no").collect()
    ]


def test_check_then_use(spark, make_files):
    check, use = "if (file_exists($f)) {", "unlink($f);"
    files = make_files(
        "\n".join([check, "a", "b", use]), "\n".join([check, "a", "b", "c", use]),
        "\n".join([check, "unlink($g);", "rename($f, $h);", use]), check + " " + use,
    )
    assert _found(files, D.check_then_use()) == [
        ("0", 1, "RACE-001", "file_exists($f) -> file op line 4"),
        ("2", 1, "RACE-001", "file_exists($f) -> file op line 3"),
    ]


def test_forms(spark, make_files):
    form, other = "<form method='post'>", "<form-group>"
    files = make_files(
        "\n".join([form, "x", "<input name=csrf></form>"]),
        "\n".join([form, "</form>", "csrf"]),
        "\n".join([form, "INSERT INTO t", "</form>"]),
        "\n".join([form] + ["x"] * 30 + ["csrf", "INSERT"]),
        "\n".join([form] + ["x"] * 29 + ["csrf"]),
        form + " csrf",
        "\n".join([form, "</form> INSERT"]),
        "\n".join([form, other, "csrf"]),  # what looks like another form does not end this one
        "\n".join([form, other, "INSERT"]),
        "\n".join([form, "x", form, "csrf", "</form>"]),
    )
    expected = {
        30: [("1", "CSRF-003"), ("2", "CSRF-002"), ("3", "CSRF-003"), ("5", "CSRF-003"), ("6", "CSRF-002"), ("8", "CSRF-002")],
        None: [("1", "CSRF-003"), ("2", "CSRF-002"), ("5", "CSRF-003"), ("6", "CSRF-002"), ("8", "CSRF-002")],
    }
    for reach, rows in expected.items():
        assert [(f, r) for f, _, r, _ in _found(files, D.unprotected_forms(reach))] == rows


def test_forms_against_reading_line_by_line(spark, make_files):
    rng = random.Random(9)
    kinds = ["<FORM id=a method = \"POST\">", "INSERT", "</form>", "x", "x", "csrf", "</form> ->save", "<form>"]
    texts = [[rng.choice(kinds) for _ in range(rng.randint(1, 60))] for _ in range(9)]
    for reach in (30, 3, None):
        wanted = []
        for n, lines in enumerate(texts):
            for i, line in enumerate(lines):
                if not re.search(D.M.POST_FORM, line):
                    continue
                token = write = False
                for after in lines[i + 1 :][:reach]:
                    token = token or "csrf" in after
                    if token:
                        break
                    write = write or bool(re.search(D.M.STATE_CHANGE, after))
                    if "</form>" in after:
                        break
                if not token:
                    wanted.append((str(n), i + 1, "CSRF-002" if write else "CSRF-003"))
        files = make_files(*["\n".join(t) for t in texts])
        assert [f[:3] for f in _found(files, D.unprotected_forms(reach))] == wanted


def test_logout_and_headers(spark, make_files):
    unset = "unset($_SESSION['u']);"
    files = make_files(f"x\n{unset}\n{unset}", f"{unset}\nsession_destroy();", "nothing")
    rows = with_lines(files).select(F.explode_outer(D.incomplete_logout()).alias("d")).where("d IS NOT NULL").collect()
    assert [(r.d.line_no, "2 unset" in r.d.description) for r in rows] == [(2, True)]
    files = make_files("echo 1;\nheader('X-Frame-Options: DENY');", "$a = 1;")
    assert [r for _, _, r, _ in _found(files, D.missing_headers())] == [
        "HEADER-004", "HEADER-005", "HEADER-006",
    ]


def test_file_level_rule(spark, make_files):
    files = make_files("a\nframework:\n  profiler:\n    enabled: true\n", "framework: x")
    rows = D.file_level_matches(with_lines(files), file_level_rules()).collect()
    assert [(r.line_no, r.rule_id) for r in rows] == [(2, "SYMFONY-002")]


def _flows(files):
    df = taint.with_flows(taint.with_facts(with_lines(files)), every_path=True)
    rows = df.select("path", "edges", F.posexplode_outer("flows").alias("n", "f")).where("f IS NOT NULL")
    out = {}
    for r in rows.orderBy("path", "n").collect():
        out.setdefault(r.path, []).append(
            (r.f.line_no, V.SINKS[r.f.sink][0], r.f.src_var, r.f.src_key, r.f.src_line,
             [(e.line_no, e.operation, e.variable) for e in (r.edges[n] for n in r.f.path)]
             + [(r.f.line_no, "sink", r.f.variable)])
        )
    return out


def _model(lines):
    """The data-flow rules, read line by line with plain regular expressions."""
    var = re.compile(r"\$[a-zA-Z_][a-zA-Z0-9_]*")
    names = [n.lower() for v in V.FLOW_SANITIZERS.values() for n in v]
    known, flows = {}, []
    for no, line in enumerate(lines, 1):
        if line.strip().startswith(("//", "#", "/*")):
            continue
        low = line.lower()
        m = re.search(V.ASSIGNMENT, line)
        target, rest = (m.group(1), m.group(2)) if m else ("", "")
        if m:
            for p in V.SOURCES:
                s = re.search(p, rest)
                if s:
                    known[target] = dict(var=target, key=s.group(0), line=no, clean=False,
                                         path=[(no, "source", target)])
                    break
        f = re.search(V.DB_FETCH, line)
        row = None if f else re.search(V.ROW_COLUMN, line)
        if f:
            known[f.group(1)] = dict(var=f.group(1), key=V.DB_FETCH_KEY, line=no, clean=False,
                                     path=[(no, "source", f.group(1))])
        elif row and row.group(2) in known:
            old = known[row.group(2)]
            known[row.group(1)] = dict(old, clean=False, path=old["path"] + [(no, "assignment", row.group(1))])
        if m and not (target in known and known[target]["line"] == no):
            for ref in var.findall(rest):
                if ref in known and not known[ref]["clean"]:
                    old = known[ref]
                    known[target] = dict(old, path=old["path"] + [(no, "assignment", target)])
                    break
        if m and any(n in rest.lower() for n in names):
            for ref in var.findall(rest):
                if ref in known:
                    known[target] = dict(known[ref], clean=True)
                    break
        for function, category, _, _ in V.SINKS:
            if function.lower() not in low:
                continue
            if function == "header" and not re.search(V.HEADER_CALL, line):
                continue
            if category == "File Inclusion" and (
                not re.search(V.INCLUDE_CALL, line) or re.search(V.OUTPUT_STRING, line)
            ):
                continue
            if any(n.lower() in low for n in V.FLOW_SANITIZERS[category]):
                continue
            for ref in var.findall(line):
                info = known.get(ref)
                if not info or info["clean"]:
                    continue
                if info["key"] == V.DB_FETCH_KEY and category != "Cross-Site Scripting":
                    continue
                flows.append((no, function, info["var"], info["key"], info["line"],
                              info["path"] + [(no, "sink", ref)]))
    return flows


def test_flows_equal_line_by_line_model(spark, make_files):
    rng = random.Random(11)
    shapes = [
        "{a} = $_GET['x'];", "{a} = {b};", "{a} = {b} . {c};", "{a} = intval({b});", "echo {a};",
        "{a} = htmlspecialchars({b});", "mysql_query({a} . {b});", "{a} = mysqli_fetch_assoc($r);",
        "{a} = {b}['col'];", "{a} = {a}['c'];", "print_r({a});", "if ({a} == {b}) exec({a});",
        "// echo {a};", "{a} .= {b};", "header('Location: ' . {a});", "echo \"<b required {a}>\";",
        "include({a});", "{a} = 'x'; echo {a};", "{a} = $_POST['y']; echo {a};", "$l = ->fetch($s);",
        "foreach ($x as $k => {a}) echo {b};", "{a} = file_get_contents('php://input');",
        "/* {a} = $_GET['z']; */ echo {a};", "unlink(basename({a}));", "  # {a} = $_GET[1]",
    ]
    var = lambda: rng.choice(["$a", "$b", "$ab"])
    bodies = [
        [rng.choice(shapes).replace("{a}", var()).replace("{b}", var()).replace("{c}", var())
         for _ in range(rng.randint(2, 18))]
        for _ in range(250)
    ]
    got = _flows(make_files(*["\n".join(b) for b in bodies]))
    for n, body in enumerate(bodies):
        assert got.get(f"p/f{n}.php", []) == _model(body), body


def test_extended_fetch(spark, make_files):
    files = with_lines(make_files("$r = $st->fetch();\necho $r;"))
    count = lambda extended: taint.with_flows(taint.with_facts(files, extended)).select(
        F.size("flows").alias("n")
    ).collect()[0].n
    assert (count(False), count(True)) == (0, 1)


def test_self_appending_code(spark, make_files):
    """2,000 appends: 2,001 edges; of 6,000 flows one a line has its path, in order from the source."""
    files = make_files("$s = $_GET['a'];\n" + "$s = $s . 'x'; echo $s; print $s;\n" * 2000)
    df = taint.with_flows(taint.with_facts(with_lines(files)))
    assert taint.flow_edges(df).count() == 2001
    row = df.select("flows", F.transform(taint.flow_candidates(), lambda c: F.size(c["steps"])).alias("steps")).first()
    with_path = [(f.line_no, f.path) for f in row.flows if f.path is not None]
    assert len(with_path) == len({f.line_no for f in row.flows}) == 2000
    assert all(path == list(range(line_no)) for line_no, path in with_path)
    assert sum(row.steps) == sum(line_no + 1 for line_no, _ in with_path)
