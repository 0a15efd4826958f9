import random

from pyspark.sql import functions as F

from riskloom.functions.dialect import to_java
from riskloom.operators import comments, lines as L


def _lines(spark, content):
    df = spark.createDataFrame([("p", "f", content)], "project STRING, path STRING, content STRING")
    return L.with_lines(df).collect()


def test_line_ends(spark):
    cases = {
        "": [], "a": ["a"], "a\n": ["a"], "a\n\n": ["a", ""], "a\r\nb\r\n": ["a", "b"],
        "a\r": ["a"], "a\n\r": ["a", ""], "a\r\r\nb": ["a\r", "b"], "\n": [""],
    }
    for content, expected in cases.items():
        assert _lines(spark, content)[0].lines == expected, repr(content)


def test_oversized_line_is_noted_and_scanned(spark, make_files):
    limit = 1024 * 1024
    files = make_files("ok\n" + "x" * (limit - 1), "no\n" + "x" * limit)
    assert [r.path for r in L.with_lines(files).collect()] == ["p/f0.php", "p/f1.php"]
    assert [r.path for r in L.rejected_files(files).collect()] == ["p/f1.php"]


def test_dialect_boundary_and_space(spark):
    df = spark.createDataFrame([("éBUGé",), ("a\x0bb",)], "t STRING")
    hit = lambda p: [r[0] for r in df.select(F.rlike("t", F.lit(to_java(p)))).collect()]
    assert hit(r"BUG\b")[0] is True
    assert hit(r"a\sb")[1] is False
    assert hit(r"[^a]\b")[0] is True


def _model(lines):
    """Line by line: (state before, shown text or None)."""
    inside, out = False, []
    for text in lines:
        before, s = inside, text.strip()
        shown = s
        if inside:
            at = s.find("*/")
            if at < 0:
                out.append((before, None))
                continue
            inside, shown = False, s[at + 2:]
            if not shown.strip():
                out.append((before, None))
                continue
        at = shown.find("/*")
        if at >= 0 and "*/" not in shown[at:]:
            inside, shown = True, shown[:at]
            if not shown.strip():
                out.append((before, None))
                continue
        out.append((before, None if shown.startswith(("//", "#")) else shown))
    return out


def test_comment_state_equals_line_by_line_model(spark):
    rng = random.Random(7)
    pieces = ["/*", "*/", "*", "/", "//", "#", " ", "x", "$a", "*/*", "/*/"]
    files = [
        ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 14))]
        for _ in range(1500)
    ]
    files.append(["/* a */ b /*", "x", "*/*", "y", "// foo /*", "z", " */ // x", "*/", "# q"])
    rows = [(str(n), f) for n, f in enumerate(files)]
    df = spark.createDataFrame(rows, "path STRING, lines ARRAY<STRING>")
    df = comments.with_comment_state(df).select(
        "path", F.posexplode(F.arrays_zip("lines", "in_comment")).alias("pos", "x")
    ).select("path", "pos", F.col("x.lines").alias("text"), F.col("x.in_comment").alias("in_comment"))
    got = {}
    for r in comments.with_visible_part(df).collect():
        got[int(r.path), r.pos] = (r.in_comment == "1", r.visible)
    for n, f in enumerate(files):
        for pos, expected in enumerate(_model(f)):
            assert got[n, pos] == expected, (f, pos)
