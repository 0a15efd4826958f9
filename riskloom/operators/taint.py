"""Untrusted data from source to sink, file by file.

Spark reduces every file to the few facts that can move taint (one entry per
relevant line).  A small Arrow function then walks those facts in line order;
lines, texts and all other columns stay on the JVM side.
"""

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from riskloom.functions import sqltext
from riskloom.functions.dialect import sql_string, to_java
from riskloom.functions.sqltext import any_of, constant_list, first_known
from riskloom.functions.text import WHITE_SPACE, clipped, trimmed
from riskloom.model import Rule, SHOWN_STEP_CHARS
from riskloom.operators import walk
from riskloom.rules import flows as V
from riskloom.rules.exemptions import VARIABLE

_EDGE = "ARRAY<STRUCT<line_no: INT, operation: STRING, variable: STRING, previous: INT>>"
_FLOW = (
    "ARRAY<STRUCT<line_no: INT, sink: INT, variable: STRING, src_var: STRING, src_key: STRING, "
    "src_line: INT, last: INT, path: ARRAY<INT>>>"
)
TRACE = f"STRUCT<edges: {_EDGE}, flows: {_FLOW}>"
cloudpickle.register_pickle_by_value(walk)

SINK_RULES: list[Rule] = [
    Rule(
        "TAINT-" + category.replace(" ", ""), category, severity, cwe, "",
        source="taint-analysis",
    )
    for _, category, severity, cwe in V.SINKS
]
_CLEAN_NAMES = list(
    dict.fromkeys(name.lower() for names in V.FLOW_SANITIZERS.values() for name in names)
)


def _sinks_on(text: str, low: str) -> str:
    """Sinks named on the line, without false calls and locally cleaned categories."""
    options = []
    for n, (function, category, _, _) in enumerate(V.SINKS):
        conditions = [any_of(low, [function.lower()])]
        if function == "header":
            conditions.append(sqltext.rlike(text, V.HEADER_CALL))
        if category == "File Inclusion":
            conditions.append(sqltext.rlike(text, V.INCLUDE_CALL))
            conditions.append(f"NOT {sqltext.rlike(text, V.OUTPUT_STRING)}")
        names = [name.lower() for name in V.FLOW_SANITIZERS[category]]
        conditions.append(f"NOT {any_of(low, names)}")
        options.append(f"if({' AND '.join(conditions)}, {n}, NULL)")
    return f"array_compact(array({', '.join(options)}))"


def line_facts(extended_fetch: bool = False) -> Column:
    """Per file: the lines that can start, move, clean or end a flow."""
    fetch_pattern = V.DB_FETCH_EXTENDED if extended_fetch else V.DB_FETCH

    def when(condition: str, value: str) -> str:
        return f"if({condition}, {value}, '')"

    space, variables = sql_string(WHITE_SPACE), sql_string(to_java(VARIABLE))
    # Each step keeps fewer lines, so what costs more is asked of few.
    comment = f"(contains(t, '#') OR contains(t, '/')) AND rlike(trim(BOTH {space} FROM t), '^(//|#|/[*])')"
    numbered = (
        "filter(transform(lines, (t, i) -> "
        f"if(contains(t, '$') AND NOT ({comment}), named_struct('line_no', i + 1, 'text', t), NULL)), x -> x IS NOT NULL)"
    )
    prepared = (
        f"transform({numbered}, x -> named_struct('line_no', x.line_no, 'text', x.text, 'low', lower(x.text), "
        f"'target', {when("contains(x.text, '=')", sqltext.extract('x.text', V.ASSIGNMENT, 1))}))"
    )
    judged = (
        f"filter(transform({prepared}, x -> named_struct('x', x, "
        f"'rest', {when("x.target <> ''", sqltext.extract('x.text', V.ASSIGNMENT, 2))}, "
        f"'fetch_var', {when("contains(x.low, 'fetch')", sqltext.extract('x.text', fetch_pattern, 1))}, "
        f"'sinks', {_sinks_on('x.text', 'x.low')})), "
        "p -> p.x.target <> '' OR p.fetch_var <> '' OR size(p.sinks) > 0)"
    )
    lowered = f"transform({judged}, p -> named_struct('p', p, 'low_rest', lower(p.rest)))"
    source = first_known(
        [f"nullif({sqltext.extract('q.p.rest', p)}, '')" for p in V.SOURCES] + ["''"]
    )
    is_row = "q.p.fetch_var = '' AND contains(q.p.x.text, '[')"
    return F.expr(
        f"transform({lowered}, q -> named_struct("
        "'line_no', q.p.x.line_no, 'target', q.p.x.target, "
        f"'rest_vars', regexp_extract_all(q.p.rest, {variables}, 0), "
        f"'src_key', {when(any_of('q.p.rest', ['$_', 'php://input']), source)}, "
        "'fetch_var', q.p.fetch_var, "
        f"'row_to', {when(is_row, sqltext.extract('q.p.x.text', V.ROW_COLUMN, 1))}, "
        f"'row_from', {when(is_row, sqltext.extract('q.p.x.text', V.ROW_COLUMN, 2))}, "
        f"'cleans', q.p.x.target <> '' AND {any_of('q.low_rest', _CLEAN_NAMES)}, "
        "'sinks', q.p.sinks, "
        f"'line_vars', regexp_extract_all(q.p.x.text, {variables}, 0)))"
    )


def with_facts(df: DataFrame, extended_fetch: bool = False) -> DataFrame:
    return df.withColumn("facts", line_facts(extended_fetch))


def _tracer(every_path: bool):
    """The Arrow function; it carries its constants and needs no package on workers."""
    kind = T.DataType.fromDDL(TRACE)
    follow, trace_type = walk.walk, to_arrow_type(kind)
    fetch_key = V.DB_FETCH_KEY
    output_sinks = {n for n, s in enumerate(V.SINKS) if s[1] == "Cross-Site Scripting"}
    standing = [(category, severity) for _, category, severity, _ in V.SINKS]

    def trace(facts: pa.Array) -> pa.Array:
        # Columns of all files go in and out as flat arrays; an object for each fact would cost more than the walk.
        rows = facts.values
        columns = {}
        for n, field in enumerate(rows.type):
            column = rows.field(n)
            if pa.types.is_list(field.type):
                ends, items = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False).tolist()
                columns[field.name] = [items[a:b] for a, b in zip(ends, ends[1:])]
            else:
                columns[field.name] = column.to_numpy(zero_copy_only=False).tolist()
        edges, flows = follow(columns, facts.offsets.to_pylist(), fetch_key, output_sinks, standing, every_path)
        return as_structs({"edges": as_lists(edges, trace_type.field("edges").type),
                           "flows": as_lists(flows, trace_type.field("flows").type)}, trace_type)

    def as_structs(arrays: dict, type_: pa.StructType) -> pa.StructArray:
        return pa.StructArray.from_arrays([arrays[f.name] for f in type_], fields=list(type_))

    def as_lists(found: dict, type_: pa.ListType) -> pa.ListArray:
        values = {f.name: pa.array(found[f.name], f.type) for f in type_.value_type}
        return pa.ListArray.from_arrays(pa.array(found["ends"], pa.int32()), as_structs(values, type_.value_type), type=type_)

    return F.arrow_udf(trace, kind)


def with_flows(df: DataFrame, every_path: bool = False) -> DataFrame:
    """Adds ``flows`` and ``edges``.  Files without any source or any sink never reach Python's loop.

    An edge is in the table once, however many flows go over it.  Flows that another one of their
    line and category replaces have no path, unless ``every_path`` is on.
    """
    possible = F.exists(
        "facts", lambda f: (f["src_key"] != "") | (f["fetch_var"] != "")
    ) & F.exists("facts", lambda f: F.size(f["sinks"]) > 0)
    relevant = F.when(possible, F.col("facts")).otherwise(F.slice("facts", 1, 0))
    traced = df.withColumn("_trace", _tracer(every_path)(relevant))
    return traced.select("*", "_trace.flows", "_trace.edges").drop("_trace")


def flow_edges(df: DataFrame) -> DataFrame:
    """``df`` with ``edges`` → one row per edge; ``previous`` is the line and variable it continues."""
    rows = df.select("project", "path", "edges", F.posexplode_outer("edges").alias("edge", "e")).where("e IS NOT NULL")
    before = F.when(F.col("e.previous") >= 0, F.get("edges", F.col("e.previous")))
    return rows.select(
        "project", "path", "edge", "e.line_no", "e.operation", "e.variable",
        F.col("e.previous").alias("previous"), before["line_no"].alias("previous_line"),
        before["variable"].alias("previous_variable"),
    )


def sink_function(sink: Column) -> Column:
    return F.element_at(constant_list(s[0] for s in V.SINKS), sink + 1)


def flow_candidates() -> Column:
    """Flows as findings-to-be: ``(line_no, rule, match, description, advice, steps)``."""

    def step(line_no: Column, operation: Column, variable: Column) -> Column:
        return F.struct(
            F.col("path").alias("file"), line_no.alias("line"),
            clipped(trimmed(F.element_at(F.col("lines"), line_no)), SHOWN_STEP_CHARS).alias("code"),
            operation.alias("operation"), variable.alias("variable"),
        )

    def report(f: Column, steps: Column) -> Column:
        call = F.concat(sink_function(f["sink"]), F.lit("()"))
        way = F.concat(
            F.transform(f["path"], lambda n: F.get(steps, n)),
            F.array(step(f["line_no"], F.lit("sink"), f["variable"])),
        )
        return F.struct(
            f["line_no"].alias("line_no"),
            f["sink"].alias("rule"),
            F.concat(f["src_var"], F.lit(" -> "), call).alias("match"),
            F.concat(
                F.lit("Untrusted data: "), f["src_var"], F.lit(" set from "), f["src_key"],
                F.lit(" (line "), f["src_line"].cast("string"), F.lit(") reaches "), call,
                F.lit(" (line "), f["line_no"].cast("string"), F.lit(")"),
            ).alias("description"),
            F.concat(
                F.lit("Clean "), f["src_var"], F.lit(" before it reaches "), call
            ).alias("advice"),
            F.coalesce(way, F.slice(steps, 1, 0)).alias("steps"),
        )

    # Every edge is worded once; paths pick from these.
    worded = F.transform("edges", lambda e: step(e["line_no"], e["operation"], e["variable"]))
    return F.flatten(
        F.transform(F.array(worded), lambda steps: F.transform("flows", lambda f: report(f, steps)))
    )
