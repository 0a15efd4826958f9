"""State machine over the taint facts of files; plain Python, no imports."""


def walk(
    facts: dict[str, list], ends: list[int], fetch_key: str, output_sinks: set[int], standing: list[tuple],
    every_path: bool = False,
) -> tuple[dict[str, list], dict[str, list]]:
    """Edges and flows of files.  ``facts`` are columns, in line order within a file; file n has the facts from
    ``ends[n]`` up to ``ends[n + 1]``.  Results are columns with ``ends`` of their own.

    ``state`` maps a variable to what is known about it.  Data that came from a
    database counts only where it is printed (``output_sinks``).

    An edge is a step with the number of the edge before it in its file (-1: none); variables and flows share edges.
    A flow names its last edge.  Its path, all numbers from the source on, is unrolled only if no other flow of
    its line stands in its place later: ``standing`` gives (category, severity) of each sink, and of one
    line and category the severest and first flow is reported.  ``every_path`` unrolls all.
    """
    edge_lines, operations, edge_variables, before, edge_ends = [], [], [], [], [0]
    flow_lines, flow_sinks, flow_variables, sources, lasts, paths, flow_ends = [], [], [], [], [], [], [0]
    first_edge = 0

    def edge(line_no, operation, variable, previous):
        edge_lines.append(line_no)
        operations.append(operation)
        edge_variables.append(variable)
        before.append(previous)
        return len(before) - 1 - first_edge

    names = (
        "line_no", "target", "rest_vars", "src_key", "fetch_var", "row_to", "row_from", "cleans", "sinks", "line_vars",
    )
    all_facts = list(zip(*[facts[name] for name in names]))
    for begin, end in zip(ends, ends[1:]):
        state: dict[str, tuple] = {}  # variable -> (source, last edge, sanitized)
        best: dict[tuple, int] = {}  # line and category -> flow
        first_edge, first_flow = len(before), len(lasts)
        for line_no, target, rest_vars, src_key, fetch_var, row_to, row_from, cleans, sinks, line_vars in all_facts[begin:end]:
            if src_key:
                state[target] = ((target, src_key, line_no), edge(line_no, "source", target, -1), False)
            if fetch_var:
                state[fetch_var] = ((fetch_var, fetch_key, line_no), edge(line_no, "source", fetch_var, -1), False)
            elif row_to and row_from in state:
                source, last, _ = state[row_from]
                state[row_to] = (source, edge(line_no, "assignment", row_to, last), False)
            if target:
                known = state.get(target)
                if known is None or known[0][2] != line_no:
                    for ref in rest_vars:
                        if ref in state and not state[ref][2]:
                            source, last, _ = state[ref]
                            state[target] = (source, edge(line_no, "assignment", target, last), False)
                            break
                if cleans:
                    for ref in rest_vars:
                        if ref in state:
                            source, last, _ = state[ref]
                            state[target] = (source, last, True)
                            break
            for sink in sinks:
                for ref in line_vars:
                    info = state.get(ref)
                    if info is None or info[2]:
                        continue
                    source, last, _ = info
                    if source[1] == fetch_key and sink not in output_sinks:
                        continue
                    category, severity = standing[sink]
                    held = best.get((line_no, category))
                    if held is None or standing[flow_sinks[held]][1] < severity:
                        best[line_no, category] = len(lasts)
                    flow_lines.append(line_no)
                    flow_sinks.append(sink)
                    flow_variables.append(ref)
                    sources.append(source)
                    lasts.append(last)
                    paths.append(None)
        unrolled = {}  # edge -> path; flows of one line often end in one edge
        for flow in range(first_flow, len(lasts)) if every_path else best.values():
            last = lasts[flow]
            if last not in unrolled:
                path, at = [], last
                while at >= 0:
                    path.append(at)
                    at = before[first_edge + at]
                unrolled = {last: path[::-1]}
            paths[flow] = unrolled[last]
        edge_ends.append(len(before))
        flow_ends.append(len(lasts))
    return {
        "ends": edge_ends, "line_no": edge_lines, "operation": operations, "variable": edge_variables, "previous": before,
    }, {
        "ends": flow_ends, "line_no": flow_lines, "sink": flow_sinks, "variable": flow_variables,
        "src_var": [s[0] for s in sources], "src_key": [s[1] for s in sources], "src_line": [s[2] for s in sources],
        "last": lasts, "path": paths,
    }
