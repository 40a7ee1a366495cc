"""What of a Python source is docstring, string, comment or inside brackets; functions, calls and taint facts of it.

Only Python's own grammar can tell, so these are small helpers over ``tokenize`` and ``ast``, one file at a time
within Spark's tasks. A source that doesn't parse has no masks but docstrings by counted quotes, and no functions.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pyarrow as pa
from pyspark.sql import DataFrame

MASK = "path string, line_no int, line string, docstring boolean, strings array<struct<a:int,b:int>>, comment_at int, depth int"
BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def split_lines(source: str) -> list[str]:
    out = BREAK.split(source)
    return out[:-1] if out and out[-1] == "" else out


def docstring_lines(source: str, lines: list[str]) -> set[int]:
    """Lines strictly inside a string of several lines: its first and last line hold code too. By counted quotes where
    the source doesn't parse."""
    try:
        inside = set()
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.Constant) and isinstance(node.value, str):
                inside.update(range(node.lineno + 1, node.end_lineno))
        return inside
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        inside, open_ = set(), ""
        for i, line in enumerate(lines, 1):
            if open_:
                inside.add(i)
                open_ = "" if line.count(open_) % 2 else open_
            else:
                code = line.split("#", 1)[0]
                open_ = next((q for q in ('"' * 3, "'" * 3) if code.count(q) % 2), "")
        return inside


def mask(source: str) -> list[tuple]:
    """(line_no, line, docstring, string spans, comment column, bracket depth) of every line."""
    lines = split_lines(source)
    doc, spans, comment, depth = docstring_lines(source, lines), {}, {}, {}
    try:
        level, seen = 0, set()
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.start[0] not in seen:
                seen.add(t.start[0])
                depth[t.start[0]] = level
            if t.type in (tokenize.STRING, getattr(tokenize, "FSTRING_MIDDLE", -1)):
                for row in range(t.start[0], t.end[0] + 1):
                    a = t.start[1] if row == t.start[0] else 0
                    b = t.end[1] if row == t.end[0] else len(lines[row - 1]) if row <= len(lines) else 0
                    spans.setdefault(row, []).append({"a": a, "b": b})
            elif t.type == tokenize.COMMENT:
                comment[t.start[0]] = t.start[1]
            elif t.type == tokenize.OP:
                level += (t.string in "([{") - (t.string in ")]}")
    except (tokenize.TokenError, SyntaxError, IndentationError):
        spans, comment, depth = {}, {}, {}
    return [(i, line, i in doc, spans.get(i, []), comment.get(i), depth.get(i, 0)) for i, line in enumerate(lines, 1)]


def _per_file(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """files(path, text) -> rows_of(path, text) for every file, as the schema says."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = list(rows_of(path, text or ""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], kinds.names)

    return files.select("path", "text").mapInArrow(work, schema)


def python_masks(files: DataFrame) -> DataFrame:
    """files(path, text) -> path, line_no, line, docstring, strings, comment_at, depth."""
    return _per_file(files, MASK, lambda path, text: ((path, *row) for row in mask(text)))


FUNCTION = "path string, name string, line_start int, line_end int, source string, doc string, args array<string>"


def functions_of(path: str, text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = split_lines(text)
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield path, node.name, start, node.end_lineno, "\n".join(lines[start - 1 : node.end_lineno]), (ast.get_docstring(node) or "")[:300], [a.arg for a in node.args.args]


def split_functions(files: DataFrame) -> DataFrame:
    """A row for every function of every file, decorators included."""
    return _per_file(files, FUNCTION, functions_of)


UNIT = "path string, imports array<string>, functions array<string>, doc string"


def unit_of(path: str, text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield path, [], [], ""
        return
    names = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            names.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            names.add(node.module)
    yield path, sorted(names), [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))], (ast.get_docstring(tree) or "")[:500]


def file_units(files: DataFrame) -> DataFrame:
    """Imports, function names and docstring of every file."""
    return _per_file(files, UNIT, unit_of)


# Facts for the call graph (kind node, alias, edge) and for taint (def, alias, call, arg, assign); flags are what else is known of the row.
FACT = "path string, kind string, scope string, klass string, name string, target string, pos int, line int, names array<string>, flags array<string>"


def dotted(node) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def _own(fn):
    """The nodes of a function, without those of functions, classes and lambdas inside it."""
    todo = list(ast.iter_child_nodes(fn))
    while todo:
        node = todo.pop(0)
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            yield node
            todo[:0] = ast.iter_child_nodes(node)


def _functions(node, klass: str = ""):
    """Every function below node with its class; one inside a function counts as its neighbour."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield child, klass
            yield from _functions(child, klass)
        elif isinstance(child, ast.ClassDef):
            yield from _functions(child, child.name)
        else:
            yield from _functions(child, klass)


def _graph_facts(path: str, tree):
    """Functions of the module and methods of its classes; and every call inside a function, with the innermost function
    and class around it. Calls of what has no dotted name are there with an empty one."""
    for top in tree.body:
        for node in top.body if isinstance(top, ast.ClassDef) else [top]:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                klass = top.name if isinstance(top, ast.ClassDef) else ""
                yield path, "node", f"{klass}.{node.name}" if klass else node.name, klass, node.name, "", 0, node.lineno, [a.arg for a in node.args.args], []
    todo = [(tree, "", "")]
    while todo:
        node, klass, caller = todo.pop()
        for child in ast.iter_child_nodes(node):
            inside = caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inside = f"{klass}.{child.name}" if klass else child.name
            elif isinstance(child, ast.Call) and caller:
                yield path, "edge", caller, klass, dotted(child.func), "", -1, child.lineno, [], []
            todo.append((child, child.name if isinstance(child, ast.ClassDef) else klass, inside))


def facts_of(path: str, text: str):
    """Import aliases, definitions, and each function's own calls with their arguments and assignments to a name."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    ids = lambda n: sorted({x.id for x in ast.walk(n) if isinstance(x, ast.Name)})
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield path, "alias", "", "", a.asname or a.name.split(".")[0], a.name, 0, node.lineno, [], []
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                if a.name != "*":
                    yield path, "alias", "", "", a.asname or a.name, f"{node.module or ''}{'.' if node.module else ''}{a.name}", node.level, node.lineno, [], []
    yield from _graph_facts(path, tree)
    for node, klass in _functions(tree):
        scope = f"{klass}.{node.name}" if klass else node.name
        yield path, "def", scope, klass, node.name, "", 0, node.lineno, [a.arg for a in node.args.args], []
        for x in _own(node):
            if isinstance(x, ast.Call) and (name := dotted(x.func)):
                flags = ["shell"] if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in x.keywords) else []
                if x.args and isinstance(x.args[0], ast.Call) and dotted(x.args[0].func).rpartition(".")[2] in ("BytesIO", "StringIO"):
                    flags.append("buffer")
                yield path, "call", scope, klass, name, "", -1, x.lineno, [], flags
                for i, arg in enumerate(x.args):
                    yield path, "arg", scope, klass, name, ast.unparse(arg), i, x.lineno, ids(arg), flags
            elif isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                called = dotted(x.value.func) if isinstance(x.value, ast.Call) else ""
                yield path, "assign", scope, klass, x.targets[0].id, ast.unparse(x.value), 0, x.lineno, ids(x.value), [called]


def facts(files: DataFrame) -> DataFrame:
    return _per_file(files, FACT, facts_of)
