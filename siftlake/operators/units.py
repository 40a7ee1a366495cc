"""Units a reviewer reads: summaries of files, a project's tree, and the windows around labelled lines."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import split_lines as lines_of
from .masks import _per_file, split_functions, split_lines


def summary_of(path: str, text: str):
    """One line: the file's name and lines, its functions with four arguments at most, its classes with six methods, 20 entries."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield path, f"{name}: (does not parse)"
        return
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)
    items = []
    for n in tree.body:
        if isinstance(n, kinds):
            items.append(f"def {n.name}({', '.join(a.arg for a in n.args.args[:4])})")
        elif isinstance(n, ast.ClassDef):
            items.append(f"class {n.name}: {', '.join([m.name for m in n.body if isinstance(m, kinds)][:6])}")
    yield path, f"{name} ({len(split_lines(text))} lines): " + "; ".join(items[:20])


def file_summaries(files: DataFrame) -> DataFrame:
    """files(path, text) -> path, summary."""
    return _per_file(files, "path string, summary string", summary_of)


def tree_text(files: DataFrame, name: str, most: int = 60) -> DataFrame:
    """One row: tree, the project's name and its first paths, with how many there are if those aren't all. Only most paths leave a task."""
    first = files.select("path").orderBy("path").limit(most).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    n = files.agg(F.count("*").alias("n"))
    rows = F.concat(F.array(F.lit(f"{name}/")), F.transform("paths", lambda p: F.concat(F.lit("  "), p)), F.when(F.col("n") > most, F.array(F.format_string("  ... %d files", "n"))).otherwise(F.array().cast("array<string>")))
    return first.crossJoin(n).select(F.array_join(rows, "\n").alias("tree"), "n")  # one row each


def project_unit(files: DataFrame, name: str, most: int = 200) -> DataFrame:
    """One row: name, source (the tree and the summaries of the first most files), file_count."""
    some = file_summaries(files.orderBy("path").limit(most)).agg(F.array_sort(F.collect_list(F.struct("path", "summary"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x["summary"]), "\n\n")
    return tree_text(files, name).crossJoin(some).select(F.lit(name).alias("name"), F.concat_ws("\n\n", "tree", text).alias("source"), F.col("n").alias("file_count"))  # one row each


def retrieval_cases(truth: DataFrame, files: DataFrame, known: DataFrame, window: int = 3000) -> DataFrame:
    """truth(lib, file, line, rule, verdict), files(lib, file, text), known(rule, kid) -> the cases, with window and query.

    Rows with verdict T or F and a known rule. file: the line begins within the first window characters, which are the
    query. func: the first function in order of nesting and line that holds it. outside: it begins behind the window.
    """
    rows = truth.where("verdict in ('T', 'F')").join(known, "rule").join(files, ["lib", "file"])
    before = F.length(F.array_join(F.slice(lines_of(F.col("text")), 1, F.col("line") - 1), "\n"))
    where = F.when(before < window, "file").otherwise("outside")
    head = rows.select("lib", "file", "line", "rule", "kid", "verdict", where.alias("window"), F.when(before < window, F.substring("text", 1, window)).alias("query"))
    path = F.concat_ws("\0", "lib", "file")
    functions = split_functions(files.select(path.alias("path"), "text"))
    held = rows.withColumn("path", path).join(functions.select("path", "line_start", "line_end", "source"), "path").where("line between line_start and line_end")
    n = F.row_number().over(Window.partitionBy("lib", "file", "line", "rule").orderBy("line_start", F.desc("line_end")))
    func = held.withColumn("n", n).where("n = 1").select("lib", "file", "line", "rule", "kid", "verdict", F.lit("func").alias("window"), F.substring("source", 1, window).alias("query"))
    return head.unionByName(func)
