"""Lines of texts, their neighbours and contexts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lstrip, strip

#: What ends a line.
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def split_lines(text: Column) -> Column:
    """The lines of a text, as an array; a last empty one isn't a line."""
    parts = F.split(text, BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """texts -> path, line_no (from 1), line; a last empty line isn't one."""
    out = texts.select(F.col(path).alias("path"), F.posexplode(split_lines(F.col(text))).alias("i", "line"))
    return out.select("path", (F.col("i") + 1).alias("line_no"), "line")


def cut_lines(text: str) -> tuple[list[str], list[int]]:
    """split_lines of one text inside a task, and where each line begins."""
    out, begins, at = [], [], 0
    for m in re.finditer(BREAK, text):
        out.append(text[at : m.start()])
        begins.append(at)
        at = m.end()
    if at < len(text) or not text:
        out.append(text[at:])
        begins.append(at)
    return out, begins


def _by() -> Window:
    return Window.partitionBy("path").orderBy("line_no")


def previous(col: str = "line") -> Column:
    return F.lag(col).over(_by())


def following(col: Column, n: int) -> Column:
    """The next n values, as an array."""
    return F.collect_list(col).over(_by().rowsBetween(1, n))


def around(col: Column, n: int) -> Column:
    """The values of n lines before to n lines after."""
    return F.collect_list(col).over(_by().rowsBetween(-n, n))


def numbered(col: str = "line") -> Column:
    """``  12| text``"""
    return F.concat(F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit("| "), F.col(col))


def context(rows: DataFrame, n: int = 5) -> DataFrame:
    """path, line_no, context: the numbered lines around each line."""
    return rows.select("path", "line_no", F.concat_ws("\n", around(numbered(), n)).alias("context"))


def indent(col: Column) -> Column:
    return F.length(col) - F.length(lstrip(col))


def block(n: int) -> Column:
    """The next lines, n at most, up to the first that isn't blank and not indented more than this one."""
    rest = following(F.col("line"), n)
    deep = indent(F.col("line"))
    stop = F.aggregate(
        rest,
        F.struct(F.array().cast("array<string>").alias("a"), F.lit(False).alias("end")),
        lambda s, x: F.when(s["end"] | ((strip(x) != "") & (indent(x) <= deep)), F.struct(s["a"].alias("a"), F.lit(True).alias("end"))).otherwise(F.struct(F.concat(s["a"], F.array(x)).alias("a"), F.lit(False).alias("end"))),
    )
    return stop["a"]
