"""Model replies: arrays of JSON in them, code blocks, where evidence stands, and the change a fix makes."""

from __future__ import annotations

import difflib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masks import split_lines


def fenced(text: Column) -> Column:
    """The first fenced code block, without line breaks at its end; null where there is none or it is blank."""
    code = F.regexp_replace(F.regexp_extract(text, r"(?s)```[a-zA-Z0-9_+\-]*\s*\n(.*?)```", 1), r"\n+$", "")
    return F.when(F.trim(F.regexp_replace(code, r"\s", "")) != "", code)


def first_array(text: str) -> str | None:
    """The first JSON array of a reply, in its first fenced block if there is one; None if it doesn't parse or close."""
    _, fence, rest = text.partition("```")
    if fence and "```" in rest:
        text = rest[: rest.index("```")].removeprefix("json")
    at = text.find("[")
    if at < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(text, at)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, ensure_ascii=False)


def parse_arrays(replies: DataFrame, schema: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """replies(text, kept columns) -> kept columns, pos, and the fields of schema: a row per element of the reply's array.

    Replies without a readable array give no rows, nor do elements that are no objects; missing fields are null.
    """
    kinds = {f.name: f.dataType for f in replies.schema.fields}

    def work(batches):
        for batch in batches:
            found = pa.array([first_array(t) if t else None for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found], [*keep, "found"])

    got = replies.select("text", *keep).mapInArrow(work, ", ".join([*(f"`{k}` {kinds[k].simpleString()}" for k in keep), "found string"]))
    rows = got.select(*keep, F.posexplode(F.from_json("found", "array<string>")).alias("pos", "one"))
    return rows.select(*keep, "pos", F.from_json("one", schema).alias("x")).where("x is not null").select(*keep, "pos", "x.*")


def anchor(lines: list[str], evidence: str, first: int, last: int | None) -> tuple[int, int] | None:
    """The lines (from 1, both included) that evidence stands for: those given if they hold it, white space apart, else the
    only one within three lines, for evidence of one line. None if it can't be told."""
    flat = lambda t: " ".join(t.split())
    want = flat(evidence or "")
    if not want:
        return None
    lo, hi = max(1, first), min(len(lines), last or first)
    if want in flat("\n".join(lines[lo - 1 : hi])):
        return lo, hi
    if "\n" in evidence.strip():
        return None
    near = [i for i in range(max(1, first - 3), min(len(lines), first + 3) + 1) if want in flat(lines[i - 1])]
    return (near[0], near[0]) if len(near) == 1 else None


def fix_diffs(f: DataFrame, texts: DataFrame) -> DataFrame:
    """f(pos, path, line_start, line_end, evidence, fix), texts(path, text) -> pos, path, lo, hi, diff, error: the unified diff of putting the
    fix's code in the place of its evidence; error (file, code or anchor) says what is missing."""
    rows = f.select("pos", "path", "line_start", "line_end", "evidence", fenced(F.col("fix")).alias("code")).join(texts.select("path", "text"), "path", "left")

    def one(r: dict) -> tuple:
        if r["text"] is None or r["code"] is None:
            return None, None, None, "file" if r["text"] is None else "code"
        lines = split_lines(r["text"])
        at = anchor(lines, r["evidence"], r["line_start"] or 0, r["line_end"])
        if at is None:
            return None, None, None, "anchor"
        new = lines[: at[0] - 1] + r["code"].splitlines() + lines[at[1] :]
        return *at, "\n".join(difflib.unified_diff(lines, new, r["path"], r["path"] + " (fixed)", lineterm="")), None

    def work(batches):
        for batch in batches:
            got = list(zip(*map(one, batch.to_pylist()), strict=True)) or [()] * 4
            cols = [pa.array(c, k) for c, k in zip(got, [pa.int32(), pa.int32(), pa.string(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("pos").cast(pa.int64()), batch.column("path"), *cols], ["pos", "path", "lo", "hi", "diff", "error"])

    return rows.mapInArrow(work, "pos long, path string, lo int, hi int, diff string, error string")
