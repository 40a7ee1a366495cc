"""Runs over time: diffs, trends, retention, feedback and reviews."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, drift: int = 3) -> DataFrame:
    """old, new(path, rule_id, line_start, pos) -> path, rule_id, old_line, new_line, status (kept, moved, added, removed).

    Rows of a key collapse, the later pos wins. Leftovers of a rule and path are matched one to one, nearest first
    (then by old and new line), within drift lines. Gaps wider than drift cut them into islands; only the leftovers of
    an island that has both old and new ones meet in a group, and there only those within drift form pairs.
    """
    last = lambda d, name: d.groupBy("path", "rule_id", F.col("line_start").alias(name)).agg(F.max("pos").alias("pos")).drop("pos")
    o, n = last(old, "old_line"), last(new, "new_line")
    n = n.select(*[F.col(c).alias(c if c == "new_line" else f"n_{c}") for c in n.columns])
    full = o.join(n, (F.col("path") == F.col("n_path")) & (F.col("rule_id") == F.col("n_rule_id")) & (F.col("old_line") == F.col("new_line")), "full_outer")
    full = full.select(F.coalesce("path", "n_path").alias("path"), F.coalesce("rule_id", "n_rule_id").alias("rule_id"), "old_line", "new_line")
    kept = full.where("old_line = new_line").withColumn("status", F.lit("kept"))
    rest = full.where("old_line is null or new_line is null")

    def match(key, t):
        a = sorted(x for x in t.column("old_line").to_pylist() if x is not None)
        b = sorted(x for x in t.column("new_line").to_pylist() if x is not None)
        pairs, used_a, used_b = [], set(), set()
        for _, x, y in sorted((abs(x - y), x, y) for x in a for y in b[bisect_left(b, x - drift) : bisect_right(b, x + drift)]):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                pairs.append((x, y, "moved"))
        rows = pairs + [(x, None, "removed") for x in a if x not in used_a] + [(None, y, "added") for y in b if y not in used_b]
        path, rule, _ = (k.as_py() for k in key)
        cols = [[path] * len(rows), [rule] * len(rows), *([r[i] for r in rows] for i in range(3))]
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()], strict=True)], ["path", "rule_id", "old_line", "new_line", "status"])

    rest = rest.select("path", "rule_id", F.col("old_line").cast("int"), F.col("new_line").cast("int"), F.coalesce("old_line", "new_line").cast("int").alias("line"))
    along = Window.partitionBy("path", "rule_id").orderBy("line")
    begins = F.coalesce((F.col("line") - F.lag("line").over(along) > drift).cast("int"), F.lit(0))
    rest = rest.withColumn("begins", begins).withColumn("island", F.sum("begins").over(along.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    island = Window.partitionBy("path", "rule_id", "island")
    rest = rest.withColumn("mixed", (F.count("old_line").over(island) > 0) & (F.count("new_line").over(island) > 0))
    alone = rest.where("not mixed").select("path", "rule_id", "old_line", "new_line", F.when(F.col("old_line").isNull(), "added").otherwise("removed").alias("status"))
    found = rest.where("mixed").select("path", "rule_id", "island", "old_line", "new_line").groupBy("path", "rule_id", "island").applyInArrow(match, "path string, rule_id string, old_line int, new_line int, status string")
    return kept.unionByName(alone).unionByName(found)


def key_sets(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """How many keys are kept, added and removed."""
    o, n = old.select(*on).distinct().withColumn("o", F.lit(1)), new.select(*on).distinct().withColumn("n", F.lit(1))
    both = o.join(n, on, "full_outer")
    return both.agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("kept"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"))


def trend(points: DataFrame, order: list[str], value: str, target: str | None = None) -> DataFrame:
    """points, one row a run: how many, first, last, change and largest value by order; with target its distinct values, sorted."""
    at = F.struct(*order)
    first, last = F.min_by(value, at), F.max_by(value, at)
    return points.agg(F.count("*").alias("runs"), first.alias("first"), last.alias("last"), (last - first).alias("delta"), F.max(value).alias("largest"), *([F.array_sort(F.collect_set(target)).alias("targets")] if target else []))


def latest(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The n rows of each group that come first by order."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= n)


def feedback(rows: DataFrame) -> DataFrame:
    """rows(rule, path, title, ts) -> one row a key (rule, file name, title): count, first and last."""
    key = F.concat_ws("|", "rule", F.element_at(F.split("path", r"[/\\]"), -1), "title")
    return rows.groupBy(key.alias("key"), "rule").agg(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def merge_feedback(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two feedback tables as one."""
    return a.unionByName(b).groupBy("key", "rule").agg(F.sum("count").alias("count"), F.min("first").alias("first"), F.max("last").alias("last"))


def promote(rows: DataFrame, per_key: int = 2, files: int = 3) -> DataFrame:
    """Rules with a key counted per_key times or more, or seen in files file names or more."""
    name = F.element_at(F.split("path", r"[/\\]"), -1)
    keys = rows.groupBy("rule", name.alias("file"), "title").agg(F.count("*").alias("n"))
    return keys.groupBy("rule").agg(F.max("n").alias("most"), F.countDistinct("file").alias("files"), F.sum("n").alias("total")).where((F.col("most") >= per_key) | (F.col("files") >= files))


def review(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """queue(key, ...) with each key's latest decision; pending without one."""
    last = latest(decisions, "key", [F.desc("ts"), F.desc("decision")], 1).select("key", "decision")
    return queue.join(last, "key", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def stamped(rows: DataFrame, ts: str, by: str, tie: str) -> DataFrame:
    """rows with ts raised where needed so that it rises strictly within by: each is its own or the one before plus a millisecond.

    As a running maximum: of ts - k milliseconds over the rows so far, k their number, plus k again.
    """
    w = Window.partitionBy(by).orderBy(ts, tie)
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    k = F.row_number().over(w)
    rows = rows.withColumns({"_k": k, "_ms": ms})
    top = F.max(F.col("_ms") - F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_k")
    return rows.withColumn("stamp", F.timestamp_millis(top)).drop("_k", "_ms")


#: Fixed value: what the id of a stored run looks like.
RUN_ID = r"^\d{8}-\d{6}-[0-9a-f]{6}$"


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    """The stored run of an id; none for an id that isn't one."""
    return runs.where((F.col("id") == run_id) & F.rlike("id", F.lit(RUN_ID)))


def diff_runs(findings: DataFrame, old_id: str, new_id: str, drift: int = 3) -> DataFrame:
    """findings(id, path, rule_id, line_start, pos) of stored runs -> the diff of two of them."""
    one = lambda i: run_by_id(findings, i).select("path", "rule_id", "line_start", "pos")
    return diff(one(old_id), one(new_id), drift)


def of_target(points: DataFrame, target: str) -> DataFrame:
    """Points whose target ends in the same path segment."""
    tail = lambda c: F.element_at(F.split(F.regexp_replace(c, r"[/\\]+$", ""), r"[/\\]"), -1)
    return points.where(tail(F.col("target")) == tail(F.lit(target)))


def proposal_id(rule, key):
    """FP-<rule>-<six hexadecimal digits of the key's sha1>."""
    return F.concat(F.lit("FP-"), rule, F.lit("-"), F.substring(F.sha1(key), 1, 6))
