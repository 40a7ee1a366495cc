"""A call graph kept over changes: what was read of a content is stored under its hash, so only new contents are parsed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import graph, masks

#: Rows of masks.facts with the content's key in the place of the path.
STORED = masks.FACT.replace("path string", "key string", 1)
COLUMNS = [c.split()[0] for c in masks.FACT.split(", ")]


class Snapshot(NamedTuple):
    """files(path, key), stored(key, ...: facts, and a row of kind file for every content that was parsed), parsed(path, key)."""

    files: DataFrame
    stored: DataFrame
    parsed: DataFrame

    @property
    def facts(self) -> DataFrame:
        """Facts of all files, as masks.facts gives them."""
        return self.files.join(self.stored.where("kind <> 'file'"), "key").select(*COLUMNS)


def empty(spark: SparkSession) -> Snapshot:
    names = spark.createDataFrame([], "path string, key string")
    return Snapshot(names, spark.createDataFrame([], STORED), names)


def refresh(before: Snapshot, files: DataFrame) -> Snapshot:
    """The snapshot of files(path, text), all files as they are now; paths are unique. Null text is empty.

    Contents that the snapshot before holds, under whatever path, aren't parsed again; of equal new ones one is. Files
    that don't parse have no facts and aren't tried again. Contents that no file has any more are dropped.
    """
    keyed = files.select("path", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    names = stage(keyed.select("path", "key"), "changes-files")
    known = before.stored.where("kind = 'file'").select("key")
    new = names.join(known, "key", "left_anti").groupBy("key").agg(F.min("path").alias("path"))
    new = stage(new.select("path", "key"), "changes-new")
    facts = masks.facts(files.join(new, "path", "left_semi"))
    fresh = facts.join(new, "path").select("key", *COLUMNS[1:])
    none = F.array().cast("array<string>")
    fixed = {"kind": F.lit("file"), "pos": F.lit(0), "line": F.lit(0), "names": none, "flags": none}
    marks = new.select("key", *(fixed.get(c, F.lit("")).alias(c) for c in COLUMNS[1:]))
    kept = before.stored.join(names.select("key").distinct(), "key", "left_semi").select("key", *COLUMNS[1:])
    return Snapshot(names, stage(kept.union(fresh).union(marks), "changes-facts"), new)


def changed(before: Snapshot, after: Snapshot) -> DataFrame:
    """path of every file that came, went or has another content."""
    old = before.files.withColumnRenamed("key", "old")
    return old.join(after.files, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("key"))).select("path")


def affected(before: Snapshot, after: Snapshot) -> DataFrame:
    """fqn, round: functions of changed files as they were and are (round 0), and those from which calls lead to one, in the graph before or after."""
    paths = changed(before, after)
    own = lambda s: graph.definitions(s.facts).join(paths, "path", "left_semi").select(F.col("fqn").alias("node"))
    back = lambda s: graph.call_edges(s.facts).select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    found = graph.reach(back(before).union(back(after)), own(before).union(own(after)), None)
    return found.withColumnRenamed("node", "fqn")
