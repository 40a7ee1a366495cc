"""Stored runs, chosen by the names of their files before any is opened.

A run is kept either as one JSON report, named by its id, or as rows in a folder run=<id>. Ids begin with the time, so their
order is that of the runs. Names come from the file listing alone: the binaryFile source reads no byte of a file whose
content isn't asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import RUN_ID
from ..schema import FINDING
from .files import read_reports

#: An id anywhere in a path.
ID = RUN_ID.strip("^$")
HEAD = "id string, ts double, time_str string, target string, mode string, depth string, engine struct<model:string>, stats struct<total:long,by_severity:map<string,long>>"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """id, path, length, modified of the files of every run under root; names without an id aren't runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.select(F.regexp_extract("path", ID, 0).alias("id"), "path", "length", "modified").where("id <> ''")


def ids(spark: SparkSession, root: str, n: int = 50) -> list[str]:
    """The newest n ids, newest first."""
    rows = listed(spark, root).select("id").distinct().orderBy(F.desc("id")).limit(n)
    return [r.id for r in rows.collect()]


def _reports(spark: SparkSession, root: str, n: int) -> list[str]:
    """Paths of the newest n reports, a file each."""
    rows = listed(spark, root).where(F.endswith("path", F.lit(".json"))).groupBy("id").agg(F.max("path").alias("path"))
    return [r.path for r in rows.orderBy(F.desc("id")).limit(n).collect()]


def summaries(spark: SparkSession, root: str, n: int = 50) -> DataFrame:
    """The newest n reports without their findings: id, ts, time_str, target, mode, depth, total, by_severity, model; newest first.

    n counts files, so those that can't be read are left out, not made up for. What a report lacks is empty or 0.
    """
    paths = _reports(spark, root, n)
    if not paths:
        raw = spark.createDataFrame([], HEAD + ", broken string, name string")
    else:
        read = spark.read.schema(HEAD + ", broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(paths, multiLine=True)
        raw = read.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), ID, 0))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c.split(".")[-1])
    kept = raw.where("broken is null").select(
        F.coalesce("id", "name").alias("id"), F.coalesce("ts", F.lit(0.0)).alias("ts"), empty("time_str"), empty("target"), empty("mode"), empty("depth"),
        F.coalesce("stats.total", F.lit(0)).alias("total"), F.coalesce("stats.by_severity", F.create_map().cast("map<string,bigint>")).alias("by_severity"), empty("engine.model"),
    )
    return kept.orderBy(F.desc("id"))


def newest(spark: SparkSession, root: str, n: int = 50) -> DataFrame:
    """Findings of the newest n reports, as read_reports gives them; older ones aren't opened."""
    paths = _reports(spark, root, n)
    return read_reports(spark, paths) if paths else read_reports(spark, root).limit(0)


def append(rows: DataFrame, root: str) -> None:
    """rows(run, ...) to the store of run folders; rows of ids that aren't ids are an error, those of a run that is there are added to it."""
    checked = F.when(F.rlike("run", F.lit(RUN_ID)), F.col("run")).otherwise(F.raise_error(F.concat(F.lit("not the id of a run: "), F.coalesce("run", F.lit("null")))))
    rows.withColumn("run", checked).repartition("run", F.rand(3)).write.mode("append").partitionBy("run").parquet(root)


def load(spark: SparkSession, root: str, n: int | None = None, run: str | None = None, schema: str = FINDING) -> DataFrame:
    """Rows of the newest n runs of the store, or of one; without either of all. Other runs' folders are pruned before they are read.

    A run that isn't there, and an id that is none, has no rows.
    """
    rows = spark.read.schema(f"{schema}, run string").parquet(root)
    if run is not None:
        return rows.where((F.col("run") == run) & F.rlike(F.lit(run), F.lit(RUN_ID)))
    return rows if n is None else rows.where(F.col("run").isin(ids(spark, root, n)))


def retired(spark: SparkSession, root: str, keep: int = 50) -> DataFrame:
    """id, path of the files of all runs but the newest keep."""
    first = ids(spark, root, keep)
    return listed(spark, root).where(~F.col("id").isin(first)).select("id", "path")
