"""Keyed caches as tables: what a prompt or a file's content gave before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_key(text: Column, fingerprint: Column) -> Column:
    """<fingerprint of the rules>:<sha1 of the content>."""
    return F.concat(fingerprint, F.lit(":"), F.sha1(F.coalesce(text, F.lit(""))))


def probe(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked(key, ...) + hit: whether the key is stored."""
    return asked.join(stored.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(asked: DataFrame, stored: DataFrame) -> DataFrame:
    return asked.join(stored.select("key").distinct(), "key", "left_anti")


def put(stored: DataFrame, new: DataFrame, most: int = 4000, keep: int = 3000) -> DataFrame:
    """stored, new(key, raw, ts, model) -> both, the latest of each key; if that is more than most, the keep newest (ties by key).

    The cut is found as the keep-th time, so only rows of that time meet in one task.
    """
    row = F.struct(*(c for c in stored.columns if c != "key"))
    every = stored.unionByName(new).groupBy("key").agg(F.max_by(row, "ts").alias("r")).select("key", "r.*")
    by_time = every.groupBy("ts").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(Window.orderBy(F.desc("ts"))))  # a row a second
    cut = by_time.agg(F.sum("_n").alias("_total"), F.max(F.when(F.col("_upto") >= keep, F.col("ts"))).alias("_cut"))
    marked = every.crossJoin(F.broadcast(cut))  # one row
    small, newer, last = F.col("_total") <= most, F.col("ts") > F.col("_cut"), F.col("ts") == F.col("_cut")
    tied = marked.where(~small & last).withColumn("_k", F.row_number().over(Window.partitionBy("ts").orderBy("key")))
    above = by_time.join(F.broadcast(cut.select("_cut")), F.col("ts") > F.col("_cut")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_above"))
    tied = tied.crossJoin(F.broadcast(above)).where(F.col("_k") + F.col("_above") <= keep)  # one row
    return marked.where(small | newer).select(every.columns).unionByName(tied.select(every.columns))


def stats(stored: DataFrame) -> DataFrame:
    """Entries by model."""
    return stored.groupBy("model").agg(F.count("*").alias("entries"))
