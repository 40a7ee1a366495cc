"""Incremental input: new files are scanned as they come, feedback is kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import masks, rules


def scan_stream(spark: SparkSession, root: str, out: str, checkpoint: str, facts: str | None = None):
    """Findings of every text file that appears under root, with masks and block checks, as Parquet in folders batch=<number> of out.

    facts: a folder for what call graph and taint need of each file, kept the same way; see facts_now. A batch that is
    tried again after a failure replaces its own folder, so no finding is lost or twice.
    """
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    files = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def work(batch: DataFrame, number: int) -> None:
        rules.scan(masks.python_masks(batch), masks=True).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if facts:
            marks = batch.select("path", F.lit("file").alias("kind"))
            masks.facts(batch).unionByName(marks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{facts}/batch={number}")

    return files.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def facts_now(spark: SparkSession, facts: str) -> DataFrame:
    """Facts of every file as it came last, for graph.call_edges and graph.taint."""
    rows = spark.read.schema(masks.FACT + ", batch long").parquet(facts)
    last = rows.where("kind = 'file'").groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi").where("kind <> 'file'").drop("batch")


def feedback_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """stream(ts, rule, key) -> counts by key and day; days are final once the watermark has passed them."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "rule", "key").agg(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def feedback_updates(stream: DataFrame, delay: str = "1 day", keep_days: float | None = None) -> DataFrame:
    """stream(ts, rule, path, title) -> key, rule, count, first, last (microseconds), gone: a row for every key that a batch changed.

    A key's state is its count and its first and last time. A blank rule or title is no feedback. Rows that come later than
    delay behind the newest are dropped. keep_days: a key without news for so long is told as gone and forgotten; what
    comes after counts from one.
    """
    said = stream.where((F.trim("rule") != "") & (F.trim("title") != "")).withWatermark("ts", delay)
    key = F.concat_ws("|", "rule", F.element_at(F.split(F.coalesce("path", F.lit("")), r"[/\\]"), -1), "title")
    rows = said.select("ts", key.alias("key"), "rule", F.unix_micros("ts").alias("at"))
    keep_ms = None if keep_days is None else int(keep_days * 86_400_000)

    def upsert(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get if state.exists else None
        gone = state.hasTimedOut
        count, first, last = had or (0, None, None)
        if not gone:
            for batch in batches:
                low, high = int(batch["at"].min()), int(batch["at"].max())
                count, first, last = count + len(batch), low if first is None else min(first, low), high if last is None else max(last, high)
            state.update((count, first, last))
            if keep_ms is not None:
                state.setTimeoutTimestamp(max(last // 1000 + keep_ms, state.getCurrentWatermarkMs() + 1))
        else:
            state.remove()
        yield pd.DataFrame({"key": [key[0]], "rule": [key[1]], "count": [count], "first": [first], "last": [last], "gone": [gone]})

    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("key", "rule").applyInPandasWithState(upsert, "key string, rule string, count long, first long, last long, gone boolean", "count long, first long, last long", "update", timeout)


def keep_feedback(stream: DataFrame, out: str, checkpoint: str, delay: str = "1 day", keep_days: float | None = None):
    """feedback_updates as Parquet in folders batch=<number> of out; a batch that is tried again replaces its folder."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return feedback_updates(stream, delay, keep_days).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_now(spark: SparkSession, out: str) -> DataFrame:
    """key, rule, count, first, last of every key that isn't gone: the state as the last batch left it."""
    rows = spark.read.schema("key string, rule string, count long, first long, last long, gone boolean, batch long").parquet(out)
    # a key can be told gone and come again in one batch, never the other way round
    last = rows.groupBy("key", "rule").agg(F.max_by(F.struct("count", "first", "last", "gone"), F.struct("batch", ~F.col("gone"))).alias("r"))
    at = lambda c: F.timestamp_micros(f"r.{c}").alias(c)
    return last.where("not r.gone").select("key", "rule", "r.count", at("first"), at("last"))
