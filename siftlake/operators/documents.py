"""Reports as one document: a head, rows in order, a foot.

The rows are dealt by ranges of their order and written by the tasks as parts; a part's separators are known because every
row has a number once the ranges are sorted. Read in the order of their names the parts are the document, and
write_document streams them into one file through the file system of the path, so it works wherever Spark writes.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir, stage
from ..schema import severity_rank
from .report import first_seen, sarif_results, stats

KEYS = "section int, k1 int, k2 string, k3 long, k4 long, text string"


def section(rows: DataFrame, number: int, text: Column, *keys: Column) -> DataFrame:
    """rows as the lines of a section, in order of up to four keys (int, string, long, long)."""
    empty = [F.lit(0), F.lit(""), F.lit(0), F.lit(0)]
    chosen = [k for k in (*keys, *empty[len(keys) :])]
    cast = [c.cast(t).alias(n) for c, n, t in zip(chosen, ("k1", "k2", "k3", "k4"), ("int", "string", "long", "long"), strict=True)]
    return rows.select(F.lit(number).alias("section"), *cast, text.alias("text"))


def fixed(spark: SparkSession, number: int, text: str) -> DataFrame:
    """A section of one line."""
    return spark.createDataFrame([(number, 0, "", 0, 0, text)], KEYS)


def lines_of(parts: list[DataFrame], separated: tuple[int, ...] = ()) -> DataFrame:
    """number, text: the lines of a document in order; in the sections named every line but the first begins with a comma."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    order = ("section", "k1", "k2", "k3", "k4", "text")
    held = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("section", "text", F.monotonically_increasing_id().alias("number")), "document")
    first = held.where(F.col("section").isin(*separated)).groupBy("section").agg(F.min("number").alias("first")) if separated else None
    if first is None:
        return held.select("number", "text")
    held = held.join(F.broadcast(first), "section", "left")  # a row a section
    return held.select("number", F.when(F.col("number") > F.col("first"), F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("text"))


def write_document(lines: DataFrame, path: str) -> None:
    """lines(number, text) as the one file path: parts are written by the tasks, then joined in order, as a stream of bytes."""
    spark = lines.sparkSession
    parts = f"{shared_dir(spark)}/parts-{uuid4().hex}"
    lines.repartitionByRange("number").sortWithinPartitions("number").select("text").write.mode("overwrite").text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    there, here = source.getFileSystem(conf), target.getFileSystem(conf)
    half = hadoop.fs.Path(path + ".part")
    out = here.create(half, True)
    try:
        for status in sorted(there.listStatus(source), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                into = there.open(status.getPath())
                try:
                    hadoop.io.IOUtils.copyBytes(into, out, conf, False)
                finally:
                    into.close()
    finally:
        out.close()
    here.delete(target, False)
    here.rename(half, target)
    there.delete(source, True)


def sarif_document(f: DataFrame, target: str = "", tool: str = "siftlake", version: str = "1.0.0", uri: str = "", root: str = "") -> DataFrame:
    """Findings as a SARIF 2.1.0 document: number, text. Rules in order of their first finding, results in order of pos."""
    spark, given = f.sparkSession, lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in f.columns else F.lit("")
    rule = F.coalesce("rule_id", F.lit("UNKNOWN"))
    f = f.withColumn("rule_id", rule)
    some = lambda *cs: F.coalesce(*(F.when(c != "", c) for c in cs))
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "low", "note").otherwise("warning")
    score = F.when(F.col("severity") == "critical", "9.0").when(F.col("severity") == "high", "7.0").when(F.col("severity") == "low", "2.0").otherwise("5.0")
    title = some(given("title"), F.col("rule_id"))
    text = lambda c: F.struct(c.alias("text"))
    entry = F.to_json(F.struct(
        F.col("rule_id").alias("id"), F.replace("rule_id", F.lit("-"), F.lit("")).alias("name"), text(title).alias("shortDescription"), text(F.substring(some(given("analysis"), title), 1, 2000)).alias("fullDescription"),
        F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct(F.filter(F.array(given("category"), F.col("rule_id")), lambda x: x != "").alias("tags"), score.alias("security-severity")).alias("properties"),
    ))
    firsts = f.groupBy("rule_id").agg(F.min_by(entry, "pos").alias("entry")).join(first_seen(f).select("rule_id", "rule_index"), "rule_id")
    q = json.dumps
    head = f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": {q(tool)}, "version": {q(version)}, "informationUri": {q(uri)}, "rules": ['
    foot = f'], "automationDetails": {{"id": {q(tool + "/" + target.replace(chr(92), "/"))}}}}}]}}'
    parts = [fixed(spark, 0, head), section(firsts, 1, F.col("entry"), F.col("rule_index")), fixed(spark, 2, ']}}, "results": ['), section(sarif_results(f, root), 3, F.col("result"), F.lit(0), F.lit(""), F.col("pos")), fixed(spark, 4, foot)]
    return lines_of(parts, (1, 3))


def json_report(f: DataFrame, target: str, engine: dict | None = None, figures: dict | None = None) -> DataFrame:
    """Findings as a JSON report: number, text. target, engine, stats (total and counts by severity, category and detector, with
    figures of the caller) and the findings in report order, all their columns but pos."""
    spark, q = f.sparkSession, lambda x: json.dumps(x, ensure_ascii=False)
    counted = {"total": f.count(), **(figures or {})}
    for r in stats(f).where("kind <> 'total'").orderBy(F.desc("count"), "value").collect():  # a row a severity, category and detector
        counted.setdefault(f"by_{r.kind}", {})[r.value] = r["count"]
    head = f'{{"target": {q(target)}, "engine": {q(engine or {})}, "stats": {q(counted)}, "issues": ['
    body = F.to_json(F.struct(*(F.col(c) for c in f.columns if c != "pos")), {"ignoreNullFields": "false"})
    rank = F.coalesce(severity_rank(F.col("severity")), F.lit(9))
    return lines_of([fixed(spark, 0, head), section(f, 1, body, rank, F.col("path"), F.col("line_start"), F.col("pos")), fixed(spark, 2, "]}")], (1,))
