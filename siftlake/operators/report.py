"""Reports: order, figures, gates, and their forms as JSON, SARIF and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, mask_secrets
from ..schema import severity_rank


def scan_order(f: DataFrame) -> DataFrame:
    """Findings as a scan gives them: by path, rule and line."""
    return f.orderBy("path", "rule_id", "line_start")


def redacted(f: DataFrame) -> DataFrame:
    """Findings to be shared: file names without folders, secrets masked in the texts. What is not there is not masked."""
    texts = [c for c in ("evidence", "analysis", "impact", "fix") if c in f.columns]
    return f.withColumns({"path": base_name(F.col("path")), **{c: mask_secrets(F.col(c)) for c in texts}})


def brief(f: DataFrame) -> DataFrame:
    """Markdown list rows in report order, bars in titles as slashes."""
    title = F.replace("title", F.lit("|"), F.lit("/"))
    return ordered(f).select(F.format_string("- **%s** %s (%s:%d)", F.upper("severity"), title, base_name(F.col("path")), "line_start").alias("text"))


def diff_markdown(d: DataFrame) -> DataFrame:
    """Rows of history.diff as Markdown in the order added, removed, moved, kept: a head with the count, then a row each, kept ones only counted."""
    rank = F.when(F.col("status") == "added", 0).when(F.col("status") == "removed", 1).when(F.col("status") == "moved", 2).otherwise(3)
    head = d.groupBy(rank.alias("r"), "status").agg(F.count("*").alias("n")).select("r", F.lit(0).alias("part"), F.lit("").alias("path"), F.lit(0).alias("line"), F.format_string("## %s (%d)", "status", "n").alias("text"))
    line = F.coalesce("new_line", "old_line")
    where = F.when(F.col("status") == "moved", F.format_string("%d -> %d", "old_line", "new_line")).otherwise(line.cast("string"))
    body = d.where("status <> 'kept'").select(rank.alias("r"), F.lit(1).alias("part"), "path", line.alias("line"), F.format_string("- %s %s:%s", "rule_id", "path", where).alias("text"))
    return head.unionByName(body).orderBy("r", "part", "path", "line", "text").select("text")


def payload(f: DataFrame, target: str, most: int = 10) -> DataFrame:
    """One row: what a notification carries, target, total, counts by severity and the first findings of report order."""
    n = f.agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")))
    top = ordered(f).limit(most).agg(F.collect_list(F.struct("rule_id", "severity", "path", "line_start")).alias("top"))
    return n.crossJoin(top).select(F.lit(target).alias("target"), "*")  # one row each


def ordered(f: DataFrame) -> DataFrame:
    return f.orderBy(severity_rank(F.col("severity")), "path", "line_start", "pos")


def count_by(f: DataFrame, col: str) -> DataFrame:
    """Counts of an attribute, largest first, ties by first appearance."""
    return f.groupBy(col).agg(F.count("*").alias("count"), F.min("pos").alias("first_pos")).orderBy(F.desc("count"), "first_pos")


def stats(f: DataFrame) -> DataFrame:
    """Total and counts by severity, category and detector in one pass."""
    g = f.groupingSets([[], ["severity"], ["category"], ["detector"]], "severity", "category", "detector").agg(F.count("*").alias("count"), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "category").otherwise("detector")
    return g.select(kind.alias("kind"), F.coalesce("severity", "category", "detector", F.lit("all")).alias("value"), "count")


def trimmed(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """The figures of a report after findings were taken out: those of stats over what is kept, and raw and removed counts."""
    counts = raw.agg(F.count("*").alias("n")).select(F.lit("raw").alias("kind"), F.lit("all").alias("value"), F.col("n").alias("count"))
    gone = raw.select(F.lit(1).alias("x")).unionAll(kept.select(F.lit(-1).alias("x"))).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("n"))
    return stats(kept).unionAll(counts).unionAll(gone.select(F.lit("removed"), F.lit("all"), "n"))


def at_least(f: DataFrame, severity: str) -> DataFrame:
    """Findings of the severity or a worse one; unknown severities stay."""
    from ..schema import SEVERITIES

    rank = severity_rank(F.col("severity"))
    return f.where(rank.isNull() | (rank <= SEVERITIES.index(severity)))


def preset(f: DataFrame, categories: DataFrame, disabled: DataFrame) -> DataFrame:
    """Findings of the categories(category), without those whose rule is switched off."""
    return f.join(categories.select("category").distinct(), "category", "left_semi").join(disabled.select("rule_id").distinct(), "rule_id", "left_anti")


def first_seen(f: DataFrame) -> DataFrame:
    """rule_id, rule_index from 0 by first appearance: SARIF's rule table."""
    first = f.groupBy("rule_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("count"))
    return first.withColumn("rule_index", F.row_number().over(Window.orderBy("first_pos")) - 1)


def sarif_results(f: DataFrame, root: str = "") -> DataFrame:
    """A row per finding: rule, its index, level, score, file, line and the result as SARIF 2.1.0 JSON.

    Files below root are named from it, others by their base name; without root paths stay, but for slashes at their
    beginning. Unknown severities are warnings of 5.0. Messages are cut to 2000 characters, evidence to 500, fixes to 1000.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in f.columns else F.lit("")
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "low", "note").otherwise("warning")
    score = F.when(F.col("severity") == "critical", "9.0").when(F.col("severity") == "high", "7.0").when(F.col("severity") == "low", "2.0").otherwise("5.0")
    path = F.replace(given("path"), F.lit("\\"), F.lit("/"))
    if root:
        top = root.replace("\\", "/").rstrip("/") + "/"
        path = F.when(F.startswith(path, F.lit(top)), F.expr(f"substring(replace(path, '\\\\', '/'), {len(top) + 1})")).otherwise(base_name(path))
    uri = F.ltrim(path, F.lit("/"))
    start = F.coalesce(F.when(F.col("line_start") != 0, F.col("line_start")), F.lit(1))
    end = F.coalesce(F.when(F.col("line_end") != 0, F.col("line_end")), start) if "line_end" in f.columns else start
    line = F.greatest(start, F.lit(1))
    out = f.join(first_seen(f).select("rule_id", "rule_index"), "rule_id")
    where = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.struct(line.alias("startLine"), F.greatest(start, end).alias("endLine")).alias("region")).alias("physicalLocation"))
    message = F.substring(F.trim(F.concat(given("title"), F.lit(" — "), given("analysis")), F.lit(" —")), 1, 2000)
    print_ = F.concat_ws(":", "rule_id", uri, start.cast("string"))
    confidence = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) if "confidence" in f.columns else F.lit(0.0)
    more = F.struct(
        given("severity").alias("severity"), given("category").alias("category"), given("detector").alias("detector"), confidence.alias("confidence"),
        F.substring(given("evidence"), 1, 500).alias("evidence"), F.substring(given("fix"), 1, 1000).alias("fix"), given("source").alias("source"),
    )
    result = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(message.alias("text")).alias("message"), F.array(where).alias("locations"),
        F.struct(print_.alias("primaryLocationLineHash")).alias("partialFingerprints"), more.alias("properties"),
    ))
    return out.select("pos", "rule_id", "rule_index", level.alias("level"), score.alias("score"), "path", line.alias("line"), result.alias("result"))


def markdown(f: DataFrame) -> DataFrame:
    """line_no-free Markdown rows in report order: a summary row per severity, then a table row per finding."""
    rank = F.coalesce(severity_rank(F.col("severity")), F.lit(9))
    head = f.groupBy(rank.alias("r"), "severity").agg(F.count("*").alias("n")).select("r", F.lit(0).alias("part"), F.lit("").alias("path"), F.lit(0).alias("line_start"), F.format_string("- **%s**: %d", "severity", "n").alias("text"))
    row = F.format_string("| %s | %s | %s:%d |", "severity", F.replace("rule_id", F.lit("|"), F.lit("/")), "path", "line_start")
    body = f.select(rank.alias("r"), F.lit(1).alias("part"), "path", "line_start", row.alias("text"))
    return head.unionByName(body).orderBy("part", "r", "path", "line_start", "text")
