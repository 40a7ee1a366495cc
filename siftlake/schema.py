"""Finding records: their schema, severities and lenient coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities in order, categories.
SEVERITIES = ("critical", "high", "medium", "low")
CATEGORIES = ("security", "logic", "engineering", "style")

FINDING = (
    "rule_id string, category string, severity string, title string, path string, line_start int, evidence string, analysis string, fix string, "
    "confidence double, line_end int, function_name string, impact string, source string, detector string, verified boolean, votes int, models array<string>"
)
UNIT = "kind string, name string, path string, source string, line_start int, line_end int, context struct<imports:array<string>,functions:array<string>,doc:string,language:string>"


def severity_rank(col: Column) -> Column:
    """0 for critical to 3 for low; null for anything else."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(col == s, i).otherwise(out)
    return out


def severity_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(SEVERITIES, range(len(SEVERITIES)), strict=True)), "severity string, rank int")


def enum(col: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value, trimmed and in lower case, if allowed, else the default."""
    clean = F.lower(F.trim(col))
    return F.when(clean.isin(*allowed), clean).otherwise(F.lit(default))


def clamp(col: Column, default: float = 0.5) -> Column:
    """A confidence in 0..1; the default where it is no number."""
    return F.least(F.greatest(F.coalesce(F.try_cast(col, "double") if hasattr(F, "try_cast") else col.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def line_number(col: Column) -> Column:
    """A 1-based line; 1 where it is missing, zero or no number."""
    n = col.try_cast("int")
    return F.when(n.isNull() | (n == 0), F.lit(1)).otherwise(n)


def tidy(col: Column) -> Column:
    r"""Trimmed, with literal \n and \t restored if the text has no such character of its own."""
    real = F.contains(col, F.lit("\n")) | F.contains(col, F.lit("\t"))
    return F.trim(F.when(real, col).otherwise(F.replace(F.replace(col, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))), F.lit(" \n\t\r"))


def coerce(raw: DataFrame) -> DataFrame:
    """Findings from loosely typed rows (a model's reply): missing columns get their defaults, bad values too."""
    have = set(raw.columns)
    get = lambda c, default=None: F.col(c) if c in have else F.lit(default)
    text = lambda c: tidy(F.coalesce(get(c).cast("string"), F.lit("")))
    return raw.select(
        text("rule_id").alias("rule_id"), enum(get("category", ""), CATEGORIES, "logic").alias("category"), enum(get("severity", ""), SEVERITIES, "medium").alias("severity"),
        *[text(c).alias(c) for c in ("title", "path")], line_number(get("line_start").cast("string")).alias("line_start"),
        *[text(c).alias(c) for c in ("evidence", "analysis", "fix")], clamp(get("confidence").cast("string")).alias("confidence"),
        get("line_end").cast("string").try_cast("int").alias("line_end"), get("function_name").cast("string").alias("function_name"),
        *[text(c).alias(c) for c in ("impact", "source")], F.coalesce(get("detector").cast("string"), F.lit("static")).alias("detector"),
        F.coalesce(get("verified").cast("boolean"), F.lit(False)).alias("verified"), F.coalesce(get("votes").cast("int"), F.lit(1)).alias("votes"),
        F.coalesce(get("models").cast("array<string>"), F.array().cast("array<string>")).alias("models"),
    )
