"""Secrets by entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def shannon(col: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))


# Placeholders, what is no secret by its beginning, and how a line is taken out.
PLACEHOLDER = r"(?i)(example|placeholder|your[_-]?|xxxx|changeme|dummy|sample|test[_-]?key|<|\{\{|\$\{)"
SUPPRESS = r"#\s*(noqa|nosec)\b|//\s*(eslint-disable|nosec)\b"
LITERAL = r"""(?<![\w])["'`]([^"'`\n]{16,200})["'`]"""


def secret_like(col: Column, min_len: int = 20) -> Column:
    """Long, in one piece, with letters and digits, no URL, path, placeholder or plain digest."""
    digest = F.rlike(col, F.lit("^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"))
    return (
        (F.length(col) >= min_len) & ~F.rlike(col, F.lit(r"[ \t/\\]")) & ~F.rlike(col, F.lit(PLACEHOLDER)) & ~F.startswith(col, F.lit("data:"))
        & ~digest & F.rlike(col, F.lit(r"\p{L}")) & F.rlike(col, F.lit(r"\p{N}"))
    )


def entropy_findings(rows: DataFrame, least: float = 3.5) -> DataFrame:
    """rows(path, line_no, line): quoted literals that look like secrets; comment and suppressed lines don't count."""
    rows = rows.where(~F.rlike(strip(F.col("line")), F.lit(r"^(#|//|\*)")) & ~F.rlike("line", F.lit(SUPPRESS)))
    out = rows.select("path", "line_no", F.explode(F.regexp_extract_all("line", F.lit("(?U)" + LITERAL), 1)).alias("literal"))
    out = out.where(secret_like(F.col("literal"))).withColumn("entropy", shannon(F.col("literal"))).where(F.col("entropy") >= least)
    return out.select("path", F.col("line_no").alias("line_start"), F.lit("R-SEC-ENTROPY").alias("rule_id"), "literal", "entropy", F.lit(0.6).alias("confidence"))
