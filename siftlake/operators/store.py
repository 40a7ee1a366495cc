"""Rules and knowledge items that users keep: checks, upserts, packs, previews."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from ..functions.text import checksum, valid_id
from ..schema import CATEGORIES, SEVERITIES


@F.pandas_udf(BooleanType())
def compiles(patterns: pd.Series) -> pd.Series:
    """Whether a pattern is one; null and empty ones aren't."""
    def ok(p) -> bool:
        try:
            return bool(p) and bool(re.compile(p))
        except (re.error, OverflowError, RecursionError):
            return False

    return patterns.map(ok)


def checked(new: DataFrame, builtin: DataFrame) -> DataFrame:
    """new(id, title, severity, category, ...) + reason: what speaks against a row (id, title, pattern, severity, category, builtin), else empty.

    Severity and category are looked at in lower case. Ids of builtin rows can't be taken. Rows with a pattern are rules:
    it must be there and compile. A null id, title, severity or category speaks against its row.
    """
    rule = ~compiles("pattern") if "pattern" in new.columns else F.lit(False)
    given = builtin.select(F.col("id").alias("_b")).distinct()
    rows = new.join(given, F.trim("id") == F.col("_b"), "left")
    reason = (
        F.when(~F.coalesce(valid_id(F.trim("id")), F.lit(False)), "id").when(F.trim(F.coalesce("title", F.lit(""))) == "", "title")
        .when(rule, "pattern")
        .when(~F.coalesce(F.lower("severity").isin(*SEVERITIES), F.lit(False)), "severity").when(~F.coalesce(F.lower("category").isin(*CATEGORIES), F.lit(False)), "category")
        .when(F.col("_b").isNotNull(), "builtin").otherwise("")
    )
    return rows.withColumn("reason", reason).drop("_b")


def upsert(stored: DataFrame, new: DataFrame, builtin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Custom rows with the accepted ones of new(pos, ...) in the place of those of their id (the last of an id wins), and what became of each new row: id, reason, created."""
    told = checked(new, builtin)
    good = told.where("reason = ''")
    last = good.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("pos")))).where("_n = 1")
    kept = stored.join(last.select("id"), "id", "left_anti")
    log = told.join(stored.select("id").distinct().withColumn("_had", F.lit(True)), "id", "left")
    return kept.unionByName(last.select(stored.columns)), log.select("id", "reason", ((F.col("reason") == "") & F.col("_had").isNull()).alias("created"))


def delete(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Custom rows without those of ids(id)."""
    return stored.join(ids.select("id").distinct(), "id", "left_anti")


def listed(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """All rows, with whether they are builtin."""
    return builtin.withColumn("builtin", F.lit(True)).unionByName(custom.withColumn("builtin", F.lit(False)), allowMissingColumns=True)


#: Digits of a leaf's hash that name its node on each level of the tree.
LEVELS = (8, 6, 4, 2, 0)


def canonical(rows: DataFrame) -> Column:
    """A row as JSON, columns in order of name, nulls kept."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"})


def tree_hash(rows: DataFrame, level: int = 0) -> DataFrame:
    """The nodes of a hash tree over rows: at (digits), hash, n (rows below). Level 0 is the root, one row; none without rows.

    A leaf is a distinct row with how often it occurs. The digits of its hash deal it, so the tree depends neither on
    order nor on partitions; a node has at most 256 children, and those of the lowest level share 8 digits. Of two
    packs only the nodes that differ need a look.
    """
    text = canonical(rows)
    leaf = F.sha2(F.concat("text", F.lit("#"), F.col("n").cast("string")), 256)
    nodes = rows.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("n")).select(leaf.alias("at"), leaf.alias("hash"), "n")
    for digits in LEVELS[: LEVELS.index(level) + 1]:
        below = F.array_sort(F.collect_list(F.struct("at", "hash")))
        nodes = nodes.groupBy(F.substring("at", 1, digits).alias("at")).agg(below.alias("below"), F.sum("n").alias("n"))
        nodes = nodes.select("at", F.sha2(F.array_join(F.transform("below", lambda b: b["hash"]), ""), 256).alias("hash"), "n")
    return nodes


def pack_checksum(rows: DataFrame) -> DataFrame:
    """One row: kind, rows and checksum of a pack, the root of its rows' hash tree; of no rows the hash of nothing."""
    root = tree_hash(rows).agg(F.coalesce(F.max("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("hash"))
    return root.select(F.lit("pack").alias("kind"), "rows", F.substring("hash", 1, 32).alias("checksum"))


def pack_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, a, b: the canonical rows that two packs don't hold equally often, and how often each does. Only rows below nodes of two digits that differ are compared."""
    names = lambda d: tree_hash(d, 2).select("at", "hash")
    one, two = names(a), names(b).withColumnRenamed("hash", "other")
    apart = one.join(two, "at", "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select("at")

    def leaves(d: DataFrame, side: str) -> DataFrame:
        rows = d.select(canonical(d).alias("row")).groupBy("row").agg(F.count("*").alias(side))
        at = F.substring(F.sha2(F.concat("row", F.lit("#"), F.col(side).cast("string")), 256), 1, 2)
        return rows.withColumn("at", at).join(F.broadcast(apart), "at", "left_semi").drop("at")  # 256 nodes at most

    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return leaves(a, "a").join(leaves(b, "b"), "row", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("row", zero("a"), zero("b"))


#: What a pack says it is, and the version written.
KIND, VERSION = "rule-pack", 2


def _sum(rules: DataFrame, items: DataFrame) -> str:
    """The checksum of both halves of a pack."""
    both = "".join(pack_checksum(half).first().checksum for half in (rules, items))
    return hashlib.sha256(both.encode()).hexdigest()[:32]


def _own(rows: DataFrame) -> DataFrame:
    """Custom rows without what tells where they were kept."""
    rows = rows.where(~F.coalesce("builtin", F.lit(False))) if "builtin" in rows.columns else rows
    return rows.drop("builtin", "file", "place", "ord", "pos")


def write_pack(rules: DataFrame, items: DataFrame, path: str) -> str:
    """Custom rules and items as a pack: folders rules and items of JSON lines under path, then a head with kind, version, rows and checksum, which comes last, so that a pack without one is unfinished. The checksum is given back."""
    spark, rules, items = rules.sparkSession, _own(rules), _own(items)
    for name, rows in (("rules", rules), ("items", items)):
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
    told = _sum(*(spark.read.schema(rows.schema).json(f"{path}/{name}") for name, rows in (("rules", rules), ("items", items))))
    head = {"pack": KIND, "version": VERSION, "checksum": told, "rules_schema": rules.schema.json(), "items_schema": items.schema.json()}
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    return told


def read_pack(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules and items of a pack; ValueError if it isn't one or its rows don't have its checksum (an empty one isn't checked)."""
    try:
        head = json.loads(spark.read.text(f"{path}/head").first().value)
    except (ValueError, AttributeError) as e:
        raise ValueError("the pack has no head") from e
    if not isinstance(head, dict) or head.get("pack") != KIND:
        raise ValueError("this is no pack of rules and items")
    rules, items = (spark.read.schema(StructType.fromJson(json.loads(head[f"{n}_schema"]))).json(f"{path}/{n}") for n in ("rules", "items"))
    if head.get("checksum") and _sum(rules, items) != head["checksum"]:
        raise ValueError("the pack's checksum doesn't fit its rows")
    return rules, items


def import_pack(pack: DataFrame, claimed: str, stored: DataFrame, builtin: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """upsert() of a pack's rows if the checksum claimed for them is theirs (an empty claim isn't checked); else ValueError.

    dry_run: what would become of each row is told, with reason "dry run" where it would be taken, and nothing is stored.
    pack without pos: rows of one id go by their text, the last is taken.
    """
    if claimed and pack_checksum(pack.drop("pos")).first().checksum != claimed:
        raise ValueError("the pack's checksum doesn't fit its rows")
    if "pos" not in pack.columns:
        pack = pack.withColumn("pos", canonical(pack))
    rows, log = upsert(stored, pack, builtin)
    if not dry_run:
        return rows, log
    return stored, log.select("id", F.when(F.col("reason") == "", "dry run").otherwise(F.col("reason")).alias("reason"), F.lit(False).alias("created"))


def rules_fingerprint(rules: tuple) -> str:
    """16 digits that change with anything of the rules that bears on findings, as a cache's key has it."""
    text = json.dumps([{k: v for k, v in sorted(vars(r).items())} for r in rules], ensure_ascii=False, sort_keys=True)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def preview(rows: DataFrame, pattern: str, n: int = 20) -> DataFrame:
    """rows(path, line_no, line) -> path, line_no, found: the first n lines of each file that a pattern matches, and the first match, 60 characters of it."""
    hit = rows.where(F.rlike("line", F.lit(pattern))).withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("_k") <= n)
    return hit.select("path", "line_no", F.substring(F.regexp_extract("line", pattern, 0), 1, 60).alias("found"))
