"""Mixing sources to target weights by Pareto order sampling (operator 6).

A source is to give target words of its source_size. A document's expected copies rise with its length: level * f, with
f the root of its size, but not above cap; the level is the one at which the expected words are the target. The whole
part of that is given for certain. The rest, an inclusion probability p, is drawn as one Pareto sample: documents are
ranked by the odds of a uniform number u over the odds of their p, and the smallest ranks enter until the words they
bring come nearest to what is still due. The uniform number is a hash of the id and the seed, so reruns agree.

A rank r is kept as r / (1 + r), which lies between 0 and 1. The cut through a source's ranking is found without sorting
the source: ranks fall into bins, words are summed by bin, and only the bin that holds the cut is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stage, table

WEIGHTS, SHARE, CAP, BINS, SEED, SALTS = (5.0, 2.0, 1.0), 1.5, 2.0, 1 << 16, "mix-1", 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes(source, size) -> source, source_size, target.

    Sources in code point order, null last, take the weights in turn. They divide share of all words by weight; a
    target stops at cap times its source's size and the excess is shared again by weight, until none is above.
    That ends where target = min(cap * size, level * weight), with the level found by taking sources in the order
    in which they reach their cap. One row per source is all that meets in one task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = by.select("source", "source_size", w.alias("w"), (F.lit(cap) * F.col("source_size")).alias("most"))
    full = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    every = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    )
    level = F.first(F.when(F.col("left") / F.col("w_left") <= F.col("most") / F.col("w"), F.col("left") / F.col("w_left")), ignorenulls=True).over(every)
    return by.select("source", "source_size", F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("w")).alias("target"))


def source_levels(sizes: DataFrame, goal: DataFrame, cap: float = CAP) -> DataFrame:
    """sizes(source, size), goal of source_targets -> source, source_size, target, level (infinite where all reach cap).

    f is a whole number, 1024 times the root of the size, and all sums are of whole numbers, so they don't depend on
    their order. Documents reach the cap from the largest down; a row for each size of a source meets in one task.
    """
    f = F.floor(1024 * F.sqrt("size")).cast("decimal(38,0)")
    words = (F.count("*") * F.col("size")).cast("decimal(38,0)")
    by = sizes.where("size > 0").groupBy("source", "size").agg(words.alias("words")).select("source", "size", "words", f.alias("f"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    up = down.rowsBetween(0, Window.unboundedFollowing)
    by = by.select("source", "f", (F.sum("words").over(down) - F.col("words")).cast("double").alias("capped"), F.sum((F.col("words") * F.col("f")).cast("decimal(38,0)")).over(up).cast("double").alias("rest"), "size")
    at = by.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    level = (F.col("g.target") - F.lit(cap) * F.col("b.capped")) / F.col("b.rest")
    at = at.select("g.source", "b.size", level.alias("level"), (level * F.col("b.f").cast("double") <= cap).alias("ok"))
    found = at.where("ok").groupBy("source").agg(F.max(F.struct("size", "level"))["level"].alias("level"))
    both = goal.alias("g").join(found.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")), "left")
    level = F.when(F.col("g.target") >= F.lit(cap) * F.col("g.source_size") * (1 - 1e-12), F.lit(float("inf"))).otherwise(F.coalesce("f.level", F.lit(float("inf"))))
    return both.select("g.source", "g.source_size", "g.target", level.alias("level"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, bins: int = BINS, size: str | None = None) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, text_key, size, source_size, target, whole, p, copies: a row per row of docs.

    size: SQL for a document's size; by default its words (null or empty text: 0). text_key: a hash of the text,
    which with doc_id and source names the row. whole: the copies given for certain; p: the probability of one more. A document is copied cap
    times at most, rounded up, and whole. Documents of no size are never taken. Equal ids have equal u: those on the cut
    are told apart by text; rows that are alike in all are interchangeable. Null ids share one u. Other columns are not
    read; texts of any length are counted whole; an empty table gives no rows.
    """
    word_count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if size is None else F.expr(size)
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double")
    rows = docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), word_count.cast("long").alias("size"), ((u + 0.5) / F.lit(float(16**13))).alias("u"))
    rows = stage(rows, "mix-sizes")
    goal = stage(source_levels(rows, source_targets(rows, weights, share, cap), cap), "mix-levels")
    # A source can hold a third of all rows: what is known of it goes to SALTS places, its rows to one of them.
    places = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    salt = F.floor(F.col("r.u") * SALTS).cast("int")
    f = F.floor(1024 * F.sqrt("r.size")).cast("double")
    e = F.when(F.col("r.size") > 0, F.when(F.col("g.level") == float("inf"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("g.level") * f))).otherwise(0.0)
    rows = rows.alias("r").join(places(goal).alias("g"), same("r", "g") & (salt == F.col("g.salt"))).select("r.*", "g.source_size", "g.target", e.alias("e"))
    rows = rows.select("doc_id", "source", "text_key", "size", "u", "source_size", "target", F.floor("e").alias("whole"), (F.col("e") - F.floor("e")).alias("p"))
    rank = F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p"))
    rows = stage(rows.select("*", F.when(F.col("p") > 0, rank).alias("t")), "mix-ranks")
    sure = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    sure = stage(sure.select("source", (F.col("target") - F.col("sure")).alias("due")), "mix-due")
    bin_ = F.floor(F.col("t") * bins)
    binned = rows.where("t is not null").groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("words"))
    at = binned.select("*", (F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")).alias("before"))
    due = F.col("g.due")
    at = at.alias("a").join(sure.alias("g"), same("a", "g")).where((F.col("before") < due) & (due <= F.col("before") + F.col("words"))).select("g.source", "a.bin", "a.before", "g.due")
    inside = rows.where("t is not null").withColumn("bin", bin_).alias("r").join(at.alias("a"), same("r", "a") & (F.col("r.bin") == F.col("a.bin")))
    order = Window.partitionBy("source").orderBy("t", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.select("r.source", "doc_id", "text_key", "t", "size", "due", "before").withColumn("upto", F.col("before") + F.sum("size").over(order))
    # A document enters while the words due are not yet reached and it brings the sum nearer to them.
    inside = inside.where((F.col("upto") - F.col("size") < F.col("due")) & (F.abs(F.col("upto") - F.col("due")) < F.abs(F.col("upto") - F.col("size") - F.col("due"))))
    last = inside.groupBy("source").agg(F.max(F.struct("t", "doc_id", "text_key")).alias("cut"))
    # Where no bin holds the cut, the words due are none, or (by rounding) all there are.
    ends = rows.where("t is not null").groupBy("source").agg(F.sum("size").alias("all"))
    cut = sure.alias("g").join(at.alias("a"), same("g", "a"), "left").join(last.alias("l"), same("g", "l"), "left").join(ends.alias("n"), same("g", "n"), "left")
    upper = F.when(F.col("a.bin").isNotNull(), F.col("a.bin")).when(F.col("g.due") > F.col("n.all"), F.lit(bins + 1)).otherwise(-1)
    cut = places(cut.select("g.source", upper.cast("long").alias("bin"), "l.cut"))
    key = F.struct("r.t", "r.doc_id", "r.text_key")
    inner = F.coalesce(F.floor(F.col("r.t") * bins) < F.col("c.bin"), F.lit(False)) | F.coalesce((F.floor(F.col("r.t") * bins) == F.col("c.bin")) & (key <= F.col("c.cut")), F.lit(False))
    return rows.alias("r").join(cut.alias("c"), same("r", "c") & (salt == F.col("c.salt"))).select("r.doc_id", "r.source", "r.text_key", "r.size", "r.source_size", "r.target", "r.whole", "r.p", (F.col("r.whole") + inner.cast("long")).alias("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op6_mixing": op6_mixing}
SQL = {
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS wt FROM s),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY most / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM w),
v AS (SELECT *, first_value(CASE WHEN rest / w_left <= most / wt THEN rest / w_left END IGNORE NULLS) OVER (ORDER BY most / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev FROM l),
g AS (SELECT source, source_size, least(most, coalesce(lev, 'infinity'::DOUBLE) * wt) AS target FROM v),
z AS (SELECT source, size, count(*) * size AS words, floor(1024 * sqrt(size::DOUBLE))::HUGEINT AS f FROM d WHERE size > 0 GROUP BY source, size),
c AS (SELECT source, size, f, coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
             sum(words * f) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS left_over FROM z),
t AS (SELECT g.source, arg_max((target - 2.0::DOUBLE * capped) / left_over, size) AS level
      FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
      WHERE (target - 2.0::DOUBLE * capped) / left_over * f::DOUBLE <= 2.0::DOUBLE GROUP BY g.source),
h AS (SELECT g.*, CASE WHEN target >= 2.0::DOUBLE * source_size * (1 - 1e-12::DOUBLE) THEN 'infinity'::DOUBLE ELSE coalesce(level, 'infinity'::DOUBLE) END AS level
      FROM g LEFT JOIN t ON g.source IS NOT DISTINCT FROM t.source),
e AS (SELECT d.*, source_size, target,
             CASE WHEN size = 0 THEN 0.0::DOUBLE WHEN isinf(level) THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, level * floor(1024 * sqrt(size::DOUBLE))) END AS e
      FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
p AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM e),
k AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS due FROM p),
r AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, text_key ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, source_size, target,
       (size * (whole + (p > 0 AND upto - size < due AND abs(upto - due) < abs(upto - size - due))::BIGINT))::BIGINT AS taken
FROM r"""
}
