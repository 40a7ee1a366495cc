"""Findings against ground truth: clusters, precision, recall, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clusters(f: DataFrame, gap: int = 3) -> DataFrame:
    """f(path, line_start, line_end, pos) + cluster: a new one where a row begins more than gap behind the end of the row before (that row's only)."""
    w = Window.partitionBy("path").orderBy("line_start", "pos")
    before = F.lag(F.coalesce("line_end", "line_start")).over(w)
    new = F.when(before.isNull() | (F.col("line_start") - before > gap), 1).otherwise(0)
    return f.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w)).drop("_new")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision and recall (1 without a denominator) and F1 (0 without one)."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(1.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def first_match(cl: DataFrame, expected: DataFrame, reach: int = 2, step: int = 64) -> DataFrame:
    """cl(path, cluster, lo, hi, keys), expected(path, key, line, ord): for each cluster the first expected row within reach whose key it holds.

    Both sides meet on path, key and a bin of step lines, so a path with many of both makes no more pairs than lie close.
    """
    bins = F.sequence(F.floor((F.col("lo") - reach) / step), F.floor((F.col("hi") + reach) / step))
    spans = cl.withColumn("_bin", F.explode(bins)).withColumn("_key", F.explode(F.array_distinct("keys")))
    wanted = expected.withColumns({"_bin": F.floor(F.col("line") / step), "_key": F.col("key")})
    hit = spans.join(wanted, ["path", "_key", "_bin"]).where(F.col("line").between(F.col("lo") - reach, F.col("hi") + reach)).drop("_key", "_bin")
    n = F.row_number().over(Window.partitionBy("path", "cluster").orderBy("ord"))
    return hit.withColumn("n", n).where("n = 1").drop("n")


def nearest(f: DataFrame, g: DataFrame, reach: int = 3) -> DataFrame:
    """f(path, line, id), g(path, line, id): for each row of f the nearest of g within reach, ties to the smaller line, then id."""
    spread = f.select("path", F.col("line").alias("f_line"), F.col("id").alias("f_id"), F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach)).alias("line"))
    hit = spread.join(g.select("path", "line", F.col("id").alias("g_id")), ["path", "line"])
    delta = F.abs(F.col("line") - F.col("f_line"))
    n = F.row_number().over(Window.partitionBy("f_id").orderBy(delta, "line", "g_id"))
    return hit.select("f_id", "g_id", delta.alias("delta"), n.alias("n")).where("n = 1").drop("n")


def against_baseline(truth: DataFrame, hits: DataFrame, on: list[str]) -> DataFrame:
    """truth(on, verdict, pattern), hits(on): per pattern the true kept and lost, the false that stay or are gone."""
    now = truth.join(hits.select(*on).distinct().withColumn("hit", F.lit(True)), on, "left")
    is_ = lambda v, hit: F.count_if((F.col("verdict") == v) & (F.col("hit").isNotNull() if hit else F.col("hit").isNull()))
    return now.groupBy("pattern").agg(is_("T", True).alias("kept_t"), is_("T", False).alias("lost_t"), is_("F", True).alias("still_fp"), is_("F", False).alias("removed_fp"))


def novel(truth: DataFrame, hits: DataFrame, on: list[str]) -> DataFrame:
    """Hits that no row of truth judges; nulls in on are alike."""
    known = truth.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return hits.join(known, reduce(lambda a, b: a & b, same), "left_anti")


def jaccard(runs: DataFrame, run: str, key: str) -> DataFrame:
    """For every two runs that share a key: shared, all keys of both, and their ratio. Others have 0; consistency() counts them."""
    d = runs.select(run, key).distinct()
    n = d.groupBy(run).agg(F.count("*").alias("n"))
    shared = d.alias("a").join(d.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{run}") < F.col(f"b.{run}")))
    shared = shared.groupBy(F.col(f"a.{run}").alias("run_a"), F.col(f"b.{run}").alias("run_b")).agg(F.count("*").alias("shared"))
    out = shared.join(n.toDF("run_a", "na"), "run_a").join(n.toDF("run_b", "nb"), "run_b")
    either = F.col("na") + F.col("nb") - F.col("shared")
    return out.select("run_a", "run_b", "shared", either.alias("either"), F.round(F.col("shared") / either, 6).alias("jaccard"))


def consistency(runs: DataFrame, run: str, key: list[str], rule: str, all_runs: DataFrame | None = None) -> DataFrame:
    """One row: runs, avg_pairwise (the mean Jaccard similarity of every two runs) and stable_rules (rules of keys that all runs have).

    Pairs without a common key count 0 and aren't formed; two empty runs count 1. all_runs(run): the runs, where some may
    have no row. A single run has the similarity 1, none 0.
    """
    whole = F.struct(*key)
    d = runs.select(run, whole.alias("_key"), F.col(rule).alias("_rule")).distinct()
    names = (runs if all_runs is None else all_runs).select(run).distinct()
    n = names.join(d.groupBy(run).agg(F.count("*").alias("n")), run, "left").agg(F.count("*").alias("runs"), F.count_if(F.col("n").isNull()).alias("empty"))
    near = jaccard(d.select(run, "_key"), run, "_key").agg(F.coalesce(F.sum(F.col("shared") / F.col("either")), F.lit(0.0)).alias("total"))
    common = d.groupBy("_key", "_rule").agg(F.count("*").alias("_n")).crossJoin(n.select("runs")).where("_n = runs")  # one row
    stable = common.agg(F.array_sort(F.collect_set("_rule")).alias("stable_rules"))
    pairs, empties = F.col("runs") * (F.col("runs") - 1) / 2, F.col("empty") * (F.col("empty") - 1) / 2
    mean = F.when(F.col("runs") == 0, 0.0).when(F.col("runs") == 1, 1.0).otherwise(F.round((F.col("total") + empties) / pairs, 3))
    return n.crossJoin(near).crossJoin(stable).select("runs", mean.alias("avg_pairwise"), "stable_rules")  # one row each


DEFECTS = ("security", "logic")


def score_run(f: DataFrame, expected: DataFrame, reach: int = 2) -> DataFrame:
    """f(path, line_start, line_end, pos, key, category), expected(path, key, line, ord) -> one row: tp, fp, fn, advisory, precision, recall, f1.

    Findings of a file that lie within reach + 1 lines of the one before are a cluster. A cluster takes the first
    expected row of its file, one of its keys and its lines, reach wider; more clusters may take the same. One that takes
    none is false if it has a security or logic finding, else advice. tp: expected rows taken, fn: the others.
    """
    c = clusters(f, reach + 1).groupBy("path", "cluster").agg(
        F.min("line_start").alias("lo"), F.max(F.coalesce("line_end", "line_start")).alias("hi"), F.collect_set("key").alias("keys"), F.max(F.col("category").isin(*DEFECTS)).alias("defect"),
    )
    m = first_match(c, expected, reach)
    left = c.join(m.select("path", "cluster"), ["path", "cluster"], "left_anti")
    n = m.agg(F.countDistinct("ord").alias("tp")).crossJoin(left.agg(F.count_if("defect").alias("fp"), F.count_if(~F.col("defect")).alias("advisory"))).crossJoin(expected.agg(F.count("*").alias("expected")))  # one row each
    n = n.selectExpr("tp", "fp", "expected - tp fn", "advisory")
    p, r, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select("*", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"))


def average_runs(scores: DataFrame, same: list[str]) -> DataFrame:
    """scores, a row a run -> runs, the means of precision, recall and f1, and whether all runs agree in the columns of same."""
    return scores.agg(F.count("*").alias("runs"), *(F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")), (F.countDistinct(F.struct(*same)) == 1).alias("stable"))


def planted(manifest: DataFrame, hits: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """manifest(id, lib, file, start, end, expect), hits(lib, file, line, rule, evidence) -> id, expect, result.

    Hits in the planted lines, one wider, count. hit_located: one is of the rule expected and its evidence holds a word
    of located(rule, word); hit_unlocated: the rule only; MISS: none. Rows whose expect begins with TRAP, not widened,
    are trap_clean or TRAP_BREACH. Lines are spread over the planted ones, so the join is on equal keys.
    """
    trap = F.startswith("expect", F.lit("TRAP"))
    pad = F.when(trap, 0).otherwise(1)
    spread = manifest.select("id", "lib", "file", "expect", F.explode(F.sequence(F.col("start") - pad, F.col("end") + pad)).alias("line"))
    near_ = spread.join(hits, ["lib", "file", "line"])
    if located is None:
        near_ = near_.withColumn("named", F.lit(False))
    else:
        words = located.groupBy("rule").agg(F.collect_set("word").alias("words"))
        near_ = near_.join(words, "rule", "left").withColumn("named", F.coalesce(F.exists("words", lambda w: F.contains("evidence", w)), F.lit(False)))
    right = F.col("rule") == F.col("expect")
    got = near_.groupBy("id").agg(F.max(right).alias("hit"), F.max(right & F.col("named")).alias("at"), F.count("*").alias("n"))
    result = F.when(trap, F.when(F.coalesce("n", F.lit(0)) > 0, "TRAP_BREACH").otherwise("trap_clean")).when(F.col("at"), "hit_located").when(F.col("hit"), "hit_unlocated").otherwise("MISS")
    return manifest.join(got, "id", "left").select("id", "expect", result.alias("result"))


def planted_recall(results: DataFrame) -> DataFrame:
    """results of planted -> expect, n, hit, located for every rule that was planted; traps don't count."""
    rows = results.where(~F.startswith("expect", F.lit("TRAP")))
    return rows.groupBy("expect").agg(F.count("*").alias("n"), F.count_if(F.startswith("result", F.lit("hit"))).alias("hit"), F.count_if(F.col("result") == "hit_located").alias("located"))


def adjudication_rows(hits: DataFrame, truth: DataFrame, rules: DataFrame, graded: list[str]) -> DataFrame:
    """hits(file, line, rule, evidence) whose rule begins with one of graded or DISCOVERED-CWE -> hits + title, why, gt, pattern.

    gt is the verdict of truth(file, line, rule, verdict, pattern), O without one; a rule without title has its id.
    """
    kept = hits.where(F.exists(F.array(*map(F.lit, [*graded, "DISCOVERED-CWE"])), lambda p: F.startswith("rule", p)))
    out = kept.join(truth.select("file", "line", "rule", F.col("verdict").alias("gt"), "pattern"), ["file", "line", "rule"], "left").join(rules.select("rule", "title", "why"), "rule", "left")
    fill = {"title": F.col("rule"), "why": F.lit(""), "gt": F.lit("O"), "pattern": F.lit("")}
    return out.withColumns({c: F.coalesce(c, v) for c, v in fill.items()})


def adjudication_summary(rows: DataFrame) -> DataFrame:
    """rows(gt, real: kept by the model) -> one row: T, F and precision before and after, fp_killed, lost_t, novel_kept."""
    is_ = lambda v, real=None: F.count_if((F.col("gt") == v) & (F.lit(True) if real is None else F.coalesce("real", F.lit(False)) == real))
    p = lambda t, f: F.round(F.try_divide(t, t + f), 3)
    return rows.agg(
        F.count("*").alias("n"), is_("T").alias("t_before"), is_("F").alias("f_before"), p(is_("T"), is_("F")).alias("precision_before"),
        is_("T", True).alias("t_after"), is_("F", True).alias("f_after"), p(is_("T", True), is_("F", True)).alias("precision_after"),
        is_("F", False).alias("fp_killed"), is_("T", False).alias("lost_t"), is_("O", True).alias("novel_kept"),
    )


def tool_totals(rows: DataFrame) -> DataFrame:
    """rows(tool, lib, findings, t, f) -> per tool the sums over libs and t / (t + f)."""
    t, f = F.sum("t"), F.sum("f")
    return rows.groupBy("tool").agg(F.sum("findings").alias("findings"), t.alias("t"), f.alias("f"), F.round(F.try_divide(t, t + f), 3).alias("precision"))


def decision_counts(rows: DataFrame, decisions: tuple[str, ...] = ("pending", "adopt", "reject")) -> DataFrame:
    """rows(decision) -> one row: total and the count of each decision."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("decision") == d).alias(d) for d in decisions))


def flips(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """a, b(on, verdict): how many common rows, and how many changed."""
    pair = a.select(*on, F.col("verdict").alias("va")).join(b.select(*on, F.col("verdict").alias("vb")), on)
    changed = F.count_if(~F.col("va").eqNullSafe(F.col("vb")))
    return pair.agg(F.count("*").alias("common"), changed.alias("changed"), F.round(F.try_divide(changed, F.count("*")), 6).alias("rate"))


def verdict_pivot(rows: DataFrame, by: str) -> DataFrame:
    """Counts of T, F and ? per group, and T / (T + F). Other verdicts, null ones too, are ?."""
    rows = rows.withColumn("verdict", F.when(F.col("verdict").isin("T", "F"), F.col("verdict")).otherwise("?"))
    p = rows.groupBy(by).pivot("verdict", ["T", "F", "?"]).agg(F.count(F.lit(1)))
    t, f = F.coalesce("T", F.lit(0)), F.coalesce("F", F.lit(0))
    return p.select(by, t.alias("t"), f.alias("f"), F.coalesce("?", F.lit(0)).alias("open"), F.round(F.try_divide(t, t + f), 6).alias("precision"))


def recall_at_k(ranked: DataFrame, k: int) -> DataFrame:
    """ranked(query_id, grp, rank, good): the share of queries with a good row among the first k, per group."""
    per = ranked.where(F.col("rank") <= k).groupBy("grp", "query_id").agg(F.max(F.col("good").cast("int")).alias("hit"))
    return per.groupBy("grp").agg(F.count("*").alias("queries"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("recall"))


def nested_top(rows: DataFrame, group: str, n_groups: int, n_rows: int, order: str) -> DataFrame:
    """The n_groups largest groups and of each the first n_rows by order."""
    top = rows.groupBy(group).agg(F.count("*").alias("size")).orderBy(F.desc("size"), group).limit(n_groups)
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.join(top, group).withColumn("n", n).where(F.col("n") <= n_rows)
