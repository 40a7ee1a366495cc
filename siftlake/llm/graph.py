"""Connected components as alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """edges(a, b): any order, loops and repeats allowed -> (node, component): the smallest id reachable.

    Large-star and small-star steps alternate: every node links its larger (then smaller) neighbours to its
    smallest one, until each component is one star. Each step is a minimum per node, which combines before the
    shuffle, and an equi-join that adaptive execution can split, so a hub never meets in one task. Nulls are
    dropped. rows: about how many edges there are. Nodes without edges do not appear. The rounds needed grow with the logarithm of a component's size.
    """
    a, b = F.col("a"), F.col("b")
    e = stage(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges", rows)
    print_of = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    last = print_of(e)
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy(a.alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where(b > a).join(low, a == F.col("k")).select(b.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(a.alias("k")).agg(F.min("b").alias("m"))
        small = large.join(low, a == F.col("k")).select(F.col("a"), F.col("b"), F.col("m"))
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        e = stage(small.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), "edges", last[0])
        now = print_of(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(a.alias("node"), b.alias("component")).union(e.select(b, b)).distinct()
