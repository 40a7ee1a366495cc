"""URL filter by a path-template tree (operator 1), with DataFrame functions only.

Per host, the paths of all URLs form a tree of segments. A segment's runs of digits and long hexadecimal runs are
first written as ``#``; equal shapes are then counted, so the tree is built over counts and a host that holds a
third of all URLs is no larger than its shapes. From the root on, each round

* steps over the segments that all shapes below a node share, and ends the nodes with one shape: a round is needed per
  branching, not per segment, whatever the depth of a path;
* writes ``*`` for the children of a node that are nearly as many as its URLs: such a segment is variable;
* else puts children together that are alike statistically: a child's categories are the shapes of what follows;
  children with the same most frequent one are pooled, and those that a chi-square test doesn't tell from their pool
  become one branch, ``~name`` after its first member. Where labels of both kinds are in a pool, they are tested too:
  a blocked branch doesn't join an allowed one, and an unlabelled branch can join either.

The rules label URLs: block, allow, or none. A template's purity is (blocked + strength * prior) / (labelled +
strength), over the labelled URLs of all branches that it took in: few labels leave it near the prior, which is low, so
that a template without labels is kept. One at or above the threshold is rejected. A URL that a rule fits gets the
rule's verdict, any other that of its template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stage, table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^([^?#]*)", 1)
    return lower_ascii(raw), path


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits host (or a domain above it) and the path's start, as struct(rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def shapes(path: Column) -> Column:
    """Segments with runs of digits and of 8 or more hexadecimal digits as #."""
    plain = F.regexp_replace(F.regexp_replace(path, "(?i)(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])", "#"), "[0-9]+", "#")
    return F.split(F.regexp_replace(plain, "^/", ""), "/")


TREE = ("host", "shape", "rest", "prefix", "n", "bad", "good")


def _stepped(t: DataFrame) -> DataFrame:
    """t with what all shapes of a node share moved from rest to prefix; all of it where the node has one shape."""
    node = t.groupBy("host", "prefix").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    same = F.zip_with(F.slice("lo", 1, F.least(F.size("lo"), F.size("hi"))), F.slice("hi", 1, F.least(F.size("lo"), F.size("hi"))), lambda a, b: a == b)
    first = F.coalesce(F.array_position(same, False).cast("int"), F.lit(0))
    shared = F.when(F.col("lo") == F.col("hi"), F.size("lo")).otherwise(F.when(first > 0, first - 1).otherwise(F.size(same)))
    out = t.join(node.select("host", "prefix", shared.alias("k")), ["host", "prefix"])
    more = F.when(F.col("k") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", 1, F.col("k")), "/"))).otherwise("")
    left = F.slice("rest", F.col("k") + 1, F.size("rest"))
    return out.select("host", "shape", left.alias("rest"), F.concat("prefix", more).alias("prefix"), "n", "bad", "good")


def _branched(t: DataFrame, min_children: int, variable: float, z: float) -> DataFrame:
    """t, no rest empty, with its prefix grown by the branch that the first segment belongs to."""
    key = ["host", "prefix"]
    cat = F.concat(F.when(F.size("rest") == 1, ".").otherwise("/"), F.array_join(F.slice("rest", 2, F.size("rest")), "/"))
    c = t.groupBy(*key, F.element_at("rest", 1).alias("seg"), cat.alias("cat")).agg(*(F.sum(x).alias(x) for x in ("n", "bad", "good")))
    child = c.groupBy(*key, "seg").agg(F.sum("n").alias("nc"), F.sum("bad").alias("b"), F.sum("good").alias("g"), F.max(F.struct("n", "cat"))["cat"].alias("mode"))
    node = child.groupBy(*key).agg((F.count("*") >= min_children).alias("many"), (F.count("*") >= variable * F.sum("nc")).alias("nearly"))
    pool = c.join(child.select(*key, "seg", "nc", "mode"), [*key, "seg"])
    by_cat = pool.groupBy(*key, "mode", "cat").agg(F.sum("n").alias("np"))
    total = by_cat.groupBy(*key, "mode").agg(F.sum("np").alias("nt"), (F.count("*") - 1).alias("df"))
    shape = pool.join(by_cat, [*key, "mode", "cat"]).groupBy(*key, "mode", "seg", "nc").agg(F.sum(F.col("n") * F.col("n") / F.col("np")).alias("s"))
    labels = child.groupBy(*key, "mode").agg(F.sum("b").alias("pb"), F.sum("g").alias("pg"))
    chi = child.join(shape.drop("nc"), [*key, "mode", "seg"]).join(total, [*key, "mode"]).join(labels, [*key, "mode"])
    both, own, every = (F.col("pb") > 0) & (F.col("pg") > 0) & (F.col("b") + F.col("g") > 0), F.col("b") + F.col("g"), F.col("pb") + F.col("pg")
    told = F.when(both, every / own * (F.col("b") * F.col("b") / F.col("pb") + F.col("g") * F.col("g") / F.col("pg")) - own).otherwise(0.0)
    df = F.col("df") + F.when(both, 1).otherwise(0)
    chi = chi.select(*key, "mode", "seg", (F.col("s") * F.col("nt") / F.col("nc") - F.col("nc") + told <= df + z * F.sqrt(2.0 * df) + 1e-9).alias("alike"))
    group = chi.where("alike").groupBy(*key, "mode").agg(F.min("seg").alias("name"), F.count("*").alias("k"))
    branch = chi.join(group, [*key, "mode"], "left").join(node, key)
    name = F.when(F.col("many") & F.col("nearly"), "*").when(F.col("alike") & (F.col("k") > 1), F.concat(F.lit("~"), "name")).otherwise(F.col("seg"))
    grown = t.withColumn("seg", F.element_at("rest", 1)).join(branch.select(*key, "seg", name.alias("branch")), [*key, "seg"])
    return grown.select("host", "shape", F.slice("rest", 2, F.size("rest")).alias("rest"), F.concat("prefix", F.lit("/"), "branch").alias("prefix"), "n", "bad", "good")


def templates(urls: DataFrame, min_children: int = 8, variable: float = 0.5, z: float = 2.33) -> DataFrame:
    """urls(host, path, label) -> host, shape, template, n, bad, good: a row per host and shape, with its URLs and the blocked and allowed ones."""
    is_ = lambda x: F.sum((F.col("label") == x).cast("long"))
    t = urls.groupBy("host", shapes(F.col("path")).alias("rest")).agg(F.count("*").alias("n"), is_("block").alias("bad"), is_("allow").alias("good"))
    t = stage(t.select("host", F.array_join("rest", "/").alias("shape"), "rest", F.lit("").alias("prefix"), "n", "bad", "good"), "url-shapes")
    done = []
    while True:
        t = stage(_stepped(t), "url-steps")
        done.append(t.where(F.size("rest") == 0))
        t = t.where(F.size("rest") > 0)
        if t.isEmpty():
            break
        t = stage(_branched(t, min_children, variable, z), "url-branches")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("host", "shape", F.col("prefix").alias("template"), "n", "bad", "good")


def judge(pages: DataFrame, rules=RULES, strength: float = 4.0, prior: float = 0.2, threshold: float = 0.5, **tree) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, template, purity, by_rule: one row per row of pages.

    Null, empty and unparsable URLs have the empty host and path, and so one template. Rows that repeat count as often
    as they occur and get the same verdict; URLs of any length are taken whole. Columns besides page_id and url are not
    read. An empty table gives no rows. by_rule: the verdict is a rule's, not the template's.
    """
    host, path = parse(F.col("url"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule)
    urls = urls.withColumn("label", F.coalesce("r.verdict", F.lit("none")))
    t = stage(templates(urls, **tree), "url-templates")
    both = t.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    both = both.select("host", "template", ((F.col("bad") + strength * prior) / (F.col("bad") + F.col("good") + strength)).alias("purity"))
    by_shape = t.select("host", "shape", "template").join(both, ["host", "template"])
    out = urls.withColumn("shape", F.array_join(shapes(F.col("path")), "/")).join(by_shape, ["host", "shape"])
    verdict = F.coalesce("r.verdict", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity", F.col("r.rule").isNotNull().alias("by_rule"))


def op1_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op1_url_tree": op1_url_tree}
SQL: dict[str, str] = {}
