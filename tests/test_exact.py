"""White space of all kinds, literals of patterns, folds, masking, call graph rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.functions import literals
from siftlake.functions import text as T
from siftlake.operators import entropy, graph, masks, replies, rules, scripts, validate
from siftlake.operators import lines as L
from pyspark.sql import functions as F

SOURCE = """def f(p):
{0}try:
{0}{0}go()
{0}except Exception:
{0}{0}clean()
{0}{0}raise
{0}# eval(y)
{0}h = open(p)
{0}h.close()
{0}try:
{0}{0}go()
{0}except:
{0}{0}logger.warning("x")
{0}x = eval(y)
"""


@pytest.mark.parametrize("gap", ["\t", "    ", "\u3000"])
def test_indent_by_any_white_space(spark, gap):
    rows = L.lines(spark.createDataFrame([("a.py", SOURCE.format(gap))], "path string, text string"))
    assert [(r.rule_id, r.line_start, r.evidence) for r in rules.scan(rows).orderBy("line_start").collect()] == [("R-LOG-001", 12, "except:"), ("R-SEC-003", 14, "x = eval(y)")]


def test_script_comments_behind_tabs(spark):
    rows = L.lines(spark.createDataFrame([("a.js", "\t/* eval(y)\neval(z)\n*/ eval(w)\n\t// eval(x)\n\teval(v)\n")], "path string, text string"))
    assert [r.line_start for r in rules.scan_js(rows).collect()] == [5]
    keys = L.lines(spark.createDataFrame([("a", '\t# k = "aB3dE5gH7jK9mN1pQ3"\n\tk = "aB3dE5gH7jK9mN1pQ3sT5"\n')], "path string, text string"))
    assert [r.line_start for r in entropy.entropy_findings(keys).collect()] == [2]


EVERY = [*(r.pattern for r in (*rules.PYTHON, *rules.JS)), *(g[0] for g in rules.GUARDS), "a?b*", "(?i:x)y", "[^a]b", "(ab|c)+d", "x{0,2}", "(?=q)r"]
BITS = sorted({x for p in EVERY for c in literals.needs(p)[1] for x in c} | {" ", "x", "=", ")", "K", "ſ", "A", ".", "'", "f\"", ":", "\t"})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=9).map("".join), st.booleans())
def test_no_match_without_its_literals(line, upper):
    line = line.upper() if upper else line
    for p in EVERY:
        if re.search(p, line):
            cased, clauses = literals.needs(p)
            have = line if cased else literals.plain_fold(line)
            assert all(any(x in have for x in c) for c in clauses), (p, line)


def test_candidates_hold_all_findings(spark):
    text = "\n".join([SOURCE.format("\t"), "é\x85os.system(x)\r\nPASSWORD = 'abcdefgh'\rİ paſſword='12345678'  is 'x'", "nothing"])
    texts = spark.createDataFrame([("a.py", text), ("b.py", None), ("c.py", ""), ("d.py", "\n\n")], "path string, text string")
    plain = rules.scan(L.lines(texts), block_checks=False)
    assert sorted(map(tuple, rules.scan_texts(texts).collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 6
    split = {(r.path, r.line_no): r.line for r in L.lines(texts).collect()}
    assert L.cut_lines(text)[0] == [split["a.py", k + 1] for k in range(sum(p == "a.py" for p, _ in split))]


def test_literals_of_patterns():
    assert literals.needs(r"os\.system\s*\(") == (True, (("os.system",), ("(",)))
    assert literals.needs(r"(?i)api_?key") == (False, (("api",), ("key",)))
    assert literals.needs(r"a*|b")[1] == () and literals.needs(r"(?i:a)b")[1] == ()


MASKS = [
    ('api_key = "AB+/=cdefgh;x"', 'api_key = "***[已掩码];x"'), ("p@ss!word päßwörter123", "p@ss!word päßwörter123"), ("sk-a_bcdefghij", "sk-a_b…[已掩码]"), ("token=sk-abcdefghij", "token=***[已掩码]"),
    ("Passwd:\n  hunter22 sk-abcdefghij sk-short", "Passwd:\n  ***[已掩码] sk-abc…[已掩码] sk-short"),
]


def test_masking(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MASKS)], "i int, t string").select("i", T.mask_secrets(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [b for _, b in MASKS]


def test_arrays_are_strict_json():
    assert replies.first_array('[{"a": "x\ny"}]') is None and replies.first_array('x [{"a": 1}] y') == '[{"a": 1}]'


GRAPH = """import os as o
class C:
    def m(self):
        self.n()
        C.n(self)
        f()
        print(1)
        list(map(lambda x: h(x), []))
    def n(self):
        def inner():
            h(2)
        class D:
            def deep(self):
                h(3)
        inner()
def f():
    h(1)
    (lambda: h(4))()
    unknown.h(5)
    m.h(6)
def h(x):
    h(x)
def print(x):
    pass
"""


def test_call_graph_rules(spark):
    facts = masks.facts(spark.createDataFrame([("m.py", GRAPH)], "path string, text string"))
    assert {r.fqn for r in graph.definitions(facts).collect()} == {"m.C.m", "m.C.n", "m.f", "m.h", "m.print"}
    got = sorted((r.caller, r.callee, r.line) for r in graph.call_edges(facts).collect())
    assert got == sorted([
        ("m.C.m", "m.C.n", 4), ("m.C.m", "m.C.n", 5), ("m.C.m", "m.f", 6), ("m.C.m", "m.h", 8), ("m.C.inner", "m.h", 11), ("m.D.deep", "m.h", 14), ("m.f", "m.h", 17), ("m.f", "m.h", 18), ("m.f", "m.h", 20)])
    stats = graph.graph_stats(facts).first()
    # print, list, map, inner(), the call of a lambda, unknown.h
    assert (stats.defs, stats.edges, stats.unresolved) == (5, 9, 6)


FINDING = "pos int, path string, rule_id string, line_start int, line_end int, detector string, verified boolean, fix string, confidence double, votes int, models array<string>, analysis string"


def test_dedupe_goes_one_by_one(spark):
    rows = [(i, "p", "R", 1, None if i else 9, d, False, "f", 0.5, i + 1, [f"m{i}"], "") for i, d in enumerate(["static", "llm", "static"])]
    rows += [(9, None, "R", 1, 0, None, True, None, 0.2, 1, None, "")]
    f = spark.createDataFrame(rows, FINDING)
    got = {r.path: r for r in validate.dedupe(f).collect()}
    assert (got["p"].detector, round(got["p"].confidence, 6), got["p"].votes, got["p"].models, got["p"].line_end, got["p"].pos) == ("both", 0.6, 6, ["m0", "m1", "m2"], 9, 1)
    assert got[None].confidence == 0.2 and len(got) == 2
    same = [(i, "p", "R", 1, 1, "static", False, "f", 0.5, 1, ["m"], "") for i in range(3)]
    assert validate.dedupe(spark.createDataFrame(same, FINDING), doubled=True).first().votes == 4
    assert validate.dedupe_combined(spark.createDataFrame(same, FINDING)).first().votes == 3
    assert validate.dedupe(f.limit(0)).count() == 0


def test_merge_is_one_by_one(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice("ab"), "R", s := r.randrange(40), r.choice([None, 0, s, s + 3, s + 9]), r.choice(["llm", "static", "llm", None]), r.random() < 0.5, "f", r.random(), r.randrange(3), r.choice([["m1"], ["m2"], [], None]), "x" * r.randrange(4)) for i in range(120)]
    out = {}
    names = [c.split()[0] for c in FINDING.split(", ")]
    for row in (dict(zip(names, x, strict=True)) for x in rows):
        have, stop = out.setdefault(row["path"], []), lambda x: x["line_end"] or x["line_start"]
        for k, old in enumerate(have):
            a, b = set(old["models"] or ()), set(row["models"] or ())
            apart = old["detector"] == row["detector"] == "llm" and a and b and not a & b
            if (old["detector"] != row["detector"] or apart) and old["line_start"] <= stop(row) and row["line_start"] <= stop(old):
                best = row if len(row["analysis"]) >= len(old["analysis"]) else old
                told = "cross" if old["detector"] == row["detector"] == "llm" else "both" if old["detector"] != row["detector"] else old["detector"]
                have[k : k + 1] = []
                row = best | {"detector": told, "models": sorted(a | b), "votes": old["votes"] + row["votes"], "verified": old["verified"] or row["verified"], "confidence": max(old["confidence"], row["confidence"]), "line_start": min(old["line_start"], row["line_start"]), "line_end": max(stop(old), stop(row))}
                break
        have.append(row)
    got = validate.merge(spark.createDataFrame(rows, FINDING), ("path", "rule_id")).collect()
    assert sorted(str(sorted(x.asDict().items())) for x in got) == sorted(str(sorted(x.items())) for v in out.values() for x in v) and len(got) < 110


def test_verify_keeps_null_paths(spark):
    f = spark.createDataFrame([(1, None, 1, 1, "x"), (2, "a", 1, 1, "x")], "pos int, path string, line_start int, line_end int, evidence string")
    got = validate.verify(f, spark.createDataFrame([("a", "x\n")], "path string, text string"))
    assert sorted((r.pos, r.verdict) for r in got.collect()) == [(1, "range"), (2, "ok")]


def test_script_functions():
    source = "function a() {\n  if (x) { y() }\n  function inner() { return `${ {} }` }\n}\nconst b = (x) => { return '}' }\nclass K {\n  m(x) {\n  }\n  if (x) {\n  }\n}\nfunction open( {\n"
    assert [r[1:4] for r in scripts.functions_of("p", source)] == [("a", 1, 4), ("b", 5, 5), ("m", 7, 8)]
    assert scripts.blocks("{a}} {{b}") == ([0, 5, 6], [2, None, 8])
