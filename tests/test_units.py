"""Loaders, script functions, replies, units, stores and caches."""

import json

import pytest
from pyspark.sql import functions as F

from siftlake.operators import cache, lines, replies, report, rules, scripts, store, units
from siftlake.sources import files


def test_loaders(spark, tmp_path):
    def put(name, doc):
        (tmp_path / name).write_text(json.dumps(doc))
        return str(tmp_path / name)

    a = {"id": "A", "title": "t", "severity": "high", "category": "logic", "pattern": r"os\.system", "exclude": ["ok"], "body_check": "no_reraise", "top_only": True}
    (tmp_path / "r").mkdir()
    put("r/b.json", {"rules": [{"id": "B", "pattern": "("}, {"id": "C", "pattern": "x", "match_comment": True}]})
    put("r/a.json", {"rules": [a]})
    put("r/js_rules.json", {"rules": [{"id": "J", "pattern": "eval"}]})
    got = files.as_rules(files.read_rules(spark, str(tmp_path / "r")))
    assert [(r.id, r.exclude, r.checks, r.top_only, r.in_comments) for r in got] == [("A", ("ok",), ("no_reraise",), True, False), ("C", (), (), False, True)]
    df = lines.lines(spark.createDataFrame([("m.py", "os.system(x)\nos.system(y) # ok\n")], "path string, text string"))
    assert [(r.rule_id, r.line_start) for r in rules.scan(df, got[:1]).collect()] == [("A", 1)]
    assert [r.id for r in files.as_rules(files.read_script_rules(spark, str(tmp_path / "r" / "js_rules.json")), rules.JS_EXT)] == ["J"]
    assert files.read_guards(spark, put("g.json", {"guards": [{"id": "g", "pattern": "p", "protects": ["CWE-1"]}]})) == (("p", ("CWE-1",), ""),)
    assert files.read_catalog(spark, put("c.json", {"sources": [{"match": "input", "cwe": "CWE-20"}], "sinks": [{"match": "eval", "cwe": "CWE-95"}]})) == (("input",), {"eval": "CWE-95"})
    assert [tuple(r) for r in files.read_weaknesses(spark, put("m.json", {"map": {"R": "CWE-1"}})).collect()] == [("R", "CWE-1")]
    assert [(r.lib, r.line, r.note) for r in files.read_truth(spark, put("lib.json", {"meta": {"lib": "x"}, "annotations": [{"file": "f", "line": 3, "rule": "R", "verdict": "T", "why": "w"}]})).collect()] == [("x", 3, "w")]
    want, clean = files.read_manifest(spark, put("man.json", {"expected": [{"file": "f", "cwe": "K", "line": 2}], "negatives": ["n.py"]}))
    assert tuple(want.first()) == ("f", "K", 2, 0) and clean.first().path == "n.py"
    (tmp_path / "k").mkdir()
    put("k/s.json", {"items": [{"id": "i", "title": "t", "tags": ["a"]}]})
    put("k/custom.json", {"items": [{"id": "c", "title": "t"}]})
    (tmp_path / "k" / "bad.json").write_text("{")
    assert [(r.id, r.builtin) for r in files.read_knowledge(spark, str(tmp_path / "k")).orderBy("ord").collect()] == [("c", False), ("i", True)]
    some = spark.createDataFrame([("a/tests/x.py", ""), ("a/test_x.py", ""), ("a/x.py", ""), ("requirements.txt", "")], "path string, text string")
    assert [r.path for r in files.package_files(some).collect()] == ["a/x.py", "requirements.txt"] and [r.path for r in files.manifests(some).collect()] == ["requirements.txt"]


def test_scripts(spark):
    src = "// function no() {\nfunction a(x) {\n  const s = '}';\n  function inner() { }\n  return `t } ${x}`;\n}\nexport const b = async (y) => {\n  /* } */\n};\nclass K {\n  run(z) {\n  }\n}\nif (a) {\n}\nimport q from 'mod'\nconst r = require(\"fs\")\nfunction open() {\n"
    df = spark.createDataFrame([("a.js", src), ("b.js", "")], "path string, text string")
    assert [(r.name, r.line_start, r.line_end) for r in scripts.split_functions(df).collect()] == [("a", 2, 6), ("b", 7, 9), ("run", 11, 12)]
    code = scripts.masked(src)
    assert len(code) == len(src) and code.count("\n") == src.count("\n") and "t }" not in code and "${x}" in code and "no()" not in code
    unit = scripts.file_units(df).orderBy("path").first()
    assert unit.imports == ["mod", "fs"] and "a" in unit.functions and "b" in unit.functions


def test_replies(spark):
    rows = [(1, "so:\n```json\n[{\"rule_id\": \"a]\"}, 3, {\"x\": 1}]\n```\nbye [9]"), (2, "no array"), (3, "[{\"rule_id\": \"b\"}"), (4, None), (5, "x [1, [2]] y"), (6, "[{\"rule_id\": \"c\"}] and [{}]")]
    got = replies.parse_arrays(spark.createDataFrame(rows, "id int, text string"), "rule_id string").collect()
    assert sorted((r.id, r.pos, r.rule_id) for r in got if r.rule_id) == [(1, 0, "a]"), (6, 0, "c")]
    assert [r[0] for r in spark.createDataFrame([("a\n```py\nx = 1\n\n```\n```\ny\n```",), ("none",), ("```\n \n```",)], "t string").select(replies.fenced(F.col("t"))).collect()] == ["x = 1", None, None]
    texts = spark.createDataFrame([("f", "a\nb  = 1\nc\nd\nd\n")], "path string, text string")
    f = [(1, "f", 2, None, "b = 1", "```\nB\n```"), (2, "f", 1, None, "c", "```\nC\n```"), (3, "f", 3, None, "d", "```\nD\n```"), (4, "f", 2, None, "b", "no code"), (5, "g", 2, None, "b", "```\nB\n```")]
    got = {r.pos: r for r in replies.fix_diffs(spark.createDataFrame(f, "pos int, path string, line_start int, line_end int, evidence string, fix string"), texts).collect()}
    assert [(got[i].lo, got[i].hi, got[i].error) for i in (1, 2, 3, 4, 5)] == [(2, 2, None), (3, 3, None), (None, None, "anchor"), (None, None, "code"), (None, None, "file")]
    assert "-b  = 1\n+B" in got[1].diff


def test_units(spark):
    src = "def f(a, b, c, d, e):\n    return 1\nclass K:\n    def m(self):\n        return 2\n"
    df = spark.createDataFrame([("p/a.py", src), ("p/b.py", "def (")], "path string, text string")
    assert {r.path: r.summary for r in units.file_summaries(df).collect()} == {"p/a.py": "a.py (5 lines): def f(a, b, c, d); class K: m", "p/b.py": "b.py: (does not parse)"}
    assert units.tree_text(df, "p", 1).first().tree == "p/\n  p/a.py\n  ... 2 files"
    assert units.project_unit(df, "p").first().file_count == 2
    truth = spark.createDataFrame([("l", "a", 5, "R", "T"), ("l", "a", 1, "R", "?"), ("l", "a", 3, "R", "F")], "lib string, file string, line int, rule string, verdict string")
    got = units.retrieval_cases(truth, spark.createDataFrame([("l", "a", src)], "lib string, file string, text string"), spark.createDataFrame([("R", "K1")], "rule string, kid string"), 45).collect()
    assert sorted((r.line, r.window) for r in got) == [(3, "file"), (5, "func"), (5, "outside")]


def test_store(spark):
    row = "pos int, id string, title string, severity string, category string"
    have = spark.createDataFrame([(0, "mine", "old", "low", "style")], row)
    new = spark.createDataFrame([(1, "mine", "new", "LOW", "style"), (2, "mine", "newer", "low", "style"), (3, "b1", "t", "low", "style"), (4, "!", "t", "low", "style"), (5, "ok", " ", "low", "style"), (6, "ok", "t", "bad", "style"), (7, "fine", "t", "high", "logic")], row)
    rows, log = store.upsert(have, new, spark.createDataFrame([("b1",)], "id string"))
    assert {(r.id, r.title) for r in rows.collect()} == {("mine", "newer"), ("fine", "t")}
    assert sorted((r.id, r.reason, r.created) for r in log.collect()) == [("!", "id", False), ("b1", "builtin", False), ("fine", "", True), ("mine", "", False), ("mine", "", False), ("ok", "severity", False), ("ok", "title", False)]
    assert store.delete(rows, rows.where("id = 'mine'")).count() == 1 and store.listed(have, rows).where("builtin").count() == 1
    told = store.pack_checksum(new.drop("pos")).first().checksum
    assert store.pack_checksum(new.drop("pos").orderBy("title")).first().checksum == told
    store.import_pack(new, told, have, have.limit(0))
    with pytest.raises(ValueError):
        store.import_pack(new.limit(2), told, have, have.limit(0))


def test_cache(spark):
    row = "key string, raw string, ts int, model string"
    have = spark.createDataFrame([(f"k{i:02d}", "r", i // 3, "m") for i in range(30)], row)
    got = cache.put(have, spark.createDataFrame([("k00", "new", 99, "n")], row), most=20, keep=10).collect()
    assert sorted(r.key for r in got) == ["k00", *(f"k{i}" for i in range(21, 30))] and {r.raw for r in got if r.key == "k00"} == {"new"}
    assert cache.put(have, have, most=30, keep=10).count() == 30 and cache.misses(have, have.limit(29)).count() == 1
    tied = cache.put(have.limit(0), have.withColumn("ts", F.lit(1)), most=5, keep=4).collect()
    assert sorted(r.key for r in tied) == ["k00", "k01", "k02", "k03"]


def test_report_forms(spark):
    f = spark.createDataFrame([(1, "R", "high", "a|b", "x/y.py", 3, "token = 'abcdef123456'"), (2, "S", "low", "t", "x/z.py", 1, "")], "pos int, rule_id string, severity string, title string, path string, line_start int, evidence string")
    assert [r.text for r in report.brief(f).collect()] == ["- **HIGH** a/b (y.py:3)", "- **LOW** t (z.py:1)"]
    assert report.redacted(f).first().evidence == "token = '***[已掩码]'" and report.redacted(f).first().path == "y.py"
    d = spark.createDataFrame([("p", "R", 1, 2, "moved"), ("p", "R", None, 9, "added"), ("p", "R", 4, 4, "kept")], "path string, rule_id string, old_line int, new_line int, status string")
    assert [r.text for r in report.diff_markdown(d).collect()] == ["## added (1)", "- R p:9", "## moved (1)", "- R p:1 -> 2", "## kept (1)"]
    one = report.payload(f, "t").first()
    assert (one.total, one.high, len(one.top)) == (2, 1, 2)


def test_counts_after_taking_out(spark):
    f = spark.createDataFrame([("high", "security", "llm"), ("low", "style", "static"), ("low", "style", "llm")], "severity string, category string, detector string")
    got = {(r.kind, r.value): r["count"] for r in report.trimmed(f, f.where("severity = 'high'")).collect()}
    assert got == {("total", "all"): 1, ("severity", "high"): 1, ("category", "security"): 1, ("detector", "llm"): 1, ("raw", "all"): 3, ("removed", "all"): 2}


def test_verdicts_novel_hits_targets_and_times(spark):
    from siftlake.functions import text as T
    from siftlake.operators import evaluate, history

    v = spark.createDataFrame([("a", "T"), ("a", "F"), ("a", "maybe"), ("a", None), ("b", "?")], "rule string, verdict string")
    assert sorted(tuple(r) for r in evaluate.verdict_pivot(v, "rule").collect()) == [("a", 1, 1, 2, 0.5), ("b", 0, 0, 1, None)]
    truth, hits = spark.createDataFrame([("p", 1), (None, 2)], "path string, line int"), spark.createDataFrame([("p", 1), (None, 2), ("q", 1)], "path string, line int")
    assert [tuple(r) for r in evaluate.novel(truth, hits, ["path", "line"]).collect()] == [("q", 1)]
    points = spark.createDataFrame([(2, 5, "y"), (1, 9, "x"), (3, 6, "x")], "n int, total int, target string")
    assert tuple(history.trend(points, ["n"], "total", "target").first()) == (3, 9, 6, -3, 9, ["x", "y"])
    t = spark.sql("select timestamp'2024-01-02 03:04:05.6' a, '2024-01-02T03:04:05' b, 'no' c").select(T.stamp(F.col("a")), T.epoch(F.col("b")), T.epoch(F.col("c"))).first()
    assert tuple(t) == ("2024-01-02T03:04:05", 1704164645, None)
