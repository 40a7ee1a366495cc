"""Rules, masks and taint: each exemption beside a case that must still fire."""

import random

from pyspark.sql import functions as F

from siftlake import schema
from siftlake.functions import text as T
from siftlake.operators import entropy, evaluate, graph, history, lines, masks, rules, validate
from siftlake.sources import files


def found(spark, source, path="a.py", masked=True):
    f = spark.createDataFrame([(path, source)], "path string, text string")
    rows = masks.python_masks(f) if masked else lines.lines(f)
    return {(r.rule_id, r.line_start) for r in rules.scan(rows, masks=masked).collect()}


def test_lines(spark):
    df = spark.createDataFrame([("a", "x\ny\r\nz\n"), ("b", ""), ("c", None), ("d", "\n\n")], "path string, text string")
    assert sorted((r.path, r.line_no, r.line) for r in lines.lines(df).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("d", 1, ""), ("d", 2, "")]


def test_masks(spark):
    hits = found(spark, 'import os\nos.system(x)\n# os.system(x)\ny = 1  # os.system(x)\ns = "os.system(x)"\nos.system(y)  # noqa\n"""\nos.system(z)\n"""\n')
    assert hits == {("R-SEC-002", 2)}
    assert ("R-STYLE-003", 1) in found(spark, "f = lambda: 1\n")
    assert ("R-STYLE-003", 2) not in found(spark, "g(\nf = lambda: 1)\n")


def test_except(spark):
    assert ("R-LOG-001", 3) in found(spark, "try:\n    f()\nexcept Exception:\n    g(1)\n")
    assert ("R-LOG-001", 3) not in found(spark, "try:\n    f()\nexcept Exception:\n    g(1)\n    raise\n")
    assert ("R-LOG-001", 3) in found(spark, "try:\n    f()\nexcept Exception:\n    g(1)\nraise ValueError\n")
    assert ("R-LOG-001", 3) in found(spark, "try:\n    f()\nexcept Exception:\n    pass\n")  # swallowed: what the rule is for
    assert ("R-LOG-001", 3) not in found(spark, "try:\n    f()\nexcept Exception:\n    # no\n    return None\n")
    assert ("R-LOG-001", 3) in found(spark, "try:\n    f()\nexcept BaseException:\n    return None\n")
    for line in ("traceback.print_exc()", "self.showtraceback()", "f(exc_info=True)", "MY_LOGGER.exception('x')"):
        assert ("R-LOG-001", 3) not in found(spark, f"try:\n    f()\nexcept Exception:\n    {line}\n")
    assert ("R-ENG-001", 1) in found(spark, "h = open('x')\nxh.close()\n")
    assert ("R-LOG-001", 3) not in found(spark, "try:\n    f()\nexcept Exception:\n    g(1)\n    logger.warning('x')\n")
    assert ("R-ENG-001", 1) in found(spark, "h = open('x')\n") and ("R-ENG-001", 1) not in found(spark, "h = open('x')\nh.close()\n")


def test_paths_and_unicode(spark):
    assert ("R-SEC-003", 1) in found(spark, "eval(x)\n") and not found(spark, "eval(x)\n", "site-packages/a.py") and not found(spark, "éeval(x)\n")
    assert not found(spark, "def f(:\n", masked=True)


def test_js(spark):
    src = "eval(a)\n// eval(a)\n/*\neval(b)\n*/\n// eslint-disable-next-line\neval(c)\nx = 1 // eval(d)\n"
    df = lines.lines(spark.createDataFrame([("a.js", src), ("a.py", src)], "path string, text string"))
    assert {(r.path, r.line_start) for r in rules.scan_js(df).collect()} == {("a.js", 1)}


def test_entropy(spark):
    df = spark.createDataFrame([("a", 1, 'k = "aB3dE5gH7jK9mN1pQ3sT"'), ("a", 2, '# "aB3dE5gH7jK9mN1pQ3sT"'), ("a", 3, 'k = "https://example.org/a1b2c3"')], "path string, line_no int, line string")
    assert [r.line_start for r in entropy.entropy_findings(df).collect()] == [1]
    assert spark.range(1).select(entropy.shannon(F.lit("0123456789abcdef"))).first()[0] == 4.0


def test_functions_and_taint(spark):
    src = "from flask import request\nimport os\ndef run(cmd):\n    os.system(cmd)\ndef view():\n    q = request.args.get('q')\n    z = q + 'x'\n    run(z)\n    ok = 'fixed'\n    os.system(ok)\n"
    f = spark.createDataFrame([("app/web.py", src)], "path string, text string")
    assert sorted(r.name for r in masks.split_functions(f).collect()) == ["run", "view"]
    assert masks.file_units(f).first().imports == ["flask", "os"]
    facts = masks.facts(f)
    assert [(r.caller, r.callee) for r in graph.call_edges(facts).collect()] == [("app.web.view", "app.web.run")]
    assert [(r.fn, r.line, r.cwe) for r in graph.taint(facts).collect()] == [("app.web.run", 4, "CWE-78")]


def test_coerce(spark):
    raw = spark.createDataFrame([("r", " HIGH ", "odd", "1.7", "0"), ("r", "bad", "logic", "x", "12")], "rule_id string, severity string, category string, confidence string, line_start string")
    got = [(r.severity, r.category, r.confidence, r.line_start) for r in schema.coerce(raw).collect()]
    assert got == [("high", "logic", 1.0, 1), ("medium", "logic", 0.5, 12)]


def test_diff(spark):
    row = "path string, rule_id string, line_start int, pos int"
    old = spark.createDataFrame([("a", "r", 1, 1), ("a", "r", 10, 2), ("a", "r", 50, 3)], row)
    new = spark.createDataFrame([("a", "r", 1, 1), ("a", "r", 12, 2), ("a", "r", 13, 3)], row)
    got = sorted((r.status, r.old_line, r.new_line) for r in history.diff(old, new).collect())
    assert got == [("added", None, 13), ("kept", 1, 1), ("moved", 10, 12), ("removed", 50, None)]


def test_diff_of_many(spark):
    """Islands of a hot key against greedy matching of all its pairs; the pairs formed stay few."""
    r = random.Random(8)
    sides = [{k: sorted(r.sample(range(6000 if k == "hot" else 40), 1500 if k == "hot" else 12)) for k in ("hot", "b", "c")} for _ in range(2)]
    row = "path string, rule_id string, line_start int, pos int"
    old, new = (spark.createDataFrame([(k, "r", x, 1) for k in s for x in s[k]], row) for s in sides)
    want = []
    for k in sides[0]:
        both = set(sides[0][k]) & set(sides[1][k])
        a, b = (sorted(set(s[k]) - both) for s in sides)
        want += [(k, x, x, "kept") for x in both]
        for _, x, y in sorted((abs(x - y), x, y) for x in list(a) for y in list(b) if abs(x - y) <= 5):
            if x in a and y in b:
                a.remove(x)
                b.remove(y)
                want.append((k, x, y, "moved"))
        want += [(k, x, -1, "removed") for x in a] + [(k, -1, y, "added") for y in b]
    got = history.diff(old, new, 5).na.fill(-1)
    assert "island" in got._jdf.queryExecution().toString()
    assert sorted((x.path, x.old_line, x.new_line, x.status) for x in got.collect()) == sorted(want)


def test_merge_and_gate(spark):
    f = spark.createDataFrame([("a", "k", 1, 5, 1, 0.5), ("a", "k", 4, 9, 2, 0.6), ("a", "k", 11, None, 3, 0.9)], "path string, key string, line_start int, line_end int, pos int, confidence double")
    assert sorted((r.line_start, r.line_end, r.merged) for r in validate.merge_intervals(f).collect()) == [(1, 9, 2), (11, 11, 1)]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.mask_secrets(F.lit("token = 'abcdef123456' sk-abcdefghijkl"))) == "token = '***[已掩码]' sk-abc…[已掩码]"
    assert one(T.suffix(F.lit("a/b.tar/c.py"))) == ".py" and one(T.stem(F.lit("x\\c.py"))) == "c"


def test_sources(spark, tmp_path):
    for name, text in {"a.py": "x\n", "sub/b.py": "y\n", "node_modules/c.py": "z\n", "d.txt": "t\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = sorted((r.path, r.text) for r in files.read_files(spark, str(tmp_path)).collect())
    assert got == [("a.py", "x\n"), ("sub/b.py", "y\n")]
    scan = spark.createDataFrame([('{"dependencies":[{"name":"p","version":"1","vulns":[{"id":"X-1","aliases":["CVE-1"],"fix_versions":["2"],"description":""},{"id":"X-1","aliases":["CVE-1"],"fix_versions":["2"],"description":""}]}]}',), ("oops",)], "text string")
    assert sorted((r.id or "", r.note) for r in files.dependency_findings(spark, scan).collect()) == [("", "unreadable scanner output"), ("CVE-1", "")]


def test_stream(spark, tmp_path):
    from siftlake.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("os.system(x)\n")
    out = str(tmp_path / "out")
    for _ in range(2):
        incremental.scan_stream(spark, str(tmp_path / "in"), out, str(tmp_path / "cp")).awaitTermination()
    assert [r.rule_id for r in spark.read.parquet(out).collect()] == ["R-SEC-002"]


def taint_of(spark, source, path="app/web.py", **more):
    f = spark.createDataFrame([(path, source), *more.items()], "path string, text string")
    return graph.taint_paths(masks.facts(f)).collect()


def test_taint_filters(spark):
    """Each exemption beside what must still be found, in one source."""
    src = (
        "import os, subprocess, argparse\n"
        "def a():\n    os.system(request.args.get('q'))\n"
        "def b(self):\n    x = input()\n    self.open(x)\n    eval(x)\n"
        "def c():\n    x = request.args.get('p')\n    subprocess.run([x])\n    subprocess.run(x, shell=True)\n"
        "def d():\n    o = parser.parse_args()\n    open(o)\n"
        "def e():\n    p = request.args.get('f')\n    if os.path.isfile(p):\n        return open(p)\n"
        "def f():\n    p = os.path.join(__file__, 'request')\n    open(p)\n"
        "def g():\n    n = request.args.get('f')\n    send_file(BytesIO(n))\n    send_file(n)\n"
    )
    got = {(r.fn.split(".")[-1], r.line, r.reason) for r in taint_of(spark, src)}
    assert got == {("a", 3, None), ("b", 6, "bare"), ("b", 7, None), ("c", 10, "noshell"), ("c", 11, None), ("d", 14, "cli"), ("e", 18, "guard"), ("g", 24, "buffer"), ("g", 25, None)}
    origin = {(r.fn.split(".")[-1], r.line): r.origin for r in taint_of(spark, src)}
    assert origin["a", 3] == "direct" and origin["b", 7] == "source web.py:5"


def test_relative_imports_and_methods(spark):
    f = spark.createDataFrame([("pkg/__init__.py", "from .m import go\ndef top():\n    go(1)\n"), ("pkg/m.py", "from . import n as k\nclass C:\n    def go(self, v):\n        k.run(v)\ndef go(v):\n    k.run(v)\n    nowhere()\n"), ("pkg/n.py", "import os\ndef run(c):\n    def inner(z):\n        os.system(z)\n    inner(c)\n")], "path string, text string")
    facts = masks.facts(f)
    assert {(r.caller, r.callee) for r in graph.call_edges(facts).collect()} == {("pkg.top", "pkg.m.go"), ("pkg.m.C.go", "pkg.n.run"), ("pkg.m.go", "pkg.n.run")}
    assert graph.graph_stats(facts).first().asDict() == {"files": 3, "defs": 4, "edges": 3, "unresolved": 3}
    row = graph.calls_of(facts, "pkg/n.py", "run").first()
    assert row.callers == "pkg.m.C.go(m.py:4); pkg.m.go(m.py:6)" and row.callees == ""


def test_scripts_of_blocks(spark):
    src = "var p = 'src/**/*.js'\neval(a)\n/* x */ eval(b)\n/* y\n eval(c)\n*/\neval(d)\nx == y\ne.innerHTML = z\n"
    df = lines.lines(spark.createDataFrame([("a.js", src)], "path string, text string"))
    assert {(r.rule_id, r.line_start) for r in rules.scan_js(df).collect()} == {("JS-SEC-001", 2), ("JS-SEC-001", 7), ("JS-LOG-002", 8), ("JS-SEC-003", 9)}


def test_guards(spark):
    df = spark.createDataFrame([("a.py", "x = yaml.safe_load(f)\ny = md5(b)\n"), ("b.py", "# a Cache key\ny = md5(b)\n")], "path string, text string")
    assert {tuple(r) for r in rules.guard_points(df).collect()} == {("a.py", "CWE-502", 1), ("b.py", "CWE-327", 2)}


def test_multi_line_strings(spark):
    assert ("R-SEC-001", 1) in found(spark, 'cursor.execute(f"""\nselect eval(x)\n""" + y)\n') and not {r for r in found(spark, 'x = """\neval(y)\n"""\n')}


def test_finding_chain(spark):
    """Merging, suppressing, the id gate, cross review and evidence, case by case."""
    row = "pos int, path string, rule_id string, key string, line_start int, line_end int, detector string, models array<string>, votes int, verified boolean, confidence double, analysis string, source string, evidence string"
    base = [
        (1, "a", "R1", "K", 5, 7, "static", [], 1, True, 0.95, "", "cwe", "x"), (2, "a", "K", "K", 7, 9, "llm", ["m"], 1, False, 0.6, "long text", "", "y"), (3, "a", "R1", "K", 6, None, "static", [], 1, True, 0.95, "", "", "z"),
        (4, "a", "K", "K", 20, 22, "llm", ["m"], 1, False, 0.6, "one", "", ""), (5, "a", "K", "K", 21, None, "llm", ["n"], 1, True, 0.8, "two", "s", ""), (6, "a", "K", "K", 21, None, "llm", ["n"], 1, True, 0.7, "t", "", ""),
        (7, "b", "ODD", "K", 1, None, "llm", ["m"], 1, True, 0.9, "", "", ""), (8, "b", "R9", "K", 2, None, "static", [], 1, True, 0.9, "", "", ""), (9, "b", "DISCOVERED-x", "K", 3, None, "llm", ["m"], 1, True, 0.9, "", "", ""), (10, "b", "EVEN", "K", 30, None, "llm", ["m"], 1, True, 0.9, "", "", ""),
    ]
    f = spark.createDataFrame(base, row)
    got = {r.pos: r for r in validate.merge(f.where("path = 'a'")).collect()}
    # the second takes in the first; the third, static, then meets a row of both and joins it
    assert sorted(got) == [2, 5] and (got[2].detector, got[2].votes, got[2].line_start, got[2].line_end, got[2].source, got[2].verified, got[2].confidence) == ("both", 3, 5, 9, "cwe", True, 0.95)
    # the two models agree (cross); the third finding of one of them then differs from cross
    assert (got[5].detector, got[5].models, got[5].line_start, got[5].line_end, got[5].votes) == ("both", ["m", "n"], 20, 22, 3)
    assert validate.merge(f.where("pos in (4, 5)")).first().detector == "cross"
    ids = {r.pos: r for r in validate.id_gate(f, spark.createDataFrame([("R1",), ("K",)], "rule_id string")).collect()}
    assert [ids[p].rule_id for p in (7, 8, 9, 10)] == ["DISCOVERED-ODD-01", "R9", "DISCOVERED-x", "DISCOVERED-EVEN-02"] and "ODD" in ids[7].analysis and len(ids) == 10
    guards = spark.createDataFrame([("b", "K", 2)], "path string, key string, line int")
    left = validate.suppress(f.withColumns({"lo": F.col("line_start"), "hi": F.coalesce("line_end", "line_start")}), guards)
    assert sorted(r.pos for r in left.where("path = 'b'").collect()) == [8, 10]
    marked, figures = validate.cross_review(validate.merge(f))
    assert figures.first().asDict() == {"agreed": 1, "single": 3, "by_rule": 1, "agreement": 0.25} and marked.where("analysis like '[to be%'").count() == 3
    text = spark.createDataFrame([("t", "ab c\ndef\n\n\n\n\n\nlast\n")], "path string, text string")
    asked = spark.createDataFrame([(1, "t", 1, None, "a b c"), (2, "t", 1, None, ""), (3, "t", 9, None, ""), (4, "t", 1, None, "last"), (5, "t", 1, 5, "last"), (6, "t", 1, None, "abcdef"), (7, "no", 1, None, "")], "pos int, path string, line_start int, line_end int, evidence string")
    assert {r.pos: r.verdict for r in validate.verify(asked, text).collect()} == {1: "ok", 2: "ok", 3: "range", 4: "drift", 5: "ok", 6: "missing", 7: "range"}


def test_evaluation(spark):
    runs = spark.createDataFrame([(1, "a", "r", 1), (1, "a", "s", 2), (2, "a", "r", 1), (3, "b", "q", 9)], "run int, path string, rule_id string, line_start int")
    assert tuple(evaluate.consistency(runs, "run", ["path", "rule_id", "line_start"], "rule_id").first()) == (3, round(0.5 / 3, 3), [])
    assert tuple(evaluate.consistency(runs.where("run < 3"), "run", ["path", "rule_id", "line_start"], "rule_id").first()) == (2, 0.5, ["r"])
    f = spark.createDataFrame([("a", 1, None, 1, "K", "security"), ("a", 4, None, 2, "Z", "style"), ("a", 20, None, 3, "Q", "style"), ("a", 40, None, 4, "Q", "logic")], "path string, line_start int, line_end int, pos int, key string, category string")
    want = spark.createDataFrame([("a", "K", 6, 0), ("a", "K", 90, 1)], "path string, key string, line int, ord int")
    assert tuple(evaluate.score_run(f, want).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    m = spark.createDataFrame([(1, "l", "f", 5, 6, "R1"), (2, "l", "f", 9, 9, "TRAP-x"), (3, "l", "f", 30, 31, "R1"), (4, "l", "f", 50, 51, "R2")], "id int, lib string, file string, start int, end int, expect string")
    hits = spark.createDataFrame([("l", "f", 7, "R1", "os.system(x)"), ("l", "f", 8, "R9", ""), ("l", "f", 30, "R1", "other")], "lib string, file string, line int, rule string, evidence string")
    got = evaluate.planted(m, hits, spark.createDataFrame([("R1", "system")], "rule string, word string"))
    assert {r.id: r.result for r in got.collect()} == {1: "hit_located", 2: "trap_clean", 3: "hit_unlocated", 4: "MISS"}
    assert {tuple(r) for r in evaluate.planted_recall(got).collect()} == {("R1", 2, 2, 1), ("R2", 1, 0, 0)}
    r = evaluate.adjudication_summary(spark.createDataFrame([("T", True), ("T", False), ("F", False), ("F", True), ("O", True)], "gt string, real boolean")).first()
    assert (r.precision_before, r.precision_after, r.fp_killed, r.lost_t, r.novel_kept) == (0.5, 0.5, 1, 1, 1)


def test_stamps(spark):
    rows = spark.createDataFrame([("a", 1000, 1), ("a", 1000, 2), ("a", 1001, 3), ("a", 5000, 4)], "k string, ms long, i int").withColumn("ts", F.timestamp_millis("ms"))
    got = history.stamped(rows, "ts", "k", "i").select("i", F.unix_millis("stamp").alias("s")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1000), (2, 1001), (3, 1002), (4, 5000)]


def test_merge_against_all_rows(spark):
    """Islands give what going through all rows of a file in order gives."""
    r = random.Random(3)
    rows = [(i, r.choice("ab"), "K", r.randrange(1, 200), None, r.choice(["static", "llm", "llm"]), [r.choice("mno")], 1, False, r.random(), "x" * r.randrange(5)) for i in range(160)]
    rows = [x[:4] + (x[3] + r.randrange(0, 9),) + x[5:6] + ([] if x[5] == "static" else x[6],) + x[7:] for x in rows]
    f = spark.createDataFrame(rows, "pos int, path string, key string, line_start int, line_end int, detector string, models array<string>, votes int, verified boolean, confidence double, analysis string")
    want = []
    for path in "ab":
        out = []
        for row in (dict(zip(f.columns, x, strict=True)) for x in rows if x[1] == path):
            for old in out:
                apart = old["detector"] != row["detector"] or old["detector"] == "llm" and old["models"] and row["models"] and not set(old["models"]) & set(row["models"])
                if apart and old["line_start"] <= row["line_end"] and row["line_start"] <= old["line_end"]:
                    break
            else:
                out.append(row)
                continue
            out.remove(old)
            keep = dict(row if len(row["analysis"]) >= len(old["analysis"]) else old)
            keep["detector"] = "both" if old["detector"] != row["detector"] else "cross"
            keep["votes"], keep["line_start"], keep["line_end"] = old["votes"] + row["votes"], min(old["line_start"], row["line_start"]), max(old["line_end"], row["line_end"])
            keep["models"] = sorted({*old["models"], *row["models"]})
            out.append(keep)
        want += [(x["pos"], x["detector"], x["votes"], x["line_start"], x["line_end"], x["models"]) for x in out]
    got = [(x.pos, x.detector, x.votes, x.line_start, x.line_end, x.models) for x in validate.merge(f).collect()]
    assert sorted(got) == sorted(want) and len(got) < 150
