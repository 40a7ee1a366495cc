"""Colours of taint, the call graph kept over changes, and streams, against plain Python or a full run."""

import random

from pyspark.sql import functions as F

from siftlake.operators import graph


def test_colours_of_random_graphs(spark):
    """Rounds against a fixpoint in plain Python; some nodes are seeded in both colours, loops and parallel edges occur."""
    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randrange(60), r.randrange(60), r.random() < 0.15) for _ in range(90)]
        seeds = [(r.randrange(60), r.random() < 0.3) for _ in range(4)]
        want = {}
        for n, f in seeds:
            want[n] = (want.get(n, (False, 0))[0] or f, 0)
        for k in range(1, 5):
            new = {}
            for a, b, by in edges:
                if a in want and b not in want:
                    new[b] = (new.get(b, (False,))[0] or by or want[a][0], k)
            want |= new
        got = graph.colours(spark.createDataFrame(edges, "src int, dst int, foreign boolean"), spark.createDataFrame(seeds, "node int, foreign boolean"), 4)
        assert {x.node: (x.foreign, x.round) for x in got.collect()} == want
    line = spark.createDataFrame([(i, i + 1) for i in range(9)], "src int, dst int")
    assert graph.reach(line, spark.createDataFrame([(0,)], "node int"), None).count() == 10


def test_colour_is_decided_once(spark):
    """A variable of the command line's stays so though foreign data reaches it in a later round; a parameter is foreign."""
    from siftlake.operators import masks

    src = "def a():\n    o = parser.parse_args()\n    x = o\n    y = input()\n    z = y\n    w = z\n    x = w\n    open(x)\ndef b(p):\n    open(p)\ndef c():\n    o = parser.parse_args()\n    b(o)\n"
    f = spark.createDataFrame([("m.py", src)], "path string, text string")
    assert {(r.fn, r.line, r.reason) for r in graph.taint_paths(masks.facts(f)).collect()} == {("m.a", 8, "cli"), ("m.b", 10, None)}


FILES = {
    "a.py": "from b import g\ndef f():\n    g()\n",
    "b.py": "from c import h\ndef g():\n    h()\n",
    "c.py": "def h():\n    pass\n",
    "copy/c.py": "def h():\n    pass\n",
    "d.py": "def lone():\n    pass\n",
    "bad.py": "def (",
    "none.py": None,
}


def test_snapshot_after_a_change(spark):
    """A refreshed snapshot equals one built anew, and only the changed content is parsed."""
    from siftlake.operators import changes, masks

    table = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    rows = lambda d: sorted(map(repr, d.collect()))
    first = changes.refresh(changes.empty(spark), table(FILES))
    assert first.parsed.count() == 6 and rows(first.facts) == rows(masks.facts(table(FILES)))
    now = {k: v for k, v in FILES.items() if k != "d.py"} | {"c.py": "def h():\n    k()\ndef k():\n    pass\n", "new.py": FILES["b.py"]}
    second = changes.refresh(first, table(now))
    assert [r.path for r in second.parsed.collect()] == ["c.py"]
    assert rows(second.facts) == rows(masks.facts(table(now))) and rows(graph.call_edges(second.facts)) == rows(graph.call_edges(masks.facts(table(now))))
    assert {r.path for r in changes.changed(first, second).collect()} == {"c.py", "d.py", "new.py"}
    got = {r.fqn: r.round for r in changes.affected(first, second).collect()}
    assert got == {"c.h": 0, "c.k": 0, "d.lone": 0, "new.g": 0, "b.g": 1, "a.f": 2}
    third = changes.refresh(second, table(now))
    assert third.parsed.count() == 0 and changes.affected(second, third).count() == 0
    # what is stored is what counts: a text of a known content isn't looked at
    marked = second._replace(stored=second.stored.where("kind <> 'node'"))
    assert changes.refresh(marked, table(now)).facts.where("kind = 'node'").count() == 0
    gone = changes.refresh(second, table({}))
    assert gone.facts.count() == 0 == gone.stored.count()


def test_feedback_state(spark, tmp_path):
    """Restarts from the checkpoint give what one batch over all rows gives; keys without news go."""
    from siftlake.operators import history
    from siftlake.streaming import incremental

    r, day = random.Random(1), lambda n: f"2024-01-{n:02d} 10:00:{r.randrange(60):02d}"
    row = "ts string, rule string, path string, title string"
    batches = [[(day(n), f"r{r.randrange(3)}", r.choice(["a/x.py", "b\\x.py", "y.py", None]), "t") for _ in range(40)] for n in (1, 2, 3)]
    batches[1] += [(day(2), " ", "p", "t"), (day(2), "r", "p", ""), (day(2), None, "p", "t")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    whole = spark.createDataFrame([x for b in batches for x in b], row).selectExpr("timestamp(ts) ts", "rule", "coalesce(path, '') path", "title")

    def run(rows, out, keep=None):
        spark.createDataFrame(rows, row).selectExpr("timestamp(ts) ts", "rule", "path", "title").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("ts timestamp, rule string, path string, title string").parquet(src)
        incremental.keep_feedback(stream, out, out + "-cp", "1 day", keep).awaitTermination()
        return sorted(map(tuple, incremental.feedback_now(spark, out).collect()))

    for b in batches:
        got = run(b, out)
    want = history.feedback(whole.where("trim(rule) <> '' and trim(title) <> ''"))
    assert got == sorted(map(tuple, want.collect())) and len(got) == 9
    again = str(tmp_path / "again")
    assert [x[2] for x in run([("2024-01-03 11:00:00", "q", "p", "t")], again, 10)] and ("q|p|t" in {x[0] for x in run([], again, 10)})
    kept = run([("2024-03-01 00:00:00", "z", "p", "t")], again, 10)
    kept = run([("2024-03-02 00:00:00", "z", "p", "t"), ("2024-03-02 00:00:00", "q", "p", "t")], again, 10)
    assert [(x[0], x[2]) for x in kept] == [("q|p|t", 1), ("z|p|t", 2)]


def test_checked_stream(spark, tmp_path):
    """Masks and block checks count in a stream, and its facts make the call graph of all files that came."""
    from siftlake.streaming import incremental

    into, out, facts = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "facts")
    into.mkdir()
    run = lambda: incremental.scan_stream(spark, str(into), out, str(tmp_path / "cp"), facts).awaitTermination()
    (into / "b.py").write_text("def g(c):\n    os.system(c)\n")
    run()
    (into / "a.py").write_text('from b import g\ndef f():\n    """\n    os.system(x)\n    """\n    g(input())\n    s = "os.system(x)"\n')
    run()
    assert [(r.path.rsplit("/", 1)[1], r.rule_id, r.line_start) for r in spark.read.parquet(out).collect() if r.rule_id == "R-SEC-002"] == [("b.py", "R-SEC-002", 2)]
    edges = graph.call_edges(incremental.facts_now(spark, facts).withColumn("path", F.regexp_extract("path", "[^/]+$", 0)))
    assert [(r.caller, r.callee) for r in edges.collect()] == [("a.f", "b.g")]
