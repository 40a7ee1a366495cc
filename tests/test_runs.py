"""Packs, rule admission and the store of runs."""

import json

import pytest

from siftlake.operators import store
from siftlake.operators.rules import PYTHON
from siftlake.sources import runs

ROW = "pos int, id string, title string, severity string, category string, pattern string"


def test_admission(spark):
    bad = ["(", "a[", None, "", "x{2,1}", "(?P<n"]
    new = spark.createDataFrame([(i, f"R-{i}", "t", "low", "style", p) for i, p in enumerate([*bad, "a+", "(?i)x|y"])], ROW)
    rows, log = store.upsert(new.limit(0), new, new.select("id").limit(0))
    assert {r.id for r in rows.collect()} == {"R-6", "R-7"} and {r.reason for r in log.where("not created").collect()} == {"pattern"}


def test_tree(spark):
    rows = spark.range(2000).selectExpr("concat('r', id) id", "if(id % 7 = 0, null, id) n")
    root = lambda d: tuple(store.pack_checksum(d).first())
    told = root(rows)
    assert told == root(rows.repartition(7).orderBy("n").select("n", "id")) and told[1] == 2000
    assert root(rows.union(rows.limit(1)))[2] != told[2] and root(rows.limit(0))[1] == 0
    other = rows.where("id <> 'r5'").union(spark.createDataFrame([("new", 1)], "id string, n long")).union(rows.where("id = 'r9'"))
    got = {json.loads(r.row)["id"]: (r.a, r.b) for r in store.pack_differences(rows, other).collect()}
    assert got == {"r5": (1, 0), "new": (0, 1), "r9": (1, 2)}
    assert store.pack_differences(rows, rows.repartition(3)).count() == 0
    nodes = {d: store.tree_hash(rows, d).count() for d in (0, 2, 4)}
    assert nodes[0] == 1 and 240 <= nodes[2] <= 256 < nodes[4] < 2000


def test_pack_round_trip(spark, tmp_path):
    path = str(tmp_path / "pack")
    own = spark.createDataFrame([(1, "R-1", "t", "low", "style", "a+"), (2, "R-2", None, "low", "style", "b"), (3, "R-1", "u", "low", "style", "(")], ROW)
    items = spark.createDataFrame([("K-1", "t", ["x"], False), ("K-2", "t", None, True)], "id string, title string, tags array<string>, builtin boolean")
    told = store.write_pack(own, items, path)
    rules, kept = store.read_pack(spark, path)
    assert {r.id for r in kept.collect()} == {"K-1"} and rules.count() == 3 and "pos" not in rules.columns
    have = own.drop("pos").limit(0)
    rows, log = store.import_pack(rules, store.pack_checksum(rules).first().checksum, have, items.select("id"), dry_run=True)
    assert rows.count() == 0 and sorted((r.id, r.reason) for r in log.collect()) == [("R-1", "dry run"), ("R-1", "pattern"), ("R-2", "title")]
    rows, _ = store.import_pack(rules, "", have, items.select("id"))
    assert [r.title for r in rows.collect()] == ["t"]
    head = json.loads(spark.read.text(f"{path}/head").first().value)
    assert head["checksum"] == told
    for change in ({"pack": "other"}, {"checksum": "0" * 32}):
        spark.createDataFrame([(json.dumps(head | change),)], "value string").write.mode("overwrite").text(f"{path}/head")
        with pytest.raises(ValueError):
            store.read_pack(spark, path)
    assert len(store.rules_fingerprint(PYTHON)) == 16 and store.rules_fingerprint(PYTHON) != store.rules_fingerprint(PYTHON[1:])


def run_id(i: int) -> str:
    return f"202401{1 + i // 24:02d}-{i % 24:02d}0000-{i:06x}"


def test_newest_reports(spark, tmp_path):
    """The limit counts files, before any is read; older ones could not be read at all."""
    for i in range(60):
        text = json.dumps({"id": run_id(i), "ts": i, "target": f"t{i}", "engine": {"model": "m"}, "stats": {"total": 1, "by_severity": {"low": 1}}, "issues": [{"rule_id": f"r{i}", "path": "p", "line_start": 1}]})
        (tmp_path / f"{run_id(i)}.json").write_text("{broken" if i in (3, 58) else text)
    (tmp_path / "notes.json").write_text("{}")
    got = runs.summaries(spark, str(tmp_path), 5).collect()
    assert [r.id for r in got] == [run_id(i) for i in (59, 57, 56, 55)] and got[0].model == "m" and got[0].by_severity == {"low": 1} and got[0].mode == ""
    found = runs.newest(spark, str(tmp_path), 5)
    assert len(found.inputFiles()) == 5 and {r.rule_id for r in found.collect()} == {f"r{i}" for i in (59, 57, 56, 55)}
    assert {r.id for r in runs.retired(spark, str(tmp_path), 50).collect()} == {run_id(i) for i in range(10)}
    (tmp_path / "none").mkdir()
    assert runs.summaries(spark, str(tmp_path / "none")).count() == 0 == runs.newest(spark, str(tmp_path / "none")).count()


def test_store_of_runs(spark, tmp_path):
    root = str(tmp_path / "runs")
    rows = spark.createDataFrame([(run_id(i), f"r{k}", "p", k) for i in range(6) for k in range(3)], "run string, rule_id string, path string, line_start int")
    runs.append(rows.where(f"run < '{run_id(4)}'"), root)
    runs.append(rows.where(f"run >= '{run_id(4)}'"), root)
    got = runs.load(spark, root, n=2)
    assert {(r.run, r.rule_id) for r in got.collect()} == {(run_id(i), f"r{k}") for i in (4, 5) for k in range(3)}
    assert "PartitionFilters: [run" in got._jdf.queryExecution().toString()
    assert runs.load(spark, root, run=run_id(1)).count() == 3 and runs.load(spark, root, run="../x").count() == 0 and runs.load(spark, root).count() == 18
    assert runs.ids(spark, root, 1) == [run_id(5)]
    with pytest.raises(Exception, match="not the id of a run"):
        runs.append(rows.withColumn("run", rows.path), root)
