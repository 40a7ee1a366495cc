"""The file-tree source: pruning before reading, names with underscores, partitions."""

import os

import pytest

from siftlake.sources import files


@pytest.fixture
def tree(tmp_path):
    for name in ("a.py", "pkg/__init__.py", "pkg/_x.py", ".hidden.py", "node_modules/m.js", "data/d.py", "pkg/data/e.py", "pkg/skip_me.py", "out/o.ts", "b.txt", "c.JS", "dist/z.py"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(f"x = '{name}'\r\n".encode() + (b"\xff" if name == "a.py" else b""))
    os.symlink(tmp_path / "nowhere.py", tmp_path / "node_modules" / "gone.py")  # can't be opened, in a folder that is ignored
    os.symlink(tmp_path / "nowhere.py", tmp_path / "pkg" / "skip_gone.py")
    return tmp_path


def test_tree_is_pruned(spark, tree):
    ignore = [*files.IGNORED, "skip_*.py"]
    got = {r.path: r.text for r in files.read_files(spark, str(tree), ignore=ignore).collect()}
    assert sorted(got) == [".hidden.py", "a.py", "data/d.py", "out/o.ts", "pkg/__init__.py", "pkg/_x.py", "pkg/data/e.py"]
    assert got["a.py"] == "x = 'a.py'\r\n�" and got["pkg/_x.py"] == "x = 'pkg/_x.py'\r\n"
    audit = files.read_files(spark, "file://" + str(tree), ignore=["skip_*"], folders=files.AUDIT_IGNORED)
    assert sorted(r.path for r in audit.collect()) == [".hidden.py", "a.py", "pkg/__init__.py", "pkg/_x.py"]


def test_one_file_and_none(spark, tree):
    assert [tuple(r) for r in files.read_files(spark, str(tree / "b.txt")).collect()] == [("b.txt", "x = 'b.txt'\r\n")]
    (tree / "empty").mkdir()
    assert files.read_files(spark, str(tree / "empty")).count() == 0


def test_files_are_dealt_by_size(spark, tree, monkeypatch):
    monkeypatch.setattr(files, "PART", 1)
    reader = files.TreeReader({"root": str(tree), "exts": '[".py"]', "folders": '["data"]'})
    parts = [p.value for p in reader.partitions()]
    assert all(len(p) <= 1 for p in parts) and len(parts) == 7
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [".hidden.py", "a.py", "dist/z.py", "pkg/__init__.py", "pkg/_x.py", "pkg/skip_me.py"]


def test_dependency_reports(spark):
    """Both formats, a bare list, repeated rows, missing fields, and outputs that tell nothing."""
    from siftlake.sources import files

    texts = {
        "a": '{"dependencies":[{"name":"p","version":"1","vulns":[{"id":"X-1","aliases":["Y","CVE-1"],"fix_versions":["2","3"],"description":"d"},{"id":"X-1","aliases":["CVE-9"],"fix_versions":[]},{"id":"X-2"}]},{"name":"q","vulns":null}]}',
        "b": '[{"name":"p","version":"1","vulns":[{"id":"X-1"}]}]',
        "c": '{"vulnerabilities":{"l":{"severity":"MODERATE","via":["m",{"t":1}]},"k":{"severity":"info"},"j":{}}}',
        "d": "oops", "e": " ", "f": None, "g": '{"dependencies":[]}',
    }
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    got = {(r.path, r.rule_id): (r.severity, r.fix, r.source, r.analysis) for r in files.dependency_issues(df).collect()}
    assert got == {
        ("a", "DEP-CVE-1"): ("high", "2, 3", "X-1 (CVE-1)", "d"), ("a", "DEP-X-2"): ("high", "see the advisory", "X-2", ""), ("b", "DEP-X-1"): ("high", "see the advisory", "X-1", ""),
        ("c", "DEP-NPM-l"): ("medium", "see the advisory", "registry audit", '["m",{"t":1}]'), ("c", "DEP-NPM-k"): ("medium", "see the advisory", "registry audit", "[]"), ("c", "DEP-NPM-j"): ("medium", "see the advisory", "registry audit", "[]"),
    }
    assert sorted(map(tuple, files.dependency_notes(df).collect())) == [("d", "unreadable scanner output"), ("e", "no scanner output"), ("f", "no scanner output")]


def test_first_match_of_a_hot_path(spark):
    """Bins against all pairs of one path."""
    import random

    from siftlake.operators import evaluate

    r = random.Random(4)
    cl = [("p", i, lo, lo + r.choice([0, 3, 200]), r.sample("abc", r.randrange(0, 3))) for i, lo in enumerate(r.sample(range(-20, 3000), 150))]
    exp = [("p", r.choice("abc"), r.randrange(3000), k) for k in range(200)]
    want = {}
    for _, i, lo, hi, keys in cl:
        fits = [k for _, key, line, k in exp if key in keys and lo - 2 <= line <= hi + 2]
        if fits:
            want[i] = min(fits)
    got = evaluate.first_match(spark.createDataFrame(cl, "path string, cluster int, lo int, hi int, keys array<string>"), spark.createDataFrame(exp, "path string, key string, line int, ord int"))
    assert {x.cluster: x.ord for x in got.collect()} == want and len(want) > 30
