"""Reports of one document, read back by a JSON reader."""

import json

from siftlake.operators import documents, report

FINDING = "pos long, rule_id string, severity string, category string, title string, analysis string, path string, line_start int, line_end int, detector string, confidence double, evidence string, fix string, source string"


def found(n=300):
    rows = [(i, f"R-{i % 7}", ["critical", "high", "medium", "low", "odd"][i % 5], "security" if i % 2 else "", f'say "{i}"\n' if i % 3 else "", "why – ü" * (i % 4), f"/src/a{i % 9}\\b.py", i % 4, None if i % 2 else i, "llm", i / 300, "x" * (i * 3), "y = 1", "") for i in range(n)]
    return rows, rows[::-1]


def read(spark, lines, path):
    documents.write_document(lines, str(path))
    return json.loads(path.read_text(encoding="utf-8"))


def test_sarif_document(spark, tmp_path):
    rows, shuffled = found()
    f = spark.createDataFrame(shuffled, FINDING).repartition(5)
    doc = read(spark, documents.sarif_document(f, "a\\b", root="/src"), tmp_path / "r.sarif")
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == [f"R-{i}" for i in range(7)] and run["automationDetails"]["id"] == "siftlake/a/b"
    assert len(run["results"]) == 300
    for row, got in zip(rows, run["results"], strict=True):
        start, end = row[7] or 1, row[8] or row[7] or 1
        assert (got["ruleId"], got["ruleIndex"], got["level"]) == (row[1], int(row[1][2:]), {"critical": "error", "high": "error", "low": "note"}.get(row[2], "warning"))
        assert got["message"]["text"] == f"{row[4]} — {row[5]}".strip(" —")[:2000]
        assert got["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": row[6][5:].replace("\\", "/")}, "region": {"startLine": start, "endLine": max(start, end)}}
        assert got["properties"]["evidence"] == row[11][:500] and got["partialFingerprints"]["primaryLocationLineHash"] == f"{row[1]}:{row[6][5:].replace(chr(92), '/')}:{start}"
    first = run["tool"]["driver"]["rules"][1]
    assert first["shortDescription"]["text"] == rows[1][4] and first["properties"] == {"tags": ["security", "R-1"], "security-severity": "7.0"} and first["name"] == "R1"


def test_json_report(spark, tmp_path):
    rows, shuffled = found(120)
    f = spark.createDataFrame(shuffled, FINDING).repartition(4)
    doc = read(spark, documents.json_report(f, "t", {"model": "m"}, {"raw": 130}), tmp_path / "r.json")
    order = ["critical", "high", "medium", "low", "odd"]
    want = sorted(rows, key=lambda r: (order.index(r[2]), r[6], r[7], r[0]))
    assert [(i["rule_id"], i["path"], i["line_start"]) for i in doc["issues"]] == [(r[1], r[6], r[7]) for r in want]
    assert doc["stats"]["total"] == 120 and doc["stats"]["raw"] == 130 and doc["stats"]["by_severity"]["odd"] == 24 and doc["engine"] == {"model": "m"}


def test_empty_documents(spark, tmp_path):
    f = spark.createDataFrame([], FINDING)
    assert read(spark, documents.sarif_document(f), tmp_path / "a")["runs"][0]["results"] == [] and read(spark, documents.json_report(f, ""), tmp_path / "b")["issues"] == []
    assert report.sarif_results(f).count() == 0
