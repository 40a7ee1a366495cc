"""Retrieval by automaton and by blocks against plain loops."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import kb

ITEM = "ord int, triggers array<string>, tags array<string>, title string, not_when array<string>, require_any_in array<string>"


def made(seed=2):
    r = random.Random(seed)
    word = lambda: r.choice(["eval(", "Exec", "path", "import", "os.", "SQL", "open", "é", "select_from", "", "aab", "ab"])
    some = lambda n: r.choice([None, [], [word() for _ in range(r.randrange(n))], [word(), None]])
    items = [(i, some(4), some(3), r.choice([None, "Path open SQL path the", "eval of import", ""]), some(2), some(3)) for i in range(40)]
    texts = [(i, r.choice([None, " ".join(word() for _ in range(r.randrange(20)))]), r.choice([None, word()])) for i in range(60)]
    return items, texts


def plain(items, texts, scoped):
    out = {}
    for q, text, scope in texts:
        low = (text or "").lower()
        where = scope.lower() if scoped and scope is not None else low
        words = set(re.findall(r"[a-z_]{3,}", low)) - set(kb.STOP)
        for ord_, triggers, tags, title, bad, need in items:
            lows = lambda xs: [x.lower() for x in xs or () if x is not None]
            score = 3 * sum(t in low for t in lows(triggers)) + 2 * sum(t in words for t in lows(tags)) + sum(w in words for w in re.findall(r"[a-z_]{3,}", (title or "").lower()))
            out[q, ord_] = (score, any(x in where for x in lows(bad)) or (bool(need) and not any(x in where for x in lows(need))))
    return out


@pytest.mark.parametrize(("scoped", "most"), [(False, 1 << 20), (True, 400)])
def test_retrieve(spark, scoped, most):
    items, texts = made()
    want = plain(items, texts, scoped)
    t = spark.createDataFrame(texts, "query_id int, text string, scope string")
    i = spark.createDataFrame(items, ITEM)
    t = t if scoped else t.drop("scope")
    got = {(r.query_id, r.ord): (r.score, r.vetoed) for r in kb.retrieve(t, i, vetoes=True, most=most).collect()}
    assert got == {k: v for k, v in want.items() if v[0] or v[1]}
    best = [(r.query_id, r["rank"], r.ord, r.score) for r in kb.retrieve(t, i, 3, most=most).orderBy("query_id", "rank").collect()]
    order = [(q, sorted(((-want[q, o][0], o) for o in range(40) if want[q, o][0] and not want[q, o][1]))[:3]) for q in range(60)]
    assert best == [(q, n + 1, o, -s) for q, rows in order for n, (s, o) in enumerate(rows)]
    assert kb.retrieve(t, i.limit(0)).count() == kb.retrieve(t.limit(0), i, 2).count() == 0


@pytest.mark.parametrize("block", [4, 1 << 13])
def test_vector_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(kb, "ITEMS", block)
    monkeypatch.setattr(kb, "ASKED", block)
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 6))
    x[7], x[9] = x[8], 2 * x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    e = spark.createDataFrame([*rows, (70, None), (71, []), (72, [1.0, float("nan")]), (73, [1.0, 2.0])], "ord long, v array<double>")
    got = kb.vector_top_k(e.withColumnRenamed("ord", "query_id"), e, 4, others=True).orderBy("query_id", "rank").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [(i, j) for i in range(60) for _, j in sorted((-max(round(float(u[i] @ u[j]), 6), 0.0), j) for j in range(60) if j != i)[:4]]
    assert [(g.query_id, g.ord) for g in got] == want
    again = kb.vector_store(e).count()
    assert again == kb.vector_store(e.repartition(3)).count() >= 60 // (2 * block)


def test_fusion_and_its_parts(spark):
    rows = spark.createDataFrame([(1, 1, 4, 0.5, False), (1, 2, 8, 0.0, True), (1, 3, 0, 0.09, False), (2, 1, 0, -1.0, False), (2, 2, 0, 0.3, False)], "query_id int, ord int, kw int, cos double, vetoed boolean")
    assert sorted((r.query_id, r.ord, r.score) for r in kb.fuse(rows).collect()) == [(1, 1, 0.5), (2, 2, 0.15)]
    one = spark.createDataFrame([("Use Eval( here", ["eval(", "x"], ["use", "eval"], "eval use use", [1.0, 0.0], [1.0, 1.0])], "q string, t array<string>, g array<string>, n string, a array<double>, b array<double>")
    got = one.select(kb.keyword_score(F.col("q"), kb.words(F.col("q")), F.col("t"), F.col("g"), F.col("n")), kb.veto(F.col("q"), F.array(F.lit("HERE")), F.array().cast("array<string>")), kb.veto(F.col("q"), F.array().cast("array<string>"), F.array(F.lit("no"))), F.round(kb.cosine(F.col("a"), F.col("b")), 6), T.knowledge_text(F.col("n"), F.lit(None).cast("string"), F.col("g"), F.col("t"))).first()
    assert tuple(got) == (3 + 4 + 3, True, True, 0.707107, "eval use use  use eval eval( x")
