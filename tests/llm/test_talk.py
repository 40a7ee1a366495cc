"""Conversation repair, prefix trie and toxicity against brute force; nulls, empties, ties, repeats, long rows, odd columns."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftlake.llm import prefixtrie, repair, toxic

from ..conftest import DATA

TALK = "conv_id long, turn long, role string, text string, part string, kind string, c string, d string"


def talk(seed=3, n=60):
    r = random.Random(seed)
    said = ["Yes.", "No", "Why?", "", "  \t", "Ähm!", "so it is. ", "Fine!\n", "a" * 40_000 + "."]
    rows = []
    for c in [*range(n), -5, -20, 1000]:
        for t in range(r.randrange(1, 12) if c != 7 else 90):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[t % 2]
            role = "system" if t == 0 and r.random() < 0.3 else r.choice([role] * 12 + ["tool", "", None])
            rows.append((c, r.choice([t] * 9 + [None, 0, t + 3]), role, r.choice([*said, None, f"turn {t}.", f"turn {t}"])))
    rows += [rows[0], rows[5], rows[5]] + [(None, 0, "user", "Hm?"), (None, 1, "assistant", "Hm."), (2000, None, None, None)]
    for k in range(3):  # conversations of equal turns
        rows += [(3000 + k, t, ("user", "assistant")[t % 2], f"same {t}.") for t in range(5)]
    rows += [(3003, t, ("user", "assistant")[t % 2], f"same {t}.") for t in range(9)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", "y", "1", "2") for r in rows], TALK).repartition(parts)


LEGAL = re.compile(r"\A(s?(ua)+)?\Z")


def cheapest(rows):
    """Dijkstra over (cost, audit): rows are (role, text, fault); every audit is grown letter by letter and the end is judged by the grammar."""
    roles = {"u": "user", "a": "assistant"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, made, lines = heapq.heappop(heap)
        if k == len(rows) and LEGAL.match(made):
            return cost, audit, "\n".join(lines)
        if (k, made[-1:]) in seen and k < len(rows):
            continue
        seen.add((k, made[-1:]))
        follow = "a" if made[-1:] == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", k, made + follow, (*lines, roles[follow] + ":")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, made, lines))
            if fault != "drop":
                more = 3 * (fault == "cut")
                if role[:1] == follow or (role[:1] == "s" and not made):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, made + role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, made + follow, (*lines, f"{roles[follow]}:{text}")))


def brute_repair(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            convs[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, kept in convs.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2].encode()))
        seen, faults = set(), []
        for _, role, text in kept:
            left = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not left else "copy" if (role, text) in seen else "cut" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        n, turns = Counter(faults), {t for t, _, _ in kept if t is not None}
        cost, audit, made = cheapest([(role, text, "drop" if f in ("blank", "copy") else f) for (_, role, text), f in zip(kept, faults, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["copy"], n["cut"], illegal, cost, audit, hashlib.sha256(made.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_repair(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = talk()
    got = repair.repair(frame(spark, rows)).collect()
    want = brute_repair(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_search_is_cheapest():
    r = random.Random(8)
    for _ in range(400):
        rows = [(r.choice("sua-"), r.choice("fftd")) for _ in range(r.randrange(8))]
        cost, audit, _ = cheapest([({"s": "system", "u": "user", "a": "assistant", "-": ""}[a], "x", {"f": "", "t": "cut", "d": "drop"}[f]) for a, f in rows])
        assert repair.search("".join(a + f for a, f in rows)) == (cost, audit)


def test_blocks_chain_to_the_whole():
    r = random.Random(9)
    for _ in range(200):
        pattern = "".join(r.choice("sua-") + r.choice("fftd") for _ in range(r.randrange(1, 40)))
        parts = [pattern[i : i + 10] for i in range(0, len(pattern), 10)]
        ways = [[repair.search(p, q, g) for q in range(4) for g in range(5)] for p in parts]
        ranks = []
        for w in ways:
            order = sorted({x[1] for x in w if x})
            ranks.append([order.index(x[1]) if x else -1 for x in w])
        cost, way = repair.chain([[x[0] if x else -1 for x in w] for w in ways], ranks)
        assert (cost, "".join(w[q * 5 + g][1] for w, (q, g) in zip(ways, way, strict=True))) == repair.search(pattern)


def test_long_patterns_end():
    r = random.Random(10)
    pattern = "".join(r.choice("sua-") + r.choice("fftd") for _ in range(repair.BLOCK))
    assert len(repair.search(pattern)[1]) >= repair.BLOCK


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def sums(path):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [sums(k) for k in kids[path]]
        return sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[path]) - 1) * words

    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *sums(p), ends(p)) for p, m in members.items()), key=str)


@pytest.mark.parametrize(("members", "turns"), [(1 << 12, 1 << 17), (2, 4), (1, 1), (5, 10)])
def test_trie(spark, monkeypatch, members, turns):
    monkeypatch.setattr(prefixtrie, "MEMBERS", members)
    monkeypatch.setattr(prefixtrie, "TURNS", turns)
    monkeypatch.setattr(prefixtrie.shared, "__defaults__", (members, turns))
    rows = [r for r in talk(n=45) if r[0] != 7 or (r[1] or 0) < 20]
    got = [tuple(r) for r in prefixtrie.nodes(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_trie(rows)


def test_small_tables(spark):
    none, one = frame(spark, []), frame(spark, [(4, None, None, None)])
    assert repair.repair(none).count() == prefixtrie.nodes(none).count() == 0
    assert sorted((tuple(r) for r in prefixtrie.nodes(one).collect()), key=str) == brute_trie([(4, None, None, None)])
    assert {r[0]: tuple(r[1:]) for r in repair.repair(one).collect()} == brute_repair([(4, None, None, None)])
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in repair.repair(frame(spark, [(dropped, 0, "user", "Hi.")])).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_runs_are_those_of_each_text():
    texts = ["Ab  cÉ", None, "", "x\0y\tz", "\U0001f600 ok"]
    clean = [" " + " ".join((t or "").replace("\0", " ").lower().split()) + " " for t in texts]
    for n, (doc, h) in zip(range(toxic.LOW, toxic.HIGH + 1), toxic.runs(texts), strict=False):
        want = [(i, t[k : k + n]) for i, t in enumerate(clean) for k in range(len(t) - n + 1)]
        assert doc.tolist() == [i for i, _ in want]
        assert len({g for _, g in want}) == len(set(h.tolist())) == len(set(zip((g for _, g in want), h.tolist(), strict=True)))


def test_weights_reach_the_least_loss():
    r = np.random.default_rng(1)
    x = (r.random((300, 12)) < 0.3) * 1.0
    label = (r.random(300) < 1 / (1 + np.exp(-(x[:, 0] * 3 - 1)))) * 1.0
    doc, k = np.nonzero(x)
    ratio = r.normal(size=12)
    w, bias, grad = toxic.fit_weights(doc, k, ratio, label, np.ones(300), 1e-2, 1500)
    loss = lambda w, b: np.mean(np.logaddexp(0, (x * ratio) @ w + b) - label * ((x * ratio) @ w + b)) + 0.5e-2 * w @ w
    assert grad < 1e-3
    for _ in range(50):
        assert loss(w, bias) <= loss(w + 0.05 * r.normal(size=12), bias + 0.05 * r.normal()) + 1e-9


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxic.judge(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    hit = sum(p and t for p, t in held)
    assert hit / sum(p for p, _ in held) > 0.95 and hit / sum(t for _, t in held) > 0.85


def test_toxicity_odd_rows(spark):
    bad, good = "you idiot %d moron", "you are kind %d friend"
    rows = [(i, (bad if i % 3 == 0 else good) % i, "x", 0.5) for i in range(300)]
    odd = [(None, None, "x", 0.1), (None, bad, "x", 0.1), (900, "", "x", 0.1), (901, None, "x", 0.1), (902, "idiot " * 100_000, "x", 0.1), (5, rows[5][1], "x", 0.5), (5, rows[5][1], "x", 0.5)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(300)] + [(None, 1, "x"), (7, None, "x"), (6, 0, "x"), (5000, 1, "x")], "doc_id long, toxic int, text string")
    found = toxic.judge(docs, labels, ("doc_id", "text", "held_out", "score"))
    assert found.columns == ["doc_id", "text", "held_out_", "score_", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows) + len(odd)
    assert len({r.score for r in got if not r.text}) == 1 and len({(r.text, r.score) for r in got}) == len({r.text for r in got})
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert next(r for r in got if r.doc_id == 902).predicted == 1
    assert toxic.judge(docs.limit(0), labels).count() == 0
    assert max(r.score for r in toxic.judge(docs, labels.limit(0)).collect()) < 1e-9
    assert min(r.score for r in toxic.judge(docs, labels.where("toxic = 1")).collect()) > 1 - 1e-9
