"""Operators on pairs and repeats against brute force; nulls, empties, ties and repeated rows."""

import hashlib
import random

import numpy as np
import pytest

from siftlake.llm import graph, mixing, nearcopies, simhash, suffixes, vectors


def texts():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(0, 60))) for _ in range(40)]
    near = [b.replace("alpha", "alphA").replace("beta gamma", "beta gamme", 1) for b in base]
    return [None, "", "  ", "one", "one two", *base, *base[:8], *near, base[3]]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(500, k) for k in range(200, 260)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_golay_keys_miss_nothing():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = a.copy()
    for k in range(3):
        b ^= np.where(r.random(3000) < 0.9, np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64), np.uint64(0))
    for x, y in ((a, b), (b, a)):
        ra, ka = simhash.keys(x.view(np.int64), False)
        rb, kb = simhash.keys(y.view(np.int64), True)
        left, right = set(zip(ra.tolist(), ka.tolist(), strict=True)), set(zip(rb.tolist(), kb.tolist(), strict=True))
        assert {i for i, _ in left & right} == set(range(3000))


def test_simhash(spark):
    rows = [(i if i != 9 else None, t, "extra") for i, t in enumerate(texts())] + [(5, texts()[5], "extra")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(got) == len(rows)
    fps = {(d, t): simhash.fingerprint(t) for d, t, _ in rows}
    keys = sorted(set(fps.values()))
    comp = {k: k for k in keys}
    for _ in keys:
        for a in keys:
            for b in keys:
                if (a ^ b).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min((d for (d, _), f in fps.items() if comp[f] == c and d is not None), default=None) for c in set(comp.values())}
    by_fp = {f: least[comp[f]] for f in keys}
    for r in got:
        assert r.component_id == by_fp[r.fp % (1 << 64)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert len(kept) == len(set(comp.values())) and simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("options", [{"min_len": 12, "k": 5}, {"min_len": 20, "k": 8, "heavy": 1}, {"min_len": 20, "k": 8, "bucket": 500}, {"min_len": 20, "k": 8, "stride": 50}])
def test_repeats(spark, options):
    t = texts() + ["a" * 100, "a" * 57, "é" * 40, "abc" * 30, "abc" * 30, "x\0\0\0" * 20]
    df = spark.createDataFrame([(i % 70 if i > 3 else None, x, 1) for i, x in enumerate(t)], "doc_id long, text string, at int").repartition(3)
    got = sorted((r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(df, **options).collect())
    assert got == sorted(suffixes.brute_force(t, options["min_len"]))
    assert suffixes.remove_repeats(df.limit(0)).count() == 0
    clash = suffixes.remove_repeats(df.withColumns({c: df["at"] for c in ("spans", "kept", "n_bytes")}), ("spans", "kept", "n_bytes", "at"), **options)
    assert clash.columns == ["doc_id", "at", "spans_", "kept_", "n_bytes_", "n_bytes", "n_removed", "spans", "kept"] and {r.spans_ for r in clash.collect()} == {1}


def test_suffix_levels_merge():
    r = random.Random(9)
    segs = [bytes(r.choice(b"ab") for _ in range(60)) for _ in range(40)]
    found = suffixes.repeated(segs, [False] * 40, 12, batch=100)
    seen = {}
    for s in segs:
        for i in range(len(s) - 11):
            seen[s[i : i + 12]] = seen.get(s[i : i + 12], 0) + 1
    assert [m.tolist() for m in found] == [[seen[s[i : i + 12]] > 1 for i in range(len(s) - 11)] for s in segs]
    levels = suffixes.SuffixLevels(12)
    for s in segs:
        levels.add(np.frombuffer(s, np.uint8), np.arange(49))
    assert len(levels.levels) <= 7


def test_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 8))
    x = np.concatenate((x, x[:20] * 3, x[:15] + r.normal(scale=0.15, size=(15, 8)), np.tile(x[5], (10, 1))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] + [1.0] * 7), (904, [1.0, 2.0]), (905, []), (906, [2.0, 4.0])]
    got = {g.vec_id: g for g in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    comp = list(range(len(x)))
    for _ in comp:
        for i, j in zip(*np.nonzero(near), strict=True):
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert [got[i].component_id for i in range(len(x))] == comp
    assert [got[i].n_links for i in range(900, 907)] == [0, 0, 0, 0, 1, 0, 1] and got[906].component_id == 904
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    lone = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (7, [0.0, 1.0]), (8, [0.01, 1.0]), (8, [-1.0, 0.0]), (None, [-1.0, 0.01]), (None, None)]
    got = vectors.near_vectors(spark.createDataFrame([(*x, "n") for x in lone], "vec_id long, embedding array<double>, least string"))
    assert sorted((g.vec_id or 0, g.n_links, g.component_id or 0, g.kept) for g in got.collect()) == [(0, 0, 0, False), (0, 1, 0, False), (0, 1, 0, False), (0, 1, 7, False), (7, 1, 7, True), (8, 1, 7, False), (8, 1, 7, False)]


def test_mixing_inclusion(spark):
    """Over many seeds documents are drawn as often as their own probabilities say, the likely and the unlikely ones."""
    rows = [(i, "a" if i % 3 else "b", " ".join(["w"] * (1 + i % 40))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    drawn = [(g.p, g.copies - g.whole) for k in range(12) for g in mixing.mix(df, bins=8, seed=f"s{k}").collect() if g.p > 0]
    middle = sorted(p for p, _ in drawn)[len(drawn) // 2]
    assert len({p for p, _ in drawn}) > 20 and {x for _, x in drawn} == {0, 1}
    for own in ([d for d in drawn if d[0] < middle], [d for d in drawn if d[0] >= middle]):
        assert abs(sum(x for _, x in own) - sum(p for p, _ in own)) < 0.08 * len(own)


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", None, "c"]), " ".join(["w"] * r.randrange(0, 30))) for i in range(800)] + [(1, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, bins=8).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), bins=64).collect()))
    for s in ("a", "b", "c", None):
        own = [g for g in got if g.source == s]
        assert abs(sum(g.copies * g.size for g in own) - own[0].target) <= 30 and all(g.copies <= 2 for g in own)
    assert abs(sum({g.source: g.target for g in got}.values()) - 1.5 * sum(g.size for g in got)) < 1e-6
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline_keeps_one_of_near_copies(spark):
    """Copies of similarity 0.8 to 1 leave one; those below stay, also where fingerprints are near."""
    import corpus_pipeline

    r = random.Random(6)
    docs = []
    for k in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        docs.append(" ".join(words))
        for _ in range(k % 6):  # a replaced word takes five shingles of 196
            words[r.randrange(20, 180)] = f"new{r.randrange(10**6)}"
        docs.append(" ".join(words))
    docs += [docs[0], docs[0].upper() + " ", None, "", "one", "One", "one two"]
    sets = [nearcopies.shingles(t).tolist() for t in docs]
    part = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = set(sets[i]), set(sets[j])
            if len(a & b) / len(a | b) >= 0.8:
                part = [part[j] if x == part[i] else x for x in part]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(docs)], "doc_id long, text string, source string").repartition(4)
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted({min(i for i, x in enumerate(part) if x == p) for p in part}) and 60 < len(got) < len(docs)


def family(r, groups=30, common=400, pair=6, own=46):
    """Texts over one passage: those of a pair reach a similarity of 0.8, all others nearly do."""
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    base = words(common)
    return [" ".join(base + shared + words(own)) for _ in range(groups) for shared in [words(pair)] for _ in range(2)]


@pytest.mark.parametrize("tile", [7, 256])
def test_near_copies_in_a_large_group(spark, monkeypatch, tile):
    monkeypatch.setattr(nearcopies, "TILE", tile)
    r = random.Random(5)
    docs = family(r) + [" ".join(d.split()[:-1] + [f"x{k}"]) for d in family(r, 1) for k in range(40)]
    sets = [set(nearcopies.shingles(d).tolist()) for d in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    found = nearcopies.links(spark.createDataFrame([(d, i) for i, d in enumerate(docs)], "text string, tk long").repartition(3))
    assert {(x.a, x.b) for x in found.collect()} <= set(near)
    part = list(range(len(docs)))
    for i, j in near:
        part = [part[i] if x == part[j] else x for x in part]
    group = {x.node: x.component for x in graph.components(found).collect()}
    assert [group.get(i, i) for i in range(len(docs))] == [min(j for j, p in enumerate(part) if p == q) for q in part] and len(near) > 30


def test_alike_is_jaccard():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    side = lambda x: (np.array([len(s) for s in x]), np.concatenate(x))
    got = nearcopies.alike(side(sets[:15]), side(sets[15:]), 0.3)
    assert got.tolist() == [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.3 for b in sets[15:]] for a in sets[:15]]
