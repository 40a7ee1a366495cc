"""Near copies by the Jaccard similarity of their word shingles; the pipeline's second stage.

Candidates come from two sides. Operator 9: SimHash fingerprints of the same shingles at most three bits apart, by its
Golay-code keys. As a similarity of 0.8 moves some ten bits, texts are also keyed by MinHash.
Every distinct text gives BANDS keys of ROWS minima each, under BANDS * ROWS hashes of its distinct shingles. Two texts
of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9996 at 0.8. The texts of a key are paired
with each other, those of a key of more than FEW texts first with four of them, of which two change from key to key.
Pairs are verified by the exact similarity of their shingle sets; only verified ones link. A key of more than FEW texts
whose texts these links leave in several components is then compared whole: its shingle sets are packed into tiles in
order of component, and every pair of tiles is multiplied as membership matrices, but for those that lie in one
component. So no pair that shares a key is lost, and a large group of near copies costs rows times its stragglers, not
rows squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import own_name, part_batches, release, stage, tidy, utf8
from .graph import components
from .vectors import forest

WORDS, LEAST, BANDS, ROWS, FEW, CHUNK = 5, 0.8, 20, 5, 16, 1 << 13
#: A tile's texts and bytes of shingles at most (one text at least); shingles that are multiplied at once.
TILE, TILE_BYTES, COLUMNS = 128, 1 << 18, 1 << 12


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; a shorter text is one, a text without words too."""
    from xxhash import xxh64_intdigest

    w = utf8(text).lower().split()
    return np.fromiter((xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))), np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(hashes(text, words))


def signature(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band."""
    r = np.random.default_rng(11)
    flip, odd = (r.integers(0, 1 << 64, bands * rows, dtype=np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    low = np.full(bands * rows, np.iinfo(np.uint64).max)
    for k in range(0, len(found), CHUNK):
        low = np.minimum(low, ((found[k : k + CHUNK, None] ^ flip) * odd).min(0))
    low, key = low.reshape(bands, rows), np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = (key ^ low[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """docs(tk, text) -> key, tk, n (distinct shingles): BANDS rows a row, and one whose key is the fingerprint and n -1."""

    def work(batches):
        for batch in part_batches(batches):
            tk, keys, n = batch.column("tk").to_numpy(), [], []
            for t in batch.column("text").to_pylist():
                h = hashes(t, words)
                found = np.unique(h)
                keys += [signature(found), np.array([simhash.majority(h)], np.uint64).view(np.int64)]
                n += [len(found)] * BANDS + [-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(tk, BANDS + 1)), pa.array(n, pa.int64())], ["key", "tk", "n"])

    return docs.mapInArrow(tidy(work), "key long, tk long, n long")


def _print_pairs(fps: DataFrame) -> DataFrame:
    """fps(fp, tk) -> a, b: texts of one fingerprint with the first of them, and the first ones of linked fingerprints."""
    nodes = stage(fps.groupBy("fp").agg(F.min("tk").alias("rep"), F.count("*").alias("c")), "shingle-prints")
    alike = fps.join(nodes.where("c > 1"), "fp").where("tk <> rep").select(F.col("rep").alias("a"), F.col("tk").alias("b"))
    near = simhash.links(nodes.select("fp"))
    near = near.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    return alike.union(near.select(F.least("ra", "rb"), F.greatest("ra", "rb")))


def _tiles(rows: DataFrame, words: int) -> DataFrame:
    """rows(key, part, tk, text) -> tiles of a key's texts in order of part: key, tile, lo, hi (parts), tks, parts, sizes, hashes (packed)."""
    names = ("tks", "parts", "sizes", "hashes")

    def work(batches):
        from pyspark import TaskContext

        number, key, held, size = TaskContext.get().partitionId() << 32, None, [], 0

        def tile():
            tks, parts, sets = zip(*held, strict=True)
            packed = [np.array(tks, "<i8"), np.array(parts, "<i8"), np.array([len(x) for x in sets], "<i8"), np.concatenate(sets)]
            row = {"key": key, "tile": number, "lo": min(parts), "hi": max(parts)} | {n: x.tobytes() for n, x in zip(names, packed, strict=True)}
            return pa.RecordBatch.from_pylist([row], pa.schema([(n, pa.int64()) for n in ("key", "tile", "lo", "hi")] + [(n, pa.binary()) for n in names]))

        for batch in part_batches(batches):
            for k, part, tk, text in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "tk", "text")), strict=True):
                found = shingles(text, words)
                if held and (k != key or len(held) == TILE or size + found.nbytes > TILE_BYTES):
                    yield tile()
                    number, held, size = number + 1, [], 0
                key = k
                held.append((tk, part, found))
                size += found.nbytes
        if held:
            yield tile()

    rows = rows.select("key", "part", "tk", "text").repartitionByRange("key", "part", "tk").sortWithinPartitions("key", "part", "tk")
    return stage(rows.mapInArrow(tidy(work), "key long, tile long, lo long, hi long, tks binary, parts binary, sizes binary, hashes binary"), "shingle-tiles")


def alike(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """Which of the sets of one are similar to which of two by least or more; a side is (sizes, their hashes in a row)."""
    both = np.intersect1d(one[1], two[1])
    n = np.zeros((len(one[0]), len(two[0])))
    sides = [(np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(both, hashes), hashes) for sizes, hashes in (one, two)]
    for k in range(0, len(both), COLUMNS):
        part, dense = both[k : k + COLUMNS], []
        for (row, at, hashes), (sizes, _) in zip(sides, (one, two), strict=True):
            ok = (at >= k) & (at < k + len(part))
            ok[ok] = both[at[ok]] == hashes[ok]
            m = np.zeros((len(sizes), len(part)), np.float32)
            m[row[ok], at[ok] - k] = 1
            dense.append(m)
        n += dense[0] @ dense[1].T
    return n / (one[0][:, None] + two[0][None, :] - n) >= least


def _across(large: DataFrame, texts: DataFrame, found: DataFrame, words: int, least: float) -> DataFrame:
    """large(key, tk) -> a, b: links between texts of one key that the links found leave in different components; of a
    pair of tiles as many as tell the components that meet."""
    comp = components(found, found.count())
    rows = stage(large.join(comp, F.col("tk") == F.col("node"), "left").select("key", "tk", F.coalesce("component", "tk").alias("part")), "shingle-large")
    open_ = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.bit_xor(F.xxhash64("tk")).alias("members"), F.count("*").alias("c")).where("lo < hi")
    keys = open_.groupBy("members", "c").agg(F.min("key").alias("key")).select("key")  # keys of the same texts are compared once
    tiles = _tiles(rows.join(keys, "key").join(texts, "tk"), words)
    light = tiles.select("key", "tile", "lo", "hi")
    met = light.join(light.toDF("key", "tile_b", "lo_b", "hi_b"), "key").where("tile <= tile_b and not (lo = hi and lo_b = hi_b and lo = lo_b)")
    met = met.select(F.col("tile").alias("i"), F.col("tile_b").alias("j"), F.explode(F.array_distinct(F.array("tile", "tile_b"))).alias("tile"))

    def work(t: pa.Table) -> pa.Table:
        sides = [{n: np.frombuffer(r[n], "<u8" if n == "hashes" else "<i8") for n in ("tks", "parts", "sizes", "hashes")} for r in sorted(t.to_pylist(), key=lambda r: r["tile"])]
        one, two = sides[0], sides[-1]
        linked = alike((one["sizes"], one["hashes"]), (two["sizes"], two["hashes"]), least) & (one["parts"][:, None] != two["parts"][None, :])
        edges = forest(linked)
        release()
        return pa.table([pa.array([int(one["tks"][x]) for x, _ in edges], pa.int64()), pa.array([int(two["tks"][y]) for _, y in edges], pa.int64())], ["a", "b"])

    dealt = met.join(tiles.drop("key", "lo", "hi"), "tile").groupBy("i", "j")
    return stage(dealt.applyInArrow(work, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "shingle-across")


def links(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs(text, tk) -> a, b: pairs of text hashes, a < b, whose shingle sets are similar by least or more."""
    every = stage(_keys(docs.select("tk", "text"), words).distinct(), "shingle-keys")
    keys = every.where("n >= 0")
    row, mixed = F.struct("tk", "n"), F.xxhash64("tk", "key")
    ends = keys.groupBy("key").agg(F.count("*").alias("c"), F.min(row).alias("r1"), F.max(row).alias("r2"), F.min_by(row, mixed).alias("r3"), F.max_by(row, mixed).alias("r4")).where("c > 1")
    shared = stage(keys.join(ends, "key"), "shingle-groups")
    few = shared.where(F.col("c") <= FEW)
    met = few.select("key", "tk", "n").join(few.select("key", row.alias("o")), "key").select("tk", "n", "o")
    met = met.union(shared.where(F.col("c") > FEW).select("tk", "n", F.explode(F.array("r1", "r2", "r3", "r4")).alias("o")))
    met = met.where((F.col("tk") != F.col("o.tk")) & (F.least("n", "o.n") >= F.lit(least - 1e-9) * F.greatest("n", "o.n")))
    met = met.select(F.least("tk", "o.tk").alias("a"), F.greatest("tk", "o.tk").alias("b")).union(_print_pairs(every.where("n < 0").select(F.col("key").alias("fp"), "tk")))
    pairs = stage(met.distinct(), "shingle-pairs")
    asked = pairs.select(F.col("a").alias("tk")).union(pairs.select("b")).distinct()
    texts = stage(docs.groupBy("tk").agg(F.first("text").alias("text")).join(asked, "tk", "left_semi"), "shingle-texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def verify(batches):
        for batch in part_batches(part_batches(batches, 1 << 19, "ta"), 1 << 19, "tb"):
            same = []
            for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                x, y = shingles(x, words), shingles(y, words)
                n = len(np.intersect1d(x, y, assume_unique=True))
                same.append(n / (len(x) + len(y) - n) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    found = stage(both.select("a", "b", "ta", "tb").mapInArrow(tidy(verify), "a long, b long"), "shingle-links")
    large = shared.where(F.col("c") > FEW).select("key", "tk")
    return found if large.isEmpty() else found.union(_across(large, texts, found, words, least))


def keep_one(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs without near copies: of each group that links join, the row of the smallest doc_id (nulls last) stays, of
    equal ids that of the smallest text hash, of rows alike in both one. All columns of docs come back as they were."""
    id_, tk = own_name("_id", docs.columns), own_name("_tk", docs.columns)
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), tk: F.xxhash64("text")})
    found = links(rows.select("text", F.col(tk).alias("tk")), words, least)
    group = components(found, found.count())
    ids = rows.groupBy(F.col(tk).alias("t")).agg(F.min(F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("i"))).alias("least"))
    parts = ids.join(group, F.col("t") == F.col("node"), "left")
    first = parts.groupBy(F.coalesce("component", "t").alias("part")).agg(F.min(F.struct("least", F.col("least.i").alias("i"), "t")).alias("m")).select(F.col("m.i").alias("f_id"), F.col("m.t").alias("f_tk"))
    rows = rows.alias("r").join(first.alias("f"), F.col(f"r.{id_}").eqNullSafe(F.col("f.f_id")) & (F.col(f"r.{tk}") == F.col("f.f_tk")), "left_semi")
    return rows.dropDuplicates([id_, tk]).select(*(F.col(f"`{c}`") for c in docs.columns))
