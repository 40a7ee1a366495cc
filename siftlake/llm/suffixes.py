"""Repeated passages by a logarithmic family of suffix arrays (operator 7).

Bytes are removed that lie in a string of min_len bytes which starts at another place too. Three steps keep the
suffix arrays to what may repeat:

1. Every window of min_len bytes has an anchor: the start of its smallest hashed k-mer. Equal windows have equal
   anchors at equal offsets. The windows of an anchor are one segment of text. An anchor whose k-mer occurs once
   in the corpus has no repeated window and goes.
2. If all segments of a k-mer are equal, all their windows repeat: nothing need be compared. That settles exact
   copies and the inside of near copies, whatever their number.
3. The other segments, each different text once, meet by k-mer in buckets of bounded size. In a bucket they come
   in batches; a batch's windows are sorted as a suffix array (suffixes are compared up to min_len bytes), it is
   merge-scanned against the arrays that are there, equal windows are marked on both sides, and arrays of equal
   size merge, so that a bucket of n batches holds log n arrays. A k-mer with more different segments than a
   bucket takes is dealt by window instead: windows are counted one by one, whole, over all tasks.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import part_batches, release, renamed, stage, table, tidy, utf8

MIN_LEN, KMER, BUCKET, HEAVY = 200, 32, 1 << 18, 8192
BASE = 0x9E3779B97F4A7C15
POS, STRIDE = 24, 1 << 18


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """256 random values; powers of BASE and of its inverse modulo 2^64, n each."""
    value = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, np.uint64)) * np.uint64(inverse)
        down = np.cumprod(np.full(n, inverse, np.uint64)) * np.uint64(BASE)
    return value, up, down


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: running minima forwards and backwards within blocks of w."""
    n = len(x)
    block = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = x
    block = block.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(texts: list[bytes], min_len: int = MIN_LEN, k: int = KMER) -> tuple[np.ndarray, ...]:
    """For each anchor of the texts: text's number, first window, further windows, k-mer's hash, segment's hash."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < min_len:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    value, up, down = _powers(1 << max(19, int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * up[:n], out=total[1:])
    kmers = _mix((total[k:] - total[:-k]) * down[: n - k + 1])
    # The leftmost smallest: the hash's high bits, then the place.
    w, starts = min_len - k + 1, np.concatenate(([0], np.cumsum(sizes)))
    at = np.empty(n - min_len + 1, np.int64)
    for a in range(0, n - min_len + 1, 1 << (POS - 1)):
        some = kmers[a : a + (1 << (POS - 1)) + w - 1]
        low = _sliding_min(some >> np.uint64(POS) << np.uint64(POS) | np.arange(len(some), dtype=np.uint64), w)
        low = low[: 1 << (POS - 1)]
        at[a : a + len(low)] = a + (low & np.uint64((1 << POS) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(owner[: n - min_len + 1] == owner[min_len - 1 :])
    if not len(inside):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    new = np.concatenate(([True], (at[inside[1:]] != at[inside[:-1]]) | (owner[inside[1:]] != owner[inside[:-1]])))
    first = inside[new]
    more = np.diff(np.append(np.flatnonzero(new), len(inside))) - 1
    segment = _mix(_mix((total[first + more + min_len] - total[first]) * down[first]) + more.astype(np.uint64))
    own = owner[first]
    return own, first - starts[own], more, kmers[at[first]], segment


def strides(data: bytes, min_len: int, most: int) -> list[tuple[int, bytes]]:
    """A text as pieces of about most bytes, with where they begin; each window of min_len bytes lies in one piece."""
    return [(a, data[a : a + most + min_len - 1]) for a in range(0, max(1, len(data) - min_len + 1), most)]


def _anchor_rows(docs: DataFrame, min_len: int, k: int, stride: int) -> DataFrame:
    """Long texts are cut into strides; an anchor whose windows lie in two of them gives two segments, which changes nothing
    but how its windows are grouped."""
    names = ["doc_id", "tk", "at", "more", "h", "s"]

    def rows(pieces, ids, tk):
        own, at, more, h, s = anchors([d for _, _, d in pieces], min_len, k)
        of, base = np.array([i for i, _, _ in pieces], np.int64), np.array([a for _, a, _ in pieces], np.int64)
        at, row = at + base[own], pa.array(of[own])
        cols = [ids.take(row), tk.take(row), pa.array(at.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names)

    def work(batches):
        for batch in part_batches(batches, stride):
            ids, tk, pieces, size = batch.column("doc_id"), batch.column("tk"), [], 0
            for i, t in enumerate(batch.column("text").to_pylist()):
                for a, d in strides(utf8(t), min_len, stride):
                    pieces.append((i, a, d))
                    size += len(d)
                    if size >= stride:
                        yield rows(pieces, ids, tk)
                        pieces, size = [], 0
            if pieces:
                yield rows(pieces, ids, tk)

    return docs.mapInArrow(tidy(work), "doc_id long, tk long, at int, more int, h long, s long")


# ---- suffix arrays ------------------------------------------------------------------------------------------


class SuffixLevels:
    """Sorted windows by level; marked[i]: window i occurs again. Windows are numbered in the order in which they come."""

    def __init__(self, min_len: int = MIN_LEN):
        self.kind, self.min_len, self.levels, self.marked = np.dtype(f"S{min_len}"), min_len, [], np.zeros(0, bool)

    def add(self, data: np.ndarray, starts: np.ndarray) -> None:
        """data: bytes; starts: where windows begin."""
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, self.min_len)[starts]).view(self.kind).ravel()
        order = np.argsort(keys, kind="stable")
        base = len(self.marked)
        self.marked = np.concatenate((self.marked, np.zeros(len(keys), bool)))
        keys, ids = keys[order], order + base
        same = np.flatnonzero(keys[1:] == keys[:-1])
        self.marked[ids[same]] = self.marked[ids[same + 1]] = True
        for old, old_ids in self.levels:
            at = np.minimum(np.searchsorted(old, keys), len(old) - 1)
            hit = np.flatnonzero(old[at] == keys)
            # The first of equal ones is enough: all of an array's equal windows were marked when it was made or merged.
            self.marked[ids[hit]] = self.marked[old_ids[at[hit]]] = True
        self.levels.append((keys, ids))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, ia), (b, ib) = self.levels[-2:]
            keys = np.concatenate((a, b))
            order = np.argsort(keys, kind="stable")
            self.levels[-2:] = [(keys[order], np.concatenate((ia, ib))[order])]


def repeated(segments: list[bytes], settled: list[bool], min_len: int = MIN_LEN, batch: int = 1 << 17) -> list[np.ndarray]:
    """For each segment, which of its windows occur again in it or another, or all if it is settled."""
    levels, sizes, k = SuffixLevels(min_len), [max(0, len(s) - min_len + 1) for s in segments], 0
    while k < len(segments):
        end, size = k, 0
        while end < len(segments) and size < batch:
            size += len(segments[end])
            end += 1
        starts, base = [], 0
        for s, n in zip(segments[k:end], sizes[k:end], strict=True):
            starts.append(np.arange(base, base + n))
            base += len(s)
        levels.add(np.frombuffer(b"".join(segments[k:end]), np.uint8), np.concatenate(starts))
        k = end
    out = np.split(levels.marked, np.cumsum(sizes)[:-1]) if sizes else []
    return [m | s for m, s in zip(out, settled, strict=True)]


def runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _compare(segs: DataFrame, min_len: int, bucket: int, heavy: int) -> DataFrame:
    """segs(h, s, n, text): different segments of contested k-mers -> h, s, lo, hi: runs of repeated windows."""
    by_h = segs.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.length("text")).alias("size"))
    total = by_h.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket))
    segs = segs.join(by_h.select("h", "kinds"), "h")

    def work(t):
        found = repeated(t.column("text").to_pylist(), [n > 1 for n in t.column("n").to_pylist()], min_len)
        rows = [(i, lo, hi) for i, m in enumerate(found) for lo, hi in runs(m)]
        at = pa.array([r[0] for r in rows], pa.int64())
        cols = [t.column("h").take(at), t.column("s").take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())]
        release()
        return pa.table(cols, ["h", "s", "lo", "hi"])

    light = segs.where(F.col("kinds") <= heavy).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    light = light.select("bucket", "h", "s", "n", "text").groupBy("bucket").applyInArrow(work, "h long, s long, lo int, hi int")
    dealt = segs.where(F.col("kinds") > heavy).select("h", "s", "n", "text", F.explode(F.sequence(F.lit(0), F.length("text") - min_len)).alias("lo"))
    dealt = dealt.select("h", "s", "n", "lo", F.sha2(F.substring("text", F.col("lo") + 1, F.lit(min_len)), 256).alias("w"))
    twice = dealt.groupBy("h", "w").agg(F.count("*").alias("k"), F.max("n").alias("most")).where("k > 1 or most > 1").select("h", "w")
    return light.unionByName(dealt.join(twice, ["h", "w"]).select("h", "s", "lo", (F.col("lo") + 1).alias("hi")))


def repeats(docs: DataFrame, min_len: int = MIN_LEN, k: int = KMER, bucket: int = BUCKET, heavy: int = HEAVY, stride: int = STRIDE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tk, spans: the bytes [lo, hi) of the text that repeat, for rows that have some.

    tk: xxhash64 of the text. Rows with equal doc_id and text are copies of each other like any other rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    found = stage(_anchor_rows(rows, min_len, k, stride), "anchors")
    kmers = found.groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("n > 1")
    # Written, so that both sides of the join are dealt anew and a k-mer of many copies can be split.
    kmers = stage(kmers.select("h", (F.col("s0") != F.col("s1")).alias("open")), "repeated-kmers")
    found = stage(found.join(kmers, "h"), "repeated-anchors")
    settled = found.where("not open").select("doc_id", "tk", F.col("at").alias("lo"), (F.col("at") + F.col("more") + min_len).alias("hi"))
    open_ = found.where("open")
    kinds = open_.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("d"), "doc_id", "tk", "at", "more")).alias("one"))
    wanted = kinds.select("h", "s", "n", "one.*").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "s", "n", "at", "more")).alias("want"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tk") == F.col(f"{b}.tk"))
    texts = rows.alias("d").join(wanted.alias("w"), same("d", "w")).select(F.col("d.text").cast("binary").alias("text"), "want")
    piece = F.col("c")
    segs = texts.select("text", F.explode("want").alias("c")).select("c.h", "c.s", "c.n", F.substring("text", piece["at"] + 1, piece["more"] + min_len).alias("text"))
    segs = stage(segs.dropDuplicates(["h", "s"]), "segments")  # rows that repeat with their id bring a segment twice
    part = stage(_compare(segs, min_len, bucket, heavy), "segment-runs")
    part = open_.join(part, ["h", "s"]).select("doc_id", "tk", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") - 1 + min_len).alias("hi"))
    return settled.unionByName(part).groupBy("doc_id", "tk").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


OWN = ("n_bytes", "n_removed", "spans", "kept")


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = (), as_text: bool = False, **options) -> DataFrame:
    """docs(doc_id, text, kept columns) -> doc_id, kept columns, n_bytes, n_removed, spans, kept (the bytes that are left): a row per row.

    Null and empty texts are empty; a text of any length is taken whole, in strides; rows that repeat are copies of
    each other; an empty table gives no rows. All places of a repeated string are removed, the first too. Spans are
    maximal runs of removed bytes and may cut a character; kept is bytes for that reason or, if as_text, text without
    such characters. A kept column named like one of the results gets an underscore.
    """
    found = repeats(docs, **options)
    fields = [f for f in docs.schema.fields if f.name in {"doc_id", *keep} - {"text"}]
    names = renamed(fields, (*OWN, "text"))
    rows = docs.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)), F.coalesce("text", F.lit("")).alias("text"))
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.tk"))
    rows = rows.alias("d").join(found.alias("s"), on, "left").select(*[f"d.`{n}`" for n in names], "d.text", "s.spans")

    def work(batches):
        for part in part_batches(batches):
            size, gone, spans, kept = [], [], [], []
            for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                data, at, left = utf8(text), 0, []
                cut = merged([(s["lo"], s["hi"]) for s in found or []])
                for lo, hi in cut:
                    left.append(data[at:lo])
                    at = hi
                left.append(data[at:])
                kept.append(b"".join(left))
                size.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in cut])
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            left = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            cols = [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), left]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + cols, [*names, *OWN])

    schema = ", ".join([*(f"`{n}` {f.dataType.simpleString()}" for f, n in zip(fields, names, strict=True)), "n_bytes long, n_removed long, spans array<struct<lo:long,hi:long>>, kept " + ("string" if as_text else "binary")])
    return rows.mapInArrow(tidy(work), schema)


def brute_force(texts: list[str | None], min_len: int = MIN_LEN) -> list[tuple[int, int, int, str]]:
    """What op7 returns for a few texts, window by window."""
    data, seen = [utf8(t) for t in texts], {}
    for d in data:
        for i in range(len(d) - min_len + 1):
            seen[d[i : i + min_len]] = seen.get(d[i : i + min_len], 0) + 1
    out = []
    for d in data:
        spans = merged([(i, i + min_len) for i in range(len(d) - min_len + 1) if seen[d[i : i + min_len]] > 1])
        left = b"".join(d[a:b] for a, b in zip([0, *(hi for _, hi in spans)], [*(lo for lo, _ in spans), len(d)], strict=True))
        out.append((len(d), len(d) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
    return out


def op7_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_levels": op7_suffix_levels}
SQL: dict[str, str] = {}
