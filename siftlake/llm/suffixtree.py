"""Language-model scores by a probabilistic suffix tree over words (operator 5).

Symbols are the tokens of a text, words with A-Z in lower case and an end, led in by a start mark. The tree's contexts
are the last 0 to DEPTH symbols, whatever their number in the corpus, so the tree grows with the corpus. A context,
however often seen, passes if its next symbols differ from those of the context one symbol shorter: its count times the
divergence of the two distributions has to reach GAIN. Contexts that pass are in the tree, and so are all their suffixes,
else it would be no tree. Next-symbol counts are smoothed towards the shorter context's distribution, down to the words'
own counts, one added to each; the more kinds of next symbol a context has, the more. A token is scored after the longest
suffixes that are in the tree.

The tree is nowhere whole. Neighbouring documents form blocks of bounded size. A block hands on each gram (context and
symbol) it holds once, with its count, as a 52-bit number; grams are dealt by that number to buckets of bounded size,
which add up the counts of all blocks and answer each. One block that has a gram in training is told that it owns it, so
the owners' sums over contexts (kinds of next symbol, divergence) add up to the corpus's; they go the same way once
more where several blocks hold the context, and then, for contexts that failed, whether one that passed ends with them. Grams of a block and bucket travel as one row of packed numbers, a few bytes each. Blocks stay where they are: they
are a bucketed table in the shared folder, and only answers are dealt to them.

Words are named by 64-bit hashes, grams by 52 bits of one: of 10^10 grams one in 4 * 10^5 shares its number with another.
"""

from __future__ import annotations

import re
import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import shared_dir
from .common import held_out, part_batches, release, short_lived_shuffles, stage, table, tidy, utf8
from .suffixes import _mix, _powers

DEPTH, GAIN, STRENGTH, BLOCK, CELLS, SLICE = 2, 3.0, 4.0, 8_500_000, 1 << 19, 1 << 20
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLANK = re.compile(rb"[\x20\x09-\x0D]")


# ---- words and grams ----------------------------------------------------------------------------------------


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of some bytes, and where the words begin."""
    x = np.frombuffer(data, np.uint8)
    value, up, down = _powers(1 << max(19, int(len(x)).bit_length()))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~SPACE[x], [False])).view(np.int8)))
    a, b = edge[::2], edge[1::2]
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(value[x] * up[: len(x)], out=total[1:])
    return _mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)), a


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each between a start mark and an end, and how many each text has."""
    found, sizes, now, size = [], [], [], 0

    def flush():
        begin = np.cumsum([0, *(len(d) + 1 for d in now)])
        h, at = word_hashes(b"\n".join(now))
        cuts = np.searchsorted(at, begin)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found.extend((START[None], h[i:j], END[None]))
            sizes.append(j - i + 2)

    for t in texts:
        d = utf8(t).lower()
        if len(d) > SLICE:  # a long text by itself, in pieces that end at white space
            if now:
                flush()
                now, size = [], 0
            parts, at = [], 0
            while at < len(d):
                cut = BLANK.search(d, at + SLICE)
                end = cut.start() if cut else len(d)
                parts.append(word_hashes(d[at:end])[0])
                at = end
            found.extend((START[None], *parts, END[None]))
            sizes.append(sum(map(len, parts)) + 2)
            continue
        now.append(d)
        size += len(d)
        if size >= SLICE:
            flush()
            now, size = [], 0
    if now:
        flush()
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.array(sizes, np.int64)


class Grams:
    """The distinct grams of one length in a block, in the order of their numbers: key, a place, and of each place the gram that ends there (-1: none)."""

    def __init__(self, hashes: np.ndarray, of: np.ndarray, first: np.ndarray, places: np.ndarray | None, size: int):
        """hashes: of the distinct grams; of: which of them ends at each of places (None: all, size); first: a place of each."""
        key = hashes >> np.uint64(12)
        order = np.argsort(key)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.key, self.first = key[order], first[order]
        if places is None:
            self.at = place[of]
        else:
            self.at = np.full(size, -1, np.int32)
            self.at[places] = place[of]

    def count(self, trained: np.ndarray) -> np.ndarray:
        """How often each ends at one of the places in training."""
        at = self.at[trained]
        return np.bincount(at[at >= 0], minlength=len(self.key))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, which of them stands at each place, and a place of each."""
    by = np.argsort(codes)
    ordered = codes[by]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(by)]
    of = np.empty(len(by), np.int32)
    of[by] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], of, by[new]


def grams(vocab: np.ndarray, seq: np.ndarray, sizes: np.ndarray, depth: int) -> list[Grams]:
    """By length from 1: a block's grams. vocab: symbols' hashes; seq: symbols by their place in vocab."""
    depth_at = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # symbols before this one in its text
    n = np.int64(len(vocab))
    first = np.zeros(len(vocab), np.int64)
    first[seq] = np.arange(len(seq))
    out = [Grams(vocab, seq, first, None, len(seq))]
    for k in range(1, depth + 1):
        last, at = out[-1], np.flatnonzero(depth_at >= k)
        code, of, first = distinct(last.at[at - 1].astype(np.int64) * n + seq[at])
        hashes = _mix((last.key << np.uint64(12))[code // n] * np.uint64(0x9E3779B97F4A7C15) + vocab[code % n])
        out.append(Grams(hashes, of, at[first], at, len(seq)))
    return out


# ---- packed rows --------------------------------------------------------------------------------------------


def pack(x: np.ndarray, width: int) -> bytes:
    """Whole numbers as width planes of bytes; the planes above the fourth, and all of few-valued ones, deflated."""
    planes = np.ascontiguousarray(np.asarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zlib.compress(planes.tobytes(), 1) if width <= 4 else planes[:4].tobytes() + zlib.compress(planes[4:].tobytes(), 1)


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    raw = zlib.decompress(data) if width <= 4 else data[: 4 * n] + zlib.decompress(data[4 * n :])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys[:1]), 7)


def unpack_keys(data: bytes, first: int, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, 7, n)) + np.uint64(first)


BLOCK_ROW = "block long, doc_ids array<long>, outs array<boolean>, sizes array<long>, vocab binary, seq binary"
ASK = "bucket long, block long, length int, first long, n int, keys binary, count binary, weight binary"
TOLD = "block long, bucket long, length int, round int, n int, total binary, flag binary, shared binary, all_total long, all_kinds long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """docs(doc_id, out, text) -> a row per block of block bytes at most (or of one longer slice), in a table bucketed by block."""

    def row(number, ids, outs, found, sizes):
        s = np.concatenate(found)
        vocab, of, n = np.unique(s, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # common symbols get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in ((ids, pa.int64()), (outs, pa.bool_()), (np.concatenate(sizes), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([vocab[order].tobytes()], pa.binary()), pa.array([pack(rank[of], 4)], pa.binary())], names(BLOCK_ROW))

    def work(batches):
        from pyspark import TaskContext

        part, seq, now, size = TaskContext.get().partitionId(), 0, ([], [], [], []), 0
        for batch in part_batches(batches):
            more = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if now[0] and size + more > block:
                yield row((part << 32) + seq, *now)
                seq, now, size = seq + 1, ([], [], [], []), 0
                release()
            s, n = symbols(batch.column("text").to_pylist())
            for have, new in zip(now, (batch.column("doc_id").to_pylist(), batch.column("out").to_pylist(), [s], [n]), strict=True):
                have.extend(new)
            size += more
        if now[0]:
            yield row((part << 32) + seq, *now)

    spark = docs.sparkSession
    name = f"suffix_blocks_{uuid4().hex}"
    places = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.mapInArrow(tidy(work), BLOCK_ROW)
    rows.write.bucketBy(places, "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _open(b: dict, depth: int) -> tuple[list[Grams], np.ndarray, np.ndarray]:
    """A block's row -> its grams, the sizes of its texts and which of them are held out."""
    sizes, outs = np.array(b["sizes"], np.int64), np.array(b["outs"], bool)
    seq = unpack(b["seq"], 4, int(sizes.sum())).astype(np.int64)
    return grams(np.frombuffer(b["vocab"], np.uint64), seq, sizes, depth), sizes, outs


def _asked(block: int, length: int, g: Grams, buckets: int, count: np.ndarray, weight: np.ndarray | None = None, only: np.ndarray | None = None):
    """Rows of ASK: a block's grams of one length (or only some) by bucket."""
    pick = np.arange(len(g.key)) if only is None else np.flatnonzero(only)
    key = g.key[pick]
    bucket = (key >> np.uint64(20)) * np.uint64(buckets) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[k], cuts[k + 1])
        w = b"" if weight is None else zlib.compress(weight[pick[own]].astype("<f4").tobytes(), 1)
        yield length * buckets + k, block, length, int(key[cuts[k]]), int(cuts[k + 1] - cuts[k]), pack_keys(key[own]), pack(count[pick[own]], 4), w


def _rows(rows, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [()] * len(schema.split(", "))
    return pa.table([pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, schema.split(", "), strict=True)], names(schema))


def _answer(t: pa.Table, round_: int, gain: float) -> pa.Table:
    """One bucket: all blocks' rows -> the same grams' totals. Round 1: flag marks the owner, shared the grams of several blocks; later rounds: flag marks those whose weights add up to gain, all_kinds counts a row's others."""
    rows = sorted(t.to_pylist(), key=lambda r: r["block"])
    n = [r["n"] for r in rows]
    keys = np.concatenate([unpack_keys(r["keys"], r["first"], r["n"]) for r in rows])
    count = np.concatenate([unpack(r["count"], 4, r["n"]) for r in rows]).astype(np.int64)
    unique, of = np.unique(keys, return_inverse=True)
    total = np.bincount(of, count, len(unique)).astype(np.int64)
    if round_ == 1:
        flag, have = np.zeros(len(keys), bool), np.flatnonzero(count)
        flag[have[np.unique(of[have], return_index=True)[1]]] = True
    else:
        weight = np.concatenate([np.frombuffer(zlib.decompress(r["weight"]), "<f4") for r in rows]).astype(float)
        flag = (np.bincount(of, weight, len(unique)) >= gain)[of]
    cuts, total_of, shared = np.cumsum([0, *n]), total[of], (np.bincount(of) > 1)[of]
    if round_ == 1:
        sums = [(int(total.sum()), int(np.count_nonzero(total)))] + [(0, 0)] * (len(rows) - 1)
    else:
        sums = [(0, int(np.count_nonzero(~flag[a:b]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    out = [(r["block"], r["bucket"], r["length"], round_, r["n"], pack(total_of[a:b], 5), np.packbits(flag[a:b]).tobytes(), np.packbits(shared[a:b]).tobytes(), *s) for r, a, b, s in zip(rows, cuts[:-1], cuts[1:], sums, strict=True)]
    release()
    return _rows(out, TOLD)


def _told(t: pa.Table, round_: int, length: int, size: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's answers of a round for grams of one length, in their order: totals, flags, and which are shared."""
    total, flag, shared = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, bool)
    mine = t.filter(pc.and_(pc.equal(t["round"], round_), pc.equal(t["length"], length)))
    rows = sorted(mine.to_pylist(), key=lambda r: r["bucket"])
    if rows:
        at = slice(None) if only is None else only
        bits = lambda name: np.concatenate([np.unpackbits(np.frombuffer(r[name], np.uint8), count=r["n"]) for r in rows]).astype(bool)
        total[at] = np.concatenate([unpack(r["total"], 5, r["n"]) for r in rows])
        flag[at], shared[at] = bits("flag"), bits("shared")
    return total, flag, shared


# ---- scores -------------------------------------------------------------------------------------------------


def score(docs: DataFrame, out, depth: int = DEPTH, gain: float = GAIN, strength: float = STRENGTH, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row.

    out: a boolean column; its rows are not learned from. Null and empty texts are one end token. If nothing is
    learned, every token has the count 0. Repeated rows count as often as they occur. Texts of any length are taken
    whole; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(out, F.lit(False)).alias("out"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = _blocks(rows, block)
    symbols_ = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-symbols_ * (depth + 1) // cells // (depth + 1)))

    def ask(batches):
        for batch in batches:
            for b in batch.to_pylist():
                grams_, sizes, outs = _open(b, depth)
                trained = np.repeat(~outs, sizes)
                found = [r for k, g in enumerate(grams_) for r in _asked(b["block"], k, g, buckets, g.count(trained))]
                yield from _rows(found, ASK).to_batches()
                release()

    first = blocks.mapInArrow(ask, ASK).groupBy("bucket").applyInArrow(lambda t: _answer(t, 1, gain), TOLD)
    with short_lived_shuffles(docs.sparkSession):
        first = stage(first, "gram-counts")
    start = first.where("length = 0").agg(F.sum("all_total"), F.sum("all_kinds")).first()
    ends = rows.where("not out").count()
    n_tokens, kinds = (start[0] or 0) - ends, (start[1] or 0) - (ends > 0)  # without the start marks

    def sums(b, told):
        """Totals by gram length, and for each context length the contexts asked for again, with owned kinds and divergence."""
        g, sizes, outs = _open(b, depth)
        n = [_told(told, 1, k, len(x.key)) for k, x in enumerate(g)]
        again = []
        for k in range(1, depth + 1):
            own, f = np.flatnonzero(n[k][1]), g[k].first
            ctx, size = g[k - 1].at[f - 1], len(g[k - 1].key)
            count, of, c = n[k][0][own], f[own], ctx[own]
            p = count / n[k - 1][0][c]
            if k == 1:
                q = n[0][0][g[0].at[of]] / max(1, n_tokens)
            else:
                q = n[k - 1][0][g[k - 1].at[of]] / n[k - 2][0][g[k - 2].at[of - 1]]
            gained = np.bincount(c, count * np.log(p / q), size)
            is_context = np.zeros(size, bool)
            is_context[ctx] = True
            again.append((is_context & (n[k - 1][0] > 0) & n[k - 1][2], np.bincount(c, minlength=size), gained))
        return g, sizes, outs, n, again

    def tested(g, again, told):
        """For each context length: kinds of next symbol, the contexts that pass, and those with all suffixes of this block's. Contexts of one block are decided in it."""
        kinds_, passed = [], []
        for k, (only, count, gained) in enumerate(again):
            count_, pass_, _ = _told(told, 2, k, len(only), only)
            kinds_.append(np.where(only, count_, count))
            passed.append(np.where(only, pass_, gained >= gain))
        closed = [x.copy() for x in passed]
        for k in range(len(closed) - 1, 0, -1):
            closed[k - 1][g[k - 1].at[g[k].first[closed[k]]]] = True
        return kinds_, passed, closed

    def ask_again(key, left, told):
        b = left.to_pylist()[0]
        g, _, _, _, again = sums(b, told)
        out_ = _rows([r for k, (only, count, gained) in enumerate(again) for r in _asked(b["block"], k, g[k], buckets, count, gained, only)], ASK)
        release()
        return out_

    def ask_suffixes(key, left, told):
        b = left.to_pylist()[0]
        g, _, _, _, again = sums(b, told)
        _, passed, closed = tested(g, again, told)
        out_ = _rows([r for k in range(depth - 1) for r in _asked(b["block"], k, g[k], buckets, np.zeros(len(g[k].key), np.int64), closed[k], again[k][0] & ~passed[k])], ASK)
        release()
        return out_

    def answered(ask_, of, told, round_, least, name):
        asked = of.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask_, ASK)
        with short_lived_shuffles(docs.sparkSession):
            return stage(asked.groupBy("bucket").applyInArrow(lambda t: _answer(t, round_, least), TOLD), name)

    second = answered(ask_again, blocks, first, 2, gain, "context-sums")
    told_ = first.unionByName(second)
    failed = second.where(F.col("length") < depth - 1).where("all_kinds > 0").select("block").distinct()
    if not failed.isEmpty():  # blocks without a failed context know all
        told_ = told_.unionByName(answered(ask_suffixes, blocks.join(failed, "block", "left_semi"), told_.join(failed, "block", "left_semi"), 3, 0.5, "context-suffixes"))

    def finish(key, left, told):
        b = left.to_pylist()[0]
        g, sizes, outs, n, again = sums(b, told)
        p = base = (n[0][0] + 1) / (n_tokens + kinds + 1)
        at = g[0].at
        logp = np.log10(p)[at]
        kinds_, passed, stays = tested(g, again, told)
        for k in range(1, depth + 1):
            have, stay, hold = n[k - 1][0], stays[k - 1], strength + kinds_[k - 1]
            if k < depth:
                stay = stay | _told(told, 3, k - 1, len(stay), again[k - 1][0] & ~passed[k - 1])[1]
            f = g[k].first
            ctx, shorter = g[k - 1].at[f - 1], g[k - 1].at[f]
            q = p[shorter]
            p = np.where(stay[ctx], (n[k][0] + hold[ctx] * q) / (have[ctx] + hold[ctx]), q)
            here = g[k].at >= 0
            logp[here] = np.log10(p)[g[k].at[here]]
        begin = np.cumsum(sizes) - sizes
        logp[begin] = 0.0  # start marks are given
        plain = np.log10(base)[at]
        plain[begin] = 0.0
        known = n[0][0][at] > 0
        known[begin] = False
        sum_ = lambda x, kind: np.add.reduceat(x.astype(kind), begin)
        ids, outs_ = pa.array(b["doc_ids"], pa.int64()), pa.array(outs)
        cols = [ids, outs_, pa.array(sizes - 1), pa.array(sum_(known, np.int64)), pa.array(np.full(len(sizes), n_tokens, np.int64)), pa.array(sum_(plain, float)), pa.array(sum_(logp, float))]
        release()
        return pa.table(cols, names(RESULT))

    return blocks.groupBy("block").cogroup(told_.groupBy("block")).applyInArrow(finish, RESULT)


def by_hand(texts: list[str | None], outs: list[bool], depth: int = DEPTH, gain: float = GAIN, strength: float = STRENGTH) -> list[tuple[int, int, float, float]]:
    """n_tokens, n_known, base_score, score of a few texts, context by context."""
    from collections import Counter, defaultdict
    from math import log, log10

    told = [["<", *utf8(t).lower().split(), ">"] for t in texts]
    after: dict[tuple, Counter] = defaultdict(Counter)
    for d, o in zip(told, outs, strict=True):
        for i in range(1, 0 if o else len(d)):
            for k in range(min(depth, i) + 1):
                after[tuple(d[i - k : i])][d[i]] += 1
    words = after[()]
    n = words.total()

    def passes(c: tuple) -> bool:
        have, up = after[c].total(), after[c[1:]]
        return sum(m * log(m / have / (up[x] / up.total())) for x, m in after[c].items()) >= gain

    kept = {c[i:] for c in list(after) if c and passes(c) for i in range(len(c))}
    out = []
    for d in told:
        base = total = 0.0
        for i in range(1, len(d)):
            p = (words[d[i]] + 1) / (n + len(words) + 1)
            base += log10(p)
            for k in range(1, min(depth, i) + 1):
                c = tuple(d[i - k : i])
                if c in kept:
                    hold = strength + len(after[c])
                    p = (after[c][d[i]] + hold * p) / (after[c].total() + hold)
            total += log10(p)
        out.append((len(d) - 1, sum(words[w] > 0 for w in d[1:]), base, total))
    return out


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


QUERIES = {"op5_suffix_tree": op5_suffix_tree}
SQL: dict[str, str] = {}
