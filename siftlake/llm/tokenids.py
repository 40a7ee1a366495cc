"""Token-id shards with a minimal perfect hash index (operator 3).

A file row is one shard: the ids of its documents as little-endian integers, end id included, one after another
in ascending doc_id order, and an index from keys to places. The index is a cascade of bit arrays: a key sits at the
first level where it hashes alone, and the number of set bits before it is its slot, so each of n keys has one of n
slots. A slot holds the key's fingerprint, by which foreign keys are told, and the number of its document in the
shard. Shards are written and read by Spark, so a lost executor's shards are written again and none appears twice.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table, tidy

# ---- encoding -----------------------------------------------------------------------------------------------

#: Words of these characters, without ``<|``, can be cut into the tokenizer's words here: their lower case and
#: letter class are plain. All others go to the tokenizer whole.
PLAIN = r"^[\x21-\x7EÀ-įı-ɏ]+$"
LETTERS = "a-zÀ-ÖØ-öø-ɏ"
PARTS = rf"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+)"


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after another."""
    return flat[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]


class WordEncoder:
    """Ids of whole texts from a tokenizer whose words end at white space; the ids of words are remembered.

    White space parts words in this vocabulary, and lower-casing and composition don't reach across it, so a
    text's ids are its words' ids, one after another. Words are cut, counted once and put together again as
    columns. Two memories take turns: when the newer one is full it becomes the older, and what is used moves on.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.limit, self.new, self.old = limit, {"": b""}, {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of words of the tokenizer: many in one call, told apart by the ids that end a word."""
        out = []
        groups = [parts[k : k + 256] for k in range(0, len(parts), 256)]
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if len(cuts) == len(group) else self._whole(group)
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        found = [new.get(p) for p in parts]
        miss = [i for i, x in enumerate(found) if x is None]
        for i in miss:
            found[i] = old.get(parts[i])
        fresh = [i for i in miss if found[i] is None]
        for i, x in zip(fresh, self._parts([parts[i] for i in fresh]), strict=True):
            found[i] = x
        new.update((parts[i], found[i]) for i in miss if len(parts[i]) <= 64)
        return found

    def _runs(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize
        return np.frombuffer(b"".join(codes), self.dtype), np.cumsum(lens) - lens, lens

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in one row, and where each word's begin and how many they are."""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), PARTS, "\\1 "), " ")
        parts = cut.flatten().dictionary_encode()
        flat, start, lens = self._runs(self._known(parts.dictionary.to_pylist()))
        use = parts.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(lens[use])))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        rest, rest_start, rest_lens = self._runs(self._whole(words.filter(pc.invert(plain)).to_pylist()))
        ids = np.concatenate((gather(flat, start[use], lens[use]), rest))
        at = plain.to_numpy(zero_copy_only=False)
        starts, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts[at], sizes[at] = ends[:-1], np.diff(ends)
        starts[~at], sizes[~at] = len(ids) - len(rest) + rest_start, rest_lens
        return ids, starts, sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        ids, starts, sizes = self._words(words.dictionary)
        use = words.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[use])))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = gather(ids, starts[use], sizes[use])
        return [out[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def slices(texts: list[str], most: int = 6_000_000):
    """Runs of texts of about most characters."""
    k = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[k : i + 1]
            k, size = i + 1, 0
    if k < len(texts):
        yield texts[k:]


# ---- minimal perfect hash -----------------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


class HashIndex:
    """A minimal perfect hash of distinct 64-bit keys: sizes, the level's bits, ones before each word, the keys left over."""

    LEVELS, GAMMA, PRINT = 24, 1.5, 99

    def __init__(self, sizes, bits, left):
        self.sizes, self.bits, self.left = list(sizes), np.asarray(bits, np.uint64), np.asarray(left, np.uint64)
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before, self.placed = np.cumsum(ones) - ones, int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> HashIndex:
        sizes, bits, rest = [], [np.empty(0, np.uint64)], keys.astype(np.uint64)
        while len(rest) and len(sizes) < cls.LEVELS:
            n = -(-max(64, int(cls.GAMMA * len(rest))) // 64) * 64
            at = (mix(rest, len(sizes) + 1) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(n)
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(bits), np.sort(rest))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some foreign keys, any slot for the others."""
        keys = keys.astype(np.uint64)
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes):
            at = (mix(keys[open_], level + 1) % np.uint64(n)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[word] + below)[hit]
            open_, base = open_[~hit], base + n // 64
        at = np.searchsorted(self.left, keys[open_])
        found = at < len(self.left)
        found[found] = self.left[at[found]] == keys[open_][found]
        out[open_[found]] = self.placed + at[found]
        return out

    @classmethod
    def prints(cls, keys: np.ndarray) -> np.ndarray:
        return (mix(keys, cls.PRINT) >> np.uint64(33)).astype(np.int32)


# ---- shards -------------------------------------------------------------------------------------------------

#: shard: place in the order of ids; width: bytes of an id; ends: tokens up to each document's end, in the shard.
SHARD = (
    "shard long, n_docs long, n_tokens long, width int, ids binary, doc_ids array<long>, ends array<long>, "
    "sizes array<long>, bits array<long>, left_over array<long>, prints array<int>, rows array<int>"
)


def _shard(number: int, dtype: np.dtype, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([len(x) // dtype.itemsize for x in ids])
    keys = np.array([k for k in doc_ids if k is not None], np.int64)
    keys, first = np.unique(keys, return_index=True)
    first += sum(k is None for k in doc_ids)  # nulls come first
    index = HashIndex.build(keys.view(np.uint64))
    slot = index.slots(keys.view(np.uint64))
    prints, rows = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
    prints[slot], rows[slot] = index.prints(keys.view(np.uint64)), first
    values = [number, len(doc_ids), int(ends[-1]), dtype.itemsize, b"".join(ids), doc_ids, ends, index.sizes, index.bits.view(np.int64), index.left.view(np.int64), prints, rows]
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.binary()] + [pa.list_(pa.int64())] * 5 + [pa.list_(pa.int32())] * 2
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in SHARD.split(", ")])


def write_shards(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = 4_000_000) -> DataFrame:
    """docs(doc_id, text) -> the shards, written in the shared folder and read again.

    Null and empty texts hold the end id alone. Null ids come first; rows that repeat an id stay, ordered by a hash
    of the text; the index leads to an id's first row in a shard. A shard takes documents until it holds
    shard_tokens, so it is as large as that and one document at most. path is the tokenizer's file.
    """

    def work(batches):
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        end, ids, keys, size = np.array([end_id], enc.dtype).tobytes(), [], [], 0
        for batch in batches:
            k, found = 0, batch.column("doc_id").to_pylist()
            for texts in slices([t or "" for t in batch.column("text").to_pylist()]):
                for code in enc.encode(texts):
                    keys.append(found[k])
                    ids.append(code + end)
                    k, size = k + 1, size + len(code) // enc.dtype.itemsize + 1
                    if size >= shard_tokens:
                        yield _shard((part << 32) + seq, enc.dtype, keys, ids)
                        ids, keys, size, seq = [], [], 0, seq + 1
        if ids:
            yield _shard((part << 32) + seq, enc.dtype, keys, ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.col("tie")).sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stage(rows.mapInArrow(tidy(work), SHARD), "token-shards")


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """shards -> doc_id, shard, first (place in the shard), n_tokens, ids_crc32 and ids (little-endian 32-bit): a row per document.

    with_ids: else ids is null. Every id is looked up through the shard's index; its fingerprint has to be the stored one.
    """

    def work(batches):
        for batch in batches:
            for s in batch.to_pylist():
                keys = np.array([k for k in s["doc_ids"] if k is not None], np.int64).view(np.uint64)
                index = HashIndex(s["sizes"], np.array(s["bits"], np.int64).view(np.uint64), np.array(s["left_over"], np.int64).view(np.uint64))
                slot = index.slots(keys)
                if (slot < 0).any() or (np.array(s["prints"], np.int32)[slot] != index.prints(keys)).any():
                    raise ValueError(f"the index of shard {s['shard']} doesn't fit its keys")
                nulls = s["n_docs"] - len(keys)
                row = np.concatenate((np.arange(nulls), np.array(s["rows"], np.int64)[slot]))
                row[nulls:] += _repeats(keys)
                ends = np.array(s["ends"], np.int64)
                first = np.concatenate(([0], ends[:-1]))[row]
                ids = np.frombuffer(s["ids"], f"<u{s['width']}").astype("<u4")
                names = ["doc_id", "shard", "first", "n_tokens", "ids_crc32", "ids"]
                for k in range(0, len(row), 4096):
                    r, a = row[k : k + 4096], first[k : k + 4096]
                    got = [ids[x:y].tobytes() for x, y in zip(a.tolist(), ends[r].tolist(), strict=True)]
                    cols = [s["doc_ids"][k : k + 4096], [s["shard"]] * len(r), a, ends[r] - a, list(map(zlib.crc32, got))]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(got if with_ids else [None] * len(r), pa.binary())], names)

    return shards.mapInArrow(work, "doc_id long, shard long, first long, n_tokens long, ids_crc32 long, ids binary")


def _repeats(keys: np.ndarray) -> np.ndarray:
    """For sorted keys: how many equal ones come before each."""
    at = np.arange(len(keys))
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(keys) else at


class Shard:
    """A shard's row (as a dict), opened once: its index is counted through here, and each access then takes constant time."""

    def __init__(self, row: dict):
        self.index = HashIndex(row["sizes"], np.array(row["bits"], np.int64).view(np.uint64), np.array(row["left_over"], np.int64).view(np.uint64))
        self.ids, self.ends = np.frombuffer(row["ids"], f"<u{row['width']}"), np.array(row["ends"], np.int64)
        self.doc_ids, self.prints, self.rows = row["doc_ids"], np.array(row["prints"], np.int32), np.array(row["rows"], np.int64)

    def get(self, doc_ids: np.ndarray) -> list[np.ndarray | None]:
        """The ids of documents; None for one that isn't there: its slot is free, or holds another fingerprint or, if that is alike too, another key."""
        keys = doc_ids.astype(np.int64).view(np.uint64)
        slots, prints, out = self.index.slots(keys), self.index.prints(keys), []
        for key, slot, mark in zip(doc_ids.tolist(), slots.tolist(), prints.tolist(), strict=True):
            row = int(self.rows[slot]) if slot >= 0 and self.prints[slot] == mark else -1
            out.append(self.ids[self.ends[row - 1] if row else 0 : self.ends[row]] if row >= 0 and self.doc_ids[row] == key else None)
        return out


def lookup(shard: dict, doc_id: int) -> np.ndarray | None:
    """The ids of one document of a shard (a row as a dict); None if it isn't there. For many, open the Shard once."""
    return Shard(shard).get(np.array([doc_id], np.int64))[0]


def fetch(asked: DataFrame, shards: DataFrame) -> DataFrame:
    """asked(doc_id) -> doc_id, ids (little-endian 32-bit): the first row of each id that the shards hold, once.

    Ids meet the shards' keys in an equal join, and only shards that are asked for something are opened, each once.
    """
    where = shards.select("shard", F.explode("doc_ids").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.min("shard").alias("shard"))
    want = asked.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(where, "doc_id").groupBy("shard").agg(F.collect_list("doc_id").alias("want"))

    def work(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.array(row["want"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.astype("<u4").tobytes() for x in Shard(row).get(keys)], pa.binary())], ["doc_id", "ids"])

    return shards.join(want, "shard").mapInArrow(tidy(work), "doc_id long, ids binary")


def token_table(docs: DataFrame, path: str, with_ids: bool = True, **options) -> DataFrame:
    """docs(doc_id, text) -> doc_id, start, n_tokens, ids_crc32, ids, read back from the shards. start: ids of all documents before it.

    Null and empty texts hold the end id alone; see write_shards for null and repeated ids. Texts of any length are
    encoded whole, other columns aren't read, an empty table gives no rows.
    """
    shards = write_shards(docs, path, **options)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    out = read_shards(shards, with_ids).join(starts, "shard")
    return out.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op3_token_shards": op3_token_shards}
SQL: dict[str, str] = {}
