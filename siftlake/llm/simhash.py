"""SimHash near-duplicates through Golay-code keys (operator 9).

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits. If two fingerprints differ in at most three bits,
one of these holds, and each is a key of 30 bits or more:

* the third segment is equal, and the first or the second holds one error at most;
* the first or the second is equal, and one of the other two holds one error at most;
* each segment holds just one error: then of the second and of the third one half is equal.

A segment is taken exactly, or within one error through the perfect binary Golay code (23, 12, 7). One side of the join
takes the codeword nearest to its segment; the other takes every codeword within four bits of its own, one to six of
them. Words one bit apart always share such a codeword, because the one's nearest codeword lies within three bits of
it, so within four of the other. Candidates are verified by the population count of the XOR.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, part_batches, stage, table, tidy, utf8
from .graph import components

GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1 generates the code
CHUNK = 1 << 16


# ---- fingerprints -------------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the word shingles, repeats included; no word: zero."""
    from xxhash import xxh64_digest

    words = utf8(text).lower().split()  # bytes.lower and bytes.split know ASCII only, which is what is asked for
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, ends = np.concatenate(([0], ends[:-1] + 1))[:n], ends[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        digests = b"".join([xxh64_digest(line[a:b], 42) for a, b in zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of some shingles' hashes: bits that over half of them have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tk (xxhash64 of the text), fp (the fingerprint's bits as a signed long). Null and empty texts: zero."""

    def work(batches):
        for batch in part_batches(batches):
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(fp)], ["doc_id", "tk", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").mapInArrow(tidy(work), "doc_id long, tk long, fp long")


# ---- Golay keys ---------------------------------------------------------------------------------------------


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(1)
def cosets() -> np.ndarray:
    """[2048, 6]: by syndrome, the error patterns of up to three bits, then those of four; -1 fills the row."""
    found = defaultdict(list)
    for weight in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)])
        for s, p in zip(syndromes(patterns).tolist(), patterns.tolist(), strict=True):
            found[s].append(p)
    out = np.full((2048, 6), -1, np.int64)
    for s, p in found.items():
        out[s, : len(p)] = p
    return out


def codewords(segment: np.ndarray, wide: bool) -> np.ndarray:
    """Indices (the 12 high bits) of the nearest codeword or, if wide, of all within four bits; -1 fills up."""
    errors = cosets()[syndromes(segment)]
    errors = errors if wide else errors[:, :1]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


#: Bits of the three segments, and the keys: for each, how the segments are taken (left out where None).
CUTS = ((41, 23), (18, 23), (0, 18))
KEYS = (("fuzzy", None, "exact"), (None, "fuzzy", "exact"), ("exact", None, "fuzzy"), (None, "exact", "fuzzy"), ("exact", "fuzzy", None), ("fuzzy", "exact", None))
KEYS += tuple(("fuzzy", x, y) for x in ("low", "high") for y in ("low", "high"))


def taken(part: np.ndarray, bits: int, how: str, wide: bool) -> tuple[np.ndarray, int]:
    """A segment taken one way: a row of values for each fingerprint (-1 fills up), and the bits they need."""
    half = bits // 2
    if how == "fuzzy":
        return codewords(part, wide), 12
    if how == "exact":
        return part[:, None], bits
    return ((part & (1 << half) - 1)[:, None], half) if how == "low" else ((part >> half)[:, None], bits - half)


def keys(fps: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint: positions in fps, and keys as 64-bit integers that also name the kind of key."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64), n) for at, n in CUTS]
    rows, out = [], []
    for kind, plan in enumerate(KEYS):
        key, ok = np.full((len(fps), 1), kind, np.int64), np.ones((len(fps), 1), bool)
        for (part, n), how in zip(parts, plan, strict=True):
            if how is None:
                continue
            new, need = taken(part, n, how, wide)
            ok = (ok[:, :, None] & (new >= 0)[:, None, :]).reshape(len(fps), -1)
            key = ((key << need)[:, :, None] | np.maximum(new, 0)[:, None, :]).reshape(len(fps), -1)
        at, col = np.nonzero(ok)
        rows.append(at)
        out.append(key[at, col])
    return np.concatenate(rows), np.concatenate(out)


def _key_rows(nodes: DataFrame, wide: bool) -> DataFrame:
    name = "w" if wide else "n"

    def work(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for k in range(0, len(fps), CHUNK):
                at, key = keys(fps[k : k + CHUNK], wide)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[k : k + CHUNK][at])], ["key", name])

    return nodes.select("fp").mapInArrow(tidy(work), f"key long, {name} long")


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """nodes(fp), each once -> pairs (a, b), a < b, of fingerprints at most max_bits (3 or fewer) apart, each once."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys are complete for up to three bits")
    narrow, wide = _key_rows(nodes, False), _key_rows(nodes, True)
    near = (F.col("n") != F.col("w")) & (F.bit_count(F.col("n").bitwiseXOR(F.col("w"))) <= max_bits)
    pairs = narrow.join(wide, (narrow.key == wide.key) & near)
    return pairs.select(F.least("n", "w").alias("a"), F.greatest("n", "w").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tk, fp, component_id, n_links, part: one row per row of docs.

    Documents link if their fingerprints differ in at most max_bits bits; component_id is the smallest doc_id that
    links reach, the document's own included. Equal fingerprints, those of empty texts too, become one node before
    any join, so groups of copies cost one row. n_links counts the links between different fingerprints. Null ids
    are kept: a group whose ids are all null has a null component. part, the smallest fingerprint that links reach,
    names every group. Texts are read whole, whatever their length; rows that repeat are rows of the
    result each; other columns of docs are not read; an empty table gives no rows.
    """
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    n = fps.count()
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "fingerprint-nodes", n)
    pairs = stage(links(nodes, max_bits), "fingerprint-links", n)
    comp = components(pairs, pairs.count())
    degree = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).groupBy("fp").agg(F.count("*").alias("n_links"))
    comp = comp.join(nodes, F.col("node") == F.col("fp")).select("fp", "component", "least")
    least = comp.groupBy("component").agg(F.min("least").alias("component_id"))
    of = comp.join(least, "component").select("fp", "component", "component_id").join(degree, "fp", "left")
    of = nodes.join(of, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "fp").alias("part"))
    of = stage(of, "fingerprint-groups", n)
    # A fingerprint of more than a 1024th of all rows: there are fewer than 1024 of these, which may be sent everywhere,
    # so that their rows need not meet in one task.
    hot = of.where(F.col("copies") * 1024 > n).drop("copies")
    rest = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(of.drop("copies"), "fp")
    return rest.unionByName(fps.join(F.broadcast(hot), "fp")).select("doc_id", "tk", "fp", "component_id", "n_links", "part")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each group the row of the smallest doc_id (nulls last) stays, of equal ids that
    of the smallest text hash, of rows alike in both one. All columns of docs come back as they were."""
    found = near_duplicates(docs, **options)
    first = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("m")).select(F.col("m.doc_id").alias("f_id"), F.col("m.tk").alias("f_tk"))
    id_, tk = own_name("_id", docs.columns), own_name("_tk", docs.columns)
    rows = docs.withColumns({id_: F.col("doc_id").cast("long"), tk: F.xxhash64("text")}).alias("r")
    rows = rows.join(first.alias("f"), F.col(f"r.{id_}").eqNullSafe(F.col("f.f_id")) & (F.col(f"r.{tk}") == F.col("f.f_tk")), "left_semi")
    return rows.dropDuplicates([id_, tk]).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


QUERIES = {"op9_simhash": op9_simhash}
SQL: dict[str, str] = {}
