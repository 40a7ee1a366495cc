"""SentencePiece encoding and decoding by batched Viterbi (operator 4).

The model's pieces and scores are searched for the segmentation of greatest total score, as its unigram
encoder would. Texts are cut where no piece can reach across; the parts, once each, are grouped by length, and the
parts of one length advance together: at every end, hashes of the substrings that end there probe the sorted
hashes of the pieces of each length, hits are confirmed by their characters, and the maximum over all lengths is
kept with the length it came from. Of equal scores the longest last piece wins. A character that no piece covers
costs ten below the lowest score and is written as the pieces of its UTF-8 bytes, or as the unknown piece where the
model has none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, part_batches, renamed, table, tidy

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Pieces:
    """A model: pieces (string, score, kind), kind one of normal, byte, other; pieces of kind other are only decoded (as nothing)."""

    def __init__(self, pieces: list[tuple[str, float, str]], unknown: int = 0, prefix: bool = True):
        self.unknown, self.prefix, self.size = unknown, prefix, len(pieces)
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
        self.low = min((s for _, s, _ in normal), default=0.0) - 10.0
        self.dtype = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        out = [p.replace(SPACE, " ").encode() if kind == "normal" else b"" for p, _, kind in pieces]
        for b, i in self.bytes.items():
            out[i] = bytes([b])
        out[unknown] = " ⁇ ".encode()
        self.out = out
        by: dict[int, list] = {}
        for p, s, i in normal:
            by.setdefault(len(p), []).append((p, s, i))
        self.by = {}
        for n, own in by.items():
            chars = np.array([[ord(c) for c in p] for p, _, _ in own], np.uint32)
            hashes = self._hash(chars)
            order = np.argsort(hashes)
            assert len(np.unique(hashes)) == len(own), "two pieces share a hash"
            self.by[n] = hashes[order], chars[order], np.array([s for _, s, _ in own])[order], np.array([i for _, _, i in own])[order]
        # A text can be cut before a space that follows another character, and around characters of no piece.
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in normal)
        used = {c for p, _, _ in normal for c in p}
        bare = "".join(re.escape(c) for c in "\n\t\r" if c not in used)
        self.cut = re.compile(f"[^{bare}]+|[{bare}]" if whole and bare else "(?s).+" if whole else f"[{bare}]|{SPACE}*[^{SPACE}{bare}]+|{SPACE}+" if bare else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), np.uint64)
        for k in range(chars.shape[1]):
            h = (h + chars[:, k] + np.uint64(1)) * BASE
        return h ^ h >> np.uint64(32)

    def viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """chars [n, length] of code points -> the best piece's length and id at every end, [n, length + 1]; id -1: unknown."""
        n, length = chars.shape
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0.0
        back, ids = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        # open_[k]: hashes of the substrings that began k characters before, not yet mixed
        open_: list[np.ndarray] = []
        most = max(self.by, default=1)
        for end in range(1, length + 1):
            c = chars[:, end - 1] + np.uint64(1)
            open_ = [(h + c) * BASE for h in [np.zeros(n, np.uint64), *open_[: most - 1]]]
            top, size, who = best[:, end - 1] + self.low, np.ones(n, np.int32), np.full(n, -1, np.int32)
            for k in range(min(end, most), 0, -1):
                if k not in self.by:
                    continue
                hashes, spelt, scores, names = self.by[k]
                h = open_[k - 1] ^ open_[k - 1] >> np.uint64(32)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                hit = hit[(spelt[at[hit]] == chars[hit, end - k : end]).all(1)]
                new = best[hit, end - k] + scores[at[hit]]
                # the unknown character loses to any piece of equal score; longer pieces come first and keep ties
                won = (new > top[hit]) | (new == top[hit]) & (who[hit] < 0)
                hit, new = hit[won], new[won]
                top[hit], size[hit], who[hit] = new, k, names[at[hit]]
            best[:, end], back[:, end], ids[:, end] = top, size, who
        return back, ids

    def _spell(self, part: str, back: list[int], ids: list[int]) -> bytes:
        out, end = [], len(part)
        while end:
            i = ids[end]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(part[end - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            end -= back[end]
        return np.array(out[::-1], self.dtype).tobytes()

    def encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        by: dict[int, list[str]] = {}
        for p in parts:
            by.setdefault(len(p), []).append(p)
        out = {}
        for n, own in by.items():
            step = max(1, (1 << 17) // n)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                chars = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
                back, ids = self.viterbi(chars)
                out.update((p, self._spell(p, b, i)) for p, b, i in zip(some, back.tolist(), ids.tolist(), strict=True))
        return out

    def parts(self, text: str) -> list[str]:
        return self.cut.findall((SPACE if self.prefix and text else "") + text.replace(" ", SPACE))

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def load(path: str) -> Pieces:
    """From a model file: its normalisation has to be the identity, as that of the given one is."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return Pieces([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())], sp.unk_id())


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), memory: int = 300_000, longest: int = 48) -> DataFrame:
    """docs(text, kept columns) -> kept columns, ids array<int>: a row per row. Null and empty texts: no ids.

    path: the model file. Up to memory short parts are remembered by each task. Texts of any length are encoded whole;
    rows that repeat get equal ids; an empty table gives no rows. A kept column named ids gets an underscore.
    """
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = renamed(fields, ("ids",))
    text = next((n for f, n in zip(fields, names, strict=True) if f.name == "text"), own_name("text", names))

    def work(batches):
        model, known = load(path), {}
        for batch in part_batches(batches, 2_000_000, text):
            cut = [model.parts(t or "") for t in batch.column(text).to_pylist()]
            if len(known) > memory:
                known = {}
            found = model.encode_parts([p for p in set().union(*cut) if p not in known])
            known.update((p, ids) for p, ids in found.items() if len(p) <= longest)
            long = {p: ids for p, ids in found.items() if len(p) > longest}
            get = (lambda p: long[p] if len(p) > longest else known[p]) if long else known.__getitem__
            rows = [np.frombuffer(b"".join(map(get, parts)), model.dtype).astype(np.int32) for parts in cut]
            ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [ids], [*names, "ids"])

    schema = ", ".join([*(f"`{n}` {f.dataType.simpleString()}" for f, n in zip(fields, names, strict=True)), "ids array<int>"])
    rows = docs.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)), *([] if text in names else [F.col("text").alias(text)]))
    return rows.mapInArrow(tidy(work), schema)


def decode(coded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """coded(ids, kept columns) -> kept columns, text. Null ids: null text; ids outside the model raise IndexError. A kept
    column named text gets an underscore; ids can be kept."""
    fields = [f for f in coded.schema.fields if f.name in keep]
    names = renamed(fields, ("text",))
    own = next((n for f, n in zip(fields, names, strict=True) if f.name == "ids"), own_name("ids", names))

    def work(batches):
        model = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = part.column(own)
                flat, ends = np.asarray(ids.values), np.asarray(ids.offsets)
                text = [model.decode(flat[a:b]) if ok else None for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), ids.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(text, pa.string())], [*names, "text"])

    schema = ", ".join([*(f"`{n}` {f.dataType.simpleString()}" for f, n in zip(fields, names, strict=True)), "text string"])
    rows = coded.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)), *([] if own in names else [F.col("ids").alias(own)]))
    return rows.mapInArrow(tidy(work), schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, decoded_sha256, whole: the decoded text is the text, but for U+2581, which decodes to a space."""
    docs = table(spark, sf_dir, "documents")
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))
    coded = encode(docs.select("doc_id", "text", F.sha2(plain, 256).alias("sha")), model_path(), ("doc_id", "sha"))
    coded = coded.select("*", F.size("ids").alias("n_pieces"))
    out = decode(coded, model_path(), ("doc_id", "sha", "n_pieces"))
    out = out.select("doc_id", F.col("n_pieces").cast("long").alias("n_pieces"), F.sha2("text", 256).alias("decoded_sha256"), "sha")
    return out.select("doc_id", "n_pieces", "decoded_sha256", (F.col("decoded_sha256") == F.col("sha")).alias("whole"))


QUERIES = {"op4_pieces": op4_pieces}
SQL: dict[str, str] = {}
