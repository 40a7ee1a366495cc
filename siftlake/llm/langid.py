"""Language ID by a bidirectional gated recurrent network over bytes (operator 8).

The network reads words (bytes between white space, in pieces of LONGEST at most) from both sides and gives every
byte a distribution over the languages. A document's distribution is the mean of those of all its bytes. Equal
words have equal outputs, so each is read once per task slice and counted as often as it occurs; words of one
length go through together, so nothing is padded.

Training is on the driver, in numpy, by backpropagation through time, on a sample of labelled rows bounded by
PER_LANG distinct texts a language and WORDS words a text, for every label there is. Only text and label are looked at.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, own_name, part_batches, renamed, stage, table, tidy, utf8

LONGEST, PER_LANG, WORDS = 48, 200, 200
KNOWN, PARTS = 1 << 17, 16  # words that a task remembers; groups of tasks in which hashes are first ranked


def has_letter(text: str) -> bool:
    """Whether some character is a letter; numerals such as ½ or Ⅷ and marks are none."""
    if any("a" <= c <= "z" for c in text[:64]):
        return True
    return any(unicodedata.category(c)[0] == "L" for c in set(text))


def sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class ByteGRU:
    """Weights by name; f and b are the two directions. Gates stand in the order update, reset, candidate."""

    def __init__(self, classes: int, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h, self.w = hidden, {}
        for d in "fb":
            self.w["x" + d] = r.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w["u" + d] = r.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            self.w["c" + d] = np.zeros(3 * hidden, np.float32)
        self.w["out"] = r.normal(0, hidden**-0.5, (2 * hidden, classes)).astype(np.float32)
        self.w["bias"] = np.zeros(classes, np.float32)

    def _run(self, words: np.ndarray, d: str):
        n, length = words.shape
        h, state, kept = self.h, np.zeros((n, self.h), np.float32), []
        x, u, c = (self.w[k + d] for k in "xuc")
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            pre = x[words[:, t]] + c
            gates = sigmoid(pre[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            cand = np.tanh(pre[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            kept.append((t, state, z, r, cand))
            state = state + z * (cand - state)
        after = [k[1] for k in kept[1:]] + [state]
        return kept, {k[0]: a for k, a in zip(kept, after, strict=True)}

    def positions(self, words: np.ndarray):
        """words [n, length] of bytes -> log-probabilities [length, n, classes], with what backpropagation needs."""
        (kf, f), (kb, b) = self._run(words, "f"), self._run(words, "b")
        both = np.stack([np.concatenate((f[t], b[t]), axis=1) for t in range(words.shape[1])])
        score = both @ self.w["out"] + self.w["bias"]
        score -= score.max(-1, keepdims=True)
        return score - np.log(np.exp(score).sum(-1, keepdims=True)), both, kf, kb

    def gradients(self, words: np.ndarray, labels: np.ndarray):
        """Mean loss over all positions, and its gradient by every weight."""
        logp, both, kf, kb = self.positions(words)
        length, n, _ = logp.shape
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = -logp[:, np.arange(n), labels].mean()
        d_score = np.exp(logp)
        d_score[:, np.arange(n), labels] -= 1
        d_score /= length * n
        grads["out"] = np.einsum("tnh,tnc->hc", both, d_score)
        grads["bias"] = d_score.sum((0, 1))
        d_both, h = d_score @ self.w["out"].T, self.h
        for d, kept, cols in (("f", kf, slice(0, h)), ("b", kb, slice(h, 2 * h))):
            u, after = self.w["u" + d], np.zeros((n, h), np.float32)
            for t, state, z, r, cand in reversed(kept):
                d_new = after + d_both[t][:, cols]
                d_cand = d_new * z * (1 - cand * cand)
                d_z = d_new * (cand - state) * z * (1 - z)
                d_rs = d_cand @ u[:, 2 * h :].T
                d_r = d_rs * state * r * (1 - r)
                d_pre = np.concatenate((d_z, d_r, d_cand), axis=1)
                grads["u" + d][:, : 2 * h] += state.T @ d_pre[:, : 2 * h]
                grads["u" + d][:, 2 * h :] += (r * state).T @ d_cand
                grads["c" + d] += d_pre.sum(0)
                np.add.at(grads["x" + d], words[:, t], d_pre)
                after = d_new * (1 - z) + d_rs * r + d_pre[:, : 2 * h] @ u[:, : 2 * h].T
        return loss, grads

    def train(self, words: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 384, rate: float = 0.01, seed: int = 11) -> ByteGRU:
        """Adam over batches of words of one length, lengths drawn by their share of all bytes."""
        r = np.random.default_rng(seed)
        sizes = np.array([len(w) for w in words])
        by = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes) if n}
        share = np.array([n * len(i) for n, i in by.items()], float)
        lengths, m, v = list(by), {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}
        for step in range(1, steps + 1 if by else 1):
            n = lengths[r.choice(len(lengths), p=share / share.sum())]
            own = by[n][r.integers(0, len(by[n]), min(batch, 4 * len(by[n])))]
            _, grads = self.gradients(np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(-1, n), labels[own])
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """[words, classes]: sums over each word's bytes of their distributions."""
        out = np.zeros((len(words), len(self.w["bias"])), np.float32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, bounds):
            for k in range(0, len(group), 4096):
                own = group[k : k + 4096]
                if n := int(sizes[own[0]]) if len(own) else 0:
                    logp = self.positions(np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8).reshape(-1, n))[0]
                    out[own] = np.exp(logp).sum(0)
        return out


def chunks(text: str, most: int = 1 << 20):
    """The words of a text in order, in lists of about most bytes."""
    data, at, space = utf8(text), 0, re.compile(rb"\s")
    while at < len(data):
        end = space.search(data, at + most) if at + most < len(data) else None
        end = end.start() if end else len(data)
        yield cut(data[at:end])
        at = end


def cut(text: str | bytes) -> list[bytes]:
    """The words of a text in order; those above LONGEST bytes in pieces of that."""
    words = (text if isinstance(text, bytes) else utf8(text)).split()
    if words and max(map(len, words)) > LONGEST:
        return [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return words


def sample(docs: DataFrame, per_lang: int = PER_LANG, words: int = WORDS) -> DataFrame:
    """docs(text, lang), labelled -> lang, words: per_lang distinct texts of each language, all where there are fewer.

    Texts come in the order of a hash of theirs; so do a text's words. Copies are one text before any is counted;
    of each language every task hands on per_lang hashes at most, to one of PARTS groups of tasks, and each group as
    many to the last. The hashes chosen are a written table, so that Spark knows their size when it plans the texts' join.
    """
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))

    def least(hashes, *by):
        return hashes.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("n") <= per_lang).drop("n")

    dealt = rows.select("lang", "h").distinct().withColumn("part", F.spark_partition_id() % PARTS)
    first = stage(least(least(dealt, "lang", "part"), "lang").select("lang", "h"), "langid-sample")
    rows = rows.join(first, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def pick(batches):
        import xxhash

        for batch in batches:
            got = [sorted(set(cut(t)), key=lambda w: (xxhash.xxh64_intdigest(w), w))[:words] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(got, pa.list_(pa.binary()))], ["lang", "words"])

    return rows.select("lang", "text").mapInArrow(pick, "lang string, words array<binary>")


def fit(labelled: DataFrame, **options) -> tuple[list[str], ByteGRU | None]:
    """Languages, sorted, and the network; none if nothing is labelled."""
    rows = sorted((r.lang, [bytes(w) for w in r.words]) for r in sample(labelled, **options).collect())
    langs = sorted({lang for lang, words in rows if words})
    if not langs:
        return [], None
    words = [w for _, ws in rows for w in ws]
    at = {lang: k for k, lang in enumerate(langs)}
    labels = np.array([at[lang] for lang, ws in rows for _ in ws])
    # every language has the same weight: draw from the smaller ones more often
    r, most = np.random.default_rng(5), np.bincount(labels).max()
    pick = np.concatenate([r.choice(np.flatnonzero(labels == k), most) for k in range(len(langs))])
    return langs, ByteGRU(len(langs)).train([words[i] for i in pick], labels[pick])


OWN = ("held_out", "lang_pred", "score")


def predict(docs: DataFrame, langs: list[str], net: ByteGRU | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, kept columns) -> kept columns, lang_pred, score: a row per row.

    Null texts, texts without a letter (empty ones too) and, if nothing was learned, all texts are ``und`` with
    score 0. score is the mean probability of the language over all bytes of the text's words. Texts of any length are
    read whole; of languages that are equally likely the first by name is taken; rows that repeat get equal results; an
    empty table gives no rows. A kept column named like a result (or held_out) gets an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, net))
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = renamed(fields, OWN)
    text = next((n for f, n in zip(fields, names, strict=True) if f.name == "text"), "text")

    def work(batches):
        langs, net = shared.value
        place: dict[bytes, int] = {}
        known = np.empty((KNOWN, len(langs)), np.float32)
        for batch in part_batches(batches, column=text):
            texts = batch.column(text).to_pylist()
            total, some, size = np.zeros((len(texts), len(langs))), [], 0

            def read():
                nonlocal place, known
                words = set().union(*(ws for _, ws in some))
                new = [w for w in words if w not in place]
                if len(place) + len(new) > len(known):
                    place, new = {}, list(words)
                    known = known if len(new) <= len(known) else np.empty((len(new), len(langs)), np.float32)
                if new:
                    known[len(place) : len(place) + len(new)] = net.pooled(new)
                    place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                for i, ws in some:
                    total[i] += known[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64)

            for i, t in enumerate(texts):
                for ws in chunks(t) if net and t and has_letter(t) else ():
                    some.append((i, ws))
                    size += len(ws)
                    if size >= KNOWN:
                        read()
                        some, size = [], 0
            read()
            best, told = (total.argmax(1), total.sum(1) > 0) if langs else (None, None)
            pred = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), told.tolist(), strict=True)] if langs else ["und"] * len(texts)
            score = np.where(told, total.max(1) / np.where(told, total.sum(1), 1), 0.0).clip(0, 1) if langs else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{n}` {f.dataType.simpleString()}" for f, n in zip(fields, names, strict=True)), "lang_pred string, score double"])
    rows = docs.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)), *([] if text in names else ["text"]))
    return rows.mapInArrow(tidy(work), schema)


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(doc_id, text, lang) -> kept columns, held_out, lang_pred, score: a row per row, see predict.

    Learns from rows with text and label whose id's checksum is not 0 modulo 5 (a null id's is that of the empty string).
    """
    out = held_out("doc_id", 5, 0)
    langs, net = fit(docs.where(~out))
    mark = own_name("held_out", docs.columns)
    found = predict(docs.withColumn(mark, out), langs, net, (*keep, mark))
    names = renamed([f for f in docs.schema.fields if f.name in keep], OWN)
    return found.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{found.columns[-3]}`").alias("held_out"), "lang_pred", "score")


def op8_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_gru": op8_byte_gru}
SQL: dict[str, str] = {}
