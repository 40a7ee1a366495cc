"""Toxicity by a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space made single spaces, and every run of 3 to 6 characters named by a 64-bit rolling
hash. Learning reads a sample of about PER_LABEL documents a label: Spark counts, by label, in how many of them a run
occurs; the FEATURES runs whose log-count ratio lies farthest from 0 in standard errors are kept. A feature of a text is
that ratio if the run occurs, else 0. Logistic weights over them are fitted in numpy, rows weighted so that the share
of each label is that of all labelled rows. Scoring looks up every run of every whole text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, own_name, part_batches, renamed, table, tidy

#: Bounds of what is learned from and kept: documents a label (about), runs of characters, runs of a document's text.
PER_LABEL, FEATURES, LOW, HIGH = 3000, 1 << 13, 3, 6
#: A run of fewer documents is no feature; smoothing of counts; strength of the weights' penalty; steps of the fit.
LEAST, ALPHA, RIDGE, STEPS = 4, 0.5, 2e-3, 400
THRESHOLD = 0.3
BASE, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BITS = 22
OWN = ("held_out", "score", "predicted")


def runs(texts: list[str | None]):
    """For each length: (document of each run, hash of each run), over all texts at once; runs never cross documents."""
    clean = [f" {' '.join((t or '').replace(chr(0), ' ').lower().split())} " for t in texts]
    flat = np.frombuffer("\0".join([*clean, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(clean), dtype=np.int32), [len(c) + 1 for c in clean])
    code, end = flat.astype(np.uint64) + np.uint64(1), flat == 0
    h, cut = code.copy(), end.copy()
    for n in range(2, HIGH + 1):
        if len(h) < 2:
            return
        h = h[:-1] * BASE + code[n - 1 :]
        cut = cut[:-1] | end[n - 1 :]
        if n >= LOW:
            ok = ~cut
            mixed = h[ok] ^ np.uint64(n)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * ODD
            yield doc[: len(h)][ok], mixed


class Model:
    """Runs (sorted hashes) with what each adds to a text's log odds, and the constant."""

    def __init__(self, keys: np.ndarray, adds: np.ndarray, bias: float):
        self.keys, self.adds, self.bias = keys, adds, bias
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) pairs that occur, each once, in order."""
        pairs = [np.empty(0, np.int64)]
        for doc, h in runs(texts):
            near = np.flatnonzero(self.seen[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            at = np.searchsorted(self.keys, h[near])
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == h[near] if len(self.keys) else np.zeros(0, bool)
            pairs.append(np.unique(doc[near][hit].astype(np.int64) * len(self.keys) + at[hit]))
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.keys)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        doc, k = self.found(texts)
        odds = self.bias + np.bincount(doc, weights=self.adds[k], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_weights(doc: np.ndarray, k: np.ndarray, ratio: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float, float]:
    """Penalised logistic regression on features ratio[k] of each doc: (weights, constant, norm of the last gradient)."""
    w, bias, n = np.zeros(len(ratio)), 0.0, len(label)
    weight = weight / weight.sum()
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, steps + 1):
        odds = bias + np.bincount(doc, weights=(w * ratio)[k], minlength=n)
        off = weight * (1 / (1 + np.exp(-np.clip(odds, -50, 50))) - label)
        g = np.append(np.bincount(k, weights=off[doc], minlength=len(ratio)) * ratio + ridge * w, off.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - (step - 1) / steps)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias, float(np.linalg.norm(g))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, features: int = FEATURES) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic) -> the model; labels that are null or of no document count for nothing.

    A document of several labels has the largest; a label other than 0 counts as 1. Without labelled documents every
    score is 0, with one label only it is that label's share.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("y"))
    known = known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total:
        return Model(np.empty(0, np.uint64), np.empty(0), -50.0)
    share = F.element_at(F.create_map(*chain.from_iterable((F.lit(y), F.lit(min(1.0, per_label / n))) for y, n in total.items())), F.col("y"))
    dice = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.select("doc_id", "text").join(F.broadcast(known.where(dice < share)), "doc_id").select("y", "text")
    if len(total) == 1:
        y = next(iter(total))
        return Model(np.empty(0, np.uint64), np.empty(0), 50.0 if y else -50.0)

    def count(batches):
        for batch in part_batches(batches):
            ys = np.array(batch.column("y").to_pylist())
            for doc, h in runs(batch.column("text").to_pylist()):
                if not len(h):
                    continue
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                once = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
                keys, inv = np.unique(h[once], return_inverse=True)
                hot = np.bincount(inv, weights=ys[doc[once]], minlength=len(keys))
                n = np.bincount(inv, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hot.astype(np.int64)), pa.array((n - hot).astype(np.int64))], ["h", "n1", "n0"])

    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    s1, s0 = sizes.get(1, 0), sizes.get(0, 0)
    grams = sample.mapInArrow(tidy(count), "h long, n1 long, n0 long").groupBy("h").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= LEAST)
    ratio = F.log((F.col("n1") + ALPHA) / (s1 + 2 * ALPHA)) - F.log((F.col("n0") + ALPHA) / (s0 + 2 * ALPHA))
    far = F.abs("r") / F.sqrt(1 / (F.col("n1") + ALPHA) + 1 / (F.col("n0") + ALPHA))
    best = grams.withColumn("r", ratio).orderBy(F.desc(far), "h").limit(features).select("h", "r").collect()
    keys = np.array([r.h for r in best], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, ratios = keys[order], np.array([r.r for r in best])[order]
    look = Model(keys, ratios, 0.0)

    def present(batches):
        for batch in part_batches(batches):
            texts = batch.column("text").to_pylist()
            doc, k = look.found(texts)
            cuts = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(k.astype(np.int32)))], ["y", "k"])

    rows = sorted((r.y, tuple(r.k)) for r in sample.mapInArrow(tidy(present), "y int, k array<int>").collect())
    label = np.array([y for y, _ in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(k) for _, k in rows])
    weight = np.where(label == 1, total[1] / max(1, s1), total[0] / max(1, s0))
    w, bias, _ = fit_weights(doc, np.array([i for _, k in rows for i in k], np.int64), ratios, label, weight)
    return Model(keys, w * ratios, bias)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, kept columns) -> kept columns, score, predicted: a row per row.

    Null and empty texts have the score of a text without runs; texts of any length are read whole; equal texts score
    alike; an empty table gives no rows. A kept column named like a result (or held_out) gets an underscore.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = renamed(fields, OWN)
    text = next((n for f, n in zip(fields, names, strict=True) if f.name == "text"), "text")

    def work(batches):
        for batch in part_batches(batches, column=text):
            score = shared.value.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    schema = ", ".join([*(f"`{n}` {f.dataType.simpleString()}" for f, n in zip(fields, names, strict=True)), "score double, predicted int"])
    rows = docs.select(*(F.col(f"`{f.name}`").alias(n) for f, n in zip(fields, names, strict=True)), *([] if text in names else ["text"]))
    return rows.mapInArrow(tidy(work), schema)


def judge(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> kept columns, held_out, score, predicted: a row per row, see fit and predict.

    Learns from labels of documents whose id's checksum is not 2 modulo 4 (a null id's is that of the empty string).
    """
    out = held_out("doc_id", 4, 2)
    model = fit(docs.where(~out), labels.where(~out))
    mark = own_name("held_out", docs.columns)
    found = predict(docs.withColumn(mark, out), model, (*keep, mark))
    names = renamed([f for f in docs.schema.fields if f.name in keep], OWN)
    return found.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{found.columns[-3]}`").alias("held_out"), "score", "predicted")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_toxicity": op12_toxicity}
SQL: dict[str, str] = {}
