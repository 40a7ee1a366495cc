"""Knowledge retrieval: keyword and vector scores, vetoes, top k.

retrieve() holds every text against all items at once: an automaton over all triggers, vetoes and conditions passes each
text once, and a table of words adds tags and titles, so the work is a text's length and its hits, not texts times items.
Items are sent to the tasks in slices of a bounded size. vector_top_k() multiplies blocks of queries with stored blocks of
items and keeps the k best of each query and block.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import shared_dir, stage

# Words a query doesn't count by.
STOP = ("the", "and", "for", "with", "that", "this", "def", "return", "class", "import", "from", "self", "none", "true", "false", "if", "else", "try")
#: Bytes of items that go to the tasks together, and vectors of a block of items and of queries.
SLICE, ITEMS, ASKED = 1 << 25, 1 << 13, 1 << 10


def words(col: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("[a-z_]{3,}"), 0)), F.array(*map(F.lit, STOP)))


def keyword_score(query: Column, query_words: Column, triggers: Column, tags: Column, title: Column) -> Column:
    """3 for every trigger in the text, 2 for every tag and 1 for every title word (repeats count) among its words."""
    low = F.lower(query)
    named = F.regexp_extract_all(F.lower(title), F.lit("[a-z_]{3,}"), 0)
    return (
        3 * F.size(F.filter(triggers, lambda t: F.contains(low, F.lower(t))))
        + 2 * F.size(F.filter(tags, lambda t: F.array_contains(query_words, F.lower(t))))
        + F.size(F.filter(named, lambda w: F.array_contains(query_words, w)))
    )


def veto(scope: Column, not_when: Column, require_any: Column) -> Column:
    """A text that holds a ``not_when`` or, where one is required, none of ``require_any``."""
    low = F.lower(scope)
    bad = F.exists(not_when, lambda x: F.contains(low, F.lower(x)))
    return F.coalesce(bad, F.lit(False)) | F.coalesce((F.size(require_any) > 0) & ~F.exists(require_any, lambda x: F.contains(low, F.lower(x))), F.lit(False))


class Matcher:
    """Items (ord, triggers, tags, title, not_when, require_any_in) against texts: each text is read once for all of them."""

    def __init__(self, items: list[dict]):
        import ahocorasick

        self.items = [r["ord"] for r in items]
        self.asked = [bool(r["require_any_in"]) for r in items]
        needles: dict[str, list[tuple[str, int]]] = {}
        self.words: dict[str, list[tuple[int, int]]] = {}
        for i, r in enumerate(items):
            for kind in ("triggers", "not_when", "require_any_in"):
                for x in r[kind] or ():
                    if x is not None:
                        needles.setdefault(x.lower(), []).append((kind, i))
            for tag in r["tags"] or ():
                if tag is not None:
                    self.words.setdefault(tag.lower(), []).append((i, 2))
            for w in re.findall(r"[a-z_]{3,}", (r["title"] or "").lower()):
                self.words.setdefault(w, []).append((i, 1))
        self.words = {w: (np.array([i for i, _ in v]), np.array([n for _, n in v])) for w, v in self.words.items() if w not in STOP}
        self.asked = np.array(self.asked, bool)
        self.everywhere = needles.pop("", [])  # an empty string is in every text
        self.automaton = ahocorasick.Automaton()
        for x, owners in needles.items():
            self.automaton.add_word(x, (x, owners))
        if needles:
            self.automaton.make_automaton()
        self.some = bool(needles)

    def _held(self, low: str) -> list[tuple[str, int]]:
        found = dict(v for _, v in self.automaton.iter(low)) if self.some else {}
        return [*self.everywhere, *(o for owners in found.values() for o in owners)]

    def score(self, text: str, scope: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Points of every item, and whether it is vetoed."""
        low, n = text.lower(), len(self.items)
        held = self._held(low)
        hit = [self.words[w] for w in set(re.findall(r"[a-z_]{3,}", low)) if w in self.words]
        points = np.zeros(n, np.int64)
        if hit:
            points += np.bincount(np.concatenate([i for i, _ in hit]), weights=np.concatenate([p for _, p in hit]), minlength=n).astype(np.int64)
        np.add.at(points, [i for kind, i in held if kind == "triggers"], 3)
        if scope is not None:
            held = self._held(scope.lower())
        vetoed = self.asked.copy()
        vetoed[[i for kind, i in held if kind == "require_any_in"]] = False
        vetoed[[i for kind, i in held if kind == "not_when"]] = True
        return points, vetoed


def _slices(items: DataFrame, most: int):
    """The items, whole, in slices of about most bytes each, in order of ord."""
    size = F.lit(64)
    for c in ("triggers", "tags", "not_when", "require_any_in"):
        size = size + F.coalesce(F.length(F.array_join(c, " ")), F.lit(0))
    total = items.agg(F.sum(size + F.coalesce(F.length("title"), F.lit(0)))).first()[0] or 0
    n = -(-total // most)
    for k in range(n):
        yield n, sorted((r.asDict() for r in items.where(F.pmod(F.xxhash64("ord"), F.lit(n)) == k).collect()), key=lambda r: r["ord"])


def retrieve(texts: DataFrame, items: DataFrame, k: int | None = None, vetoes: bool = False, most: int = SLICE) -> DataFrame:
    """texts(query_id, text and maybe scope), items(ord, triggers, tags, title, not_when, require_any_in) -> query_id, ord, score, vetoed.

    score: 3 for every trigger that the text holds, 2 for every tag and 1 for every title word (repeats count) among its
    words. vetoed: the scope (where there is none, the text) holds a ``not_when`` or, where some are required, none of
    ``require_any_in``. Rows of items with a score; with vetoes those that are vetoed without one, too. k: only the k best
    of each text that aren't vetoed, ties by ord, with their rank. Null texts are empty, nulls in items are left out; items
    of any number: more than most bytes of them are more passes over the texts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in (texts.schema["query_id"], items.schema["ord"])}
    items = items.select("ord", "triggers", "tags", "title", "not_when", "require_any_in")
    scope = "scope" if "scope" in texts.columns else None
    texts = texts.select("query_id", "text", *([scope] if scope else []))
    parts, n = [], 0
    for n, some in _slices(items, most):
        shared = texts.sparkSession.sparkContext.broadcast(some)

        def work(batches, shared=shared):
            m = Matcher(shared.value)
            ords = pa.array(m.items, kind)
            for batch in batches:
                found = []
                for i in range(batch.num_rows):
                    points, vetoed = m.score(batch.column("text")[i].as_py() or "", batch.column(scope)[i].as_py() if scope else None)
                    if k is None:
                        take = np.flatnonzero((points > 0) | vetoed if vetoes else points > 0)
                    else:  # items are in order of ord: a stable sort keeps ties in it
                        take = np.flatnonzero((points > 0) & ~vetoed)
                        take = take[np.argsort(-points[take], kind="stable")[:k]]
                    found.append((np.full(len(take), i), take, points[take], vetoed[take]))
                at, which, points, vetoed = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in range(4))
                cols = [batch.column("query_id").take(pa.array(at, pa.int64())), ords.take(pa.array(which, pa.int64())), pa.array(points, pa.int64()), pa.array(vetoed.astype(bool), pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["query_id", "ord", "score", "vetoed"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(items.schema["ord"].dataType)
        parts.append(texts.mapInArrow(work, f"query_id {kinds['query_id']}, ord {kinds['ord']}, score long, vetoed boolean"))
    if not parts:
        out = texts.select("query_id", F.lit(None).cast(kinds["ord"]).alias("ord"), F.lit(0).cast("long").alias("score"), F.lit(False).alias("vetoed")).limit(0)
        return out if k is None else out.withColumn("rank", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out if k is None else top_k(out, k)


def top_k(scored: DataFrame, k: int, query: str = "query_id", score: str = "score", order: str = "ord") -> DataFrame:
    """The k best of each query; ties by load order."""
    n = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), order))
    return scored.withColumn("rank", n).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Of L2-normalised vectors, norms lifted by 1e-9, not below 0."""
    return F.greatest(dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-9) * (F.sqrt(dot(b, b)) + 1e-9)), F.lit(0.0))


def fuse(scored: DataFrame) -> DataFrame:
    """scored(query_id, ord, kw, cos, vetoed) -> score: half keyword share of the query's best (vetoed ones too), half cosine; above 0.05 only."""
    best = F.max("kw").over(Window.partitionBy("query_id"))
    s = 0.5 * F.col("kw") / F.when(best > 0, best).otherwise(1) + 0.5 * F.greatest("cos", F.lit(0.0))
    return scored.withColumn("_s", s).where(~F.col("vetoed") & (F.col("_s") > 0.05)).withColumn("score", F.round("_s", 3)).drop("_s")


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _blocks(rows: DataFrame, id_: str, size: int, n: int) -> DataFrame:
    """rows(id, v) -> block, ids, dims, data: n blocks by the id's hash, vectors of unit length in a row; at most 2 * size in one row."""

    def pack(t: pa.Table) -> pa.Table:
        out = []
        for i in range(0, t.num_rows, 2 * size):
            part = t.slice(i, 2 * size)
            x = _unit(np.array(part["v"].to_pylist(), np.float64))
            out.append({"block": part["block"][0].as_py(), "ids": part[id_].to_pylist(), "dims": x.shape[1], "data": x.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("dims", pa.int64()), ("data", pa.binary())]))

    whole = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    rows = rows.select(F.col(id_).cast("long").alias(id_), F.col("v").cast("array<double>").alias("v")).where(whole & F.col(id_).isNotNull())
    rows = rows.withColumn("block", F.pmod(F.xxhash64(id_), F.lit(n)))
    return rows.groupBy("block", F.size("v").alias("size")).applyInArrow(lambda t: pack(t), "block long, ids array<long>, dims long, data binary")


def vector_store(items: DataFrame) -> DataFrame:
    """items(ord, v) in blocks, kept in the shared folder under the hash of the set: the same items are packed once."""
    named = items.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("ord", "v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1), "ord")).alias("y")).first()
    path = f"{shared_dir(items.sparkSession)}/kb-{named.n}-{(named.x or 0) & (1 << 64) - 1:016x}{(named.y or 0) & (1 << 64) - 1:016x}"
    try:
        return items.sparkSession.read.schema("block long, ids array<long>, dims long, data binary").parquet(path + "/whole")
    except AnalysisException:  # not stored yet
        _blocks(items, "ord", ITEMS, max(1, -(-named.n // ITEMS))).write.mode("overwrite").parquet(path + "/whole")
        return items.sparkSession.read.parquet(path + "/whole")


def vector_top_k(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, others: bool = False) -> DataFrame:
    """queries(query_id, v), items(ord, v) -> query_id, ord, score, rank: the k best by cosine, not below 0, ties (after rounding) by ord.

    Every block of queries meets every block of items once; of each pair only the k best a query leave the task. Vectors
    that are null, empty or hold nulls or NaN are left out, those of other lengths don't meet. others: an item of the query's
    own id doesn't count. ids are longs.
    """
    store = vector_store(items)
    n = queries.count()
    asked = stage(_blocks(queries, "query_id", ASKED, max(1, -(-n // ASKED))), "kb-queries").withColumnsRenamed({"ids": "q_ids", "data": "q_data", "block": "q_block"})
    numbers = store.select("block").distinct().agg(F.collect_set("block").alias("blocks"))  # a number a block
    dealt = asked.join(F.broadcast(numbers)).withColumn("block", F.explode("blocks")).drop("blocks")  # one row

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                q, x = (np.frombuffer(r[c], np.float64).reshape(-1, r["dims"]) for c in ("q_data", "data"))
                ids, names = np.array(r["ids"]), np.array(r["q_ids"])
                score = np.maximum(np.round(q @ x.T, digits), 0.0)
                if others:
                    score[names[:, None] == ids[None, :]] = -1.0
                least = np.partition(score, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                row, col = np.nonzero((score >= least[:, None]) & (score >= 0))
                order = np.lexsort((ids[col], -score[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, row)
                best = np.arange(len(row)) - first < k
                row, col = row[best], col[best]
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[col]), pa.array(score[row, col])], ["query_id", "ord", "score"])

    pairs = dealt.join(store, ["block", "dims"]).select("q_ids", "q_data", "ids", "data", "dims")
    return top_k(pairs.mapInArrow(work, "query_id long, ord long, score double"), k)
