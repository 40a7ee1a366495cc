"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 10).

Vectors are scaled to length one and turned to their principal axes, where the leading dimensions carry most of
every product. A k-d tree over the leading axes deals them into tiles. Two tiles are compared unless the boxes
around them lie farther apart than two linked vectors can. Within a pair of tiles products are summed over the leading
dimensions first; what the rest can add is bounded by the product of the suffix norms, and pairs that cannot reach
the threshold any more are given up. Those that stay are decided by the cosine of the vectors as given, in double
precision.

Axes and tree come from a bounded sample; only the speed depends on it. Each vector meets every vector whose tile
is near, so the work is that of an exact join. Tiles travel in groups: a task takes two groups and compares all their
near pairs, so a tile is sent once per pair of groups, not once per pair of tiles. Only counts and a spanning forest
leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, stage, table, tidy
from .graph import components

SAMPLE, TILE, MAX_TILES, BOX, GROUP = 4096, 2048, 65_536, 12, 32_000_000  # GROUP: bytes of a group of tiles
STEPS = (8, 16, 32)


class Axes:
    """Principal axes of a sample and a k-d tree over the leading ones, for one number of dimensions."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.mean = sample.mean(0)
        values, vectors = np.linalg.eigh(np.cov(sample - self.mean, rowvar=False, bias=True).reshape(sample.shape[1], -1))
        self.turn = vectors[:, ::-1]
        self.cuts: list[tuple[int, float]] = []
        self.depth = min(int(np.ceil(np.log2(max(1, leaves)))), int(np.log2(len(sample))))
        level = [sample @ self.turn]
        for _ in range(self.depth):
            after = []
            for rows in level:
                axis = int(np.argmax(rows[:, :BOX].var(0))) if len(rows) else 0
                at = float(np.median(rows[:, axis])) if len(rows) else 0.0
                self.cuts.append((axis, at))
                after += [rows[rows[:, axis] <= at], rows[rows[:, axis] > at]]
            level = after

    def leaf(self, turned: np.ndarray) -> np.ndarray:
        out, base = np.zeros(len(turned), np.int64), 0
        axis, at = np.array([c[0] for c in self.cuts], np.int64), np.array([c[1] for c in self.cuts])
        for d in range(self.depth):
            node = base + out
            out = 2 * out + (turned[np.arange(len(turned)), axis[node]] > at[node])
            base += 1 << d
        return out


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that join the same rows and columns of a boolean matrix as all its true cells."""
    rows, cols, out = linked.any(1), linked.any(0), []
    while rows.any():
        front = [int(np.argmax(rows))]
        rows[front] = False
        while len(front):
            new = np.flatnonzero(linked[front].any(0) & cols)
            cols[new] = False
            out += zip(np.array(front)[linked[np.ix_(front, new)].argmax(0)].tolist(), new.tolist(), strict=True)
            if not len(new):
                break
            front = np.flatnonzero(linked[:, new].any(1) & rows)
            rows[front] = False
            out += zip(front.tolist(), new[linked[np.ix_(front, new)].argmax(1)].tolist(), strict=True)
    return out


def compare(x: np.ndarray, y: np.ndarray, turn: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y (as given) have a cosine of at least least; turn: the axes, leading ones first."""
    u, v = unit(x), unit(y)
    a, b = u @ turn, v @ turn
    out = np.zeros((len(x), len(y)), bool)
    done, slack, dims = 0, 1e-9, a.shape[1]
    for k in range(0, len(x), 512):
        part, total, at = a[k : k + 512], np.zeros((min(512, len(x) - k), len(y))), None
        done = 0
        for stop in (*[s for s in STEPS if s < dims], dims):
            rest = np.sqrt(np.maximum(0, (part[:, stop:] ** 2).sum(1))), np.sqrt(np.maximum(0, (b[:, stop:] ** 2).sum(1)))
            if at is None:
                total += part[:, done:stop] @ b[:, done:stop].T
                open_ = total + rest[0][:, None] * rest[1][None, :] >= least - slack
                if (n := np.count_nonzero(open_)) == 0:
                    at = (np.empty(0, np.int64),) * 2
                    break
                if n < 0.05 * open_.size:
                    at = np.nonzero(open_)
                    total = total[at]
            else:
                total = total + np.einsum("ij,ij->i", part[at[0], done:stop], b[at[1], done:stop])
                keep = total + rest[0][at[0]] * rest[1][at[1]] >= least - slack
                at, total = (at[0][keep], at[1][keep]), total[keep]
            done = stop
        at = np.nonzero(open_) if at is None else at
        for j in range(0, len(at[0]), 1 << 16):
            r, c = at[0][j : j + (1 << 16)] + k, at[1][j : j + (1 << 16)]
            out[r, c] = np.einsum("ij,ij->i", u[r], v[c]) >= least
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def _tiles(nodes: DataFrame, axes: dict[int, Axes], rows: int) -> DataFrame:
    """nodes(id, v, dims, copies) -> tile, dims, ids, copies, vectors, box: a row per tile of about rows vectors."""
    shared = nodes.sparkSession.sparkContext.broadcast(axes)

    def leaves(batches):
        for batch in batches:
            dims = np.array(batch.column("dims"))
            out = np.zeros(len(dims), np.int64)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                out[own] = shared.value[int(d)].leaf(unit(_matrix(batch.column("v").take(pa.array(own)), d)) @ shared.value[int(d)].turn)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "dims", "copies")), pa.array(out)], ["id", "v", "dims", "copies", "leaf"])

    leafed = stage(nodes.mapInArrow(tidy(leaves), "id long, v array<double>, dims int, copies long, leaf long"), "vector-leaves")
    parts = leafed.groupBy("dims", "leaf").agg(F.ceil(F.count("*") / rows).cast("long").alias("parts"))
    salted = leafed.join(parts, ["dims", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))

    def pack(key, t):
        dims, leaf, part = (k.as_py() for k in key)
        x = _matrix(t.column("v").combine_chunks(), dims)
        turned = (unit(x) @ shared.value[dims].turn)[:, :BOX]
        box = np.stack((turned.min(0), turned.max(0))).ravel().tolist()
        cols = [[f"{dims}/{leaf}/{part}"], [dims], [np.array(t.column("id"), "<i8").tobytes()], [np.array(t.column("copies"), "<i8").tobytes()], [x.astype("<f8").tobytes()], [box]]
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.float64())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["tile", "dims", "ids", "copies", "vectors", "box"])

    return stage(salted.groupBy("dims", "leaf", "part").applyInArrow(pack, "tile string, dims int, ids binary, copies binary, vectors binary, box array<double>"), "vector-tiles")


def _near(box: np.ndarray, boxes: np.ndarray, least: float) -> np.ndarray:
    """Which boxes are near enough to box that unit vectors in them can have a cosine of least."""
    gap = np.maximum(0, np.maximum(boxes[:, 0] - box[1], box[0] - boxes[:, 1]))
    return (gap * gap).sum(1) <= 2 - 2 * least + 1e-9


def _meetings(tiles: DataFrame, least: float, group: int) -> DataFrame:
    """tile, ga, gb: the pairs of groups of tiles, ga <= gb, in which a tile meets another that is near, or itself.

    Every tile is held against all boxes; the tiles are few by their size, MAX_TILES or so at most.
    """
    boxes = tiles.select("tile", "dims", "box").orderBy("dims", "tile").collect()
    names, dims, wide = [b.tile for b in boxes], np.array([b.dims for b in boxes]), np.zeros((len(boxes), 2, BOX))
    for i, b in enumerate(boxes):
        wide[i, :, : len(b.box) // 2] = np.array(b.box).reshape(2, -1)
    shared = tiles.sparkSession.sparkContext.broadcast((names, dims, wide))

    def near(batches):
        names, dims, wide = shared.value
        place = {t: i for i, t in enumerate(names)}
        for batch in batches:
            for t in batch.column("tile").to_pylist():
                i = place[t]
                other = np.unique(np.flatnonzero(_near(wide[i], wide, least) & (dims == dims[i])) // group)
                n, own = len(other), np.full(len(other), i // group)
                cols = [pa.array([t] * n, pa.string()), pa.array([i] * n, pa.int64()), pa.array(np.minimum(own, other), pa.int64()), pa.array(np.maximum(own, other), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["tile", "number", "ga", "gb"])

    return tiles.select("tile").mapInArrow(near, "tile string, number long, ga long, gb long")


def near_vectors(table_: DataFrame, least: float = 0.9, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """table_(vec_id, embedding) -> vec_id, n_links, component_id, kept: one row per row of table_.

    Two rows link if their cosine is at least least. Rows whose vector is null, empty or zero, or holds nulls or
    components that aren't finite, and rows of different lengths, link with nothing. Equal vectors are compared
    once, whatever their number. Rows that share a vec_id are one node of the component graph, and their links add
    up. Null ids link like others but name no component: one of null ids alone has a null component_id, and a row
    without id is never kept. Other columns are not read; an empty table gives no rows. sample: rows that axes and tree
    are taken from, of each length of vectors.
    """
    rows = table_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", F.when(finite, F.col("v")).alias("v"))
    copies = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = stage(copies.select(F.monotonically_increasing_id().alias("id"), "least", "v", F.size("v").alias("dims"), "copies"), "vectors")
    counts = {r.dims: r.n for r in nodes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    size, axes = max(tile, -(-sum(counts.values()) // MAX_TILES)), {}
    for dims, n in counts.items():
        seen = nodes.where(F.col("dims") == dims).select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
        axes[dims] = Axes(unit(_matrix(seen.column("v").combine_chunks(), dims)), -(-n // size))
    if not counts:
        own = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), own.isNotNull().alias("kept"))
    tiles = _tiles(nodes.select("id", "v", "dims", "copies"), axes, size)
    turns = nodes.sparkSession.sparkContext.broadcast({d: x.turn for d, x in axes.items()})
    group = max(1, GROUP // (8 * size * max(counts)))

    def pair(one: dict, two: dict, same: bool):
        """Links of two tiles, block by block: ids with counts of links, and edges."""
        for i in range(0, len(one["ids"]), TILE):
            for j in range(i if same else 0, len(two["ids"]), TILE):
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                linked = compare(one["vectors"][a], two["vectors"][b], turns.value[one["dims"]], least)
                if twin := same and i == j:
                    np.fill_diagonal(linked, False)
                rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                ids, others = one["ids"][a], two["ids"][b]
                yield ids[rows], None, linked[rows] @ two["copies"][b]
                if not twin:
                    yield others[cols], None, linked[:, cols].T @ one["copies"][a]
                if edges := forest(linked):
                    yield ids[[e[0] for e in edges]], others[[e[1] for e in edges]], np.zeros(len(edges), np.int64)

    def work(key, t):
        ga, gb = (k.as_py() for k in key)
        found = sorted(t.to_pylist(), key=lambda p: p["number"])
        for p in found:
            p["vectors"] = np.frombuffer(p["vectors"], "<f8").reshape(-1, p["dims"])
            p["ids"], p["copies"], p["box"] = np.frombuffer(p["ids"], "<i8"), np.frombuffer(p["copies"], "<i8"), np.array(p["box"]).reshape(2, -1)
        parts = []
        for k, one in enumerate(found):
            if one["number"] // group == ga:
                for two in found[k:]:
                    if two["number"] // group == gb and one["dims"] == two["dims"] and _near(one["box"], two["box"][None], least)[0]:
                        parts += pair(one, two, one is two)
        cols = [[x for p in parts for x in p[0].tolist()], [x for p in parts for x in (p[1].tolist() if p[1] is not None else [None] * len(p[0]))], [int(x) for p in parts for x in p[2].tolist()]]
        release()
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["id", "other", "n"])

    dealt = _meetings(tiles, least, group).join(tiles, "tile").groupBy("ga", "gb")
    return _finish(rows, nodes, stage(dealt.applyInArrow(work, "id long, other long, n long"), "vector-links"))


def _finish(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    of = stage(rows.join(nodes.select("id", "v"), "v", "left").select("vec_id", "id"), "vector-rows")
    n = found.groupBy("id").agg(F.sum("n").alias("n"))
    edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    # a vec_id on several vectors joins them
    shared = of.where("id is not null and vec_id is not null").groupBy("vec_id").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    edges = edges.union(of.where("id is not null").join(shared, "vec_id").where("id <> least").select("least", "id").distinct())
    comp = components(edges, edges.count())
    of_node = nodes.select("id", "least", "copies").join(n, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    of_node = of_node.select("id", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("part"))
    names = of_node.groupBy("part").agg(F.min("least").alias("component_id"))
    out = of.join(of_node.join(names, "part").select("id", "n_links", "component_id"), "id", "left")
    own = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(own == F.col("vec_id"), F.lit(False)).alias("kept"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_vectors": op10_vectors}
SQL = {
    "op10_vectors": """
WITH RECURSIVE p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""
}
