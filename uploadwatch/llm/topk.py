"""Exact top-k search (2): the vectors with the highest integer inner products, by ball-tree branch and bound.

Components become floor(64 * x).  A bounded sample (SAMPLE vectors) gives the splits of a coarse tree; every row
goes to one of its leaves, whose ball is the sample's centre and the farthest row.  A leaf's rows are one or more
shards of a bounded number of rows.  A shard's own ball tree is built once a round, in one task, and queries stream
past it in batches: each query's nodes are ordered by the upper bound q.c + |q| r of their inner products, and left
off where the bound falls below the query's current kth score.  Queries visit leaves in rounds: first the leaf
with the highest bound, then a few more, then the rest; what a round finds is the next one's starting bound, and
leaves below it are not visited.  So all shards share the current kth score, and neither shards nor queries are
copied to every cell.

Cases: vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no
part; a row is its vec_id, so rows that share the query's are its own and repeated rows each count as a
candidate of others; only vectors of the query's length have a product with it; components of any size are
worked out exactly and scores beyond a long are clipped; ties go to the smaller vec_id; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uploadwatch.llm.common import bounded_batches, map_batches
from uploadwatch.scratch import materialize

SCALE, SHARD, BLOCK, LEAF = 64, 8192, 1024, 256
SAMPLE, LEAVES = 4096, 1024  # vectors that fit the coarse tree, leaves at most
ROUNDS = ((0, 1), (1, 8), (8, None))  # places, in order of bounds, of the leaves that a round visits
_HUGE = float(np.finfo(np.float64).max)
_LONG = np.iinfo(np.int64)


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> list[tuple[np.ndarray, np.ndarray, float, int, bool]]:
    """Nodes (rows, centre, radius, parent, whether a leaf); a node is split at the median of its widest direction's projection."""
    nodes: list[tuple[np.ndarray, np.ndarray, float, int]] = []
    todo = [(np.arange(len(points)), -1)]
    leaves: set[int] = set()
    while todo:
        rows, parent = todo.pop()
        own = points[rows]
        centre = own.mean(axis=0)
        away = own - centre
        far = np.sqrt((away * away).sum(axis=1))
        nodes.append((rows, centre, float(far.max()), parent))
        me = len(nodes) - 1
        if len(rows) <= leaf or far.max() == 0:
            leaves.add(me)
            continue
        along = away @ away[int(far.argmax())]
        order = np.argsort(along, kind="stable")
        todo += [(rows[order[: len(rows) // 2]], me), (rows[order[len(rows) // 2 :]], me)]
    return [(*node, n in leaves) for n, node in enumerate(nodes)]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles; infinite where that is no double."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * vectors)


def _exact(vectors: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """whole (scaled vectors) where doubles hold every partial sum, or else Python integers."""
    most = np.abs(whole).max(initial=0)
    with np.errstate(over="ignore"):
        small = most * most * max(1, vectors.shape[1]) < 2**52
    if small:
        return whole
    one = lambda x: math.floor(SCALE * x) if abs(x) < 1e300 else SCALE * int(x)
    return np.array([[one(x) for x in v] for v in vectors.tolist()], object).reshape(vectors.shape)


def _float(score) -> float:
    """A double that is not above the score."""
    if isinstance(score, int):
        return math.nextafter(float(min(max(score, -int(_HUGE)), int(_HUGE))), -math.inf) if score > -int(_HUGE) else -math.inf
    return float(score)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """queries x balls: no inner product in a ball is higher; infinite where doubles overflow."""
    with np.errstate(all="ignore"):
        lengths = np.sqrt((queries * queries).sum(axis=1))[:, None]
        own = queries @ centres.T + lengths * radii
        own = own + 1e-9 * (np.abs(own) + lengths * (np.sqrt((centres * centres).sum(axis=1)) + radii)) + 1e-6  # rounding never prunes
    return np.where(np.isfinite(own), own, np.inf)


class Shard:
    """A shard's vectors under their ball tree."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids, self.whole = vectors, ids, scaled(vectors)
        with np.errstate(all="ignore"):
            self.tree = ball_tree(self.whole)
        self.leaves = [n for n, node in enumerate(self.tree) if node[4]]
        self.centres, self.radii = np.array([node[1] for node in self.tree]), np.array([node[2] for node in self.tree])
        self.exact = _exact(vectors, self.whole)

    def search(self, vectors: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, k: int) -> tuple[list[np.ndarray], list[list]]:
        """For each query the ids and scores of its k best points, at least as good as its starting bound."""
        queries = scaled(vectors)
        upper = upper_bounds(queries, self.centres, self.radii).T
        for n, node in enumerate(self.tree):
            if node[3] >= 0:
                upper[n] = np.minimum(upper[n], upper[node[3]])
        upper = upper[self.leaves]
        order = np.argsort(-upper, axis=0, kind="stable")
        mine = _exact(vectors, queries)
        points = self.exact
        if mine.dtype != points.dtype or (mine.dtype != object and np.abs(queries).max(initial=0) * np.abs(self.whole).max(initial=0) * max(1, vectors.shape[1]) >= 2**52):
            integers = lambda x: x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
            mine, points = integers(mine), integers(points)
        best_ids = [np.empty(0, np.int64)] * len(queries)
        best: list = [[] for _ in queries]
        current = bounds.copy()
        for step in range(len(self.leaves)):
            turn = order[step]
            active = np.flatnonzero(upper[turn, np.arange(len(queries))] >= current)
            if not len(active):
                break
            for leaf in np.unique(turn[active]):
                who = active[turn[active] == leaf]
                rows = self.tree[self.leaves[leaf]][0]
                scores = mine[who] @ points[rows].T
                for j, q in enumerate(who):
                    fine = (self.ids[rows] != query_ids[q]) & (scores[j] >= current[q])
                    found_ids = np.concatenate([best_ids[q], self.ids[rows][fine]])
                    found = np.concatenate([np.asarray(best[q], scores.dtype), scores[j][fine]])
                    if len(found) > k:
                        keep = np.lexsort((found_ids, -found))[:k] if scores.dtype != object else np.array(sorted(range(len(found)), key=lambda i: (-found[i], found_ids[i]))[:k])
                        found_ids, found = found_ids[keep], found[keep]
                    best_ids[q], best[q] = found_ids, found
                    if len(found) == k:
                        current[q] = max(current[q], _float(min(found)))
        return best_ids, best


def _matrix(column, size: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), size)


def _stream(k: int, block: int):
    """Rows sorted by shard, its points (kind 0) before its queries: one shard is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, shard = None, [], None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "leaf", "salt", "kind"))))
            at = 0
            while at < len(places):
                to = at
                while to < len(places) and places[to] == places[at] and to - at < block:
                    to += 1
                own, part = places[at], batch.slice(at, to - at)
                at = to
                if own[:3] != place:
                    place, held, shard = own[:3], [], None
                if own[3] == 0:
                    held.append((_matrix(part.column("v"), own[0]), part.column("vec_id").to_numpy()))
                    continue
                if shard is None:
                    shard = Shard(*(np.concatenate(x) for x in zip(*held))) if held else None
                    held = []
                if shard is None:
                    continue
                query_ids, bounds = part.column("vec_id").to_numpy(), part.column("bound").to_numpy().astype(np.float64)
                ids, scores = shard.search(_matrix(part.column("v"), own[0]), query_ids, bounds, k)
                sizes = [len(x) for x in ids]
                clipped = [min(max(int(s), _LONG.min), _LONG.max) for found in scores for s in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("uid").to_numpy(), sizes), pa.int64()), pa.array(np.repeat(query_ids, sizes), pa.int64()), pa.array(np.concatenate(ids), pa.int64()), pa.array(clipped, pa.int64())],
                    names=["uid", "query_id", "vec_id", "score"],
                )

    return run


class Coarse:
    """Splits of a sample along its widest directions, and the centres of what they leave."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: dict[int, tuple[np.ndarray, float, int, int]] = {}  # node: direction, threshold, nodes below
        self.leaf: dict[int, int] = {}
        centres, todo, made = [], [(0, sample)], 1
        while todo:
            node, own = todo.pop(0)  # breadth first, so leaves are of like size
            centre = own.mean(axis=0) if len(own) else np.zeros(sample.shape[1])
            away = own - centre
            far = (away * away).sum(axis=1)
            if len(self.leaf) + len(todo) + 2 > leaves or len(own) < 4 or not 0 < far.max() < np.inf:
                self.leaf[node] = len(centres)
                centres.append(centre)
                continue
            direction = away[int(far.argmax())]
            along = own @ direction
            middle = float(np.median(along))
            self.splits[node] = (direction, middle, made, made + 1)
            todo += [(made, own[along < middle]), (made + 1, own[along >= middle])]
            made += 2
        self.centres = np.array(centres)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
                continue
            direction, middle, low, high = self.splits[node]
            below = vectors[rows] @ direction < middle
            todo += [(low, rows[below]), (high, rows[~below])]
        return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query row's k best other rows."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    valid = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = materialize(bounded_batches(valid).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("uid")), "vectors")
    usual = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (usual["dim"], usual["n"]) if usual else (0, 0)
    sample = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("uid"), F.lit(-(-n // SAMPLE) or 1)) == 0)).select("v").limit(2 * SAMPLE).collect()
    with np.errstate(all="ignore"):
        coarse = Coarse(scaled(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), dim)), min(LEAVES, max(1, -(-n // shard))))

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column("dim").to_numpy()
        leaves, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
        for size in np.unique(dims):
            at = np.flatnonzero(dims == size)
            own = scaled(_matrix(batch.column("v").take(pa.array(at)), int(size)))
            with np.errstate(all="ignore"):
                leaves[at] = coarse.place(own) if size == dim else 0
                away = own - (coarse.centres[leaves[at]] if size == dim else 0)
                far[at] = np.sqrt((away * away).sum(axis=1))
        far = np.where(np.isfinite(far), far, np.inf)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "dim", "asks", "uid")), pa.array(leaves), pa.array(far)], names=["vec_id", "v", "dim", "asks", "uid", "leaf", "far"])

    spread = materialize(map_batches(rows, placed, "vec_id bigint, v array<double>, dim int, asks boolean, uid bigint, leaf bigint, far double"), "leaves")
    balls = spread.groupBy("dim", "leaf").agg(F.max("far").alias("far"), F.ceil(F.count("*") / shard).alias("salts"))
    radii = np.full(len(coarse.centres), -1.0)  # LEAVES at most; -1: without rows
    for r in balls.filter(F.col("dim") == dim).collect():
        radii[r["leaf"]] = r["far"]
    salts = balls.select("dim", "leaf", "salts")
    points = spread.join(salts, ["dim", "leaf"]).select("dim", "leaf", F.pmod(F.xxhash64("uid"), "salts").alias("salt"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("bigint").alias("uid"), F.lit(None).cast("double").alias("bound"))
    asking = spread.filter("asks").select("uid", "vec_id", "v", "dim")

    def visits(first: int, past: int | None):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            dims, bounds = batch.column("dim").to_numpy(), batch.column("bound").to_numpy()
            take, leaves = [], []
            for size in np.unique(dims):
                at = np.flatnonzero(dims == size)
                if size != dim:  # rare lengths have one leaf
                    take += at.tolist() if first == 0 else []
                    leaves += [0] * len(at) if first == 0 else []
                    continue
                upper = upper_bounds(scaled(_matrix(batch.column("v").take(pa.array(at)), dim)), coarse.centres, np.maximum(radii, 0))
                upper[:, radii < 0] = -np.inf
                order = np.argsort(-upper, axis=1, kind="stable")[:, first:past]
                held = np.take_along_axis(upper, order, axis=1)
                who, which = np.nonzero((held >= bounds[at][:, None]) & (held > -np.inf))
                take += at[who].tolist()
                leaves += order[who, which].tolist()
            chosen = pa.array(take, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), *(batch.column(c).take(chosen) for c in ("uid", "vec_id", "v", "dim", "bound"))], names=["leaf", "uid", "vec_id", "v", "dim", "bound"])

        return run

    best = None
    for number, (first, past) in enumerate(ROUNDS):
        if number and first >= (radii >= 0).sum():
            break
        bound = asking.withColumn("bound", F.lit(float("-inf")))
        if best is not None:
            reached = best.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("bound"))
            # A clipped score may stand for a lower one.
            lowest = F.when(F.col("bound") > -float(2**63), F.col("bound"))
            bound = asking.join(reached, "uid", "left").withColumn("bound", F.coalesce(lowest, F.lit(float("-inf"))))
        sent = map_batches(bound, visits(first, past), "leaf bigint, uid bigint, vec_id bigint, v array<double>, dim int, bound double")
        queries = sent.join(salts, ["dim", "leaf"]).select("dim", "leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("kind"), "vec_id", "v", "uid", "bound")
        cells = points.unionByName(queries).repartition("dim", "leaf", "salt").sortWithinPartitions("dim", "leaf", "salt", "kind")
        found = cells.mapInArrow(_stream(k, block), "uid bigint, query_id bigint, vec_id bigint, score bigint")
        pool = found if best is None else found.unionByName(best.select(*found.columns))
        ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")))
        best = materialize(ranked.filter(F.col("rank") <= k), "best")
    return best.select("query_id", "rank", "vec_id", "score")
