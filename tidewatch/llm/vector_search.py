"""Exact top-k search by inner product with M-trees.

Vectors become integers, floor(1024 * x). The largest inner products with a query are its nearest neighbours once every
candidate x gets one more coordinate, sqrt(M - |x|^2) with M the largest squared norm: then d(q, x)^2 = |q|^2 + M - 2 q.x.
That distance is a metric, so an M-tree applies. Candidates are dealt evenly into trees of at most ``TREE`` vectors. Each
tree is built once, bottom up, and written as node rows: pages of at most ``PAGE`` vectors, and above them nodes of at
most ``FANOUT`` children, level by level up to a root. A node has a routing vector, a covering radius, and for each entry
its distance to that routing vector.

A query descends best-first: nodes in the order of the least distance that they can hold, until that exceeds the k-th
best found. Before a distance to a child's routing vector or to a member is computed, the stored parent distance bounds
it from below by the triangle inequality. Bounds are compared with a margin above rounding error, and scores are integers
computed exactly (in Python's integers where float64 would round), so the result is exact, ties included: a node or
member that could tie is never skipped.

Queries are a stated set (every 100th id). Node rows and queries are dealt by tree and sorted, nodes first, so a task reads
one tree's nodes and then streams all queries past them: vectors are shuffled twice at most, a query once per tree.
Partial top-k lists are merged by rank per query.

Nulls and odd input: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
without an id; a query meets only vectors of its own length; a query's own id is no candidate, however often it occurs,
while other repeated rows each count and may fill several ranks; ties go to the smaller vec_id; components and scores beyond
the range of a long are clamped to it; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, sized_join

K = 10
SCALE = 1024
PAGE = 128
FANOUT = 16
#: Vectors in a tree, at most about.
TREE = 16_384
QUERY_EVERY = 100
LEAST, MOST = -(2**63), 2**63 - 1
NODES = "dim int, tree int, node int, bound double, radius double, centre binary, distances binary, entries array<long>, x binary"


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v (integers as longs) and norm (squared) of the vectors that take part."""
    x = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).filter(
        F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    v = F.transform("x", lambda c: F.floor(c * SCALE))
    return x.select("vec_id", F.size("x").alias("dim"), v.alias("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    y = points - q
    return np.sqrt(np.einsum("ij,ij->i", y, y))


def _grouped(points: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of at most ``size`` points: a routing point, the group's points, and their distances to it."""
    left = np.arange(len(points))
    from_middle = _distances(points, points.mean(axis=0))
    while len(left):
        # the farthest point left routes the next group and takes what is nearest to it
        r = int(left[np.argmax(from_middle[left])])
        d = _distances(points[left], points[r])
        near = np.argsort(d, kind="stable")[:size]
        yield r, left[near], d[near]
        left = np.delete(left, near)


def build(ids: np.ndarray, x: np.ndarray, bound: float, page: int = PAGE, fanout: int = FANOUT) -> list[dict]:
    """Nodes of the M-tree over integer vectors (rows of ``x``), root last; an inner node's entries are numbers of nodes."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    real = x.astype(np.float64)
    points = np.hstack((real, np.sqrt(np.maximum(bound - (real * real).sum(axis=1), 0))[:, None]))
    nodes: list[dict] = []
    for r, members, d in _grouped(points, page):
        nodes.append({"centre": points[r], "radius": float(d[-1]), "distances": d, "entries": ids[members], "x": x[members]})
    level = list(range(len(nodes)))
    while len(level) > 1:
        centres, up = np.array([nodes[i]["centre"] for i in level]), []
        for r, members, d in _grouped(centres, fanout):
            children = [level[m] for m in members]
            radius = max(float(e) + nodes[c]["radius"] for e, c in zip(d, children))
            up.append(len(nodes))
            nodes.append({"centre": centres[r], "radius": radius, "distances": d, "entries": np.array(children), "x": None})
        level = up
    return nodes


class Tree:
    """The nodes of ``build``, to search."""

    def __init__(self, nodes: list[dict], bound: float):
        self.nodes, self.bound, self.computed = nodes, bound, 0
        self.largest = max(abs(int(f(n["x"]))) for n in nodes if n["x"] is not None for f in (np.min, np.max))

    def scores(self, rows: np.ndarray, q: np.ndarray, largest: int) -> list[int]:
        if self.largest * largest * len(q) < 2**53:
            return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64).tolist()
        return [min(max(sum(a * b for a, b in zip(r, q.tolist())), LEAST), MOST) for r in rows.tolist()]

    def search(self, query_id: int, q: np.ndarray, k: int = K) -> list[tuple[int, int]]:
        """The (score, vec_id) of the k best, best first."""
        point = np.append(q.astype(np.float64), 0.0)
        own, largest = float(point @ point), max(map(abs, q.tolist()))
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id): the worst on top
        slack = 2.5e-7 * np.sqrt(len(point)) * (1 + np.sqrt(own) + np.sqrt(self.bound))

        def reach() -> float:
            if len(best) < k or best[0][0] <= LEAST:
                return np.inf
            return float(np.sqrt(max(own + self.bound - 2.0 * best[0][0], 0.0))) + slack

        root = len(self.nodes) - 1
        d = float(_distances(self.nodes[root]["centre"][None], point)[0])
        heap, self.computed = [(max(d - self.nodes[root]["radius"], 0.0), root, d)], self.computed + 1
        while heap:
            bound, i, d = heapq.heappop(heap)
            if bound > reach():
                break
            node = self.nodes[i]
            use = np.abs(d - node["distances"])  # what the parent distance leaves
            if node["x"] is None:
                radii = node["radii"] if "radii" in node else node.setdefault("radii", np.array([self.nodes[c]["radius"] for c in node["entries"]]))
                centres = node["centres"] if "centres" in node else node.setdefault("centres", np.array([self.nodes[c]["centre"] for c in node["entries"]]))
                at = np.flatnonzero(use - radii <= reach())
                far = _distances(centres[at], point)
                self.computed += len(at)
                for c, e, r in zip(node["entries"][at].tolist(), far.tolist(), radii[at].tolist()):
                    heapq.heappush(heap, (max(e - r, bound, 0.0), c, e))
                continue
            at = np.flatnonzero(use <= reach())
            self.computed += len(at)
            for s, m in zip(self.scores(node["x"][at], q, largest), node["entries"][at].tolist()):
                if m != query_id and (len(best) < k or (s, -m) > best[0]):
                    (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (s, -m))
        return [(s, -m) for s, m in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _built(table: pa.Table) -> pa.Table:
    dim, tree, bound = (table[c][0].as_py() for c in ("dim", "tree", "bound"))
    rows = []
    for i, n in enumerate(build(table["vec_id"].to_numpy(), _matrix(table["v"], dim), bound)):
        rows.append({
            "dim": dim, "tree": tree, "node": i, "bound": bound, "radius": n["radius"], "centre": n["centre"].tobytes(), "distances": n["distances"].tobytes(),
            "entries": n["entries"].tolist(), "x": None if n["x"] is None else n["x"].tobytes()})
    return pa.Table.from_pylist(rows, schema=pa.schema([
        ("dim", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("bound", pa.float64()), ("radius", pa.float64()), ("centre", pa.binary()),
        ("distances", pa.binary()), ("entries", pa.list_(pa.int64())), ("x", pa.binary())]))


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by tree: its nodes in order, then queries (whose node is null)."""
        key, nodes, tree = None, [], None
        for batch in batches:
            found: tuple[list[int], list[int], list[int]] = ([], [], [])
            for r in batch.to_pylist():
                if (r["dim"], r["tree"]) != key:
                    key, nodes, tree = (r["dim"], r["tree"]), [], None
                if r["node"] is not None:
                    nodes.append({
                        "centre": np.frombuffer(r["centre"]), "radius": r["radius"], "distances": np.frombuffer(r["distances"]), "entries": np.array(r["entries"], np.int64),
                        "x": None if r["x"] is None else np.frombuffer(r["x"], np.int64).reshape(-1, r["dim"])})
                    bound = r["bound"]
                    continue
                tree = tree or Tree(nodes, bound)
                for score, vec_id in tree.search(r["vec_id"], np.array(r["v"], np.int64), k):
                    for held, value in zip(found, (r["vec_id"], vec_id, score)):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id ``every`` divides, its k best among all others."""
    v = materialize(integers(vectors))
    totals = materialize(v.groupBy("dim").agg(F.max("norm").alias("bound"), F.ceil(F.count("*") / TREE).cast("int").alias("trees")))
    placed = sized_join(v, totals, ["dim"], "inner")
    candidates = placed.withColumn("tree", F.pmod(F.monotonically_increasing_id(), F.col("trees")).cast("int")).select("dim", "tree", "vec_id", "v", "bound")
    nodes = materialize(candidates.groupBy("dim", "tree").applyInArrow(_built, NODES))
    queries = placed.filter(F.col("vec_id") % every == 0).select("dim", "trees", "vec_id", "v").dropDuplicates(["vec_id", "v"])
    queries = queries.select("dim", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"), "vec_id", "v")
    rows = nodes.unionByName(queries, allowMissingColumns=True).repartition("dim", "tree").sortWithinPartitions("dim", "tree", F.asc_nulls_last("node"))
    near = rows.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % {QUERY_EVERY} = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""
