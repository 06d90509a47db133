"""Exact top-k search by inner product over an M-tree.

Vectors of integers get one more coordinate, so that all have the same length ``sqrt(most)``; then the largest inner
product with a query is the smallest Euclidean distance, a metric.  The tree is paged: a node holds entries with
their covering radius and the distance to the node's own routing object.  Search is best-first: the node with the
smallest possible distance is opened next, until none can hold a better result.  The triangle inequality on stored
distances (``|d(query, parent) - d(entry, parent)|``) leaves out entries before any distance is computed.

The index is a table of nodes.  Vectors go to the nearest of a bounded number of routing objects and so to subtrees of
about equal size; a routing object with very many vectors (copies, say) is spread over several subtrees.  A query first
searches the subtree nearest to it, and then, with the threshold found, only those subtrees that may hold better ones.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialise
from .common import partitions

#: Routing objects that are broadcast, subtrees at most, vectors of a subtree (while there are fewer), entries of a page.
ROUTERS, SUBTREES, SUBTREE, PAGE = 512, 4096, 20_000, 200
_SLACK = 1e-9


def integer_vectors(df: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """``(vec_id, vec, norm)``: ``floor(scale * x)`` as little-endian 64-bit integers, and the squared length.

    Rows without id or vector, and vectors with null or non-finite components, are left out; of rows with the same id the
    smallest vector stays.
    """
    picked = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    picked = picked.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad).groupBy("vec_id").agg(F.min("v").alias("v"))

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            parts = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([int(p @ p) for p in parts], pa.int64())], names=["vec_id", "vec", "norm"])

    return picked.mapInArrow(run, "vec_id long, vec binary, norm long")


def _matrix(blobs, dim: int) -> np.ndarray:
    """Rows of a matrix; shorter vectors end in zeros."""
    blobs = list(blobs)
    out = np.zeros((len(blobs), dim), np.int64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, np.int64)
        out[i, : len(v)] = v
    return out


def _metric(vectors: np.ndarray, norms: np.ndarray, most: int) -> np.ndarray:
    """Points of the metric space: the vector and what it lacks in length."""
    return np.concatenate([vectors.astype(float), np.sqrt(np.maximum(most - norms, 0).astype(float))[:, None]], axis=1)


def _distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - to) ** 2).sum(axis=1))


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    squares = (pivots**2).sum(axis=1)
    for first in range(0, len(points), 2048):
        out[first : first + 2048] = (squares - 2 * points[first : first + 2048] @ pivots.T).argmin(axis=1)
    return out


NODE = "tree int, node int, parent int, radius double, to_parent double, center binary, least long, ids binary, vectors binary, distances binary"


def _build(most: int, dim: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """A subtree: pages around pivots, pages gathered in inner nodes, inner nodes below the root."""
        group = group.sort_values("vec_id")
        vectors, ids = _matrix(group["vec"], dim), group["vec_id"].to_numpy()
        points, tree = _metric(vectors, group["norm"].to_numpy(), most), int(group["tree"].iloc[0])
        chosen = np.random.default_rng(len(ids)).permutation(len(ids))[: max(1, len(ids) // PAGE)]
        pivots = points[np.sort(chosen)]
        pages, near = [], _nearest(points, pivots)
        for p in np.unique(near):
            own = np.flatnonzero(near == p)
            far = _distances(points[own], pivots[p])
            by = np.argsort(far, kind="stable")
            for first in range(0, len(own), PAGE):  # rings around the pivot
                cut = by[first : first + PAGE]
                pages.append((pivots[p], own[cut], far[cut]))
        centers = np.array([p[0] for p in pages])
        heads = centers[:: max(1, int(len(pages) ** 0.5))]
        inner = _nearest(centers, heads)
        root = centers.mean(axis=0)
        rows, top, number = [], 0.0, len(heads) + 1
        for h in range(len(heads)):
            reach, least = 0.0, None
            for i in np.flatnonzero(inner == h):
                center, own, far = pages[i]
                up, radius = float(_distances(center[None], heads[h])[0]), float(far.max())
                rows.append((tree, number, h + 1, radius, up, center.tobytes(), int(ids[own].min()), ids[own].tobytes(), vectors[own].tobytes(), far.tobytes()))
                reach, least, number = max(reach, up + radius), min(int(ids[own].min()), least if least is not None else int(ids[own].min())), number + 1
            if least is not None:
                up = float(_distances(heads[h][None], root)[0])
                rows.append((tree, h + 1, 0, reach, up, heads[h].tobytes(), least, None, None, None))
                top = max(top, up + reach)
        rows.append((tree, 0, -1, top, 0.0, root.tobytes(), int(ids.min()), None, None, None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])

    return run


class _Subtree:
    def __init__(self, nodes: pd.DataFrame, dim: int):
        self.children: dict[int, list] = {}
        self.pages, self.inner = {}, {}
        self.root = None
        for row in nodes.itertuples():
            center = np.frombuffer(row.center)
            if row.parent < 0:
                self.root = center
                continue
            self.children.setdefault(row.parent, []).append((row.node, row.radius, row.to_parent, center, row.least))
            if row.ids is not None:
                ids = np.frombuffer(row.ids, np.int64)
                self.pages[row.node] = (ids, np.frombuffer(row.vectors, np.int64).reshape(len(ids), dim), np.frombuffer(row.distances))
        for parent, entries in self.children.items():
            node, radius, up, center, least = zip(*entries, strict=True)
            self.inner[parent] = (np.array(node), np.array(radius), np.array(up), np.array(center), np.array(least))

    def search(self, own: int, query: np.ndarray, most: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, vec_id)``, none below ``floor``; ties to the smaller id; never the query itself."""
        point = np.append(query.astype(float), 0.0)
        length = int(query @ query) + most
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst in front
        limit = floor

        def reach() -> float:
            """Distance beyond which nothing is wanted."""
            return np.inf if limit is None else float(np.sqrt(max(length - 2 * limit, 0))) * (1 + _SLACK) + 1e-6

        waiting = [(0.0, 0, float(_distances(self.root[None], point)[0]))]
        while waiting:
            bound, node, away = heapq.heappop(waiting)
            if bound > reach():
                break
            if node in self.pages:
                ids, vectors, far = self.pages[node]
                near = np.flatnonzero((np.abs(away - far) <= reach()) & (ids != own))
                if not len(near):
                    continue
                scores = vectors[near] @ query
                if limit is not None:
                    near, scores = near[scores >= limit], scores[scores >= limit]
                for score, i in zip(scores.tolist(), ids[near].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    limit = best[0][0] if limit is None else max(limit, best[0][0])
            else:
                nodes, radius, up, center, least = self.inner[node]
                near = np.flatnonzero(np.abs(away - up) - radius <= reach())
                if len(near):
                    far = _distances(center[near], point)
                    for i, d in zip(near.tolist(), far.tolist(), strict=True):
                        if d - radius[i] <= reach():
                            heapq.heappush(waiting, (max(bound, d - radius[i]), int(nodes[i]), d))
        return [(s, -i) for s, i in best]


def _search(most: int, dim: int, k: int):
    def run(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(queries):
            tree = _Subtree(nodes, dim)
            vectors = _matrix(queries["vec"], dim)
            for own, query, floor in zip(queries["vec_id"].tolist(), vectors, queries["floor"].tolist(), strict=True):
                out += [(own, i, s) for s, i in tree.search(own, query, most, k, None if pd.isna(floor) else int(floor))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every``, the ``k`` largest inner products.

    Scores are of ``floor(scale * x)``; ties go to the smaller id; a query with fewer than ``k`` candidates gets all.  Rows
    without id, vectors that are null or hold null or non-finite components take no part; repeated ids count once; shorter
    vectors end in zeros.  An empty table, or one with a single vector, gives no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    points = materialise(integer_vectors(vectors, scale, id_column, vector_column), "vectors")
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.max(F.length("vec") / 8).cast("int").alias("dim")).first()
    if not facts["n"] or not facts["dim"]:
        facts = {"n": facts["n"], "most": facts["most"] or 0, "dim": max(1, facts["dim"] or 0)}
    n, most, dim = facts["n"], facts["most"], facts["dim"]

    sample = points.orderBy(F.xxhash64("vec_id")).limit(ROUTERS).collect()
    routers = _metric(_matrix([r["vec"] for r in sample], dim), np.array([r["norm"] for r in sample], np.int64), most)
    if len(routers):
        routers = np.unique(routers, axis=0)
        routers = routers[np.argsort(_distances(routers, routers[0]), kind="stable")]

    def route(batches):
        for batch in batches:
            if batch.num_rows:
                near = _nearest(_metric(_matrix(batch.column("vec").to_pylist(), dim), batch.column("norm").to_numpy(), most), routers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "router"])

    routed = materialise(points.mapInArrow(route, "vec_id long, vec binary, norm long, router int"), "routed")
    counts = {r["router"]: r["count"] for r in routed.groupBy("router").count().collect()}  # at most ROUTERS rows
    trees = min(SUBTREES, max(partitions(spark), -(-n // SUBTREE)))
    room = max(1, -(-n // trees))
    plan, tree, held = [], 0, 0
    for router in sorted(counts):
        if counts[router] >= room:
            tree, held = tree + (held > 0), 0
            spread = -(-counts[router] // room)
            plan.append((router, tree, spread))
            tree += spread
        else:
            if held + counts[router] > room:
                tree, held = tree + 1, 0
            plan.append((router, tree, 1))
            held += counts[router]
    bounded = spark.createDataFrame(plan, "router int, first int, spread int")
    placed = routed.join(F.broadcast(bounded), "router").withColumn("tree", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("spread"))).cast("int"))
    nodes = materialise(placed.select("tree", "vec_id", "vec", "norm").groupBy("tree").applyInPandas(_build(most, dim), NODE), "nodes")
    roots = nodes.filter("parent < 0").orderBy("tree").select("tree", "radius", "center").collect()  # at most SUBTREES + ROUTERS rows
    centers = np.array([np.frombuffer(r["center"]) for r in roots]).reshape(len(roots), dim + 1)
    reach, numbers = np.array([r["radius"] for r in roots]), np.array([r["tree"] for r in roots], np.int32)

    def aim(first: bool):
        """The nearest subtree of each query; or all others that may hold a score of its floor or better."""

        def run(batches):
            for batch in batches:
                rows, to = [], []
                floors = batch.column("floor").to_pylist()
                for i, query in enumerate(_matrix(batch.column("vec").to_pylist(), dim)):
                    away = _distances(centers, np.append(query.astype(float), 0.0))
                    nearest = int(away.argmin())
                    if first:
                        chosen = np.array([nearest])
                    else:
                        limit = np.inf if floors[i] is None else np.sqrt(max(int(query @ query) + most - 2 * floors[i], 0)) * (1 + _SLACK) + 1e-6
                        chosen = np.flatnonzero(away - reach <= limit)
                        chosen = chosen[chosen != nearest]
                    rows += [i] * len(chosen)
                    to += numbers[chosen].tolist()
                taken = batch.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *taken.columns], names=["tree", "vec_id", "vec", "floor"])

        return run

    def searched(queries: DataFrame) -> DataFrame:
        return nodes.groupBy("tree").cogroup(queries.groupBy("tree")).applyInPandas(_search(most, dim, k), "query_id long, vec_id long, score long")

    aimed = "tree int, vec_id long, vec binary, floor long"
    queries = points.filter(F.col("vec_id") % every == 0).select("vec_id", "vec")
    near = materialise(searched(queries.withColumn("floor", F.lit(None).cast("long")).mapInArrow(aim(True), aimed)), "near")
    worst = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    far = searched(queries.join(worst, "vec_id", "left").select("vec_id", "vec", "floor").mapInArrow(aim(False), aimed))
    ranked = near.union(far).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
