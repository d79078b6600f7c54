"""Clusters of inclusion vectors: density clusters, their scores, and the merge order of a heatmap's rows.

Points have id and numeric ``dims``.  Copies of a vector are one weighted point until the
end, so a value that many events share costs no more than one.  A point that lacks a
coordinate (null or NaN) belongs to no cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoframe.operators.ordering import fixed, indexed

#: Dimensions that the grid of a neighbour join uses: it meets 3 cells in each.
GRID_DIMS = 3
#: Points of a block of pair sums, and pairs of blocks that go to Python at once.
BLOCK, BATCH_BLOCKS = 1024, 16
#: Partitions of blocks, as many on either side of their product, up to which each has one block, and blocks in each of more.
SIDE_PARTS, SIDE_BLOCKS = 24, 64
#: Rows of a heatmap that are brought into order, as a figure can hold.
MOST_ROWS = 1000


def _weighted(points: DataFrame, dims: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(id, dims of every whole point; id, dims, weight of each distinct vector, under its smallest id)."""
    whole = points.select("id", *[F.col(d).cast("double").alias(d) for d in dims]).where(" and ".join(f"`{d}` is not null and not isnan(`{d}`)" for d in dims))
    return whole, fixed(whole.groupBy(*dims).agg(F.min("id").alias("id"), F.count("*").alias("weight")))


def near_pairs(points: DataFrame, eps: float, dims: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """id, other of all ordered pairs of points (id, dims) at most ``eps`` apart, each point with itself too.

    Metrics: euclidean, manhattan, cosine (a null vector is near nothing but itself).  The
    join is on cells of side eps, in the first dimensions up to GRID_DIMS: none of the
    metrics lets a pair differ by more in one coordinate.  Cosine distance is that of unit
    vectors, where it is half the squared euclidean one.
    """
    if metric not in ("euclidean", "manhattan", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    side, at = eps, [F.col(d) for d in dims]
    if metric == "cosine":
        norm = F.sqrt(sum((F.col(d) * F.col(d) for d in dims), F.lit(0.0)))
        at, side = [F.col(d) / F.nullif(norm, F.lit(0.0)) for d in dims], (2 * eps) ** 0.5
        side += 1e-9  # rounding of unit vectors
    base = points.select("id", *[a.alias(f"_x{i}") for i, a in enumerate(at)])
    cells = [f"_c{i}" for i in range(min(len(dims), GRID_DIMS))]
    base = base.select("*", *[F.floor(F.col(f"_x{i}") / side).alias(c) for i, c in enumerate(cells)])
    moved = base
    for c in cells:
        moved = moved.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    other = base.select(F.col("id").alias("other"), *[F.col(f"_x{i}").alias(f"_y{i}") for i in range(len(dims))], *cells)
    gaps = [F.col(f"_x{i}") - F.col(f"_y{i}") for i in range(len(dims))]
    if metric == "euclidean":
        near = sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps
    elif metric == "manhattan":
        near = sum((F.abs(g) for g in gaps), F.lit(0.0)) <= eps
    else:
        near = 1 - sum((F.col(f"_x{i}") * F.col(f"_y{i}") for i in range(len(dims))), F.lit(0.0)) <= eps + 1e-12
    pairs = moved.join(other, cells).where(near & (F.col("id") != F.col("other"))).select("id", "other")
    return pairs.unionByName(points.select("id", F.col("id").alias("other")))


def smallest_labels(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of the nodes of links (id, other), by large and small stars.

    Rounds grow with the logarithm of a component's size, not with its diameter; a hub's
    links are halved each round by the ids that they point to.
    """
    edges = fixed(links.where("id <> other").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct())
    digest = [F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))]
    before = None
    while (now := tuple(edges.agg(*digest).first())) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = fixed(joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    nodes = links.select("id").unionByName(links.select(F.col("other").alias("id"))).distinct()
    return nodes.join(edges.select(F.col("a").alias("id"), F.col("b").alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def dbscan(points: DataFrame, eps: float, min_points: int, dims: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """id, cluster of points: a cluster is named by its smallest core id; noise has null.

    A core point has at least ``min_points`` points within ``eps``, itself included; a point
    within ``eps`` of cores of several clusters goes to the one with the smallest name.
    """
    whole, vectors = _weighted(points, dims)
    near = fixed(near_pairs(vectors, eps, dims, metric))
    core = near.join(vectors.select(F.col("id").alias("other"), "weight"), "other").groupBy("id").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_points).select("id")
    links = near.join(core, "id").join(core.select(F.col("id").alias("other")), "other")
    labels = smallest_labels(links)
    edge = near.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("cluster"))
    named = whole.join(vectors.drop("weight").withColumnRenamed("id", "_v"), list(dims)).join(edge.withColumnRenamed("id", "_v"), "_v").select("id", "cluster")
    return points.select("id").join(named, "id", "left")


def cluster_scores(points: DataFrame, dims: Sequence[str]) -> DataFrame:
    """cluster, n, rmsstd of clustered points (cluster, dims): the root of the summed standard deviations by dimensions less one (null for one dimension)."""
    spread = sum((F.stddev_pop(d) for d in dims), F.lit(0.0)) / F.nullif(F.lit(float(len(dims) - 1)), F.lit(0.0))
    return points.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"), F.sqrt(spread).alias("rmsstd"))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norms = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    return 1 - (x @ y.T) / np.where(norms > 0, norms, 1)


#: Distances of the rows of one matrix to those of another.
DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "euclidean": lambda x, y: np.sqrt(_by_row(x, y, lambda d: (d * d).sum(1))),
    "sqeuclidean": lambda x, y: _by_row(x, y, lambda d: (d * d).sum(1)),
    "manhattan": lambda x, y: _by_row(x, y, lambda d: np.abs(d).sum(1)),
    "chebyshev": lambda x, y: _by_row(x, y, lambda d: np.abs(d).max(1)),
    "hamming": lambda x, y: _by_row(x, y, lambda d: (d != 0).mean(1)),
    "cosine": _cosine,
    "correlation": lambda x, y: _cosine(x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)),
}
DISTANCES["cityblock"] = DISTANCES["manhattan"]


def _by_row(x: np.ndarray, y: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([of(y - row) for row in x]) if len(x) else np.zeros((0, len(y)))


def _parts(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, ...]]:
    """id, cluster, weight and vectors of each block in a list of structs."""
    at, x = lists.offsets.to_pylist(), lists.values
    ids, of, weights = (x.field(c).to_numpy(zero_copy_only=False) for c in ("id", "cluster", "weight"))
    v = x.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    for i, j in pairwise(at):
        yield ids[i:j], of[i:j], weights[i:j], v[i:j]


def _pair_sums(metric: str):
    """id, cluster, other, total, n: distances of the left block's points to each cluster in the right block, by the right points' weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (ids, own, _, x), (_, right, weights, y) in zip(_parts(batch.column("left")), _parts(batch.column("right")), strict=True):
                names, of = np.unique(right, return_inverse=True)
                by_cluster = np.eye(len(names))[of] * weights[:, None]
                sums, sizes, k = DISTANCES[metric](x, y) @ by_cluster, by_cluster.sum(0).astype(np.int64), len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k), pa.int64()), pa.array(np.repeat(own, k), pa.int64()), pa.array(np.tile(names, len(ids)), pa.int64()), pa.array(sums.ravel()), pa.array(np.tile(sizes, len(ids)), pa.int64())],
                    ["id", "cluster", "other", "total", "n"],
                )

    return run


def silhouettes(points: DataFrame, dims: Sequence[str], metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """id, cluster, silhouette of clustered points (id and cluster long, dims): (b - a) / max(a, b), 0 for a point alone in its cluster, null where there is one cluster only.

    a is the mean distance to the others of the point's cluster, b the least mean distance
    to another one.  Copies of a vector in a cluster are one weighted point.  Distances are
    summed in pairs of blocks of points in order of clusters; the product of the blocks is
    taken partition by partition, with no copy of either side in a shuffle or a broadcast.
    What leaves a task is a row for a point and a cluster of the block met, not one for a
    pair; the work in tasks is a distance for each pair of distinct points, as the score needs.
    """
    rows = points.where("cluster is not null").select("cluster", "id", F.array(*[F.col(d).cast("double") for d in dims]).alias("v"))
    vectors = indexed(rows.groupBy("cluster", "v").agg(F.count("*").alias("weight")), ["cluster", "v"]).withColumnRenamed("_i", "id")
    vectors = fixed(vectors.select("id", "cluster", "weight", "v"))
    held = vectors.groupBy(F.floor(F.col("id") / block).alias("_b")).agg(F.collect_list(F.struct("id", "cluster", "weight", "v")).alias("left"))
    n_blocks = vectors.agg(F.max("id")).first()[0]
    n_blocks = 0 if n_blocks is None else n_blocks // block + 1
    held = fixed(held.repartition(min(max(n_blocks, 1), max(SIDE_PARTS, n_blocks // SIDE_BLOCKS)), "_b"))
    met = held.select("left").hint("shuffle_replicate_nl").crossJoin(held.select(F.col("left").alias("right")))
    sums = fixed(met.mapInArrow(_pair_sums(metric), "id long, cluster long, other long, total double, n long").groupBy("id", "cluster", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n")), BATCH_BLOCKS)
    own = F.col("cluster") == F.col("other")
    both = sums.groupBy("id").agg(F.max(F.when(own, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    score = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("a").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    named = vectors.join(both.select("id", score.alias("silhouette")), "id").select("cluster", "v", "silhouette")
    return rows.join(named, ["cluster", "v"]).select("id", "cluster", "silhouette")


def cluster_events(points: DataFrame, eps: float, min_points: int, dims: Sequence[str], metric: str = "euclidean") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with their cluster; scores by cluster; clustered and all events and their mean silhouette, one row)."""
    named = fixed(points.join(dbscan(points, eps, min_points, dims, metric), "id"))
    mean = silhouettes(named, dims).agg(F.avg("silhouette").alias("silhouette"))
    counts = named.agg(F.count("cluster").alias("clustered"), F.count("*").alias("events"))
    return named, cluster_scores(named, dims), counts.withColumn("_k", F.lit(1)).join(mean.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


def merges(x: np.ndarray, method: str = "weighted", metric: str = "cityblock") -> list[tuple[int, int, float, int]]:
    """Agglomeration of the rows of a matrix: (left, right, distance, size) of each merge; row i is i, merge s makes len(x) + s.

    Methods: single, complete, average, weighted, and on euclidean distances ward, centroid
    and median.  Of equal distances the pair with the smallest numbers of clusters merges.
    """
    n = len(x)
    square = method in ("ward", "centroid", "median")
    if square and metric != "euclidean":
        raise ValueError(f"{method} needs euclidean distances")
    d = DISTANCES["sqeuclidean" if square else metric](x, x).astype(float)
    # places are kept in order of cluster numbers, so the first least entry is that of the smallest pair
    d[np.tril_indices(n)] = np.inf
    full = np.minimum(d, d.T)
    names, sizes, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        m = len(names)
        upper = np.where(np.triu(np.ones((m, m), bool), 1), full, np.inf)
        i, j = divmod(int(np.argmin(upper)), m)
        gap, a, b = full[i, j], sizes[i], sizes[j]
        di, dj = full[i], full[j]
        if method == "single":
            new = np.minimum(di, dj)
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "average":
            new = (a * di + b * dj) / (a + b)
        elif method == "weighted":
            new = (di + dj) / 2
        elif method == "ward":
            k = np.array(sizes)
            new = ((a + k) * di + (b + k) * dj - k * gap) / (a + b + k)
        elif method == "centroid":
            new = (a * di + b * dj) / (a + b) - a * b * gap / (a + b) ** 2
        elif method == "median":
            new = (di + dj) / 2 - gap / 4
        else:
            raise ValueError(f"unknown method {method}")
        out.append((names[i], names[j], float(np.sqrt(max(gap, 0)) if square else gap), a + b))
        keep = [k for k in range(m) if k not in (i, j)]
        full = np.block([[full[np.ix_(keep, keep)], new[keep][:, None]], [new[keep][None, :], np.full((1, 1), np.inf)]])
        names, sizes = [names[k] for k in keep] + [n + step], [sizes[k] for k in keep] + [a + b]
    return out


def leaf_order(n: int, steps: Sequence[tuple[int, int, float, int]]) -> list[int]:
    """Rows from top to bottom of the tree: what merged first on the left comes first."""
    if not steps:
        return list(range(n))
    out, todo = [], [n + len(steps) - 1]
    while todo:
        k = todo.pop()
        if k < n:
            out.append(k)
        else:
            todo += [steps[k - n][1], steps[k - n][0]]
    return out


def _matrix_order(method: str, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["feature"], r["values"]) for b in batches for r in b.to_pylist()), key=lambda r: r[0])
        if rows:
            names = sorted({s["sample"] for _, vs in rows for s in vs})
            at = {s: k for k, s in enumerate(names)}
            x = np.zeros((len(rows), len(names)))  # a missing or null value is 0, the middle of a z-score
            for i, (_, vs) in enumerate(rows):
                for s in vs:
                    x[i, at[s["sample"]]] = s["value"] or 0.0
            steps = merges(x, method, metric)
            place = np.argsort(leaf_order(len(rows), steps))
            into = {c: s for s, (a, b, _, _) in enumerate(steps) for c in (a, b)}
            gap = [steps[into[i]][2] if i in into else None for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array(place, pa.int32()), pa.array([into.get(i) for i in range(len(rows))], pa.int32()), pa.array(gap, pa.float64())], ["feature", "place", "step", "distance"])

    return run


def heatmap_order(rows: DataFrame, method: str = "weighted", metric: str = "cityblock") -> DataFrame:
    """feature, place (from 0, top to bottom), step and distance of its first merge, over rows (feature, sample, value) of at most MOST_ROWS features.

    A heatmap holds no more rows than can be read; for more, take ``most_variable`` first.
    For the order of samples, swap the two columns.
    """
    wide = rows.groupBy(F.col("feature").cast("string").alias("feature")).agg(F.collect_list(F.struct(F.col("sample").cast("string").alias("sample"), F.col("value").cast("double").alias("value"))).alias("values"))
    if (n := wide.count()) > MOST_ROWS:
        raise ValueError(f"{n} features: a heatmap is ordered up to {MOST_ROWS}")
    return wide.repartition(1).mapInArrow(_matrix_order(method, metric), "feature string, place int, step int, distance double")

