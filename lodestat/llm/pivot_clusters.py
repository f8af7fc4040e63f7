"""Centroid clustering of integer vectors with a table of distances to fixed pivots.

Each vector's squared distances to a few pivots are computed once and stored beside it. In every round the pivots' distances to
the centroids give lower bounds by the triangle inequality, |d(x, p) - d(c, p)| <= d(x, c); centroids are visited by rising bound
and dropped from the first one on whose bound exceeds the best exact distance so far. Distances are exact integers, and bounds
are lowered by more than floating point can err, so results equal a full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.session import saved

LARGEST = 1 << 27  # components beyond could overflow a long when squared differences are added


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """`vec_id, v`: vectors of exactly `dims` finite components as floor(scale * component); other rows are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(
        (F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    too_large = F.raise_error(F.lit(f"a scaled component is beyond {LARGEST}")).cast("long")
    return rows.select("vec_id", F.transform("x", lambda c: F.when(F.abs(c * scale) <= LARGEST, F.floor(c * scale)).otherwise(too_large)).alias("v"))


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to `point`, a vector or one for each row."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def spread_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """At most `count` of the points, each the one farthest in sum from those chosen before; repeats are not chosen."""
    chosen, total = [0], squared(points, points[0])
    while len(chosen) < min(count, len(points)):
        total[chosen] = -1
        far = int(total.argmax())
        if total[far] <= 0:
            break
        chosen.append(far)
        total = total + squared(points, points[far])
    return points[chosen]


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the nearest centroid (ties: the smaller number), its squared distance, and how many were computed."""
    n, k = len(rows), len(centroids)
    roots = np.sqrt(to_pivots.astype(np.float64))
    apart = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))
    bound = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(roots[:, p, None] - apart[None, :, p]), out=bound)
    slack = 1e-9 + 1e-12 * (roots.max(initial=0) + apart.max(initial=0))
    bound = np.square(np.maximum(bound - slack, 0)) * (1 - 1e-12)
    order = np.argsort(bound, axis=1, kind="stable")
    best, cluster, computed = np.full(n, np.iinfo(np.int64).max), np.full(n, k), np.zeros(n, np.int64)
    live = np.arange(n)
    for rank in range(k):
        which = order[live, rank]
        open_ = bound[live, which] <= best[live]
        live, which = live[open_], which[open_]
        if not len(live):
            break
        found = squared(rows[live], centroids[which])
        computed[live] += 1
        better = (found < best[live]) | ((found == best[live]) & (which < cluster[live]))
        best[live[better]], cluster[live[better]] = found[better], which[better]
    return cluster, best, computed


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _literal_at(values: Sequence, kind: str, number: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(number) + 1)


def pivot_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3,
                   pivots: int = 8, seed: int = 1) -> DataFrame:
    """One row per vector: `vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared`.

    Vectors of exactly `dims` components, none null or not finite, become integers floor(scale * component); others have no row.
    The k vectors with the smallest sha256 of `seed:vec_id` (null ids last, ties by the vector) are the first centroids; fewer
    vectors give fewer clusters. Each round assigns every vector to its nearest centroid by exact squared distance (ties: the
    smaller number) and moves centroids to the componentwise floor of the mean; empty ones stay. `compared` counts the exact
    distances of the last assignment. Scaled components beyond 2^27 are refused, as distances would not fit a long.

    The table of vectors and pivot distances is written once below the shared folder and read in each round. A round sends at
    most k rows of sums for each batch of rows, added up map-side; only k rows reach the driver. Rows with equal ids are vectors
    of their own, other columns are ignored, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, dims, scale)
    first = rows.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    answer = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared long"
    if not first:
        return spark.createDataFrame([], answer)
    centroids = np.array([r["v"] for r in first], np.int64)
    fixed = spread_pivots(centroids, pivots)
    width = len(fixed)

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch["v"], dims)
            near = np.stack([squared(v, p) for p in fixed], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, width, dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists], ["vec_id", "v", "to_pivots"])

    stored = saved(rows.mapInArrow(table, "vec_id long, v array<long>, to_pivots array<long>"), "pivot_table")

    def assigned(batch: pa.RecordBatch, points: np.ndarray):
        v = matrix(batch["v"], dims)
        return v, nearest(v, matrix(batch["to_pivots"], width), points, fixed)

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], points: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(points), np.int64), np.zeros((len(points), dims), np.int64)
            for batch in batches:
                v, (cluster, _, _) = assigned(batch, points)
                count += np.bincount(cluster, minlength=len(points))
                for c in np.unique(cluster):
                    total[c] += v[cluster == c].sum(axis=0)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": some.astype(np.int32), "n": count[some], "total": list(total[some])})

        parts = stored.mapInArrow(sums, "cluster int, n long, total array<long>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
        centroids = centroids.copy()
        for r in added.collect():  # at most k rows
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]

    def last(batches: Iterator[pa.RecordBatch], points: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, (cluster, distance, computed) = assigned(batch, points)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(computed)], ["vec_id", "cluster", "distance", "compared"])

    ends = saved(stored.mapInArrow(last, "vec_id long, cluster int, distance long, compared long"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in ends.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [",".join(map(str, c)) for c in centroids.tolist()]
    return ends.select(
        "vec_id", "cluster", "distance", _literal_at([inertia.get(c, 0) for c in range(len(centroids))], "long", "cluster").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.sha2(_literal_at(names, "string", "cluster"), 256).alias("centroid_sha256"), "compared")
