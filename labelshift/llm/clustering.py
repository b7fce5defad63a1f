"""Centroid clustering (Lloyd's rounds) with geometric tightening of drifting bounds.

Vectors become integers ``floor(scale * x)``, so distances, sums and floors are exact and a result
does not depend on the partitioning. Each vector carries its cluster and a lower bound of its
distance to every other centroid. When centroids move, the bound of a vector in cluster ``a`` must
be loosened by what some other centroid can have come closer. The members of ``a`` lie in a sphere
around its old centroid; a centroid that moves from ``p`` to ``q`` and the sphere meet in one
plane, and there the points that come closer by ``t`` or more lie within the asymptotes of a
hyperbola around the move. So no member comes closer than ``|q - p| * cos(angle)``, where the angle
is the smallest between the direction of the move and a ray from its midpoint that meets the
sphere; only a sphere in the way of the move costs the full drift, and one behind it costs nothing.
A vector whose exact distance to its own centroid stays below its bound keeps its cluster; all
others are ambiguous and scanned exactly.

One round reads the vectors of the round before, writes them with their new cluster and bound, and
sums them by cluster in one grouped aggregate. Only a row for each cluster reaches the driver, and
only the centroids go to the tasks.

Cases: a vector that is null, has another number of components, or has a null, NaN or infinite
component is left out; so is one whose integers exceed ``LARGEST`` in size, since its squared
distance need not fit in a long. A null id comes last among candidates for a start. Rows that repeat
an id or a vector are vectors of their own; equal hashes are ordered by the vector. Ties in
distance go to the smaller number. Fewer vectors than ``k`` start as many clusters as there are
vectors. An empty table gives no rows. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .book import query, table
from .storage import stored

SEED = 1
SCALE = 64
LARGEST = 1 << 27
SLACK = 1e-9


class Clustering(NamedTuple):
    vectors: DataFrame  # id, vector (integers), cluster, distance (squared), scanned (by the last round)
    centroids: list[list[int]]


def whole_vectors(
    vectors: DataFrame, dimension: int, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """id and integer components of the vectors that take part."""
    parts = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    chosen = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("raw"), parts.alias("parts")
    )
    fit = F.forall(
        "raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale <= LARGEST)
    )
    return chosen.where((F.size("raw") == dimension) & fit).select(
        "id", F.col("parts").cast("array<int>").alias("vector")
    )


def starts(vectors: DataFrame, k: int, seed: int = SEED) -> list[list[int]]:
    """The vectors with the k smallest hashes of ``seed:id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(digest.alias("digest"), "vector").orderBy(F.asc_nulls_last("digest"), "vector").limit(k)
    return [list(row.vector) for row in first.collect()]


def least_angles(sphere: np.ndarray, radius: float, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How much closer each centroid may have come to a point of the sphere.

    ``before`` and ``after`` have a row for each centroid. The answer is the largest over the
    sphere of ``|x - before| - |x - after|``, or somewhat more.
    """
    move = after - before
    drift = np.sqrt((move * move).sum(axis=1))
    ray = sphere - (before + after) / 2
    reach = np.sqrt((ray * ray).sum(axis=1))
    closer = drift.copy()  # a sphere that holds the midpoint: the full drift
    apart = (reach > radius) & (drift > 0)
    toward = np.clip((ray * move).sum(axis=1)[apart] / (reach[apart] * drift[apart]), -1, 1)
    angle = np.arccos(toward) - np.arcsin(np.clip(radius / reach[apart], 0, 1))
    closer[apart] = drift[apart] * np.cos(np.clip(angle, 0, np.pi / 2))
    return closer


def loosened(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the bounds of its members must come down."""
    k = len(before)
    out = np.zeros(k)
    for own in range(k):
        others = np.arange(k) != own
        if others.any():
            steps = least_angles(before[own], radii[own], before[others], after[others])
            out[own] = max(0.0, steps.max()) * (1 + SLACK) + SLACK
    return out


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact integers, one row for each vector and one column for each centroid."""
    out = np.empty((len(rows), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        gap = rows - centroid
        out[:, c] = np.einsum("ij,ij->i", gap, gap)
    return out


def scan(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance, and the distance to the next one."""
    squares = squared_distances(rows, centroids)
    cluster = squares.argmin(axis=1)  # the first of equal ones
    place = np.arange(len(rows))
    nearest = squares[place, cluster].copy()
    squares[place, cluster] = np.iinfo(np.int64).max
    bound = np.sqrt(squares.min(axis=1).astype(np.float64)) if len(rows) else np.empty(0)
    if len(centroids) == 1:
        bound = np.full(len(rows), np.inf)
    return cluster, nearest, bound


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimension).astype(np.int64)


def _assigned(vectors: DataFrame, centroids: np.ndarray, loosening: np.ndarray | None) -> DataFrame:
    """The vectors with cluster, squared distance and bound for these centroids."""
    kind = vectors.schema["id"].dataType.simpleString()
    dimension = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(1), dimension)
            if loosening is None:
                cluster, nearest, bound = scan(rows, centroids)
                ambiguous = np.ones(len(rows), bool)
            else:
                cluster = batch.column(2).to_numpy().astype(np.int64)
                gap = rows - centroids[cluster]
                nearest = np.einsum("ij,ij->i", gap, gap)
                bound = batch.column(4).to_numpy() - loosening[cluster]
                ambiguous = np.sqrt(nearest) * (1 + SLACK) + SLACK >= bound
                some = np.flatnonzero(ambiguous)
                if len(some):
                    bound = bound.copy()
                    cluster[some], nearest[some], bound[some] = scan(rows[some], centroids)
            arrays = [
                batch.column(0),
                batch.column(1),
                pa.array(cluster.astype(np.int32)),
                pa.array(nearest),
                pa.array(bound),
                pa.array(ambiguous),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "vector", "cluster", "distance", "bound", "scanned"])

    schema = f"id {kind}, vector array<int>, cluster int, distance long, bound double, scanned boolean"
    return stored(vectors.mapInArrow(run, schema))


def _sums(assigned: DataFrame, dimension: int) -> dict[int, tuple[int, float, list[int]]]:
    """Count, radius and component sums of each cluster: one row for each on the driver."""
    rows = (
        assigned.groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("distance").alias("far"),
            *[F.sum(F.col("vector")[i].cast("long")).alias(f"s{i}") for i in range(dimension)],
        )
        .collect()
    )
    return {row.cluster: (row.n, float(row.far) ** 0.5, [row[f"s{i}"] for i in range(dimension)]) for row in rows}


def cluster_vectors(
    vectors: DataFrame,
    k: int,
    rounds: int,
    dimension: int,
    scale: int = SCALE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clustering | None:
    """``rounds`` rounds of assignment and new centroids, then a last assignment; None without vectors."""
    whole = stored(whole_vectors(vectors, dimension, scale, id_col, vector_col))
    first = starts(whole, k, seed)
    if not first:
        return None
    centroids = np.array(first, np.int64)
    assigned = _assigned(whole, centroids, None)
    for _ in range(rounds):
        found = _sums(assigned, dimension)
        radii = np.zeros(len(centroids))
        moved = centroids.copy()
        for cluster, (n, radius, sums) in found.items():
            radii[cluster] = radius * (1 + SLACK)
            moved[cluster] = [total // n for total in sums]
        steps = loosened(centroids.astype(np.float64), moved.astype(np.float64), radii)
        centroids = moved
        assigned = _assigned(assigned, centroids, steps)
    return Clustering(assigned.drop("bound"), centroids.tolist())


def with_inertia(clustering: Clustering) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned of each vector."""
    vectors = clustering.vectors
    by_cluster = {
        row.cluster: row.inertia
        for row in vectors.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    }  # at most a row for each centroid
    total = sum(by_cluster.values())
    facts = vectors.sparkSession.createDataFrame(
        [
            (c, by_cluster.get(c, 0), total, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
            for c, centroid in enumerate(clustering.centroids)
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return vectors.join(F.broadcast(facts), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned"
    )


K, ROUNDS, DIMENSION = 16, 3, 64


def _oracle() -> str:
    """Rounds unrolled; each compares all vectors with all centroids."""
    distance = "list_sum(list_transform(list_zip(p.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [
        f"""whole AS (
        SELECT row_number() OVER () AS r, vec_id,
               list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSION})""",
        f"""c0 AS (
        SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
        FROM (SELECT v, sha256('{SEED}:' || vec_id::VARCHAR) AS h FROM whole ORDER BY h, v LIMIT {K}))""",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS (
        SELECT p.r, min({distance} * {K} + q.c) AS best FROM whole p CROSS JOIN c{n} q GROUP BY p.r)""")
        if n < ROUNDS:
            parts.append(f"""s{n} AS (
        SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
        FROM (SELECT a.best % {K} AS c, unnest(w.v) AS x, unnest(range({DIMENSION})) AS i
              FROM a{n} a JOIN whole w USING (r)) GROUP BY c, i),
    m{n} AS (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{n} GROUP BY c),
    c{n + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN m{n} m USING (c))""")
    return f"""
    WITH {", ".join(parts)}
    SELECT w.vec_id, (a.best % {K})::INTEGER AS cluster, a.best // {K} AS distance,
           (sum(a.best // {K}) OVER (PARTITION BY a.best % {K}))::BIGINT AS cluster_inertia,
           (sum(a.best // {K}) OVER ())::BIGINT AS inertia,
           sha256(array_to_string(q.v, ',')) AS centroid_sha256
    FROM a{ROUNDS} a JOIN whole w USING (r) JOIN c{ROUNDS} q ON q.c = a.best % {K}
    """


@query("op11_drift_clustering", _oracle())
def op11_drift_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector with its cluster after three rounds."""
    found = cluster_vectors(table(spark, sf_dir, "embeddings"), K, ROUNDS, DIMENSION)
    if found is None:
        return spark.createDataFrame(
            [],
            "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string",
        )
    return with_inertia(found).withColumnRenamed("id", "vec_id").drop("scanned")
