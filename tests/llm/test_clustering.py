import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelshift.llm import clustering


def brute(rows, k, rounds, dimension):
    """Full scans in plain Python over (id, components)."""
    kept = []
    for i, v in rows:
        if v is None or len(v) != dimension or any(x is None or not math.isfinite(x) for x in v):
            continue
        if max(map(abs, v)) * 64 <= clustering.LARGEST:
            kept.append((i, [math.floor(64 * x) for x in v]))
    named = [(hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~", v) for i, v in kept]
    centroids = [v for _, v in sorted(named)[:k]]
    for r in range(rounds + 1):
        found = [
            min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
            for _, v in kept
        ]
        if r < rounds:
            for n in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == n]
                if own:
                    centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted([(i, c, d) for (i, _), (d, c) in zip(kept, found, strict=True)], key=repr), centroids


def frame(spark, rows):
    table = [(i, None if v is None else list(map(lambda x: None if x is None else float(x), v)), 1) for i, v in rows]
    return spark.createDataFrame(table, "vec_id long, embedding array<double>, cluster int").repartition(3)


def compare(spark, rows, k, rounds, dimension):
    found = clustering.cluster_vectors(frame(spark, rows), k, rounds, dimension)
    want, centroids = brute(rows, k, rounds, dimension)
    got = sorted([(r.id, r.cluster, r.distance) for r in found.vectors.collect()], key=repr)
    assert (got, found.centroids) == (want, centroids)
    return found


def test_clusters_equal_full_scans(spark):
    random = np.random.default_rng(5)
    centers = random.normal(0, 1, (6, 8))
    points = centers[random.integers(0, 6, 400)] + random.normal(0, 0.05, (400, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    found = compare(spark, rows, 6, 4, 8)
    assert found.vectors.where("scanned").count() < 200  # the bounds spare most vectors of the last round
    with_sums = clustering.with_inertia(found).collect()
    assert all(r.inertia == sum(x.distance for x in with_sums) for r in with_sums)


def test_odd_vectors_ties_and_repeats(spark):
    rows = [
        (1, [0, 0]), (2, [0, 0]), (2, [0, 0]), (None, [1, 1]), (None, [1, 1]), (3, [1e9, 0]), (4, [2, -2]),
        (5, [float("nan"), 0]), (6, [float("inf"), 0]), (7, [None, 0]), (8, [1]), (9, None), (10, []),
        (11, [-0.001, 0.999]), (12, [1, -1]), (13, [1e300, 1]),
    ] + [(100, [5, 5])] * 30
    for k in (1, 3, 20):
        compare(spark, rows, k, 3, 2)


def test_no_vectors(spark):
    assert clustering.cluster_vectors(frame(spark, [(1, [1.0])]), 4, 2, 2) is None


def test_a_sphere_costs_at_most_what_its_points_lose():
    random = np.random.default_rng(8)
    spared = 0
    for _ in range(300):
        center, before, after = random.normal(0, 3, (3, 4))
        radius = random.uniform(0, 4)
        points = random.normal(0, 1, (500, 4))
        points = center + radius * points / np.linalg.norm(points, axis=1)[:, None] * random.uniform(0.5, 1, (500, 1))
        lost = np.linalg.norm(points - before, axis=1) - np.linalg.norm(points - after, axis=1)
        (bound,) = clustering.least_angles(center, radius, before[None], after[None])
        drift = np.linalg.norm(after - before)
        assert max(0, lost.max()) <= bound + 1e-9 <= drift + 2e-9
        spared += bound < 0.9 * drift
    assert spared > 100


def test_query_columns(spark):
    assert "list_sum" in clustering._oracle()
    facts = clustering.with_inertia(clustering.cluster_vectors(frame(spark, [(1, [1, 2]), (2, [3, 4])]), 1, 1, 2))
    row = facts.where(F.col("id") == 1).first()
    assert row.centroid_sha256 == hashlib.sha256(b"128,192").hexdigest()
