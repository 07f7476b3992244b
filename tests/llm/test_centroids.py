"""Sort-means against trying every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import centroids


def brute(rows, k, rounds, dims, scale, seed):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * float(x)) for x in v]))
    mark = lambda d: hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for nth in range(rounds + 1):
        at = [min((gap(v, c), i) for i, c in enumerate(centers)) for _, v in kept]
        if nth < rounds:
            for i in range(len(centers)):
                mine = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == i]
                if mine:
                    centers[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    whole, per = sum(d for d, _ in at), {i: sum(d for d, c in at if c == i) for i in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), c, d, per[c], whole, sha[c]) for (i, _), (d, c) in zip(kept, at, strict=True))


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (3, 2), (1, 0)])
def test_clusters_match_brute_force(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 0.2501, 2.0]) for _ in range(4)]) for i in range(150)]
    rows += [(7, [0.0] * 4)] * 40 + [(None, [1.0, 2.0, 3.0, 4.0]), (200, None), (201, [1.0] * 3), (202, [None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("-inf"), 0.0, 0.0, 0.0]), (205, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("n", F.lit(1))
    got = centroids.cluster(frame.repartition(5), k, rounds, 4, 16)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == brute(as_float, k, rounds, 4, 16, 3)
    assert centroids.cluster(frame.limit(0), k, rounds, 4).count() == 0
    assert centroids.cluster(frame.where("vec_id >= 200"), k, rounds, 4).count() == 0


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, [5.0, 5.5])]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 8, 3, 2).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute(rows, 8, 3, 2, 1024, 3)


def test_scan_stops_strictly_beyond_twice_the_distance():
    rng = np.random.default_rng(1)
    for width in (1, 2, 6):
        centers = rng.integers(-4, 5, (9, width)) * 2
        x = rng.integers(-10, 11, (3_000, width))
        every = np.stack([centroids.squared(x, c) for c in centers], axis=1)
        for before in (np.zeros(len(x), np.int32), every.argmin(axis=1).astype(np.int32), rng.integers(0, 9, len(x)).astype(np.int32)):
            cluster, distance, tried = centroids.sort_means(x, before, centers)
            assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
            assert tried <= every.size
    spread = np.arange(20)[:, None] * 1_000
    x = np.repeat(spread, 50, axis=0) + rng.integers(-9, 10, (1_000, 1))
    assert centroids.sort_means(x, np.repeat(np.arange(20), 50), spread)[2] == len(x)  # no other centroid is tried


def test_components_out_of_range_are_refused(spark):
    rows = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="components must stay under"):
        centroids.cluster(rows, 2, 1, 2).collect()
