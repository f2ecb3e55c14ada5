"""Centroid clustering against plain Python on whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from reviewscope.llm import centroids


def brute(rows, clusters, rounds, dimensions, scale, seed):
    kept = [(k, [math.floor(scale * x) for x in v]) for k, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda k: hashlib.sha256(f"{seed}:{'null' if k is None else k}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for i in range(len(centers)):
            own = [v for (_, v), c in zip(kept, of) if c == i]
            if own:
                centers[i] = [sum(x) // len(own) for x in zip(*own)]
    last = [(k, *near(v)) for k, v in kept]
    out = []
    for k, d, c in last:
        own = [x for _, x, o in last if o == c]
        out.append((k, c, d, sum(own), sum(x for _, x, _ in last), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest(), len(own)))
    return sorted(out, key=repr)


def made(n, dimensions, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-2, 0, 3]) + rng.gauss(0, 0.2) for _ in range(dimensions)]) for i in range(n)]
    some = rows[0][1]
    rows += [(900, None), (901, []), (902, some[:-1]), (903, [None, *some[1:]]), (904, [math.nan, *some[1:]]), (905, [math.inf, *some[1:]])]
    return rows + [(None, some), (None, [-0.0] * dimensions), (3, some), (3, some), (3, rows[1][1]), (906, [-0.001] * dimensions)]


@pytest.mark.parametrize(("n", "clusters", "parts"), [(150, 7, 4), (5, 40, 2), (60, 1, 3)])
def test_made(spark, monkeypatch, n, clusters, parts):
    monkeypatch.setattr(centroids, "ROWS", 17)
    rows = made(n, 6)
    schema = "vec_id long, embedding array<double>, cluster string, vector string, key string, distance string"
    df = spark.createDataFrame([(*r, "c", "v", "k", "d") for r in rows], schema).repartition(parts)
    got = centroids.cluster(df, clusters=clusters, dimensions=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, clusters, centroids.ROUNDS, 6, centroids.SCALE, centroids.SEED)


def test_tables_give_the_distances():
    rng = np.random.default_rng(2)
    vectors, centers = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (9, 64))
    assert (centroids.distances(vectors, centers) == np.square(vectors[:, None, :] - centers[None, :, :]).sum(axis=2)).all()


def test_empty_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], schema), dimensions=2).count()
