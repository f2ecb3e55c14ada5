"""Vector near-dedup against all pairs."""

import math

import numpy as np
import pytest

from reviewscope.llm import vectors
from reviewscope.llm.queries import op2_near_vectors


def brute(rows, limit=0.95):
    fine = [
        v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows
    ]
    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if ok else None for (_, v), ok in zip(rows, fine)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, links[i], least.get(root(i)) if fine[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def answer(df):
    rows = df.collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=repr)


@pytest.mark.parametrize("cell,block,guests", [(2048, 8192, 32768), (20, 7, 16)])
def test_made(spark, cell, block, guests):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = [c + rng.normal(size=8) * s for c in centres for s in (0.02, 0.1, 0.2, 0.3) for _ in range(5)]
    walk = [rng.normal(size=8)]
    for _ in range(25):
        walk.append(walk[-1] + rng.normal(size=8) * 0.15)
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate([*x, *walk])]
    rows += [(900 + i, rows[3][1]) for i in range(30)] + [(950, [2 * v for v in rows[3][1]])]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [math.nan] * 8), (1004, [math.inf] + [1.0] * 7), (1005, [None] + [1.0] * 7)]
    rows += [(1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, node string").repartition(3)
    got = answer(vectors.classes(df, cell=cell, block=block, guests=guests))
    assert got == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert answer(op2_near_vectors(spark, sf)) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vectors.classes(df).count() == 0
