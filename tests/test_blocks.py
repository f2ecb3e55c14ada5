"""Blocks of the topics' factorisation pass between JVM and Python as Arrow."""

import numpy as np
import pyarrow as pa

from reviewscope.operators import topics

K, TERMS = 2, 5


def packed(rng, games):
    """One batch of lists, a block of three reviews per game."""
    rows = []
    for n, game in enumerate(games):
        idx = [sorted(rng.choice(TERMS, 2, replace=False).tolist()) for _ in range(3)]
        rows.append((game, n, [3 * n, 3 * n + 1, None], [2, 2, 2], sum(idx, []), rng.random(6).tolist(), rng.random(3 * K).tolist()))
    kinds = [pa.string(), pa.int64(), *map(pa.list_, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
    return rows, next(topics._pack(iter([pa.RecordBatch.from_arrays(columns, names=[*topics.BLOCK, "w"])])))


def test_step_on_arrow_blocks():
    rng = np.random.default_rng(3)
    rows, batch = packed(rng, ["g", "h", "g", "still"])
    models = {"g": rng.random((K, TERMS)), "h": rng.random((K, TERMS))}
    h = pa.array([models[r[0]].ravel() if r[0] in models else None for r in rows], pa.list_(pa.float64()))
    *out, last = topics._step(K)(iter([batch.append_column("h", h).slice(n, 1) for n in range(len(rows))]))
    got = pa.Table.from_batches(out)
    assert got.select(topics.BLOCK).equals(pa.Table.from_batches([batch.select(topics.BLOCK)]).combine_chunks())
    want = {}
    for row, w in zip(rows, got.column("w").to_pylist()):
        if row[0] in models:
            first = np.array(row[6]).reshape(-1, K)
            new, stats = topics._update_block(first, models[row[0]], np.array(row[3]), np.array(row[4]), np.array(row[5]))
            assert np.allclose(np.frombuffer(w).reshape(-1, K), new)
            want[row[0]] = want.get(row[0], 0) + stats
        else:
            assert np.allclose(np.frombuffer(w), row[6])
    sums = {r["game_id"]: r["stats"] for r in last.to_pylist()}
    assert sums.keys() == want.keys() and all(np.allclose(sums[g], want[g]) for g in want)


def test_tasks_hold_a_bounded_number_of_reviews(spark, monkeypatch):
    """More reviews make more tasks, not larger ones."""
    rows = [("g", i, f"red green{i % 3} blue{i % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, "game_id string, review_id long, review string").repartition(2)
    seen = []
    blocks = topics._blocks
    monkeypatch.setattr(topics, "_blocks", lambda *args: seen.append(args[-1]) or blocks(*args))
    monkeypatch.setattr(topics, "ROWS_PER_TASK", 10)
    topics.nmf_topics(df, 2, max_iter=1, block_rows=50)
    assert seen == [20]
