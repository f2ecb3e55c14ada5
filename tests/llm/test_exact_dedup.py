"""Exact dedup: classes, odd rows, skew, and texts that share a digest."""

import hashlib

import pytest
from pyspark.sql import functions as F

from reviewscope.llm import exact_dedup

TEXTS = [None, "", "a", "A", "a", "a ", "x" * 200_000, "x" * 200_000, "é", "é", None] + ["hot"] * 60


def frame(spark):
    rows = [(i, t, "n", i % 5) for i, t in enumerate(TEXTS)] + [(None, "a", "n", 0), (4, "a", "n", 4), (None, "alone", "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, _key string, group_size int").repartition(5), rows


def expected(rows):
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(t or "", []).append(k)
    out = []
    for k, t, *_ in rows:
        ids = [i for i in groups[t or ""] if i is not None]
        keep = max(ids) if ids else None
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        out.append((k, keep, len(groups[t or ""]), k is not None and k == keep, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("salts", [1, 7])
def test_classes(spark, salts):
    df, rows = frame(spark)
    assert sorted(map(tuple, exact_dedup.classes(df, salts=salts).collect()), key=repr) == expected(rows)
    assert exact_dedup.classes(df.limit(0)).count() == 0


def test_deduplicate_leaves_one_row_per_text(spark):
    df, rows = frame(spark)
    got = exact_dedup.deduplicate(df)
    assert got.columns == df.columns
    kept = {(r["text"] or ""): r["doc_id"] for r in got.collect()}
    assert got.count() == len(kept) == len({r[1] or "" for r in rows})
    assert kept["a"] == 4 and kept["hot"] == len(TEXTS) - 1 and kept["alone"] is None and kept[""] == 10
    assert got.filter("doc_id = 10").first()["text"] is None


def test_texts_with_one_digest_are_not_merged(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab")], "doc_id long, text string")
    weak = lambda text: F.length(text).cast("string")
    assert {r["doc_id"] for r in exact_dedup.deduplicate(df, digest=weak).collect()} == {2, 3}
    with pytest.raises(Exception, match="share a digest"):
        exact_dedup.classes(df, digest=weak).collect()


def test_the_map_side_combines_and_copies_are_dealt_over_salts(spark):
    df, _ = frame(spark)
    plan = exact_dedup.classes(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") >= 2 and "_salt" in plan and "Python" not in plan and "Arrow" not in plan
