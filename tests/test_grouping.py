import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewscope.operators import grouping

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p98": 0.98, "p100": 1.0}


def sample():
    rng = np.random.default_rng(7)
    groups = {
        "hot": np.concatenate([rng.exponential(5, 3000), np.full(900, 2.0), [1e12, -1e9]]),
        "pair": np.array([1.0, 4.0]),
        "one": np.array([3.5]),
        "flat": np.full(50, 7.0),
        "wide": np.concatenate([10.0 ** rng.uniform(-5, 5, 2000), -(10.0 ** rng.uniform(-5, 5, 500)), np.zeros(40)]),
        "close": 1 + rng.uniform(0, 1e-9, 500),
    }
    return groups


def jobs(spark, build):
    """Jobs that start while a plan is built."""
    context, name = spark.sparkContext, f"plan-{id(build)}"
    context.setJobGroup(name, name)
    build()
    started = context.statusTracker().getJobIdsForGroup(name)
    context.setLocalProperty("spark.jobGroup.id", None)
    return len(started)


def test_quantiles_start_no_job_while_planned(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    assert jobs(spark, lambda: grouping.exact_quantiles(df, ["g"], "v", PROBS)) == 0


def test_no_slice_of_a_heavy_tail_is_large(spark):
    rng = np.random.default_rng(1)
    values = 10.0 ** rng.uniform(-5, 5, 20000)
    cell, fine = grouping._order_cells(F.col("v"))
    sizes = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", cell.alias("cell"), fine.alias("fine"))
    assert sizes.groupBy("cell").count().agg(F.max("count")).first()[0] < 20
    ordered = sizes.orderBy("v").collect()
    assert [r[1:] for r in ordered] == sorted(r[1:] for r in ordered)


def test_exact_quantiles(spark):
    groups = sample()
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = grouping.exact_quantiles(df.repartition(7), ["g"], "v", PROBS).collect()
    assert len(got) == len(groups)
    for row in got:
        for name, p in PROBS.items():
            assert row[name] == pytest.approx(np.percentile(groups[row["g"]], p * 100), rel=1e-12)


def test_first_n_beyond_group_limit(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), F.col("id"))
    got = grouping.first_n(df, ["g"], [F.desc("id")], 1500)
    assert sorted(r["id"] for r in got.collect()) == list(range(3500, 5000))
    assert {r["rank"] for r in got.collect()} == set(range(1, 1501))


def test_first_n_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id"))
    plan = grouping.first_n(df, ["g"], [F.col("id")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_histogram_single_value_and_closed_end(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3 + [("b", float(i)) for i in range(11)], "g string, v double")
    got = {(r["g"], r["bin"]): r["n"] for r in grouping.histogram(df, ["g"], "v", 10).collect()}
    assert len(got) == 20 and got["a", 5] == 3
    assert [got["b", i] for i in range(10)] == np.histogram(range(11), 10)[0].tolist()


def test_join_beyond_the_broadcast_limit_gives_the_same_rows(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 10).alias("g"), F.col("id"))
    small = df.groupBy("g").agg(F.max("id").alias("top"))
    hinted = grouping.join_small(df, small, ["g"])
    monkeypatch.setattr(grouping, "BROADCAST_ROWS", 3)
    plain = grouping.join_small(df, small, ["g"])
    assert sorted(map(tuple, hinted.collect())) == sorted(map(tuple, plain.collect()))


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("a", 1.0), ("a", 9.0)], "g string, v double")
    assert grouping.group_mode(df, ["g"], "v", "m").first()["m"] == 1.0
