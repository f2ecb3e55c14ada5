from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewscope.config import NUMERIC_COLUMNS
from reviewscope.operators import credibility as cred
from reviewscope.operators import grouping, neighbours

START = datetime(2024, 1, 1)
SCHEMA = (
    "review_id long, game_id string, author_id string, timestamp_created timestamp_ntz, "
    + ", ".join(f"{c} double" for c in NUMERIC_COLUMNS)
)
CALM = dict(
    playtime_forever=500.0, num_games_owned=10.0, num_reviews=5.0, votes_up=3.0, votes_funny=3.0,
    weighted_vote_score=0.5, comment_count=1.0,
)


def frame(spark, rows):
    out = []
    for i, r in enumerate(rows):
        row = {"review_id": i, "game_id": "g", "author_id": f"a{i}", "timestamp_created": START + timedelta(days=i), **CALM, **r}
        out.append(tuple(row[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(out, SCHEMA)


EDGES = [
    ("rule1", dict(playtime_forever=9.0, weighted_vote_score=0.96, votes_up=0.0), True),
    ("rule1", dict(playtime_forever=10.0, weighted_vote_score=0.96, votes_up=0.0), False),
    ("rule1", dict(playtime_forever=9.0, weighted_vote_score=0.95, votes_up=0.0), False),
    ("rule1", dict(playtime_forever=9.0, weighted_vote_score=0.96, votes_up=1.0), False),
    ("rule2", dict(num_games_owned=501.0, playtime_forever=29.0), True),
    ("rule2", dict(num_games_owned=500.0, playtime_forever=29.0), False),
    ("rule2", dict(num_games_owned=501.0, playtime_forever=30.0), False),
    ("rule3", dict(num_reviews=51.0, votes_up=0.0), True),
    ("rule3", dict(num_reviews=50.0, votes_up=0.0), False),
    ("rule3", dict(num_reviews=51.0, votes_up=1.0), False),
    ("rule4", dict(weighted_vote_score=0.98, votes_up=0.0, comment_count=0.0, playtime_forever=14.0), True),
    ("rule4", dict(weighted_vote_score=0.97, votes_up=0.0, comment_count=0.0, playtime_forever=14.0), False),
    ("rule4", dict(weighted_vote_score=0.98, votes_up=0.0, comment_count=0.0, playtime_forever=15.0), False),
    ("rule6", dict(comment_count=11.0, votes_funny=101.0, weighted_vote_score=0.09), True),
    ("rule6", dict(comment_count=10.0, votes_funny=101.0, weighted_vote_score=0.09), False),
    ("rule6", dict(comment_count=11.0, votes_funny=100.0, weighted_vote_score=0.09), False),
    ("rule6", dict(comment_count=11.0, votes_funny=101.0, weighted_vote_score=0.1), False),
]


def test_row_rule_edges(spark):
    df = frame(spark, [e[1] for e in EDGES]).withColumns(cred.row_rules())
    got = {r["review_id"]: r for r in df.collect()}
    for i, (rule, _, want) in enumerate(EDGES):
        assert got[i][rule] is want, EDGES[i]


def test_missing_values_lose_no_row(spark):
    odd = [{c: None} for c in NUMERIC_COLUMNS] + [{"author_id": None}, {"timestamp_created": None}, {c: None for c in NUMERIC_COLUMNS}]
    flagged = cred.credibility_rules(frame(spark, [*odd, {}]))
    assert flagged.filter(" or ".join(f"{r} is null" for r in (*cred.RULES, "is_fake"))).count() == 0
    credible, fake = cred.split_reviews(flagged.withColumn("is_fake", F.when(F.col("review_id") != 3, F.col("is_fake"))))
    assert credible.count() + fake.count() == len(odd) + 1


@pytest.mark.parametrize("seconds,hit", [(0, False), (1, True), (299, True), (300, False)])
def test_rapid_fire_gap(spark, seconds, hit):
    rows = [dict(author_id="x", timestamp_created=START), dict(author_id="x", timestamp_created=START + timedelta(seconds=seconds))]
    got = {r["review_id"]: r["rule7"] for r in cred.rapid_fire(frame(spark, rows)).collect()}
    assert got == {0: False, 1: hit}


def literal_rule7(pdf, scope):
    """The rule over sorted rows of one game, on the driver."""
    s = pdf.sort_values(["author_id", "timestamp_created", "review_id"])
    gap = s["timestamp_created"].diff() if scope == "reference" else s.groupby("author_id")["timestamp_created"].diff()
    return {i for i, g in zip(s["review_id"], gap) if pd.notna(g) and pd.Timedelta(0) < g < pd.Timedelta(minutes=5)}


@pytest.mark.parametrize("scope", ["author", "reference"])
@pytest.mark.parametrize("parts", [2, 128])
def test_rapid_fire_hot_author_and_day_ends(spark, scope, parts):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        who = "hot" if i % 3 == 0 else f"a{rng.integers(0, 150):03d}"
        # Around midnight, so that neighbours fall into different days.
        at = START + timedelta(days=int(rng.integers(0, 3)), seconds=int(rng.integers(-400, 400)))
        rows.append(dict(author_id=who, timestamp_created=at))
    df = frame(spark, rows)
    got = {r["review_id"] for r in cred.rapid_fire(df.repartition(5), scope, parts=parts).filter("rule7").collect()}
    assert got == literal_rule7(df.toPandas(), scope)


@pytest.mark.parametrize("n,on", [(1000, False), (1001, True)])
def test_gates_open_above_a_thousand_rows(spark, n, on):
    # One author with all rows in a day: velocity; hardly any reaction: engagement.
    df = spark.range(n).select(
        F.col("id").alias("review_id"),
        F.lit("g").alias("game_id"),
        F.lit("x").alias("author_id"),
        (F.lit(START) + F.make_dt_interval(mins=F.lit(10) * F.col("id"))).cast("timestamp_ntz").alias("timestamp_created"),
        *[F.lit(v).alias(c) for c, v in (CALM | dict(num_reviews=40.0, votes_up=1.0, votes_funny=0.0, comment_count=0.0)).items()],
    )
    row = cred.flag_rates(cred.credibility_rules(df)).first()
    assert (row["rule8"], row["rule9"]) == ((n, n) if on else (0, 0))


def test_split_is_complete_and_layout_does_not_matter(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [dict(num_reviews=float(rng.integers(0, 80)), votes_up=float(rng.integers(0, 3))) for _ in range(300)])
    seen = set()
    for parts in (1, 4, 64):
        flagged = cred.credibility_rules(df.repartition(parts))
        credible, fake = cred.split_reviews(flagged)
        ids = sorted(r["review_id"] for r in credible.unionByName(fake).collect())
        assert ids == list(range(300))
        seen.add(tuple(sorted(r["review_id"] for r in fake.collect())))
    assert len(seen) == 1


def brute_force(pdf, k):
    x = np.stack(pdf["features"])
    label = pdf["is_fake"].to_numpy()
    ids = pdf["review_id"].to_numpy()
    out = {}
    for i in range(len(x)):
        dist = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        near = np.lexsort((ids, dist))[:k]
        out[ids[i]] = label[near].mean() > 0.5
    return out


@pytest.mark.parametrize("one_cell,broadcast", [(20, True), (100_000, True), (20, False)])
def test_neighbours_equal_brute_force(spark, one_cell, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(grouping, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(5)
    n = 1200
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[: n // 3] = [0.5, 0.5, 0.5]  # one vector holds a third of the rows
    x[-1] = [1e6, 0, 0]
    fake = rng.random(n) < 0.4
    rows = [(int(i), "g", [float(v) for v in x[i]], bool(fake[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "review_id long, game_id string, features array<double>, is_fake boolean")
    got = neighbours.knn_relabel(df, one_cell=one_cell)
    want = brute_force(df.toPandas(), 7)
    assert {r["review_id"]: r["knn_fake"] for r in got.collect()} == want


def test_neighbours_leave_small_games_alone(spark):
    df = spark.range(1000).select(F.col("id").alias("review_id"), F.lit("g").alias("game_id"), F.array(F.col("id").cast("double")).alias("features"), (F.col("id") % 2 == 0).alias("is_fake"))
    assert neighbours.knn_relabel(df).filter("knn_fake").count() == 0


def test_features_with_categories(spark):
    df = frame(spark, [dict(), dict(votes_up=9.0)]).withColumn("sentiment_score", F.when(F.col("review_id") == 0, "joy").otherwise("fear"))
    got = {r["review_id"]: r["features"] for r in cred.knn_features(df).collect()}
    assert got[0][-2:] == [0.0, 1.0] and got[1][-2:] == [1.0, 0.0]
    assert got[0][3] == pytest.approx(-1.0) and got[0][0] == 0.0


def test_rapid_fire_without_times_or_authors(spark):
    at = lambda m: f"2024-01-01 10:0{m}:00"
    rows = [(1, "a", at(0)), (2, "a", at(1)), (3, "a", None), (4, "a", None), (5, None, at(2)), (6, None, at(3)), (7, "b", None), (8, "c", at(3))]
    df = spark.createDataFrame(rows, "review_id int, author_id string, t string").selectExpr("'g' as game_id", "*", "cast(t as timestamp_ntz) as timestamp_created")
    hits = lambda scope: sorted(r[0] for r in cred.rapid_fire(df, scope).filter("rule7").select("review_id").collect())
    assert hits("author") == [2]
    # Nobody's rows come first, then a (10:00 and 10:01), then c, two minutes after a's last row.
    assert hits("reference") == [2, 6, 8]


@pytest.mark.parametrize("n", [1, 5, 256, 3000])
def test_search_in_boxes_equals_brute_force(n):
    rng = np.random.default_rng(n)
    places = np.unique(np.round(rng.normal(size=(n, 4)), 1), axis=0)
    asked = np.concatenate([places[:300], rng.normal(size=(100, 4)), [[1e6, 0, 0, 0]]])
    dist = np.round(neighbours._distances(asked, places), neighbours.DIGITS)
    kth = np.sort(dist, axis=1)[:, min(7, len(places)) - 1]
    for limit in (None, kth):
        q, p, near = neighbours._search(asked, places, 7, limit)
        assert len(set(zip(q, p))) == len(q)
        found = {(i, j) for i, j in zip(q, p)}
        assert found >= {(i, j) for i, j in zip(*np.nonzero(dist <= kth[:, None]))}
        assert np.abs(dist[q, p] - near).max() < 1e-8


def test_large_cells_are_sent_to_few_tasks(spark, monkeypatch):
    """A cell's vectors go to as many tasks as its visitors need; before, to one for every TURN vectors of the game."""
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    monkeypatch.setattr(neighbours, "TURN", 100)
    sent = []
    whole = neighbours.grouping.join_small

    def watched(df, small, on, how="inner"):
        found = whole(df, small, on, how)
        if "members" in df.columns and "turns" in small.columns:
            sent.append(found.agg({"turns": "sum"}).first()[0])
        return found

    monkeypatch.setattr(neighbours.grouping, "join_small", watched)
    rng = np.random.default_rng(4)
    rows = [(i, "g", [float(v) for v in rng.normal(size=1)], bool(rng.random() < 0.5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "review_id long, game_id string, features array<double>, is_fake boolean")
    got = {r["review_id"]: r["knn_fake"] for r in neighbours.knn_relabel(df, one_cell=20).collect()}
    assert got == brute_force(df.toPandas(), 7)
    assert sent and sent[0] < 2 * 2000
