"""Runs published as a whole: a failure changes nothing, games are replaced one by one, gates and preparation."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reviewscope.config import EMOTIONS, QualityGates
from reviewscope.operators import ensemble
from reviewscope.plans import jobs
from reviewscope.session import scratch_path
from reviewscope.sources import publish


def table(spark, rows):
    return spark.createDataFrame(rows, "game_id string, v int")


def read(spark, path, name, **how):
    return sorted(map(tuple, publish.published(spark, path, name, **how).collect()), key=repr)


def test_versions_of_games(spark):
    path = scratch_path(spark, "publish")
    with pytest.raises(ValueError, match="no table"):
        publish.published(spark, path, "a")
    publish.publish_run({"a": table(spark, [("1", 1), ("2", 2), (None, 3)]), "b": table(spark, [("1", 4)])}, path, "r1")
    assert read(spark, path, "a") == [("1", 1), ("2", 2), (None, 3)] and read(spark, path, "b") == [("1", 4)]
    # Game 1 anew; it has no rows in b any more, and game 3 is new.
    publish.publish_run({"a": table(spark, [("1", 10), ("3", 30)]), "b": table(spark, [])}, path, "r2", whole=False)
    assert read(spark, path, "a") == [("1", 10), ("2", 2), ("3", 30), (None, 3)] and read(spark, path, "b") == []
    publish.publish_run({"a": table(spark, [(None, 5)]), "b": table(spark, [])}, path, "r3", whole=False)
    assert read(spark, path, "a") == [("1", 10), ("2", 2), ("3", 30), (None, 5)]
    # A whole run replaces everything, earlier runs can still be read.
    publish.publish_run({"a": table(spark, [("2", 7)]), "b": table(spark, [("2", 8)])}, path, "r4")
    assert read(spark, path, "a") == [("2", 7)] and read(spark, path, "a", run="r1") == [("1", 1), ("2", 2), (None, 3)]


def test_a_failed_table_leaves_the_former_run(spark):
    path = scratch_path(spark, "publish")
    good = table(spark, [("1", 1)])
    publish.publish_run({"a": good, "b": good, "c": good}, path, "r1")
    bad = good.withColumn("v", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        publish.publish_run({"a": table(spark, [("1", 2)]), "b": good, "c": bad}, path, "r2")
    assert all(read(spark, path, name) == [("1", 1)] for name in "abc")
    assert [r["run"] for r in publish.published_runs(spark, path).collect()] == ["r1"]
    # The same run again, to its end.
    publish.publish_run({name: table(spark, [("1", 2)]) for name in "abc"}, path, "r2")
    assert all(read(spark, path, name) == [("1", 2)] for name in "abc")


def rows(spark, sizes):
    made = [
        (f"{g}-{i}", g, f"a{i}", "2024-01-01 10:00:00", 100.0, 5.0, 1.0, 1.0, 0.0, 0.5, 0.0, True, "the story is good and it's fun to play", "en" if i % 4 else "de")
        for g, n in sizes.items()
        for i in range(n)
    ]
    names = "review_id string, game_id string, author_id string, timestamp_created string, playtime_forever double, num_games_owned double, num_reviews double, "
    names += "votes_up double, votes_funny double, weighted_vote_score double, comment_count double, steam_purchase boolean, review string, lang string"
    return spark.createDataFrame(made, names)


def test_pipeline_prepares_gates_and_publishes(spark):
    path = scratch_path(spark, "publish")
    config = jobs.RunConfig(use_knn=False, prepare=True, gates=QualityGates(refuse_below=30), publish=path, run="only")
    run = jobs.run_review_pipeline(rows(spark, {"big": 80, "small": 20}), config)
    count = lambda name: {r[0]: r[1] for r in publish.published(spark, path, name).groupBy("game_id").count().collect()}
    # Three quarters are in English; the small game is refused but its raw rows are kept.
    assert count("raw") == {"big": 80, "small": 20} and count("cleaned") == {"big": 60}
    assert sum(count(name).get("big", 0) for name in ("credible", "fake")) == 60
    assert publish.published(spark, path, "cleaned").first()["review"] == "the story is good and its fun to play"
    verdicts = {(r["game_id"], r["gate"]): r["status"] for r in run.gates.collect()}
    assert verdicts["small", "volume"] == "refuse" and verdicts["big", "volume"] != "refuse"
    assert run.fake_summary is not None


def test_resume_makes_only_what_is_missing(spark):
    asked = {"aspects": 0, "emotions": 0}

    def scorer(text):
        asked["aspects"] += 1
        return F.struct(F.lit("POSITIVE").alias("label"), F.lit(0.9).alias("confidence"))

    def emotions(df):
        asked["emotions"] += 1
        if asked["emotions"] == 1:
            raise RuntimeError("no model yet")
        one = F.array(*(F.lit(x) for x in (0.5, 0.1, 0.1, 0.1, 0.1, 0.1)))
        return ensemble.from_probabilities(df, {"a": one, "b": one}, EMOTIONS)

    config = jobs.RunConfig(
        use_knn=False, run_nmf=False, keywords={"content": ["story"]}, scorer=scorer, emotion_models=emotions, output=scratch_path(spark, "resume"), resume=True
    )
    df = rows(spark, {"g": 40})
    first = jobs.run_full_analysis(df, config)
    status = first.results.first()["parts"]
    assert status["aspects"] == "complete" and status["emotions"].startswith("failed: RuntimeError") and first.summary is None
    second = jobs.run_full_analysis(df.repartition(7), config)
    status = second.results.first()["parts"]
    assert (status["aspects"], status["emotions"], status["summary"]) == ("reused", "complete", "complete") and asked == {"aspects": 1, "emotions": 2}
    assert second.aspects.collect() == first.aspects.collect() and second.predictions.count() == 40
    assert second.summary.first()["top_aspects"] == "content"
    third = jobs.run_full_analysis(df, config)
    assert set(third.results.first()["parts"].values()) == {"reused", "not asked for"} and asked == {"aspects": 1, "emotions": 2}
    # Other settings, another version of a model, or other rows are other parts.
    jobs.run_full_analysis(df, replace(config, versions={"scorer": "2"}))
    assert asked == {"aspects": 2, "emotions": 3}
    jobs.run_full_analysis(rows(spark, {"g": 41}), config)
    assert asked == {"aspects": 3, "emotions": 4}
