"""Whole runs, for any number of games in one job."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.config import CREDIBILITY, GATES, CredibilityThresholds, QualityGates
from reviewscope.operators import (
    aspects,
    cleaning,
    credibility,
    emotions,
    ensemble,
    grouping,
    neighbours,
    summary,
    topics,
)
from reviewscope.operators.sentiment import Scorer
from reviewscope.session import stored
from reviewscope.sources import publish, readers, writers

log = logging.getLogger(__name__)
GAME = "game_id"


@dataclass
class RunConfig:
    scope: str = "author"
    use_knn: bool = True
    thresholds: CredibilityThresholds = CREDIBILITY
    keywords: Mapping[str, Sequence[str]] | None = None  # None: discovered per game
    scorer: Scorer | None = None
    emotion_models: Callable[[DataFrame], DataFrame] | None = None  # adds `models`
    sample_size: int | None = None
    run_nmf: bool = True
    n_topics: int = 10
    output: str | None = None  # folder of this run's tables; None: the shared folder
    prepare: bool = False  # language, encoding and words of the reviews, as a source would store them
    language: str = "en"
    gates: QualityGates | None = None  # games that a volume gate refuses are left out
    publish: str | None = None  # folder of published runs: raw, cleaned, credible and fake, all or none
    run: str = ""  # name of the published run; by default the time
    whole: bool = True  # a published run replaces all games, or only its own
    resume: bool = False  # take up complete parts of an earlier run in `output` with equal input and settings
    versions: dict[str, str] = field(default_factory=dict)  # of scorer and models: functions cannot be compared
    settings: dict[str, str] = field(default_factory=dict)


class ReviewRun(NamedTuple):
    flagged: DataFrame
    credible: DataFrame
    fake: DataFrame
    summary: DataFrame
    state: DataFrame
    gates: DataFrame | None = None
    fake_summary: DataFrame | None = None


class Analysis(NamedTuple):
    review: ReviewRun
    aspects: DataFrame | None
    topics: DataFrame | None
    predictions: DataFrame | None
    results: DataFrame
    summary: DataFrame | None = None


def _stored(df: DataFrame, config: RunConfig, name: str) -> DataFrame:
    """Write once, read many: later steps start from the table, not from the sources."""
    if not config.output:
        return stored(df, name)
    path = f"{config.output.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def select_games(df: DataFrame, games: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of the chosen games, from a list or from a table with game_id."""
    if isinstance(games, DataFrame):
        return grouping.join_small(df, games.select(GAME).distinct(), [GAME], "left_semi")
    return df.filter(F.col(GAME).isin(*games))


def admitted(df: DataFrame, gates: QualityGates) -> DataFrame:
    """Rows of the games with enough reviews; refused games are left out as a whole."""
    volume = df.groupBy(GAME).agg(F.count("*").alias("__n")).filter(F.col("__n") >= gates.refuse_below)
    return grouping.join_small(df, volume.select(GAME), [GAME], "left_semi")


def run_review_pipeline(df: DataFrame, config: RunConfig = RunConfig()) -> ReviewRun:
    """Prepare, let in, clean, flag and split; state has one row per game of the input.

    With `publish` the raw, cleaned, credible and fake tables become current together, once all of them are written.
    """
    raw = df
    if config.prepare:
        df = readers.prepare_reviews(df, lang=config.language)
    if config.gates is not None:
        df = admitted(df, config.gates)
    cleaned = cleaning.clean_reviews(df)
    flagged = credibility.credibility_rules(cleaned, config.scope, config.thresholds)
    flagged = _stored(flagged, config, "flagged")
    if config.use_knn:
        featured = credibility.knn_features(flagged)
        flagged = neighbours.knn_relabel(featured, config.thresholds.neighbours, t=config.thresholds)
        flagged = _stored(flagged.drop("features", "knn_fake"), config, "relabelled")
    if config.publish:
        credible, fake = credibility.split_reviews(flagged)
        tables = {"raw": raw, "cleaned": flagged.select(*cleaned.columns), "credible": credible, "fake": fake}
        publish.publish_run(tables, config.publish, config.run or f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}", config.whole)
    return review_run(flagged, raw, config)


def review_run(flagged: DataFrame, raw: DataFrame, config: RunConfig) -> ReviewRun:
    """The tables of a run from its flagged reviews."""
    counts = raw.groupBy(GAME).agg(F.count("*").alias("raw"))
    credible, fake = credibility.split_reviews(flagged)
    return ReviewRun(
        flagged,
        credible,
        fake,
        summary.data_summary(flagged),
        summary.retention_report(flagged, counts),
        summary.quality_gates(flagged, counts, config.gates or GATES),
        summary.flagged_summary(fake),
    )


class Parts:
    """The parts of an analysis: what became of each, and with `resume` those that need not be made again.

    A part is known by the fingerprint of its input and settings. Its table has a folder named after both and is entered in the list of
    parts when it is complete, so what a failed run has finished is found by the next one.
    """

    LIST = "_parts"

    def __init__(self, spark: SparkSession, config: RunConfig, rows: DataFrame):
        self.spark, self.config, self.status = spark, config, {}
        self.given = fingerprint(rows) if config.resume else ""

    def name(self, part: str, *settings) -> str:
        text = json.dumps([part, self.given, self.config.settings, self.config.versions, *settings], sort_keys=True, default=str)
        return f"{part}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"

    def attempt(self, part: str, step: Callable[[], DataFrame], *settings) -> DataFrame | None:
        """A failed part leaves the rest of the run standing."""
        config, home = self.config, (self.config.output or "").rstrip("/")
        name = self.name(part, *settings) if config.resume and home else part
        try:
            if name != part and (known := self.entered(home, name)):
                self.status[part] = "reused"
                return self.spark.read.schema(T._parse_datatype_json_string(known)).parquet(f"{home}/{name}")
            found = _stored(step(), config, name)
            if name != part:
                entry = self.spark.createDataFrame([(name, found.schema.json())], "name string, schema string")
                entry.coalesce(1).write.mode("append").json(f"{home}/{self.LIST}")
        except Exception as error:
            log.exception("%s failed", part)
            self.status[part] = f"failed: {type(error).__name__}: {str(error).splitlines()[0][:300] if str(error) else ''}"
            return None
        self.status[part] = "complete"
        return found

    def entered(self, home: str, name: str) -> str | None:
        """Schema of a part that is complete."""
        try:
            row = self.spark.read.schema("name string, schema string").json(f"{home}/{self.LIST}").filter(F.col("name") == name).first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return row["schema"] if row else None


def fingerprint(df: DataFrame) -> str:
    """Number of rows and two sums of their hashes: the same in any order and partitioning."""
    columns = sorted(df.columns)
    one, two = (F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in columns)) for seed in (1, 2))
    sums = df.agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)"))).first()
    return f"{columns} {tuple(map(str, sums))}"


def predict_emotions(df: DataFrame, config: RunConfig) -> DataFrame:
    """Predictions of the configured models; to be stored once, so that models are never asked twice."""
    rows = df if config.sample_size is None else emotions.sample_reviews(df, config.sample_size)
    return ensemble.disagreement(ensemble.ensemble(config.emotion_models(rows)))


def run_full_analysis(df: DataFrame, config: RunConfig = RunConfig()) -> Analysis:
    """The review run, then aspects, topics and emotions of the credible reviews, and their summary.

    A part that fails is left out of the results, which say so. With `resume` and `output`, a run over the same rows with the same
    settings makes only what the earlier ones have not finished; the review run counts as a part.
    """
    spark = df.sparkSession
    first = Parts(spark, config, df)
    if config.resume and config.output:
        own = replace(config, output=f"{config.output.rstrip('/')}/{first.name('review', config.scope, config.use_knn, str(config.thresholds), config.prepare, config.language, str(config.gates))}")
        flagged = first.attempt("flagged", lambda: run_review_pipeline(df, own).flagged, own.output)
        if flagged is None:
            raise RuntimeError(f"the review run {first.status['flagged']}")
        review = review_run(flagged, df, config)
    else:
        review = run_review_pipeline(df, config)
    credible = review.credible
    parts = Parts(spark, config, credible)

    def aspect_part() -> DataFrame:
        words = config.keywords if config.keywords is not None else topics.guided_keywords(credible)
        return aspects.aspect_sentiment(aspects.judged_reviews(credible, words, config.scorer))

    def topic_part() -> DataFrame:
        found = topics.nmf_topics(credible, config.n_topics)
        rows = credible.join(found.weights, [GAME, "review_id"])
        return topics.topic_sentiment(rows, found.topics, config.scorer)

    by_aspect = parts.attempt("aspects", aspect_part, config.keywords)
    by_topic = parts.attempt("topics", topic_part, config.n_topics) if config.run_nmf else None
    predicted = None
    if config.emotion_models is not None:
        predicted = parts.attempt("emotions", lambda: predict_emotions(credible, config), config.sample_size)
    told = None
    if by_aspect is not None and predicted is not None:
        told = parts.attempt("summary", lambda: analysis_summary(review.state, by_aspect, predicted, by_topic), by_topic is None)
    status = {"aspects": "not asked for", "topics": "not asked for", "emotions": "not asked for"} | parts.status
    results = writers.results_document(
        review.state,
        None if by_aspect is None else aspects.absa_summary(by_aspect, by_topic),
        by_aspect,
        None if predicted is None else emotions.emotion_distribution(predicted),
        None if predicted is None else emotions.confidence_by_emotion(predicted),
        config.settings,
        status,
    )
    if config.output:
        writers.write_results_json(results, f"{config.output.rstrip('/')}/results")
    return Analysis(review, by_aspect, by_topic, predicted, results, told)


def analysis_summary(state: DataFrame, by_aspect: DataFrame, predictions: DataFrame, by_topic: DataFrame | None = None) -> DataFrame:
    """One row per game: counts, leading aspects, leading emotions, valence."""
    listed = lambda df, rank, item, out: df.groupBy(GAME).agg(
        F.array_sort(F.collect_list(F.struct(rank, item))).alias(out)
    )
    tops = listed(aspects.top_aspects(by_aspect), "rank", "aspect", "a")
    feelings = listed(emotions.top_emotions(predictions), "rank", "emotion", "e")
    means = emotions.confidence_by_emotion(predictions).filter(F.col("emotion").isNull())
    return (
        state.join(aspects.absa_summary(by_aspect, by_topic), GAME, "left")
        .join(tops.select(GAME, F.array_join(F.transform("a", lambda x: x["aspect"]), ", ").alias("top_aspects")), GAME, "left")
        .join(feelings.select(GAME, F.array_join(F.transform("e", lambda x: x["emotion"]), ", ").alias("top_emotions")), GAME, "left")
        .join(means.select(GAME, F.col("avg_confidence").alias("overall_confidence")), GAME, "left")
        .join(emotions.valence(predictions), GAME, "left")
    )
