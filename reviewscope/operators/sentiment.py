"""Pluggable sentiment: a scorer maps a text column to struct<label, confidence>."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.functions import text as ft

Scorer = Callable[[Column], Column]
SENTIMENT = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]
)


def lexicon_scorer(positive: Sequence[str], negative: Sequence[str]) -> Scorer:
    """Label by the more frequent word list, confidence by its share; a tie is neutral at 0.5."""

    def score(text: Column) -> Column:
        low = F.lower(text)
        hits = F.struct(
            F.regexp_count(low, F.lit(ft.any_word(positive))).alias("pos"),
            F.regexp_count(low, F.lit(ft.any_word(negative))).alias("neg"),
        )

        def judge(h: Column) -> Column:
            pos, neg = h["pos"], h["neg"]
            label = F.when(pos > neg, "POSITIVE").when(neg > pos, "NEGATIVE").otherwise("NEUTRAL")
            sure = F.when(pos == neg, F.lit(0.5)).otherwise(F.greatest(pos, neg) / (pos + neg))
            return F.struct(label.alias("label"), sure.alias("confidence"))

        return F.get(F.transform(F.array(hits), judge), F.lit(0))

    return score


def one_by_one(predict: Callable, texts, missing: Callable) -> list:
    """Answers of single rows after a batch has failed; a row that fails alone gets `missing()`."""
    out = []
    for i in range(len(texts)):
        try:
            out.append(predict(texts[i : i + 1]))
        except Exception:
            out.append(missing())
    return out


def model_scorer(make_predict: Callable, batch_size: int = 32, max_chars: int | None = None) -> Scorer:
    """A user model as scorer: `make_predict()` runs once per Python worker and returns a function
    of a batch of texts to {"label": [...], "confidence": [...]}.  `max_chars` serves models with a
    limited input.  A text that the model raises on gets no label; the rest of its batch is scored."""

    def tolerant():
        predict = make_predict()

        def run(texts):
            try:
                return predict(texts)
            except Exception:
                rows = one_by_one(predict, texts, lambda: {"label": [None], "confidence": [None]})
                return {c: np.array([r[c][0] for r in rows], dtype=object) for c in ("label", "confidence")}

        return run

    predict = predict_batch_udf(tolerant, return_type=SENTIMENT, batch_size=batch_size)

    def score(text: Column) -> Column:
        return predict(text if max_chars is None else ft.truncate(text, max_chars))

    return score


class FittedScorer:
    """A fitted classifier as scorer: the likelier of its labels, and how likely it is.

    `probabilities(df, text)` adds a column `probs`, an array in the order of `labels`: `TextBayes.probabilities`, or
    `pipeline_probabilities` of a fitted pipeline. A null or blank text is left to the neutral answer.
    """

    def __init__(self, probabilities: Callable[[DataFrame, str], DataFrame], labels: Sequence[str]):
        self.probabilities, self.labels = probabilities, list(labels)

    def apply(self, df: DataFrame, text: str) -> DataFrame:
        """Add `__s`, a struct of label and confidence."""
        names = F.array(*map(F.lit, self.labels))
        best = F.array_max("__probs")
        found = F.struct(F.get(names, F.array_position("__probs", best).cast("int") - 1).alias("label"), best.alias("confidence"))
        scored = self.probabilities(df, text).withColumnRenamed("probs", "__probs")
        return scored.withColumn("__s", F.when(~ft.is_blank(F.col(text)), found)).drop("__probs")


def pipeline_probabilities(model: PipelineModel) -> Callable[[DataFrame, str], DataFrame]:
    """Of a fitted pipeline that reads the text column it was trained on and gives `probability`."""

    def add(df: DataFrame, text: str) -> DataFrame:
        ready = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
        scored = model.transform(ready).withColumn("probs", vector_to_array("probability"))
        return scored.select(*df.columns, "probs")

    return add


def score_sentiment(df: DataFrame, scorer: Scorer | FittedScorer | None, text: str = "review") -> DataFrame:
    """Add label and confidence; without a scorer, or where it gives nothing, NEUTRAL at 0.5."""
    neutral = F.struct(F.lit("NEUTRAL").alias("label"), F.lit(0.5).alias("confidence"))
    if isinstance(scorer, FittedScorer):
        scored = scorer.apply(df, text)
    else:
        scored = df.withColumn("__s", neutral if scorer is None else scorer(F.col(text)))
    return (
        scored.withColumn("__s", F.when(F.col("__s.label").isNotNull(), F.col("__s")).otherwise(neutral))
        .withColumns({"label": F.col("__s.label"), "confidence": F.col("__s.confidence")})
        .drop("__s")
    )
