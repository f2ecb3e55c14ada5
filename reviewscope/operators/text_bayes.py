"""A text classifier from sufficient statistics: multinomial naive Bayes on the terms that chi-square picks.

Training is one group-by: of each (label, term) the reviews that have it and its occurrences, added up in the tasks first. Chi-square over
the reviews of each label says which terms are kept (at most `features`), and the weights are smoothed log shares of the kept terms'
occurrences. So a model is a table of at most `features` rows with a weight per label, trained in one pass however
many reviews there are. Scoring counts terms inside the row and joins the kept ones with the model; a review's sums are made in the
task that holds it, so one row per review is shuffled.

A review without any kept term gets the shares of the labels. Rows without a label or a text train nothing; a null text is scored as an
empty one. Labels are strings, ordered by name; on ties the first wins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewscope.config import STOP_WORDS
from reviewscope.operators import features as tf
from reviewscope.session import stored

FEATURES = 2000
SMOOTHING = 1.0
ROW = "__row"


class TextBayes(NamedTuple):
    labels: list[str]
    priors: list[float]
    #: term, chi2, weights (an array in the order of labels)
    terms: DataFrame
    stop_words: Sequence[str]

    def probabilities(self, df: DataFrame, text: str = "review", out: str = "probs") -> DataFrame:
        """Add the probabilities of the labels, in their order."""
        rows = df.withColumn(ROW, F.xxhash64(F.col(text)))
        texts = rows.select(F.col(ROW).alias("review_id"), F.lit("").alias(tf.GAME), F.coalesce(F.col(text), F.lit("")).alias("review"))
        hits = tf.term_rows(tf.term_counts(texts, "review", self.stop_words)).join(self.terms.select("term", "weights"), "term")
        sums = hits.groupBy(F.col("review_id").alias(ROW)).agg(
            F.array(*(F.sum(F.col("tf") * F.get("weights", F.lit(i))) for i in range(len(self.labels)))).alias("__sums")
        )
        # Copies of a text were summed up together.
        copies = rows.groupBy(ROW).agg(F.count("*").alias("__copies"))
        sums = sums.join(copies, ROW).select(ROW, F.transform("__sums", lambda x: x / F.col("__copies")).alias("__sums"))
        logs = [F.lit(p) + F.coalesce(F.get("__sums", F.lit(i)), F.lit(0.0)) for i, p in enumerate(self.priors)]
        return rows.join(sums, ROW, "left").withColumn(out, softmax(F.array(*logs))).drop(ROW, "__sums")

    def predict(self, df: DataFrame, text: str = "review") -> DataFrame:
        """Add `prediction` (a label) and `probs`."""
        scored = self.probabilities(df, text)
        names = F.array(*map(F.lit, self.labels))
        best = F.array_position("probs", F.array_max("probs")).cast("int")
        return scored.withColumn("prediction", F.get(names, best - 1))


def softmax(logs: Column) -> Column:
    parts = F.transform(F.array(logs), lambda x: F.transform(x, lambda v: F.exp(v - F.array_max(x))))
    return F.get(F.transform(parts, lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda a, b: a + b))), F.lit(0))


def chi_square(found: Sequence[Column], sizes: Sequence[int]) -> Column:
    """Of reviews with and without a term in each label; `found` has those with it."""
    total, have = sum(sizes), sum(found[1:], found[0])
    value = F.lit(0.0)
    for n, size in zip(found, sizes):
        for seen, expected in ((n, have * size / total), (size - n, (total - have) * size / total)):
            value = value + F.when(expected > 0, (seen - expected) * (seen - expected) / expected).otherwise(0.0)
    return value


def train_text_bayes(
    train: DataFrame,
    text: str = "review",
    label: str = "label",
    features: int = FEATURES,
    min_reviews: int = 2,
    smoothing: float = SMOOTHING,
    stop_words: Sequence[str] = STOP_WORDS,
) -> TextBayes:
    named = F.col(label).cast("string")
    rows = train.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(named.alias(tf.GAME), F.lit(0).alias("review_id"), F.col(text).alias("review"))
    counts = tf.term_counts(rows, "review", stop_words)
    stats = tf.term_rows(counts).groupBy(tf.GAME, "term").agg(F.count("*").alias("reviews"), F.sum("tf").alias("tf"))
    sizes = {r[0]: r[1] for r in rows.groupBy(tf.GAME).agg(F.count("*")).orderBy(tf.GAME).collect()}
    labels, total = list(sizes), sum(sizes.values())
    by_label = stats.groupBy("term").agg(
        *(F.coalesce(F.sum(F.when(F.col(tf.GAME) == k, F.col(c))), F.lit(0)).alias(f"{c}_{i}") for i, k in enumerate(labels) for c in ("reviews", "tf")),
        F.sum("reviews").alias("all"),
    )
    if not labels:
        none = by_label.select("term", F.lit(0.0).alias("chi2"), F.array().cast("array<double>").alias("weights"))
        return TextBayes([], [], none, stop_words)
    by_label = by_label.filter(F.col("all") >= min_reviews)
    scored = by_label.withColumn("chi2", F.round(chi_square([F.col(f"reviews_{i}") for i in range(len(labels))], list(sizes.values())), 6))
    kept = stored(scored.orderBy(F.desc("chi2"), "term").limit(features), "bayes-terms")
    whole = Window.partitionBy()  # a bounded table
    weights = F.array(*(F.ln((F.col(f"tf_{i}") + smoothing) / (F.sum(f"tf_{i}").over(whole) + smoothing * F.count("*").over(whole))) for i in range(len(labels))))
    terms = stored(kept.select("term", "chi2", weights.alias("weights")), "bayes-model")
    return TextBayes(labels, [math.log(n / total) for n in sizes.values()], terms, stop_words)
