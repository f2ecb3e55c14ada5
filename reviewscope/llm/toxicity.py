"""Toxicity by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words and the first `PREFIXES` letters of them. Those that separate the labelled
texts best are the vocabulary. The model is proportional odds: P(grade > k) = sigmoid(w x - b_k) with
one weight vector for all thresholds b_1 <= b_2 <= ..., so a feature moves a text along one scale of severity. It is
fitted on a bounded sample of labelled texts and gives the probability of each grade and the expected severity.

Grades, where only toxic or not is labelled: 0 is not toxic; toxic texts are graded 1 to `GRADES` - 1 by how many
of the vocabulary's toxic features they have, cut at quantiles of the labelled toxic texts. With a column of grades these are
used as they are.

Bounds: `VOCABULARY` features (or, with `vocabulary=None`, all that enough labelled texts of the rows given to `fit` have), and a fitting sample of `SAMPLE` labelled texts of each label. `sampled` draws it by a hash of
the key from the labels alone, so no other text is read twice or moved; `fit` counts all rows that it is given and
fits on a draw of the same size. Each side of the sample weighs as much as it does among all labels, so probabilities do not
depend on where the bounds cut. Only the vocabulary and the sample's feature numbers reach the driver.

Edge cases: a null or empty text has no features and gets the severity of the intercepts alone. Rows that repeat are scored alike; labels
that are null do not train, and a key that is labelled twice trains twice. Without labels of both kinds every severity is 0 and nothing
is toxic. Texts of any length are read whole, in slices of bounded size. Empty tables give empty results. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.llm.words import mapped, slices, text_batches
from reviewscope.session import stored

PREFIXES = (4, 5, 6)
VOCABULARY = 600
LEAST_TEXTS = 4  # at every size; the ridge keeps chance words of a few texts small
SAMPLE = 10_000
GRADES = 4
RIDGE = 1.0
TOXIC_AT = 0.3  # probability of any grade above 0 from which a text counts as toxic
STEPS = 400


class Model(NamedTuple):
    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray


def lettered(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def features(text: str | None, prefixes: tuple[int, ...] = PREFIXES) -> set[str]:
    """Distinct words, and their beginnings (marked by a hyphen)."""
    words = set(lettered(text or "").split())
    out = set(words)
    for n in prefixes:
        out.update(w[:n] + "-" for w in words if len(w) >= n)
    return out


# -------------------------------------------------------------------------------- regression
def probabilities(scale: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade = k) for k = 0 .. len(thresholds); a row for each value of the scale."""
    above = 1 / (1 + np.exp(-np.clip(scale[:, None] - thresholds[None, :], -35, 35)))
    edges = np.concatenate([np.ones((len(scale), 1)), above, np.zeros((len(scale), 1))], axis=1)
    return edges[:, :-1] - edges[:, 1:]


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, width: int, ridge: float = RIDGE, steps: int = STEPS, mass: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by penalised likelihood (gradient steps with per-parameter rates).

    rows: the features present in each text. Grades count from 0. mass: how much each text counts, 1 by default.
    """
    levels = int(grades.max())
    mass = np.ones(len(rows)) if mass is None else mass
    flat, owner = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights = np.zeros(width)
    # Thresholds as the first one and the logs of the steps between them: they stay in order.
    free = np.concatenate([[0.0], np.full(levels - 1, 0.0)])
    first, second = np.zeros(width + levels), np.zeros(width + levels)
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        thresholds = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        scale = np.bincount(owner, weights=weights[flat], minlength=len(rows))
        above = 1 / (1 + np.exp(-np.clip(scale[:, None] - thresholds[None, :], -35, 35)))
        slope = above * (1 - above)
        edges = np.concatenate([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))], axis=1)
        slopes = np.concatenate([np.zeros((len(rows), 1)), slope, np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        likelihood = np.maximum(edges[at, grades] - edges[at, grades + 1], 1e-12)
        factor = mass / likelihood
        to_scale = factor * (slopes[at, grades] - slopes[at, grades + 1])
        to_threshold = np.zeros((len(rows), levels + 2))
        np.add.at(to_threshold, (at, grades), -factor * slopes[at, grades])
        np.add.at(to_threshold, (at, grades + 1), factor * slopes[at, grades + 1])
        by_threshold = to_threshold.sum(axis=0)[1:-1]
        tail = np.cumsum(by_threshold[::-1])[::-1]
        gradient = np.concatenate([np.bincount(flat, weights=to_scale[owner], minlength=width) - ridge * weights, [tail[0]], tail[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights += move[:width]
        free += move[width:]
    return weights, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


# ------------------------------------------------------------------------------------- Spark
def feature_rows(docs: DataFrame, keep: list[str], vocabulary: list[str] | None = None) -> DataFrame:
    """The columns to keep and `features`: names, or, with a vocabulary, their numbers in it."""
    text_batches(docs)
    kind = T.ArrayType(T.StringType() if vocabulary is None else T.IntegerType())
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("features", kind)])
    held = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(vocabulary or ())})
    every = vocabulary is None

    def run(batches):
        number = held.value
        for batch in batches:
            for part in slices(batch, len(keep)):
                rows = []
                for text in part.column(len(keep)).to_pylist():
                    found = features(text)
                    rows.append(sorted(found) if every else sorted(number[f] for f in found if f in number))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(rows, pa.list_(pa.string() if every else pa.int32()))], names=schema.names
                )

    return mapped(docs.select(*keep, "text"), run, schema)


def sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """text and label of at most `sample` labelled rows of each side (0, and above 0), written once."""
    rows = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias(label)).filter(F.col(label).isNotNull() & F.col("key").isNotNull())
    rows = rows.withColumns({"side": F.col(label) > 0, "hash": F.xxhash64("key")})
    counts = {r["side"]: r["n"] for r in rows.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("side"), 2 * sample / max(1, counts.get(True, 0))).otherwise(2 * sample / max(1, counts.get(False, 0)))
    rows = rows.filter(F.pmod(F.col("hash"), F.lit(1 << 30)) / float(1 << 30) <= share)
    drawn = rows.withColumn("place", F.row_number().over(W.partitionBy("side").orderBy("hash", "key", label))).filter(F.col("place") <= sample)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    # At most 2 * sample keys, so they may be broadcast.
    return stored(texts.join(F.broadcast(drawn.select("key", label)), "key").select("text", label), "labelled-sample")


def fit_sampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from a draw of the labelled documents, in which each side counts as much as among all labels."""
    sides = labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy((F.col(f"`{label}`") > 0).cast("int").alias("side"))
    shares = {r["side"]: max(1.0, r["n"] / sample) for r in sides.agg(F.count(F.lit(1)).alias("n")).collect()}
    return fit(sampled(docs, labels, key, text, label, sample), toxic=label, sample=sample, shares=shares)


def fit(
    labelled: DataFrame,
    text: str = "text",
    toxic: str = "toxic",
    grade: str | None = None,
    vocabulary: int | None = VOCABULARY,
    sample: int = SAMPLE,
    shares: dict[int, float] | None = None,
) -> Model:
    """Learn from rows with a text and a label. shares: how many labelled texts a row of each side (0, 1) stands for."""
    rows = labelled.select(
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.col(f"`{grade or toxic}`").cast("int").alias("grade"),
        (F.col(f"`{grade or toxic}`") > 0).cast("int").alias("toxic"),
    ).filter("grade is not null")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model([], np.zeros(0), np.zeros(0))
    named = feature_rows(rows, ["toxic"]).select("toxic", F.explode("features").alias("feature"))
    counts = named.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    # Log odds of the smoothed shares, weighed by how often the feature is seen: a frequent clear sign comes first.
    bad, good = (F.col("bad") + 0.5) / (totals[1] + 1), (F.col("good") + 0.5) / (totals[0] + 1)
    strength = F.abs(F.log(bad / good)) * F.sqrt(bad + good)
    best = counts.filter(F.col("bad") + F.col("good") >= LEAST_TEXTS).withColumn("strength", strength)
    best = best.orderBy(F.desc("strength"), "feature")
    chosen = (best if vocabulary is None else best.limit(vocabulary)).select("feature", (bad > good).alias("points")).collect()
    names = [r["feature"] for r in chosen]
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, min(1.0, 1.5 * sample / n + 0.001)))), F.col("toxic"))
    drawn = rows.filter((F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)) < share)
    found = feature_rows(drawn, ["toxic", "grade"], names).toArrow()
    flags = found.column("toxic").to_numpy()
    # The bound, whatever the draw gave.
    order = np.concatenate([np.flatnonzero(flags == v)[:sample] for v in (0, 1)])
    lists = found.column("features").to_pylist()
    lists, grades = [np.array(lists[i], dtype=np.int64) for i in order], found.column("grade").to_numpy()[order].astype(np.int64)
    if grade is None:
        points = np.array([r["points"] for r in chosen])
        marks = np.array([points[x].sum() if len(x) else 0 for x in lists], dtype=float)
        bad = grades > 0
        cuts = np.quantile(marks[bad], np.arange(1, GRADES - 1) / (GRADES - 1)) if bad.any() else []
        grades = np.where(bad, 1 + np.searchsorted(cuts, marks, side="left"), 0)
    if not bad_and_good(grades):
        return Model([], np.zeros(0), np.zeros(0))
    # Texts of a side count for those that were not drawn, too; 1 on average, so that the ridge is that of the sample.
    mass = np.zeros(len(order))
    for v in (0, 1):
        own = flags[order] == v
        mass[own] = (shares or {}).get(v, 1.0) * totals[v] / max(1, own.sum())
    weights, thresholds = fit_ordinal(lists, grades, max(1, len(names)), mass=mass / mass.mean())
    return Model(names, weights, thresholds)


def bad_and_good(grades: np.ndarray) -> bool:
    return bool(len(grades)) and bool((grades > 0).any()) and bool((grades == 0).any())


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, severity (expected grade), grade (the likeliest), toxic and p_toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    numbered = feature_rows(kept, ["key"], model.features)
    schema = T.StructType([kept.schema["key"], *T._parse_datatype_string("severity double, grade int, toxic boolean, p_toxic double").fields])

    def run(batches):
        model = held.value
        for batch in batches:
            n, lists = len(batch), batch.column(1)
            if len(model.thresholds):
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                p = probabilities(np.bincount(owner, weights=model.weights[flat], minlength=n).astype(np.float64), model.thresholds)
            else:
                p = np.ones((n, 1))
            bad = 1 - p[:, 0]
            columns = [p @ np.arange(p.shape[1], dtype=float), p.argmax(axis=1).astype(np.int32), bad >= TOXIC_AT, bad]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=schema.names)

    return mapped(numbered, run, schema).withColumnRenamed("key", key)
