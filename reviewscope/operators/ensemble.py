"""Several emotion models per review, combined in the row: no shuffle, no Python.

`models` is array<struct<model, emotion, confidence, probs>> with one entry per model that
answered; `ensemble` adds the joint prediction and the disagreement measures.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.config import EMOTIONS, PENALTY_WEIGHT, UNKNOWN
from reviewscope.functions import arrays as av
from reviewscope.functions import text as ft
from reviewscope.operators.sentiment import one_by_one


def model_scorer(make_predict: Callable, batch_size: int = 24) -> Callable[..., Column]:
    """A user model as a column function: `make_predict` runs once per Python worker and
    returns batch -> (n, 6) logits; Spark feeds it Arrow batches of `batch_size` rows.
    A row that the model raises on gets null, so the ensemble goes on without this model; its batch is scored."""

    def tolerant():
        predict = make_predict()

        def run(texts):
            try:
                return predict(texts)
            except Exception:
                rows = one_by_one(predict, texts, lambda: None)
                width = next((np.shape(r)[1] for r in rows if r is not None), 1)
                return np.array([np.full(width, np.nan) if r is None else np.asarray(r, dtype=float)[0] for r in rows])

        return run

    predict = predict_batch_udf(tolerant, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)

    def score(*columns) -> Column:
        # A failed row comes back as NaN (or null) entries.
        whole = lambda v: F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), v)
        return F.get(F.transform(F.array(predict(*columns)), whole), F.lit(0))

    return score


def score_models(df: DataFrame, logits: dict[str, Column], labels: Sequence[str] = EMOTIONS) -> DataFrame:
    """Softmax, label and confidence of every model; a model without logits is left out."""
    return _models(df, logits, av.let("e", av.shifted_exp("m.v"), av.normalised("e")), labels)


def from_probabilities(df: DataFrame, probs: dict[str, Column], labels: Sequence[str] = EMOTIONS) -> DataFrame:
    """The same record from models that already return probabilities (as arrays)."""
    return _models(df, probs, "m.v", labels)


def _models(df: DataFrame, vectors: dict[str, Column], probs: str, labels: Sequence[str]) -> DataFrame:
    df = df.withColumns({f"__v_{n}": v for n, v in vectors.items()})
    given = ", ".join(f"named_struct('model', '{n}', 'v', __v_{n})" for n in vectors)
    record = (
        f"named_struct('model', m.model, 'emotion', {av.best_label('p', labels)}, "
        "'confidence', array_max(p), 'probs', p)"
    )
    answered = f"filter(array({given}), m -> m.v is not null)"
    models = F.expr(f"transform({answered}, m -> {av.let('p', probs, record)})")
    return df.withColumn("models", models).drop(*[f"__v_{n}" for n in vectors])


def ensemble(df: DataFrame, weight: float = PENALTY_WEIGHT, labels: Sequence[str] = EMOTIONS) -> DataFrame:
    """Joint prediction: mean of three models minus a penalty on their pairwise distance.

    With two models the third counts as a zero vector.  With fewer than two the prediction is
    ('unknown', 0.0) and every measure is null.
    """
    zeros = f"array_repeat(0D, {len(labels)})"
    a, b, c = "x", "p2[j]", "p3[j]"
    pairs = f"(power({a} - {b}, 2) + power({b} - {c}, 2) + power({c} - {a}, 2))"
    penalty = f"transform(p1, (x, j) -> {weight!r}D * {pairs} / 3D)"
    raised = f"transform(p1, (x, j) -> greatest(({a} + {b} + {c}) / 3D - pen[j], 0D))"
    probs = f"transform(raised, r -> r / ({av.array_sum('raised')} + 1e-8D))"
    votes = "transform(said, a -> size(filter(said, b -> b = a)))"
    record = (
        f"named_struct('probs', f, 'emotion', {av.best_label('f', labels)}, 'confidence', array_max(f), "
        f"'disagreement_penalty', {av.array_sum('pen')}, 'agreement', array_max({votes}) / size(said), "
        f"'confidence_variance', {av.squared_distance('sure')} / (size(sure) - 1))"
    )
    for name, value in (
        ("sure", "transform(ms, m -> m.confidence)"),
        ("said", "transform(ms, m -> m.emotion)"),
        ("f", probs),
        ("raised", raised),
        ("pen", penalty),
        ("p3", f"coalesce(get(ms, 2).probs, {zeros})"),
        ("p2", "get(ms, 1).probs"),
        ("p1", "get(ms, 0).probs"),
    ):
        record = av.let(name, value, record)
    joint = av.let("ms", "models", f"case when size(ms) >= 2 then {record} end")
    c = F.col
    return (
        df.withColumn("__joint", F.expr(joint))
        .withColumns(
            {
                "probs": c("__joint.probs"),
                "emotion": F.coalesce(c("__joint.emotion"), F.lit(UNKNOWN)),
                "confidence": F.coalesce(c("__joint.confidence"), F.lit(0.0)),
                "disagreement_penalty": c("__joint.disagreement_penalty"),
                "agreement": c("__joint.agreement"),
                "confidence_variance": c("__joint.confidence_variance"),
                "uncertainty": F.when(c("__joint.agreement") < 0.7, "high").when(
                    c("__joint.agreement") >= 0.7, "low"
                ),
            }
        )
        .drop("__joint")
    )


def disagreement(df: DataFrame, include_ensemble: bool = False) -> DataFrame:
    """Add `jsd`: mean divergence of the models from their average, over ln(models), in [0, 1].

    include_ensemble=True counts the joint prediction as one more distribution.  Fewer than two
    usable distributions give 0.
    """
    every = "transform(models, m -> m.probs)"
    if include_ensemble:
        every = f"concat({every}, array(probs))"
    average = "transform(get(ds, 0), (x, j) -> aggregate(ds, 0D, (s, d) -> s + d[j]) / size(ds))"
    p, q = av.clip("p"), av.clip("q")
    divergence = av.array_sum(f"zip_with(d, mid, (p, q) -> {p} * ln({p} / {q}))")
    whole = f"aggregate(ds, 0D, (s, d) -> s + {divergence}) / size(ds) / ln(size(ds))"
    body = f"case when size(ds) >= 2 then {av.let('mid', average, whole)} else 0D end"
    return df.withColumn("jsd", F.expr(av.let("ds", f"filter({every}, d -> {av.usable('d')})", body)))


def confidence_cv(df: DataFrame) -> DataFrame:
    """Add `confidence_cv`: the fallback measure where only confidences are known."""
    cv = f"sqrt({av.squared_distance('sure')} / size(sure)) / ({av.mean('sure')} + 1e-10D)"
    body = f"case when size(sure) >= 2 then {cv} else 0D end"
    return df.withColumn(
        "confidence_cv", F.expr(av.let("sure", "transform(models, m -> m.confidence)", body))
    )


def _of_model(name: str) -> Column:
    return F.get(F.filter("models", lambda m: m["model"] == name), F.lit(0))


def flatten_predictions(df: DataFrame, models: Sequence[str], text: str = "review") -> DataFrame:
    """The record as flat columns: joint prediction, then three columns per model."""
    columns = [c for c in ("review_id", "game_id") if c in df.columns]
    out = [F.col(c) for c in columns]
    if text in df.columns:
        out.append(ft.truncate(F.col(text), 100, ellipsis=True).alias("text"))
    out += [
        F.col("emotion"),
        F.col("confidence"),
        F.col("disagreement_penalty"),
        F.col("agreement").alias("prediction_agreement"),
        F.col("probs").alias("raw_probabilities"),
    ]
    for name in models:
        entry = _of_model(name)
        out += [
            entry["emotion"].alias(f"{name}_emotion"),
            entry["confidence"].alias(f"{name}_confidence"),
            entry["probs"].alias(f"{name}_probabilities"),
        ]
    return df.select(*out)
