"""Ordinal regression: ordered thresholds, recovered scale, held-out accuracy on labelled documents, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest

from reviewscope.llm import toxicity
from reviewscope.llm.queries import op3_score_toxicity


def test_ordinal_fit_recovers_the_scale():
    rng = np.random.default_rng(0)
    true = rng.normal(size=30) * 2
    rows = [np.flatnonzero(rng.random(30) < 0.2) for _ in range(1500)]
    scale = np.array([true[r].sum() for r in rows])
    grades = np.searchsorted([-1.0, 1.0, 3.0], scale + rng.logistic(size=len(rows)) * 0.3)
    weights, thresholds = toxicity.fit_ordinal(rows, grades, 30)
    assert (np.diff(thresholds) > 0).all() and np.corrcoef(weights, true)[0, 1] > 0.97
    p = toxicity.probabilities(np.array([weights[r].sum() for r in rows]), thresholds)
    assert p.sum(axis=1) == pytest.approx(np.ones(len(rows))) and (p.argmax(axis=1) == grades).mean() > 0.8


def test_gradient_is_the_likelihood_slope():
    """At the fitted point no small change of a weight or threshold raises the penalised likelihood much."""
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(300)]
    grades = np.array([min(2, len(r) // 2) for r in rows])

    def value(w, b):
        p = toxicity.probabilities(np.array([w[r].sum() for r in rows]), b)
        return np.log(np.maximum(p[np.arange(len(rows)), grades], 1e-12)).sum() - 0.5 * (w**2).sum()

    w, b = toxicity.fit_ordinal(rows, grades, 5, ridge=1.0, steps=4000)
    best = value(w, b)
    for i in range(5):
        for d in (-0.05, 0.05):
            assert value(w + d * (np.arange(5) == i), b) < best + 0.02


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("lang = 'en'")
    train, test = docs.filter("doc_id % 4 <> 1"), docs.filter("doc_id % 4 = 1")
    rows = {r["doc_id"]: r for r in toxicity.score(test, toxicity.fit(train)).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in test.select("doc_id", "toxic").collect()}
    assert rows.keys() == truth.keys()
    clean = [rows[k]["toxic"] for k, v in truth.items() if not v]
    bad = [rows[k]["toxic"] for k, v in truth.items() if v]
    assert np.mean(clean) < 0.05 and np.mean(bad) > 0.6
    assert np.mean([rows[k]["severity"] for k, v in truth.items() if v]) > 5 * np.mean([rows[k]["severity"] for k, v in truth.items() if not v])


def test_odd_rows_and_given_grades(spark):
    bad, good = "you are scum and trash", "what a lovely day it is"
    rows = [(i, bad if i % 2 else good, 2 * (i % 2), "x") for i in range(40)] + [(100, None, None, "x"), (None, "", 0, "y"), (3, bad, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, severity string").repartition(3)
    model = toxicity.fit(df, grade="toxic")
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["toxic"] and not by[2]["toxic"] and by[3]["severity"] > 1 > by[2]["severity"]
    assert by[100]["severity"] == by[None]["severity"]
    assert all(0 <= r["severity"] <= 2 for r in got)
    empty = df.limit(0)
    nothing = toxicity.fit(empty)
    assert toxicity.score(empty, model).count() == 0
    few = toxicity.sampled(df, df.select("doc_id", "toxic"), sample=5)
    assert few.columns == ["text", "toxic"] and few.filter("toxic = 0").count() == 5 and few.filter("toxic = 2").count() >= 5
    assert toxicity.sampled(df, empty.select("doc_id", "toxic")).count() == 0
    assert {(r["severity"], r["toxic"]) for r in toxicity.score(df, nothing).collect()} == {(0.0, False)}


def test_probabilities_do_not_depend_on_the_bound(spark):
    """50 of 950 texts with nothing but common words are toxic, however many of either side are drawn."""
    plain = "these are the same words"
    docs = spark.createDataFrame([(i, plain + (" you scum" if i < 50 else "")) for i in range(1000)], "doc_id long, text string")
    labels = docs.select("doc_id", (docs["doc_id"] < 100).cast("int").alias("toxic"))
    for sample in (10_000, 60):
        model = toxicity.fit_sampled(docs, labels, sample=sample)
        (row,) = toxicity.score(docs.filter("doc_id = 999"), model).collect()
        assert row["p_toxic"] == pytest.approx(50 / 950, abs=0.03) and not row["toxic"]


def test_rare_features_are_kept_at_every_size(spark):
    rows = [("lovely day", 0)] * 3000 + [("lovely scum", 1)] * 6
    assert "scum" in toxicity.fit(spark.createDataFrame(rows, "text string, toxic int")).features


def plain_scores(docs, labels):
    """The query's rows, text by text: {doc_id: (severity, grade, toxic, p_toxic)}. docs: {doc_id: text}, labels: [(doc_id, toxic)]."""

    def found(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        return {w for w in words} | {w[:n] + "-" for w in words for n in (4, 5, 6) if len(w) >= n}

    train = [(found(docs[k]), t) for k, t in labels if k in docs and t is not None]
    total = Counter(t for _, t in train)
    seen = {v: Counter(f for fs, t in train if t == v for f in fs) for v in (0, 1)}
    strength, points = {}, {}
    for f in seen[0].keys() | seen[1].keys():
        if seen[0][f] + seen[1][f] >= 4:
            bad, good = (seen[1][f] + 0.5) / (total[1] + 1), (seen[0][f] + 0.5) / (total[0] + 1)
            strength[f], points[f] = abs(math.log(bad / good)) * math.sqrt(bad + good), bad > good
    names = sorted(strength, key=lambda f: (-strength[f], f))[: toxicity.VOCABULARY]
    kept = [fs & set(names) for fs, _ in train]
    marks = [sum(points[f] for f in fs) for fs in kept]
    cuts = np.quantile([m for m, (_, t) in zip(marks, train) if t], [1 / 3, 2 / 3])
    grades = [1 + sum(c < m for c in cuts) if t else 0 for m, (_, t) in zip(marks, train)]
    levels = max(grades)
    parameters = dict.fromkeys([*names, *range(levels)], 0.0)
    first, second = dict.fromkeys(parameters, 0.0), dict.fromkeys(parameters, 0.0)

    def thresholds():
        out = [parameters[0]]
        for j in range(1, levels):
            out.append(out[-1] + math.exp(parameters[j]))
        return out

    def edge(scale, k, at):
        """P(grade >= k) and its slope."""
        if k == 0 or k > levels:
            return float(k == 0), 0.0
        p = 1 / (1 + math.exp(-min(35, max(-35, scale - at[k - 1]))))
        return p, p * (1 - p)

    for step in range(1, toxicity.STEPS + 1):
        at, slope = thresholds(), dict.fromkeys(parameters, 0.0)
        by_threshold = [0.0] * levels
        for fs, g in zip(kept, grades):
            scale = sum(parameters[f] for f in fs)
            (p, dp), (q, dq) = edge(scale, g, at), edge(scale, g + 1, at)
            likelihood = max(p - q, 1e-12)
            for f in fs:
                slope[f] += (dp - dq) / likelihood
            if g >= 1:
                by_threshold[g - 1] -= dp / likelihood
            if g + 1 <= levels:
                by_threshold[g] += dq / likelihood
        for f in names:
            slope[f] -= toxicity.RIDGE * parameters[f]
        for j in range(levels):
            slope[j] = sum(by_threshold[j:]) * (math.exp(parameters[j]) if j else 1.0)
        for x, d in slope.items():
            first[x] = 0.9 * first[x] + 0.1 * d
            second[x] = 0.999 * second[x] + 0.001 * d * d
            parameters[x] += 0.05 * (first[x] / (1 - 0.9**step)) / (math.sqrt(second[x] / (1 - 0.999**step)) + 1e-9)
    out, at = {}, thresholds()
    for k, text in docs.items():
        scale = sum(parameters[f] for f in found(text) & set(names))
        above = [edge(scale, j, at)[0] for j in range(levels + 2)]
        p = [a - b for a, b in zip(above, above[1:])]
        out[k] = (sum(j * x for j, x in enumerate(p)), p.index(max(p)), 1 - p[0] >= toxicity.TOXIC_AT, 1 - p[0])
    return out


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = plain_scores(docs, labels)
    got = op3_score_toxicity(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        severity, grade, toxic, p = want[r["doc_id"]]
        assert (r["severity"], r["p_toxic"]) == pytest.approx((severity, p), abs=1e-6)
        assert abs(p - toxicity.TOXIC_AT) < 1e-6 or (r["grade"], r["toxic"]) == (grade, toxic)
