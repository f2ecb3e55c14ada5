"""Naive Bayes on texts: plain counts, held-out accuracy, odd rows; classifiers as sentiment scorers."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from reviewscope.operators import models, sentiment, text_bayes

SF = "/root/testdata/sf0.01"
ROWS = [
    (1, "great great fun", "pos"), (2, "fun story", "pos"), (3, "great story", "pos"), (4, "dull story", "neg"), (5, "dull dull bugs", "neg"),
    (6, "bugs again bugs", "neg"), (7, None, "neg"), (8, "fun", None), (9, "", "pos"), (10, "fun story", "pos"),
]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "review_id int, review string, label string, term string").repartition(3)


def test_against_plain_counts(reviews):
    model = text_bayes.train_text_bayes(reviews, stop_words=(), min_reviews=1, features=6)
    train = [(t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])], k) for _, t, k in ROWS if t is not None and k]
    sizes = Counter(k for _, k in train)
    assert model.labels == ["neg", "pos"] and model.priors == pytest.approx([math.log(sizes[k] / len(train)) for k in model.labels])
    have, seen = defaultdict(Counter), defaultdict(Counter)
    for ws, k in train:
        have[k].update(set(ws))
        seen[k].update(ws)

    def chi(term):
        both = have["neg"][term] + have["pos"][term]
        cells = [(have[k][term], both * sizes[k] / len(train)) for k in sizes] + [(sizes[k] - have[k][term], (len(train) - both) * sizes[k] / len(train)) for k in sizes]
        return round(sum((a - e) ** 2 / e for a, e in cells if e), 6)

    best = sorted({w for ws, _ in train for w in ws}, key=lambda w: (-chi(w), w))[:6]
    got = {r["term"]: r for r in model.terms.collect()}
    assert sorted(got) == sorted(best)
    total = {k: sum(seen[k][w] for w in best) + 6 for k in sizes}
    for w in best:
        assert got[w]["chi2"] == pytest.approx(chi(w))
        assert got[w]["weights"] == pytest.approx([math.log((seen[k][w] + 1) / total[k]) for k in model.labels])
    found = {r["review_id"]: r for r in model.predict(reviews).collect()}
    assert len(found) == len(ROWS)
    for i, text, _ in ROWS:
        ws = (text or "").split()
        ws += [f"{a} {b}" for a, b in zip(ws, ws[1:])]
        logs = [p + sum(got[w]["weights"][j] for w in ws if w in got) for j, p in enumerate(model.priors)]
        shares = [math.exp(v) / sum(map(math.exp, logs)) for v in logs]
        assert found[i]["probs"] == pytest.approx(shares) and found[i]["prediction"] == model.labels[shares.index(max(shares))]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("text", "review")
    for label, least in (("lang", 0.97), ("toxic", 0.9)):
        rows = docs.withColumn("label", F.col("lang")) if label == "lang" else docs.join(spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "toxic as label"), "doc_id")
        test = F.col("doc_id") % 3 == 0
        scored = text_bayes.train_text_bayes(rows.filter(~test)).predict(rows.filter(test))
        assert scored.agg(F.avg((F.col("prediction") == F.col("label").cast("string")).cast("int"))).first()[0] > least


def test_nothing_to_learn(reviews):
    model = text_bayes.train_text_bayes(reviews.limit(0))
    assert model.labels == [] and model.terms.count() == 0


def test_classifiers_judge_sentiment(spark, reviews):
    model = text_bayes.train_text_bayes(reviews, stop_words=())
    scorer = sentiment.FittedScorer(model.probabilities, ["NEGATIVE", "POSITIVE"])
    got = {r["review_id"]: r for r in sentiment.score_sentiment(reviews, scorer).collect()}
    assert got[1]["label"] == "POSITIVE" and got[5]["label"] == "NEGATIVE" and got[1]["confidence"] > 0.6
    assert [tuple(got[i][c] for c in ("label", "confidence")) for i in (7, 9)] == [("NEUTRAL", 0.5)] * 2
    train = reviews.filter("review is not null and label is not null").withColumn("label", (F.col("label") == "pos").cast("double"))
    fitted = models.train_classifiers(train, models.text_stages(dims=256), {"logistic": LogisticRegression(regParam=0.01), "again": LogisticRegression(regParam=0.1)})
    scorer = sentiment.FittedScorer(sentiment.pipeline_probabilities(fitted["logistic"]), ["NEGATIVE", "POSITIVE"])
    got = {r["review_id"]: r["label"] for r in sentiment.score_sentiment(reviews, scorer).collect()}
    assert (got[1], got[5], got[7]) == ("POSITIVE", "NEGATIVE", "NEUTRAL")
