import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewscope.config import EMOTIONS
from reviewscope.operators import emotions, ensemble

NAMES = ("a", "b", "c")
SCHEMA = "review_id long, game_id string, " + ", ".join(f"{n} array<double>" for n in NAMES)


def scored(spark, rows):
    df = spark.createDataFrame([(i, "g", *r) for i, r in enumerate(rows)], SCHEMA)
    df = ensemble.score_models(df, {n: F.col(n) for n in NAMES})
    return ensemble.confidence_cv(ensemble.disagreement(ensemble.ensemble(df)))


def soft(z):
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


def kl(p, q):
    p, q = np.clip(p, 1e-10, 1), np.clip(q, 1e-10, 1)
    return float((p * np.log(p / q)).sum())


VECTOR = st.lists(st.floats(-20, 20), min_size=6, max_size=6)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(VECTOR, VECTOR, VECTOR), min_size=5, max_size=15))
def test_ensemble_and_divergence_equal_the_formulas(spark, rows):
    for row in scored(spark, rows).collect():
        ps = [soft(z) for z in rows[row["review_id"]]]
        p1, p2, p3 = ps
        pen = 0.3 * ((p1 - p2) ** 2 + (p2 - p3) ** 2 + (p3 - p1) ** 2) / 3
        f = np.maximum((p1 + p2 + p3) / 3 - pen, 0)
        f = f / (f.sum() + 1e-8)
        assert row["probs"] == pytest.approx(f.tolist(), abs=1e-12)
        assert row["confidence"] == pytest.approx(f.max(), abs=1e-12)
        assert row["disagreement_penalty"] == pytest.approx(pen.sum(), abs=1e-12)
        m = np.mean(ps, axis=0)
        jsd = sum(kl(p, m) for p in ps) / 3 / np.log(3)
        assert row["jsd"] == pytest.approx(jsd, abs=1e-9) and -1e-9 <= row["jsd"] <= 1 + 1e-9
        c = [p.max() for p in ps]
        assert row["confidence_variance"] == pytest.approx(np.var(c, ddof=1), abs=1e-12)
        assert row["confidence_cv"] == pytest.approx(np.std(c) / (np.mean(c) + 1e-10), abs=1e-12)


def test_missing_models(spark):
    z = [3.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    three, two, one, none = scored(spark, [(z, z, z), (z, None, z), (None, z, None), (None, None, None)]).orderBy("review_id").collect()
    assert three["jsd"] == pytest.approx(0.0, abs=1e-12) and three["agreement"] == 1.0
    assert two["emotion"] == "joy" and len(two["models"]) == 2 and two["jsd"] == pytest.approx(0.0, abs=1e-12)
    p = soft(z)
    f = np.maximum(2 * p / 3 - 0.3 * 2 * p**2 / 3, 0)
    assert two["probs"] == pytest.approx((f / (f.sum() + 1e-8)).tolist())
    for row in (one, none):
        assert (row["emotion"], row["confidence"], row["agreement"], row["jsd"]) == ("unknown", 0.0, None, 0.0)


def test_agreement_levels(spark):
    one = lambda i: [9.0 if j == i else 0.0 for j in range(6)]
    rows = scored(spark, [(one(0), one(0), one(1)), (one(0), one(1), one(2))]).orderBy("review_id").collect()
    assert [r["agreement"] for r in rows] == pytest.approx([2 / 3, 1 / 3])
    assert [r["uncertainty"] for r in rows] == ["high", "high"]
    stats = emotions.disagreement_rate(scored(spark, [(one(0), one(0), one(1)), (one(0), one(0), one(0))])).first()
    assert (stats["disagreement_count"], stats["disagreement_rate"]) == (1, 0.5)


def preds(spark, rows):
    return spark.createDataFrame([(i, "g", e, float(c), float(j)) for i, (e, c, j) in enumerate(rows)], "review_id long, game_id string, emotion string, confidence double, jsd double")


def test_band_edges(spark):
    df = preds(spark, [("joy", 0.0, 0), ("joy", 0.6, 0), ("joy", 0.8, 0), ("love", 0.81, 0), ("unknown", 0.0, 0)])
    got = {r["band"]: r.asDict() for r in emotions.band_by_emotion(df).collect()}
    assert [got[b]["joy"] for b in emotions.BANDS] == [1, 1, 0]
    assert got["High (>0.8)"]["love"] == 1 and sum(got[b]["unknown"] for b in got) == 0


def test_unknown_stays_in_every_denominator(spark):
    df = preds(spark, [("joy", 0.9, 0), ("unknown", 0.0, 0), ("fear", 0.5, 0), ("fear", 0.5, 0)])
    got = {r["emotion"]: r["pct"] for r in emotions.emotion_distribution(df).collect()}
    assert got == {"joy": 25.0, "unknown": 25.0, "fear": 50.0}
    val = emotions.valence(df).first()
    assert (val["positive_pct"], val["negative_pct"], val["dominant_emotion"]) == (25.0, 50.0, "fear")


def test_sample_is_exact_and_layout_free(spark):
    df = preds(spark, [("joy", 0.5, 0)] * 400)
    a = {r["review_id"] for r in emotions.sample_reviews(df.repartition(1), 50).collect()}
    b = {r["review_id"] for r in emotions.sample_reviews(df.repartition(16), 50).collect()}
    assert len(a) == 50 and a == b
    assert emotions.sample_reviews(df, 5000).count() == 400


def test_boxplot_whiskers(spark):
    values = [0.1, 0.2, 0.2, 0.3, 0.3, 0.4, 0.95]
    row = emotions.jsd_boxplot(preds(spark, [("joy", 0.5, v) for v in values])).first()
    assert (row["whisker_low"], row["whisker_high"]) == (0.1, 0.4)
    assert row["median"] == pytest.approx(0.3)


def test_a_filter_on_the_prediction_stays_cheap(spark):
    """A filter is pushed below the ensemble; the plan must not multiply."""
    df = scored(spark, [([1.0] * 6, [2.0] * 6, [3.0] * 6)]).filter("confidence > 0 and jsd >= 0")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert df.count() == 1


def test_labels_keep_their_order():
    assert EMOTIONS == ("joy", "sadness", "anger", "fear", "surprise", "love")
