import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewscope.config import EMOTIONS, FALLBACK_KEYWORDS
from reviewscope.operators import aspects, ensemble, features, topics
from reviewscope.operators.sentiment import lexicon_scorer, model_scorer, score_sentiment


@pytest.fixture(scope="module")
def reviews(spark):
    rng = np.random.default_rng(2)
    pools = ["story plot ending quests".split(), "music sound voice soundtrack".split(), "lag crashes bugs fps".split()]
    rows = []
    for i in range(120):
        words = list(rng.choice(pools[i % 3], 5)) + list(rng.choice(["castle", "dragon", "river"], 2))
        rows.append((i, "g" if i % 2 else "h", " ".join(words)))
    return spark.createDataFrame(rows, "review_id long, game_id string, review string").persist()


def lists(df):
    return {(r["game_id"], r["topic"]): r["words"][:3] for r in df.collect()}


def test_one_block_and_many_blocks_agree(reviews):
    whole = topics.nmf_topics(reviews, n_topics=3, max_iter=40)
    parts = topics.nmf_topics(reviews, n_topics=3, max_iter=40, block_rows=25)
    assert lists(whole.topics) == lists(parts.topics)
    pick = lambda t: {(r["game_id"], r["review_id"]): r["weights"] for r in t.weights.collect()}
    a, b = pick(whole), pick(parts)
    assert a.keys() == b.keys() and len(a) == 120
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-6, abs=1e-9)


def test_error_never_grows():
    rng = np.random.default_rng(0)
    docs, terms, k = 30, 20, 4
    dense = rng.random((docs, terms)) * (rng.random((docs, terms)) < 0.3)
    dense[:, 0] += 0.1
    lens = (dense > 0).sum(axis=1)
    rows, idx = np.nonzero(dense)
    w, h = rng.random((docs, k)), rng.random((k, terms))
    errors = [np.linalg.norm(dense - w @ h)]
    for _ in range(25):
        w, sums = topics._update_block(w, h, lens, idx, dense[rows, idx])
        h, now, before = topics._next_h(h, sums, k)
        assert before == pytest.approx(errors[-1], rel=1e-9)
        assert now == pytest.approx(np.linalg.norm(dense - w @ h), rel=1e-9)
        errors.append(now)
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))


def test_guided_keywords_are_seeds_and_floor_opens_them(reviews):
    seeds = {"content": ["story", "plot", "ending"], "audio": ["music", "voice"], "value": ["price"]}
    got = {(r["game_id"], r["aspect"]): r["keywords"] for r in topics.guided_keywords(reviews, seeds, max_iter=30).collect()}
    assert len(got) == 6
    assert set(got["g", "content"]) <= set(seeds["content"]) and got["g", "audio"]
    assert got["g", "value"] == []
    free = topics.guided_keywords(reviews, seeds, max_iter=30, floor=0.01).filter("aspect = 'value' and game_id = 'g'")
    assert free.first()["keywords"]


def test_game_without_vocabulary_falls_back_to_seeds(spark):
    df = spark.createDataFrame([(1, "g", "alone words here")], "review_id long, game_id string, review string")
    got = {r["aspect"]: r["keywords"] for r in topics.guided_keywords(df).collect()}
    assert got == {a: list(w[:FALLBACK_KEYWORDS]) for a, w in aspects.KEYWORDS.items()}


def test_vocabulary_cuts(spark):
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(["red red blue", "red green", "red green"])], "review_id long, game_id string, review string")
    counts = features.term_counts(df)
    got = {r["term"]: (r["df"], r["total"]) for r in features.vocabulary(counts, 2, 1.0).collect()}
    assert got == {"red": (3, 4), "green": (2, 2), "red green": (2, 2)}
    assert {r["term"] for r in features.vocabulary(counts, 2, 0.8).collect()} == {"green", "red green"}
    norms = features.tfidf(counts, features.vocabulary(counts, 2, 1.0)).groupBy("review_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert [r["n"] for r in norms.collect()] == pytest.approx([1.0] * 3)


def test_confidence_cuts_differ_at_the_edge(spark):
    rows = [(i, "g", "tale", [0.5, 0.2]) for i in range(3)]
    df = spark.createDataFrame(rows, "review_id long, game_id string, review string, weights array<double>")
    fixed = lambda text: F.struct(F.lit("POSITIVE").alias("label"), F.lit(0.6).alias("confidence"))
    kept = aspects.aspect_sentiment(aspects.judged_reviews(df, {"content": ["tale"]}, fixed)).first()
    assert (kept["mentions"], kept["positive"]) == (3, 3)
    empty = spark.createDataFrame([], "game_id string, topic string, words array<string>")
    assert topics.topic_sentiment(df, empty, fixed).count() == 0


def test_scorers(spark):
    df = spark.createDataFrame([(1, "good good bad"), (2, "good bad"), (3, None), (4, "bad")], "review_id long, review string")
    got = {r["review_id"]: (r["label"], r["confidence"]) for r in score_sentiment(df, lexicon_scorer(["good"], ["bad"])).collect()}
    assert got[1] == ("POSITIVE", pytest.approx(2 / 3)) and got[2] == ("NEUTRAL", 0.5) and got[4] == ("NEGATIVE", 1.0)
    assert score_sentiment(df, None).select("label").distinct().collect()[0][0] == "NEUTRAL"

    def make():
        return lambda texts: {"label": np.array(["POSITIVE" if "good" in t else "NEGATIVE" for t in texts]), "confidence": np.full(len(texts), 0.9)}

    own = score_sentiment(df.filter("review is not null"), model_scorer(make, batch_size=2)).collect()
    assert {r["review_id"]: r["label"] for r in own} == {1: "POSITIVE", 2: "POSITIVE", 4: "NEGATIVE"}


def test_a_scorer_that_raises_on_one_text_scores_the_rest(spark):
    df = spark.createDataFrame([(i, "bomb" if i == 3 else f"text {i}") for i in range(8)], "review_id long, review string").coalesce(1)

    def make():
        def run(texts):
            if "bomb" in list(texts):
                raise RuntimeError("cannot")
            return {"label": np.array(["POSITIVE"] * len(texts)), "confidence": np.full(len(texts), 0.9)}

        return run

    got = {r["review_id"]: (r["label"], r["confidence"]) for r in score_sentiment(df, model_scorer(make, batch_size=4)).collect()}
    assert got.pop(3) == ("NEUTRAL", 0.5) and set(got.values()) == {("POSITIVE", 0.9)}

    def logits():
        def run(texts):
            if "bomb" in list(texts):
                raise RuntimeError("cannot")
            return np.tile(np.arange(6.0), (len(texts), 1))

        return run

    scored = ensemble.score_models(df, {m: ensemble.model_scorer(logits, batch_size=4)(F.col("review")) for m in "abc"})
    joint = {r["review_id"]: (r["emotion"], r["confidence"]) for r in ensemble.ensemble(scored).collect()}
    assert joint.pop(3) == ("unknown", 0.0) and {e for e, _ in joint.values()} == {EMOTIONS[5]}


def test_full_and_sparse_products_of_a_block_agree():
    rng = np.random.default_rng(5)
    dense = np.where(rng.random((30, 40)) < 0.2, rng.random((30, 40)), 0.0)
    dense[:, 0] = 1.0
    lens, idx = (dense > 0).sum(axis=1).astype(np.int32), np.nonzero(dense)[1].astype(np.int32)
    block = topics._packed_block(lens.tobytes(), idx.tobytes(), dense[dense > 0].tobytes(), 40)
    h, w = rng.random((3, 40)), rng.random((30, 3))
    assert block.full is not None
    products = block.by_topics(h), block.by_reviews(w, 40)
    block.full = None
    for got, same, want in zip((block.by_topics(h), block.by_reviews(w, 40)), products, (dense @ h.T, w.T @ dense)):
        assert np.allclose(got, want) and np.allclose(same, want)


def test_games_of_many_blocks_that_fit_into_a_task_need_no_rounds(reviews, monkeypatch):
    apart = topics.nmf_topics(reviews, n_topics=3, max_iter=40, block_rows=25, alone=0)
    want = {r["review_id"]: r["weights"] for r in apart.weights.collect()}
    words = lists(apart.topics)
    monkeypatch.setattr(topics, "_fit_together", None)
    whole = topics.nmf_topics(reviews, n_topics=3, max_iter=40, block_rows=25)
    got = {r["review_id"]: r["weights"] for r in whole.weights.collect()}
    assert got.keys() == want.keys() and len(got) == 120 and lists(whole.topics) == words
    assert all(got[i] == pytest.approx(want[i], rel=1e-6, abs=1e-9) for i in got)


def test_only_larger_games_are_fitted_in_rounds(spark, reviews, monkeypatch):
    small = reviews.filter("game_id = 'h' and review_id < 60")
    both = reviews.filter("game_id = 'g'").unionByName(small)
    seen, together = [], topics._fit_together
    monkeypatch.setattr(topics, "_fit_together", lambda state, *rest: seen.append({r[0] for r in state.select("game_id").collect()}) or together(state, *rest))
    mixed = topics.nmf_topics(both, n_topics=3, max_iter=20, block_rows=10, alone=350)
    assert seen == [{"g"}] and mixed.weights.count() == 90


def test_pieces_of_a_block_give_what_the_block_gives(monkeypatch):
    rng = np.random.default_rng(7)
    dense = np.where(rng.random((31, 40)) < 0.3, rng.random((31, 40)), 0.0)
    dense[:, 0] = 1.0
    lens, idx = (dense > 0).sum(axis=1).astype(np.int32), np.nonzero(dense)[1].astype(np.int32)
    packed = lens.tobytes(), idx.tobytes(), dense[dense > 0].tobytes()
    monkeypatch.setattr(topics, "CACHED", 5 * 40)
    h, w = rng.random((3, 40)), rng.random((31, 3))
    pieces = topics._product(*packed, 40)
    assert isinstance(pieces, topics._Pieces)
    for got, want in zip(topics._updated(w, h, pieces), topics._updated(w, h, topics._packed_block(*packed, 40))):
        assert np.allclose(got, want)
    # A review id that occurs twice has its terms twice: its terms are added up in the whole block.
    twice = np.array([2, 3], dtype=np.int32).tobytes(), np.array([1, 1, 0, 1, 2], dtype=np.int32).tobytes(), np.ones(5).tobytes()
    assert isinstance(topics._product(*twice, 3), topics._Block)


def test_terms_that_a_review_has_twice_add_up():
    numbers = np.array([2], dtype=np.int32), np.array([1, 1], dtype=np.int32), np.array([0.5, 0.25])
    block = topics._Block(*numbers, terms=2)
    assert block.full.tolist() == [[0.0, 0.75]]
