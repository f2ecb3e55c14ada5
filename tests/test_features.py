"""Counting of terms in pieces, against counting by hand."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from reviewscope.operators import features, grouping

WORDS = [*"abcdefgh", "ß", "日本"]


def texts(n: int, seed: int = 7) -> list[tuple]:
    rnd = random.Random(seed)
    # Ids repeat, some games are missing, some texts are missing or have a single word.
    return [
        (rnd.choice(["g", "h", None]), i // 2, rnd.choice([None, " ".join(rnd.choices(WORDS, range(20, 10, -1), k=rnd.randint(1, 12)))]))
        for i in range(n)
    ]


def terms_of(text, words=True, phrases=True) -> list[str]:
    w = (text or "").split()
    return (w if words else []) + ([f"{a} {b}" for a, b in zip(w, w[1:])] if phrases else [])


def batch_of(rows) -> pa.RecordBatch:
    games, ids, words = zip(*rows)
    columns = [pa.array(games, pa.string()), pa.array(ids, pa.int64()), pa.array(words, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["game_id", "review_id", "words"])


def summed(batches) -> dict:
    out = defaultdict(lambda: [0, 0])
    for r in (r for b in batches for r in b.to_pylist()):
        out[r["game_id"], r["term"]][0] += r["df"]
        out[r["game_id"], r["term"]][1] += r["total"]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
@pytest.mark.parametrize("listed", [None, {"g": ["a", "b", "a b", "ß 日本", "x y"], "other": ["c"]}])
def test_rows_in_pieces(monkeypatch, piece, listed):
    monkeypatch.setattr(features, "PIECE", piece)
    rows = texts(60)
    want = Counter()
    for g, i, t in rows:
        for term, n in Counter(terms_of(t)).items():
            if listed is None or term in listed.get(g, ()):
                want[g, i, term, n] += 1
    got = Counter((r["game_id"], r["review_id"], r["term"], r["tf"]) for b in features._rows(listed)([batch_of(rows)]) for r in b.to_pylist())
    assert got == want


def test_rows_come_in_the_order_of_terms():
    (out,) = features._rows(None)([batch_of([("g", 2, "b a ß b"), ("g", 1, "c")])])
    assert out.column("term").to_pylist() == ["a", "a ß", "b", "b a", "ß", "ß b", "c"]


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
@pytest.mark.parametrize("phrases", [False, True])
def test_totals_in_pieces(monkeypatch, piece, phrases):
    monkeypatch.setattr(features, "PIECE", piece)
    rows, frequent = texts(60), {"g": ["a", "b"]}
    want = defaultdict(lambda: [0, 0])
    for g, _, t in rows:
        for term, n in Counter(terms_of(t, not phrases, phrases)).items():
            if not phrases or g != "g" or set(term.split()) <= {"a", "b"}:
                want[g, term][0] += 1
                want[g, term][1] += n
    got = summed(features._totals(phrases, frequent)([batch_of(rows)]))
    assert got == {k: tuple(v) for k, v in want.items()}


@pytest.mark.parametrize("size", [3, 8, 1000])
def test_vocabulary_keeps_phrases_above_the_floor(spark, size):
    rows = [(g, i, t and t.replace("ß", "ßß")) for g, i, t in texts(300)]
    rows = [(g, i, t and " ".join(w * 2 for w in t.split())) for g, i, t in rows]
    counts = features.term_counts(spark.createDataFrame(rows, "game_id string, review_id long, review string"), stop_words=())
    got = {(r["game_id"], r["rank"]): (r["term"], r["df"], r["total"], r["docs"]) for r in features.vocabulary(counts, 2, 0.3, size).collect()}
    want = {}
    for game in ("g", "h"):
        own = [t for g, _, t in rows if g == game]
        df, total = Counter(), Counter()
        for t in own:
            total.update(terms_of(t))
            df.update(set(terms_of(t)))
        kept = sorted((t for t in df if 2 <= df[t] <= len(own) * 0.3), key=lambda t: (-total[t], t.encode()))[:size]
        want |= {(game, k): (t, df[t], total[t], len(own)) for k, t in enumerate(kept, 1)}
    assert got == want


def test_few_phrases_leave_a_task(spark):
    """Of a game with enough frequent words, phrases of rarer words are not shuffled."""
    rows = [("g", i, f"often{i % 3} often{i % 2} rare{i} seldom{i}") for i in range(60)]
    counts = features.term_counts(spark.createDataFrame(rows, "game_id string, review_id long, review string"))
    listed = {"g": ["often0", "often1", "often2"]}
    found = {r["term"] for r in features.term_totals(counts, True, listed).collect()}
    assert found == {f"often{i % 3} often{i % 2}" for i in range(6)}


def weights_of(rows, vocab) -> dict:
    """(game, id) -> {term: weight}, over all rows of an id."""
    found = defaultdict(Counter)
    for g, i, t in rows:
        for term in terms_of(t):
            if (g, term) in vocab:
                found[g, i][term] += vocab[g, term]
    return {k: {t: w / math.sqrt(sum(x * x for x in own.values())) for t, w in own.items()} for k, own in found.items()}


def weighed(spark, rows):
    counts = spark.createDataFrame(rows, "game_id string, review_id long, words string").repartition(3)
    vocab = spark.createDataFrame(
        [("g", "a", 2, 5, 1), ("g", "a b", 3, 5, 2), ("g", "ß", 1, 5, 3), ("h", "b", 4, 9, 1), ("h", "c", 2, 9, 2), ("h", "日本 c", 1, 9, 3)],
        "game_id string, term string, df long, docs long, rank int",
    )
    idf = {(r.game_id, r.term): math.log((r.docs + 1) / (r.df + 1)) + 1 for r in vocab.collect()}
    ranks = {(r.game_id, r.term): r["rank"] for r in vocab.collect()}
    return counts, vocab, idf, ranks


@pytest.mark.parametrize("piece", [1, 1 << 20])
@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("limit", [200_000, 10, 2])
def test_weights(spark, monkeypatch, piece, repeated, limit):
    """Reviews whose id comes once are weighed in their task, others together, null ids too; also where no side is small."""
    monkeypatch.setattr(features, "PIECE", piece)
    monkeypatch.setattr(grouping, "BROADCAST_ROWS", limit)
    rows = [(g, i, t and " ".join(w if w in WORDS else "a" for w in t.split())) for g, i, t in texts(80)]
    if repeated:
        # A row of terms belongs to one of the rows of its id, so no term occurs in two of them here.
        rows = [("g", 1, "a a"), ("g", 1, "ß"), ("h", 1, "b"), ("g", None, "a"), ("g", None, "ß ß"), *[(g, 100 + k, t) for k, (g, _, t) in enumerate(rows)]]
    else:
        rows = [(g, k or None, t) for k, (g, _, t) in enumerate(rows)]
    counts, vocab, idf, ranks = weighed(spark, rows)
    want = weights_of(rows, idf)
    got = defaultdict(dict)
    for r in features.tfidf(counts, vocab).collect():
        assert r["term"] not in got[r.game_id, r.review_id] and r["rank"] == ranks[r.game_id, r.term]
        got[r.game_id, r.review_id][r.term] = r.weight
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    lists = {(r.game_id, r.review_id): [(x.i, x.v) for x in r.t] for r in features.tfidf_lists(counts, vocab).collect()}
    assert lists == {k: sorted((ranks[k[0], t] - 1, w) for t, w in own.items()) for k, own in got.items()}


def test_weights_are_finished_in_their_task(spark):
    counts, vocab, _, _ = weighed(spark, [("g", 1, "a b a"), ("h", 1, "b"), ("h", 2, None)])
    counts, vocab = counts.coalesce(1).localCheckpoint(), vocab.localCheckpoint()
    for found in (features.tfidf(counts, vocab), features.tfidf_lists(counts, vocab)):
        plan = found._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and not any(step in plan for step in ("Exchange", "Window", "Join"))


def test_words_of_too_few_reviews_are_not_kept(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(features, "stored", lambda df, name: kept.setdefault(name, df.localCheckpoint()))
    rows = [("g", i, f"often rare{i} rare{i}") for i in range(5)]
    counts = features.term_counts(spark.createDataFrame(rows, "game_id string, review_id long, review string"))
    assert [r.term for r in features.vocabulary(counts, 2, 1.0).collect()] == ["often"]
    assert [r.term for r in kept["word-totals"].collect()] == ["often"]


def test_games_lie_together_in_a_file(spark):
    rows = [(f"g{i % 3}", i, "word") for i in range(90)]
    stored = features.stored_counts(spark.createDataFrame(rows, "game_id string, review_id long, review string").coalesce(1))
    games = [r.game_id for r in stored.coalesce(1).collect()]
    assert games == sorted(games) and len(games) == 90
