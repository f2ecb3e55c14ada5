"""Tagging by one automaton against patterns per aspect."""

import random

import pytest

from reviewscope.operators import aspects

WORDS = ["ab", "b", "a b", "ab c", "c++", "é", "x_y", "9", "a.b", "the", "of the", "ſ", "ß", "日本", "日"]


@pytest.fixture(scope="module")
def reviews(spark):
    rng = random.Random(4)
    glue = [" ", "", ",", "_", "-", "1", "É", "\n", "́"]
    texts = [None, ""] + ["".join(rng.choice(WORDS + ["AB", "THE"]) + rng.choice(glue) for _ in range(rng.randrange(8))) for _ in range(400)]
    return spark.createDataFrame([(i, "gh"[i % 2], t, "old", 1) for i, t in enumerate(texts)], "review_id int, game_id string, review string, low string, row int")


def answer(df):
    return {r["review_id"]: r["aspects"] for r in df.collect()}


def test_same_as_patterns(reviews):
    dictionary = {"one": WORDS[:5], "two": WORDS[3:9], "three": WORDS[8:], "none": []}
    found = aspects.tag_aspects(reviews, dictionary, automaton=True)
    assert found.columns == [*reviews.columns, "aspects"]
    want = answer(aspects.tag_aspects(reviews, dictionary, automaton=False))
    assert {k: sorted(v) for k, v in want.items()} == answer(found) and any(want.values())
    assert not any(answer(aspects.tag_aspects(reviews, {"none": []}, automaton=True)).values())


def test_same_as_patterns_per_game(spark, reviews):
    table = spark.createDataFrame([("g", "one", WORDS[:6]), ("g", "two", WORDS[4:]), ("x", "three", WORDS), ("h", "empty", [])], "game_id string, aspect string, keywords array<string>")
    want = answer(aspects.tag_aspects(reviews, table))
    got = answer(aspects.tag_aspects(reviews, table, automaton=True))
    assert {k: sorted(v) for k, v in want.items()} == got and any(want.values())


def test_large_dictionaries_take_the_automaton(spark, reviews):
    dictionary = {"many": [f"word{i}" for i in range(600)] + ["the"], "few": ["ab"]}
    assert aspects.large(dictionary)
    judged = aspects.judged_reviews(reviews, dictionary)
    assert judged.count() > 0 and {a for r in judged.collect() for a in r["aspects"]} == {"many", "few"}
