import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewscope.functions import text as ft
from reviewscope.functions.stemmer import stem
from reviewscope.operators import aspects, cleaning, text_models

TEXT = st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40)


def column(spark, values, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("x"))
    return [r["x"] for r in sorted(df.collect())]


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=60))
def test_repair_text_equals_the_codec_round_trip(spark, values):
    values += ["Canâ€™t stop", "plain", "it's", "é", "naÃ¯ve", "\x81\x8d", "日本 ok", "Ã", "â€", "😀'"]
    want = [v.encode("cp1252", errors="replace").decode("utf-8", errors="replace").replace("'", "") for v in values]
    assert column(spark, values, ft.repair_text) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aBz éÉ1_-.'ß中 \n", max_size=30), min_size=10, max_size=40))
def test_normalise_tokens_equals_the_pattern(spark, values):
    def expected(v):
        words = re.findall(r"\b[a-zA-Z]+\b", v.lower())
        return " ".join(words) if len(words) >= 3 else None

    assert column(spark, values, ft.normalise_tokens) == [expected(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab é_ .", max_size=14), min_size=10, max_size=40))
def test_any_word_equals_word_boundaries(spark, values):
    words = ["a b", "b", "ab"]
    want = [any(re.search(rf"\b{w}\b", v) for w in words) for v in values]
    assert column(spark, values, lambda c: c.rlike(ft.any_word(words))) == want


def test_keywords_per_game_match_like_a_dictionary(spark):
    df = spark.createDataFrame(
        [(1, "g", "C++ is fun."), (2, "g", "funny c"), (3, "h", "fun c++")], "review_id long, game_id string, review string"
    )
    words = spark.createDataFrame([("g", "x", ["fun"]), ("g", "y", ["c++"]), ("g", "z", [])], "game_id string, aspect string, keywords array<string>")
    got = {r["review_id"]: r["aspects"] for r in aspects.tag_aspects(df, words).collect()}
    assert got == {1: ["x", "y"], 2: [], 3: []}
    fixed = aspects.tag_aspects(df, {"x": ["fun"], "y": ["c++"]}).collect()
    assert {r["review_id"]: r["aspects"] for r in fixed}[1] == ["x", "y"]


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="votes_up"):
        cleaning.clean_reviews(spark.range(1).withColumn("review", F.lit("x")))


def test_numbers_and_blanks(spark):
    values = ["3", "x", "NaN", None, "1e2", " 7 "]
    from reviewscope.functions.numeric import to_number

    assert column(spark, values, to_number) == [3.0, 0.0, 0.0, 0.0, 100.0, 7.0]
    assert column(spark, ["", " \t", None, "　", "a"], ft.is_blank) == [True, True, True, True, False]


def test_language_guess(spark):
    values = ["the cat is in the house", "le chat est dans la maison", "der Hund ist nicht da", "xyz"]
    assert column(spark, values, ft.guess_language) == ["en", "fr", "de", None]


def test_stemmer_published_examples(spark):
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
        "rational": "ration", "formaliti": "formal", "electrical": "electr", "goodness": "good",
        "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controlling": "control",
        "stories": "stori", "sky": "sky", "rate": "rate", "roll": "roll",
    }
    assert {w: stem(w) for w in pairs} == pairs
    got = column(spark, ["The stories are adorable"], text_models.stem_and_stop)
    assert got == ["stori ador"]


def test_stems_pass_as_text_not_as_lists(spark):
    from pyspark.sql import functions as F

    from reviewscope.operators import text_models

    df = spark.createDataFrame([(1, "Running runs, the ponies 7x"), (2, ""), (3, None), (4, "the of")], "i int, review string")
    stemmed = df.select("i", text_models.stem_and_stop(F.col("review")).alias("s"))
    assert dict(stemmed.collect()) == {1: "run run poni", 2: "", 3: None, 4: ""}
    plan = stemmed._jdf.queryExecution().optimizedPlan().toString()
    assert "_stem_words(array_join" in plan
