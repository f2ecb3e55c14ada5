"""The trigram detector: held-out accuracy, plain counts, odd texts."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewscope.operators import cleaning, languages

SF = "/root/testdata/sf0.01"


def cells(text):
    plain = " " + re.sub(r"[^a-zà-ÿ]+", " ", (text or "").lower()).strip() + " "
    p = list(map(ord, plain))
    return [(p[i] * 961 + p[i + 1] * 31 + p[i + 2]) % languages.CELLS for i in range(len(p) - 2)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    test = F.col("doc_id") % 4 == 1
    model = languages.train_languages(docs.filter(~test), text="text")
    right = docs.filter(test).select((model.detect("text")["language"] == F.col("lang")).cast("int").alias("ok"))
    accuracy, n = right.agg(F.avg("ok"), F.count("ok")).first()
    assert n > 200 and accuracy > 0.95
    # Single short reviews, which lists of function words cannot tell.
    short = docs.filter(test).select("lang", F.expr("array_join(slice(split(text, ' '), 3, 6), ' ')").alias("text"))
    assert short.select((model.detect("text")["language"] == F.col("lang")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0] > 0.9


ROWS = [("the cat sat on the mat, then the hat", "en"), ("der hund und die katze", "de"), ("le chien à côté", "it's \\ fr"), (None, "en"), ("!!", "de"), ("x", None), ("the hat", "en")]


def test_weights_and_sums(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "review string, lang string, review_id int")
    model = languages.train_languages(df)
    counts = defaultdict(Counter)
    for text, lang in ROWS:
        if lang:
            counts[lang].update(cells(text))
    assert list(model.weights) == sorted(counts)
    for lang, seen in counts.items():
        total = sum(seen.values()) + languages.CELLS
        assert model.weights[lang] == [round(math.log((seen[i] + 1) / total) * languages.UNIT) for i in range(languages.CELLS)]
    got = {r["review_id"]: r["d"] for r in df.select("review_id", model.detect("review").alias("d")).collect()}
    for i, (text, _) in enumerate(ROWS):
        own = cells(text)
        if not own:
            assert got[i] is None
            continue
        sums = sorted(((-sum(model.weights[k][c] for c in own), k) for k in model.weights))
        assert got[i]["language"] == sums[0][1]
        assert got[i]["margin"] == pytest.approx((sums[1][0] - sums[0][0]) / languages.UNIT / len(own))
    kept = cleaning.language_filter(df, lang="it's \\ fr", model=model)
    assert [r["review_id"] for r in kept.collect()] == [i for i in got if got[i] and got[i]["language"] == "it's \\ fr"] and got[2]["language"][-2:] == "fr"


def test_nothing_or_one_language(spark):
    df = spark.createDataFrame([("some text", "en")], "review string, lang string")
    nothing = languages.train_languages(df.limit(0))
    assert df.select(nothing.detect("review")["language"]).first()[0] is None
    one = languages.train_languages(df)
    assert tuple(df.select(one.detect("review").alias("d")).first()["d"]) == ("en", None)
