"""Mixing: targets by hand, words near the targets, whole copies, odd rows, the same draw again."""

import random
import re

import pytest

from reviewscope.llm import mixing


def water(words, share=1.0, most=3.0):
    """Targets by giving and taking back until nothing is left over. words: {source: words}."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {s: 0.0 for s in order}, set(order), share * sum(words.values())
    while open_ and rest > 1e-9:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += rest * weight[s] / total
            if target[s] >= most * words[s]:
                over += target[s] - most * words[s]
                target[s] = most * words[s]
                open_.discard(s)
        rest = over
    return target


def corpus(seed=0):
    rng = random.Random(seed)
    sources = ["hot"] * 300 + ["b"] * 60 + ["ä"] * 40 + ["Z"] * 30 + [None] * 20 + [""] * 3
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 80]))), s, 1.5) for i, s in enumerate(sources)]


@pytest.mark.parametrize("slice_docs", [mixing.SLICE, 7])
def test_targets_and_taken_words(spark, slice_docs):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words double").repartition(4)
    got = mixing.allocate(df, slice_docs=slice_docs).collect()
    assert len(got) == len(rows)
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    words = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]]))
        words[source[r["doc_id"]]] = words.get(source[r["doc_id"]], 0) + r["size"]
    want, taken = water(words), {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == words[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        # Certain copies: nobody is more than one copy from another of the source.
        assert r["copies"] - int(want[s] / max(words[s], 1)) in (0, 1)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in words:
        assert abs(taken[s] - want[s]) <= 40  # half of the largest document
    again = mixing.allocate(df.repartition(2), slice_docs=slice_docs).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_repeats_rows(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words double")
    copies = {r["doc_id"]: r["copies"] for r in mixing.allocate(df).collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {k: n for k, n in copies.items() if n}


def test_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.allocate(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)
    assert [r["taken"] for r in mixing.allocate(blank).collect()] == [0, 0]
    one = spark.createDataFrame([(None, "a b c", "a"), (7, "d e", "a"), (7, "d e", "a")], schema)
    got = mixing.allocate(one).collect()
    assert sum(r["taken"] for r in got) == 7 and all(r["copies"] == 1 for r in got)


def test_inclusion_follows_the_words(spark):
    """Over many draws a document is taken in proportion to its words; those that would be taken more than once always are."""
    sizes = [1, 2, 2, 4, 4, 8, 60]
    docs = [(i, " ".join("w" * sizes[i % 7]), "a" if i < 70 else "b") for i in range(140)]
    docs = [(i, " ".join(["w"] * sizes[i % 7]), s) for i, _, s in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").cache()
    draws, taken = 8, dict.fromkeys(range(140), 0)
    for seed in range(draws):
        for r in mixing.allocate(df, seed=str(seed)).collect():
            taken[r["doc_id"]] += r["copies"]
    # Targets 5/7 and 2/7 of 1,620 words: for b 463 of its 810, and of these 10 documents of 60 words would fill 600.
    left = 2 / 7 * 1620
    c = left / sum(n * n * 10 for n in sizes)
    limit = max(n for n in sizes if c * n <= 1)
    assert limit == 60
    for n in set(sizes):
        own = [taken[i] / draws for i in range(70, 140) if sizes[i % 7] == n]
        assert sum(own) / len(own) == pytest.approx(c * n, abs=0.1)
    # For a 1,157 words: one whole copy and 347 words more.
    assert all(draws <= taken[i] <= 2 * draws for i in range(70))


def test_certain_documents(spark):
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate([1000, 900] + [10] * 30)] + [(100 + i, "x " * 600, "b") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in "123":
        got = {r["doc_id"]: r for r in mixing.allocate(df, weights=(1, 4), seed=seed).collect()}
        assert got[0]["copies"] == 1 or got[1]["copies"] == 1
        assert abs(sum(got[i]["taken"] for i in range(32)) - got[0]["target"]) <= 500
