"""Language ID: phrases against a plain greedy parse, odd rows, held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reviewscope.llm import language
from reviewscope.llm.queries import op5_identify_language


def plain_phrases(text: bytes, sample: bytes, block=language.BLOCK):
    """Each phrase is the longest match found anywhere in the sample, or one unknown symbol."""
    count = 0
    for at in range(0, len(text), block):
        part, i = text[at : at + block], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i : i + n + 1] in sample:
                n += 1
            count, i = count + 1, i + n
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    samples = [bytes(rng.choice(b"abcde ") for _ in range(n)) for n in (400, 900)]
    texts = ["".join(rng.choice("abcdez ") for _ in range(n)) for n in (1, 2, 255, 256, 257, 700, 3000)] + ["", "q", samples[0].decode()[50:350]]
    one = language.Identifier(language.Model(["x", "y"], samples))
    raw, ends = language.symbols(pa.array(texts))
    pieces = [raw[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
    for k, sample in enumerate(samples):
        walker = one.walkers[k]
        for piece in pieces:
            got = 0
            for at in range(0, len(piece), language.BLOCK):
                codes = one.code[np.frombuffer(piece[at : at + language.BLOCK], dtype=np.uint8)].astype(np.int32)
                got += int(walker.phrases(codes[:, None])[0])
            assert got == plain_phrases(piece, sample)
    # A batch gives what each text gives alone.
    lang, score = one(pa.array(texts))
    for i, t in enumerate(texts):
        (a,), b = one(pa.array([t]))
        assert (a, b[0]) == (lang[i], score[i])


def test_odd_rows(spark):
    en, de = "the cat sat on the mat and then the dog came " * 8, "der hund und die katze sind nicht hier aber dort " * 8
    rows = [(1, en, "en"), (2, de, "de"), (3, None, "en"), (4, "123 !!", None), (5, "THE CAT", None), (5, "THE CAT", None), (None, "die katze", None), (6, "", ""), (7, "é", None), (8, en * 300, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    model = language.fit(df)
    assert model.languages == ["de", "en"]
    got = language.predict(df, model).select("row.doc_id", "lang_pred", "score").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert {k: r["lang_pred"] for k, r in by.items() if k != 7} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "en", None: "de", 6: "und", 8: "en"}
    assert by[7]["lang_pred"] in ("de", "en") and all(0 <= r["score"] <= 1 for r in got) and by[4]["score"] == 0
    kept = language.identified(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 5, 7, 8]
    nothing = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.predict(df, nothing).collect()} == {"und"}
    assert sorted(r["doc_id"] or 0 for r in language.identified(df, nothing).collect()) == [0, 1, 2, 5, 5, 7, 8]
    assert language.predict(df.limit(0), model).count() == 0


def test_many_copies_of_few_texts(spark):
    texts = [f"der hund und die katze nummer {w} sind nicht hier" for w in ("eins", "zwei", "drei", "vier")]
    rows = [(texts[i % 4], "de") for i in range(40_000)] + [("the cat sat on the mat", "en")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), sample_texts=4)
    assert model.languages == ["de", "en"]
    assert all(language.symbols(pa.array([t]))[0].tobytes() in model.samples[0] for t in texts)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op5_identify_language(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n"))
    rows = {r["held_out"]: r for r in right.collect()}
    assert rows[True]["n"] > 150 and rows[True]["a"] > 0.98 and rows[False]["a"] > 0.98


def test_a_long_text_gives_a_piece(spark):
    long = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(50_000))
    rows = [(long, "de"), ("der hund und die katze", "de"), ("the cat sat", "en")] + [(f"lang {chr(97 + i)} x", f"l{i}") for i in range(26)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 28
    sample = model.samples[model.languages.index("de")]
    assert b"hund und" in sample and 2000 < len(sample) <= language.TOTAL_BYTES // 28
