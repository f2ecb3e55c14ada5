"""Source divergence audit against plain loops, with digests that are distinct, shared by some terms, and shared by all."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewscope.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least, top=divergence.TOP):
    """rows: (text, lang, source)."""
    rows = [(terms(t), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        own = [(ts, s) for ts, g, s in rows if g == lang]
        kept = {t for t, n in Counter(t for ts, _ in own for t in set(ts)).items() if n >= least}
        count = defaultdict(Counter)
        for ts, s in own:
            count[s].update(t for t in ts if t in kept)
            count[None].update(t for t in ts if t in kept)

        def p(s):
            below = sum(count[s].values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[s][t] + 2) // below for t in kept}

        ps = {s: p(s) for s in count}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in ps.keys() - {None}:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in ps.keys() - {None, s}]
            words = [(t, f(ps[s][t], ps[None][t])) for t in kept if count[s][t] and ps[s][t] > ps[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return sorted(out)


ROWS = (
    [("The cat SAT on the mat; été ÉTÉ", "en", "a")] * 4
    + [("a dog sat on a mat 12x", "en", "b")] * 3
    + [("cat cat cat dog", "en", None), ("", "en", "none"), (None, "en", "null"), ("rare words only", "en", "rare")]
    + [("le chat été", "fr", "a")] * 2
    + [("le chien \x00 noir", "fr", "a"), ("vu par nul autre", "xx", "only"), ("le", None, None), ("le", None, "b")]
    + [(" ".join(f"w{chr(97 + i)}" for i in range(26)), "ties", s) for s in "aab"]
    + [("word " * 40_000 + "wa", "ties", "long")]
)


@pytest.mark.parametrize("digest", [F.xxhash64, lambda t: F.xxhash64(t) % 5, lambda t: F.length(t) * 0])
@pytest.mark.parametrize("least", [1, 2])
def test_made(spark, digest, least):
    schema = "text string, lang string, source string, term string, digest int, n int, split string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in ROWS], schema).repartition(5)
    got = divergence.audit(df, least=least, digest=lambda t: digest(t).cast("long"))
    assert got.columns == divergence.OUT
    assert sorted(map(tuple, got.collect())) == brute(ROWS, least)


def test_tasks_that_give_up_their_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    df = spark.createDataFrame(ROWS, "text string, lang string, source string").coalesce(1)
    assert sorted(map(tuple, divergence.audit(df, least=2).collect())) == brute(ROWS, 2)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(4_000_000_000_000, 9_000_000_000_000, 3)], "c long, n long, v long")
    (got,) = df.select(divergence.probability(F.col("c"), F.col("n"), F.col("v"))).first()
    assert got == 1 + 10**9 * (4_000_000_000_002) // (9_000_000_000_006)
