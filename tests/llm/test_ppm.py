"""PPM and word scores against a model that walks dictionaries, and sums of probabilities."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reviewscope.llm import ppm
from reviewscope.llm.queries import op4_score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def stream(text, order):
    return [ppm.END] * order + list(" ".join(WORD.findall(lower(text))).encode()) + [ppm.END]


def plain_counts(texts, order):
    counts = defaultdict(Counter)
    for text in texts:
        s = stream(text, order)
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[tuple(s[i - j : i])][s[i]] += 1
    return counts


def plain_log(counts, context, symbol):
    """log10 probability, by sets of excluded symbols."""
    excluded, total = set(), 0.0
    started = False
    for j in range(len(context), -1, -1):
        c = tuple(context[len(context) - j :])
        if c not in counts:
            assert not started
            continue
        started = True
        left = {s: n for s, n in counts[c].items() if s not in excluded}
        if symbol in left:
            return total + math.log10(left[symbol] / (sum(left.values()) + len(left)))
        if left:
            total += math.log10(len(left) / (sum(left.values()) + len(left)))
        excluded |= set(left)
    return total - math.log10(256 - len(excluded))


def plain_base(texts, train):
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    counts = Counter(w for t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [
        (len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)))
        for t in texts
    ]


TEXTS = [
    "the cat sat on the mat", "The  dog\tsat\n", None, "", "   ", "the the the", "zebra quux", "été à la mer", "abcabcabcabd", "the cat sat on the mat",
    " leading and trailing ", "a", "\x00\x01 odd ÿ 　 bytes", "word " * 3000,
]


@pytest.mark.parametrize("words", [1 << 20, 4])
def test_made(spark, words):
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(TEXTS)] + [(None, "null key", False), (1, TEXTS[1], False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hold boolean").repartition(3)
    got = sorted(map(tuple, ppm.score(df, df["hold"], words=words).collect()), key=repr)
    train = [t for _, t, h in rows if not h]
    counts = plain_counts(train, ppm.ORDER)
    n, base = plain_base([t for _, t, _ in rows], train)
    want = []
    for (k, t, h), (tokens, known, score) in zip(rows, base):
        s = stream(t, ppm.ORDER)
        logs = sum(plain_log(counts, s[i - ppm.ORDER : i], s[i]) for i in range(ppm.ORDER, len(s)))
        want.append((k, h, tokens, known, n, score, logs))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


@pytest.mark.parametrize("nodes", [1, 50])
def test_grams_that_are_not_sent_count_too(spark, nodes):
    texts = [t for t in TEXTS if t and len(t) < 100] * 2 + ["the cat sat on a hat", "xyzzy the mat", "abcabd été"]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hold boolean").repartition(3)
    got = {r["doc_id"]: r["score"] for r in ppm.score(df, df["hold"], nodes=nodes).collect()}
    counts = plain_counts([t for _, t, h in rows if not h], ppm.ORDER)
    for i, t, _ in rows:
        s = stream(t, ppm.ORDER)
        assert got[i] == pytest.approx(sum(plain_log(counts, s[k - ppm.ORDER : k], s[k]) for k in range(ppm.ORDER, len(s))), rel=1e-9)


def test_probabilities_add_up(spark):
    """All 256 symbols after contexts that were seen whole, in part or not at all."""
    order = 3
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    levels = ppm.level_rows(ppm.counted(df, order).filter("kind = 0").select("key", "n"), order).cache()
    contexts = ppm.context_rows(levels).cache()
    asked = np.unique(ppm.streams(pa.array(["the cat sat", "quiet abcab", "ünseen"]), order)[0] >> np.uint64(8))
    grams = spark.createDataFrame([(int(c) << 8 | s,) for c in asked for s in range(256)], "gram long")
    logs = ppm.seen_logs(levels, contexts, order).select("gram", "log")
    logs = logs.join(grams, "gram").unionByName(ppm.unseen_logs(grams.join(logs, "gram", "left_anti"), levels, contexts, order)).toPandas()
    assert len(logs) == 256 * len(asked)
    assert (10**logs["log"]).groupby(logs["gram"] // 256).sum().to_numpy() == pytest.approx(np.ones(len(asked)), abs=1e-9)


def test_words_that_a_polynomial_modulo_two_powers_confuses(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    df = spark.createDataFrame([(1, one, False), (2, other, True)], "doc_id long, text string, hold boolean")
    got = {r["doc_id"]: r["n_known"] for r in ppm.score(df, df["hold"]).collect()}
    assert got == {1: 2, 2: 1}


def test_clashing_columns(spark):
    schema = "doc_id long, text string, key int, row string, grams int, n_tokens string, held_out string"
    df = spark.createDataFrame([(1, "a b", 1, "x", 2, "y", "z"), (2, "a c", 1, "x", 2, "y", "z")], schema)
    got = sorted(tuple(r)[:4] for r in ppm.score(df, df["doc_id"] == 2).collect())
    assert got == [(1, False, 3, 3), (2, True, 3, 2)]


def test_query_beats_shorter_contexts_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = op4_score_documents(spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    n, base = plain_base([docs[r["doc_id"]] for r in rows], [docs[r["doc_id"]] for r in rows if not r["held_out"]])
    for r, want in zip(rows, base):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[:2], n) and r["base_score"] == pytest.approx(want[2])
    df = spark.read.parquet(f"{sf}/documents.parquet")
    short = ppm.score(df, df["doc_id"].isin([r["doc_id"] for r in rows if r["held_out"]]), order=1).collect()
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["score"] for r in short if r["held_out"])


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert ppm.score(empty, empty["doc_id"] > 0).count() == 0
    df = spark.createDataFrame([(1, "ab")], schema)
    (row,) = ppm.score(df, df["doc_id"] > 0).collect()
    assert row["n_known"] == 0 and row["train_tokens"] == 0
    assert row["base_score"] == pytest.approx(0) and row["score"] == pytest.approx(-3 * math.log10(256))
