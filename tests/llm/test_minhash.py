"""MinHash near-dedup against all pairs."""

import random
import re

import pyarrow as pa
import pytest

from reviewscope.llm import minhash
from reviewscope.llm.queries import op10_minhash_dedup


def brute(rows, width, percent):
    """{position: (n, component)} from all pairs of exact word n-gram sets."""
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted((i for i in range(len(rows)) if sets[i]), key=lambda i: len(sets[i]))
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def answer(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


def made(seed=1):
    """Groups of near copies, a chain, a passage that many share, odd rows."""
    rng, out = random.Random(seed), []
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 90))]
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    chain = [word() for _ in range(80)]
    for _ in range(10):
        chain = [*chain[3:], word(), word(), word()]
        out.append("\n".join(chain))
    for _ in range(40):
        out.append(" ".join([*passage, *(word() for _ in range(rng.randrange(5, 60)))]))
    out += [None, "", " \t\n", "one", "ONE", "Two words", "two\twords", "é É", "x " * 4000, "x " * 5000]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("how", [{}, {"crowd": 300}, {"members": 2}])
def test_made(spark, how):
    rows = made()
    df = spark.createDataFrame([(k, t, "a") for k, t in rows], "doc_id long, text string, node string").repartition(3)
    assert answer(minhash.classes(df, width=4, **how)) == sorted(brute(rows, 4, 80), key=repr)


def test_shared_passage_is_no_prefix(spark):
    """Documents that share less than a prefix allows join with none; near copies among them still do."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"d{d}w{i}" for i in range(60)) + " " + passage for d in range(6)]
    texts.append(texts[0] + " more")
    sets = minhash.text_sets(pa.array(texts), 4)
    rows = [(bytes([i]), len(s), bytes([i]), t) for i, (s, t) in enumerate(zip(sets, texts))]
    df = spark.createDataFrame(rows, "node binary, n long, root binary, text string")
    got = minhash.crowded_pairs(df.select("node", "n", "root"), df.select("node", "text"), 4, 80).collect()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in got] == [(b"\x00", b"\x06")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert answer(op10_minhash_dedup(spark, sf)) == sorted(brute(rows, 4, 80), key=repr)


def test_null_keys_repeats_empty(spark):
    schema = "doc_id long, text string, n int, node string"
    assert minhash.classes(spark.createDataFrame([], schema)).count() == 0
    long = "a b c d e f g h"
    rows = [(None, long, 1, "x"), (3, long, 2, "y"), (3, long, 2, "y"), (None, "other words", 3, "z"), (4, None, 4, "n")]
    df = spark.createDataFrame(rows, schema)
    assert answer(minhash.classes(df, width=4)) == sorted(brute([r[:2] for r in rows], 4, 80), key=repr)
    left = [tuple(r) for r in minhash.deduplicate(df).collect()]
    assert sorted(left, key=repr) == sorted([(3, long, 2, "y"), (None, "other words", 3, "z"), (4, None, 4, "n")], key=repr)


def test_deduplicate_leaves_one_of_each(spark):
    rows = made(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(k for k, n, c in brute(rows, 5, 80) if k == c)
    assert sorted(r["doc_id"] for r in minhash.deduplicate(df).collect()) == want


def test_words_that_a_polynomial_modulo_two_powers_confuses():
    """A Thue-Morse word and its complement, 1,024 letters each."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    a, b = minhash.text_sets(pa.array([f"{one} x y z", f"{other} x y z"]), 4)
    assert len(a) == len(b) == 1 and a[0] != b[0]
