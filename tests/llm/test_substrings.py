"""Substring dedup against plain sets of windows; the sketch against plain counts."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reviewscope.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """rows: (doc_id, text)."""
    split = [(k, WORD.findall(t or "")) for k, t in rows]
    first = {}
    for k, ws in split:
        for i in range(len(ws) - width + 1):
            seq = tuple(ws[i : i + width])
            if k is not None:
                first[seq] = min(first.get(seq, k), k)
    out = []
    for k, ws in split:
        gone = set()
        for i in range(len(ws) - width + 1):
            if k is not None and first[tuple(ws[i : i + width])] < k:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((k, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def made(seed, width, documents=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["été", "a,b", "\x00", "x" * 20, " ", "Ab"]
    prose = lambda n: rng.choices(words, k=n)
    passages = [prose(width + rng.randrange(2 * width)) for _ in range(5)]
    rows = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one two")]
    for k in range(10, 10 + documents):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += prose(rng.randrange(width)) + (passages[min(rng.randrange(8), 4)] if rng.random() < 0.7 else [])
        rows.append((k, rng.choice([" ", "  ", "\n", "\t "]).join(parts) + rng.choice(["", " "])))
    copies = " ".join(passages[0] + passages[1])
    rows += [(100 + i, copies) for i in range(30)] + [(None, copies), (5, copies), (5, copies), (5, copies + " more")]
    rows += [(6, "same " * 5 * width), (7, "same " * 3 * width), (8, " ".join(passages[2] * 3)), (-3, " ".join(passages[2]))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "bits", "parts"), [(50, None, 4), (50, 1, 3), (5, None, 7), (5, 4, 1), (1, None, 3), (17, 12, 5)])
def test_made(spark, width, bits, parts):
    rows = made(width, width)
    schema = "doc_id long, text string, key int, marks string, hash string, n_words int"
    df = spark.createDataFrame([(*r, 1, "m", "h", 2) for r in rows], schema).repartition(parts)
    got = substrings.strip(df, width=width, bits=bits, with_text=True)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, width)


def test_small_slices_and_early_output(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 200)
    monkeypatch.setattr(substrings, "HELD", 10)
    monkeypatch.setattr(substrings, "BLOCK_BITS", 3)
    monkeypatch.setattr(substrings, "RUN", 4)
    rows = made(7, 10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = substrings.strip(df, width=10, bits=6, with_text=True)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 10)


def test_the_sketch_never_says_less(spark):
    """Each anchor's least cell, against the number of documents that have it."""
    rows = [(k, t) for k, t in made(3, 10) if k is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    documents = defaultdict(set)
    found = substrings.Windows(pa.array([t for _, t in rows]), 10, prints=False)
    for doc, anchor in zip(found.doc, found.anchor):
        documents[int(anchor)].add(int(doc))
    anchors = np.array(list(documents), dtype=np.uint64)
    several = np.array([len(documents[int(a)]) > 1 for a in anchors])
    for bits in (4, 16):
        table = substrings.sketch(df, 10, bits)
        at = substrings.cells(anchors, bits)
        said = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
        assert (said >= several).all()
        assert bits == 4 or (said != several).mean() < 0.01


def test_one_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(100_000)}" for _ in range(200_000))
    rows = [(1, long), (2, "x y " + long[400_000:600_000]), (3, "z" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.strip(df, with_text=True).collect()), key=repr) == brute(rows, 50)


def test_empty(spark):
    assert substrings.strip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
