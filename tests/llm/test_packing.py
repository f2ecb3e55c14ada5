"""Packing: every id once, windows gapless, no padding, ids as the tokenizer gives them."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reviewscope.llm import packing
from reviewscope.llm.queries import op7_pack_documents, tokenizer_text

ODD = [
    None,
    "",
    " ",
    "plain words",
    "it's 12 o'clock, isn't it? x<|endoftext|>y",
    "ΟΔΟΣ.x a,'s 'super x's,'s 12'3 a1b22c naïve,x e\u0301.é! $$,'' 3.14%x -- don't,re've ''s",
    "CAPITALS <|ENDOFTEXT|> <|endoftext|> AA\u030a",
    "ΟΔΟΣ İstanbul été Ångström",
    "a b c\x1cd\x85e",
    "word " * 9000,
    "多言語 テキスト 123 !!! ´´",
    "same",
    "same",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(tokenizer_text())


def reference(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]


def check(rows, texts, tokenizer, size=packing.WINDOW):
    """texts: list of (key, text), keys unique."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == {k for k, _ in texts}
    for k, text in texts:
        ids, at = reference(tokenizer, text), 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and (at == size or at & (at - 1) == 0)


def test_odd_texts(spark, tokenizer):
    texts = list(enumerate(ODD))
    df = spark.createDataFrame([(k, t, 1) for k, t in texts], "doc_id long, text string, start int")
    check(packing.pack(df, tokenizer_text()).collect(), texts, tokenizer)


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op7_pack_documents(spark, sf).collect(), texts, tokenizer)


def test_levels_follow_the_squares():
    """Each placement is one that minimises the squares, by trying all levels."""
    rng, size, closed = np.random.default_rng(3), 32, []
    packer = packing.Packer(size, lambda number, pieces: closed.append(pieces))
    for step in range(600):
        before = packer.count.copy()
        need = int(rng.integers(1, size))

        def squares(free):
            after = before.copy()
            if free < size:
                after[free] -= 1
            if free - need:
                after[free - need] += 1
            return int((after**2).sum())

        best = min(squares(f) for f in range(need, size + 1) if f == size or before[f])
        packer.add(step, np.zeros(need, dtype=np.uint32))
        assert int((packer.count**2).sum()) == best
    open_windows = int(packer.count.sum())
    packer.close()
    assert open_windows < 120 and all(sum(len(p[2]) for p in ps) in (1, 2, 4, 8, 16, 32) for ps in closed)


def test_empty_null_keys_repeats(spark, tokenizer):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), tokenizer_text()).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], schema), tokenizer_text()).collect()
    assert sum(r["length"] for r in rows) == 9 and {r["doc_id"] for r in rows} == {None, 1}


def test_known_word_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

        def __contains__(self, word):
            self.asked += 1
            return super().__contains__(word)

    encode = packing.WordEncoder(tokenizer_text(), packing.END)
    texts = pa.array(["one two's three 4", "two three, naïvé one"])
    ids, bounds = encode(texts)
    encode.known = Counted(encode.known)
    again, _ = encode(texts)
    assert encode.known.asked <= len(encode.known)
    assert again.tolist() == ids.tolist()
    whole = [reference(encode.whole, t) for t in texts.to_pylist()]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole
