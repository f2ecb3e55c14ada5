"""The pipeline's stages against brute force, each on what the stage before it left."""

from collections import Counter

import corpus_pipeline
from reviewscope.llm import mixing
from reviewscope.llm.queries import tokenizer_text
from reviewscope.session import stored
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, None, None, 0), (10_002, "12 34", "en", "src0", 5)], docs.schema)
    docs, columns = docs.unionByName(odd), docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), name))
    raw, told, single, apart, mixed = ([tuple(r) for r in t.select("doc_id", "text", "source").collect()] for t in tables[:5])
    assert all(t.columns == columns for t in tables[:5])
    assert sorted(told) == sorted(r for r in raw if r[1] and any(c.isalpha() for c in r[1]))
    last = {}
    for k, text, _ in told:
        last[text] = max(k, last.get(text, k))
    assert sorted(k for k, *_ in single) == sorted(last.values())
    assert sorted(k for k, *_ in apart) == sorted(k for k, _, c in brute([r[:2] for r in single], 5, 80) if k == c)
    copies = {r["doc_id"]: r["copies"] for r in mixing.allocate(tables[3]).collect()}
    assert Counter(k for k, *_ in mixed) == Counter({k: n for k, n in copies.items() if n})
    tokenizer = Tokenizer.from_str(tokenizer_text())
    tokens = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in mixed)
    pieces = tables[5].collect()
    assert sum(r["length"] for r in pieces) == tokens
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def test_run_is_registered(spark):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.queries() == {"pipeline": corpus_pipeline.run}
    assert corpus_pipeline.run(spark, SF).count() > 0
