"""Components against union by hand."""

import random

from reviewscope.llm.components import components


def test_components(spark):
    rng = random.Random(4)
    name = lambda i: f"{i * 7919 % 100_003:06d}".encode()
    pairs = [(i, i + 1) for i in range(300)]  # a path
    pairs += [(1000, 1001 + i) for i in range(400)]  # a hub
    pairs += [(2000 + rng.randrange(300), 2000 + rng.randrange(300)) for _ in range(250)]
    pairs += [(5000, 5000)]
    pairs += pairs[:50]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = {}
    for i in list(parent):
        groups.setdefault(root(i), set()).add(i)
    want = {name(i): min(map(name, g)) for g in groups.values() if len(g) > 1 for i in g}
    rng.shuffle(pairs)
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary").repartition(7)
    rows = components(df).collect()
    got = {bytes(r["node"]): bytes(r["root"]) for r in rows}
    assert got == want and len(rows) == len(want)
    assert components(df.limit(0)).count() == 0
