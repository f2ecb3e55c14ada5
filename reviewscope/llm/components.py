"""Connected components of links by alternating stars; every round is written, nothing is collected."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewscope.session import stored

MOST_ROUNDS = 60
HELD = 500_000


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of binary ids -> (node, root) for every node that has one; the root is the smallest of the component.

    A large star links all larger neighbours of a node to the smallest one, a small star the smaller ones. Both keep the
    components, and repeated they end in one star each, after about log2 of the longest path. Each task first
    replaces the links it holds by stars of its own, which is most of the work. A hub's links are folded before they are
    shuffled (min), and the join with the minima may be split where a hub is hot (the minima are written).
    """
    edges = written(contracted(links.select("a", "b")), "links")
    for _ in range(MOST_ROUNDS):
        if settled(edges):
            reached = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return reached.unionByName(reached.select(F.col("root").alias("node"), "root").distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "lows")
        # Large star: (v, low(u)) for the neighbours v of u that are larger than u.
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(contracted(large), "links")
        # Small star: all of a node's smaller neighbours, and the node, to the smallest of them.
        low = written(large.groupBy("a").agg(F.min("b").alias("low")), "lows")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(contracted(small.unionByName(low.select("a", F.col("low").alias("b")))).distinct(), "links")
    raise RuntimeError("components did not settle")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table of ids. They are dealt anew once they are made, into few files while they are few; the work before keeps its own tasks."""
    return stored(df.hint("rebalance"), name)


def settled(edges: DataFrame) -> bool:
    """One link for each node, and no root with a link of its own."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def contracted(links: DataFrame) -> DataFrame:
    """Links with the same components inside every task: each node to the smallest it is connected with there."""

    def run(batches):
        above: dict[bytes, bytes] = {}

        def root(node: bytes) -> bytes:
            top = node
            while (up := above.get(top, top)) != top:
                top = up
            while node != top:
                above[node], node = top, above.get(node, node)
            return top

        def out():
            rows = [(node, root(node)) for node in above]
            rows = [r for r in rows if r[0] != r[1]]
            above.clear()
            for at in range(0, len(rows), 50_000):
                columns = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
            if len(above) > HELD:
                yield from out()
        yield from out()

    return links.mapInArrow(run, "a binary, b binary")
