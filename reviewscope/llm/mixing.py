"""Mixing sources to target weights: Pareto order sampling, native DataFrame operations only.

A source has `words` words and a target of words. Every document of it gets `floor(target / words)` certain whole
copies. What is left is a sample without replacement and with unequal probabilities: a document is to be included with a probability in
proportion to its words, min(1, c * size), c being solved per source so that the expected words are those wanted. Documents that
reach 1 are certain too. The others are ranked by random odds over inclusion odds, (u / (1 - u)) / (pi / (1 - pi)), and taken in this order
up to the fixed size. The size is counted in words, so a source misses its target by half a document at most.

c comes from how many documents of a source have each size, so a source is never sorted as a whole: sizes are, and then ranks (as
t = rank / (1 + rank), which orders alike) are dealt to slices of about `SLICE` documents, the words of the slices are
summed up, and only the slice that holds the cut is ordered. The cut is a number per source, which documents compare
themselves with, so that no text is moved. Targets are computed over one row per source, in one task.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share `share` of all words. A target
stops at `most` times its source's words and the excess goes to the others by weight: target = min(most * words,
level * weight), with the one level at which the targets add up.

Edge cases: a null text has no words; documents without words take 0 words, and `mix` gives them the certain copies of
their source and are never sampled. A null source is a source of its own. u depends on the key alone: reruns agree, and rows that repeat a key are
taken or left together. A null key draws one u like any other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewscope.session import stored

WEIGHTS = (5, 2, 1)
SLICE = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str) -> Column:
    """A draw in (0, 1) from 52 bits of the md5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / float(2**52)


def targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """`source`, `words` -> also `target`. One row per source, so the windows run over a small table."""
    spell = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(spell) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("words") * F.lit(float(most)))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("words").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        weighed.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select("source", "words", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "docs")
    )


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, slice_docs: int = SLICE) -> DataFrame:
    """Per source: words, target, whole copies, c, the largest size that is not certain, and the last t taken.

    `sizes` has source, size and u; it is read several times and should be a small written table.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    per = targets(totals, weights, share, most)
    per = per.withColumn("whole", F.floor(F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0)))).withColumn(
        "wanted", F.greatest(F.col("target") - F.col("whole") * F.col("words"), F.lit(0.0))
    )
    # One row per source, written: Spark then knows its size, and does not deal out all documents by source to meet it.
    per = stored(per.withColumn("slices", F.ceil(F.col("docs") / F.lit(slice_docs))), "mixing-sources")

    wide = "decimal(38,0)"
    counts = matched(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), per.filter("wanted > 0"), "wanted")
    counts = counts.withColumn("held", F.col("size") * F.col("n")).withColumn("squares", F.col("held").cast("decimal(19,0)") * F.col("size").cast("decimal(10,0)"))
    larger = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("squares").over(W.partitionBy("source")).cast(wide) - F.coalesce(F.sum("squares").over(larger).cast(wide), F.lit(0).cast(wide))
    # As if all larger sizes were certain and this one were not.
    counts = counts.withColumn("certain", F.coalesce(F.sum("held").over(larger), F.lit(0))).withColumn(
        "c", (F.col("wanted") - F.col("certain")) / rest.cast("double")
    )
    fair = counts.filter(F.col("c") * F.col("size") <= 1).groupBy("source")
    fair = fair.agg(F.max_by(F.struct(F.col("size").alias("limit"), "c", (F.col("wanted") - F.col("certain")).alias("left")), "size").alias("fair"))
    fair = stored(fair.select("source", "fair.*"), "mixing-inclusion")
    per = matched(per.drop("docs", "wanted"), fair, "limit", "c", "left", how="left")

    ranked = matched(sizes.filter("size > 0"), matched(fair, per, "slices"), "slices", "c", "limit", "left").filter("size <= limit")
    ranked = ranked.withColumn("t", place()).withColumn("slice", F.floor(F.col("t") * F.col("slices")))
    upto = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    filled = (
        ranked.groupBy("source", "slice", "left")
        .agg(F.sum("size").alias("held"))
        .withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    )
    # Slices wholly inside the sample, and the one that holds the cut.
    last = filled.filter(F.col("before") < F.col("left")).groupBy("source").agg(F.max_by(F.struct("slice", "before"), "before").alias("cut"))
    last = stored(last, "mixing-edges")
    at_cut = matched(ranked, last, "cut").filter(F.col("slice") == F.col("cut.slice"))
    along = W.partitionBy("source").orderBy("t")
    taken = at_cut.withColumn(
        # Rows of one rank go together; a group is taken if the middle of its words lies before the end.
        "middle",
        F.col("cut.before")
        + F.sum("size").over(along.rangeBetween(W.unboundedPreceding, W.currentRow))
        - F.sum("size").over(W.partitionBy("source", "t")) / 2,
    ).filter(F.col("middle") <= F.col("left"))
    reached = taken.groupBy("source").agg(F.max("t").alias("reached"))
    edges = last.select("source", F.col("cut.slice").alias("edge"))
    joined = matched(matched(per, edges, "edge", how="left"), reached, "reached", how="left")
    # Nothing of the last slice: all that lies before it.
    cut = F.coalesce(F.col("reached"), F.col("edge") / F.col("slices"), F.lit(-1.0))
    return stored(joined.select("source", "words", "target", "whole", "c", "limit", cut.alias("cut")), "mixing-plan")


def place() -> Column:
    """t of a document that carries u, size and its source's c: u's odds over inclusion odds, brought to [0, 1)."""
    u, pi = F.col("u"), F.col("c") * F.col("size")
    return u * (1 - pi) / (u * (1 - pi) + pi * (1 - u))


def matched(left: DataFrame, right: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Join by source, null with null. The side with a row per source is broadcast only where Spark finds it small."""
    side = right.select(F.col("source").alias("_source"), *columns)
    return left.join(side, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def copies() -> Column:
    """Copies of a document that carries size, u and its source's row of the plan."""
    certain = F.col("size") > F.col("limit")
    sampled = (F.col("size") > 0) & (F.col("size") <= F.col("limit"))
    return F.col("whole") + F.when(certain, 1).when(sampled & (place() <= F.col("cut")), 1).otherwise(0)


PLAN = ("words", "target", "whole", "c", "limit", "cut")


def drawn(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        uniform(F.col(f"`{key}`"), seed).alias("u"),
    )


def allocate(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **how) -> DataFrame:
    """For every row: key, size, source_size, target, taken (words, repeats counted) and copies."""
    sizes = stored(drawn(docs, key, text, source, seed), "mixing-sizes")
    return matched(sizes, plan(sizes, **how), *PLAN).select(
        F.col("key").alias(key),
        "size",
        F.col("words").alias("source_size"),
        "target",
        (F.col("size") * copies()).alias("taken"),
        copies().alias("copies"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **how) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it was taken."""
    sizes = stored(drawn(docs, key, text, source, seed).select("source", "size", "u"), "mixing-sizes")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"),
        uniform(F.col(f"`{key}`"), seed).alias("u"),
    )
    times = matched(rows, plan(sizes, **how), *PLAN).withColumn("times", copies().cast("int")).filter("times > 0")
    return times.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one")).select("row.*")
