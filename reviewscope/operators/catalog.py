"""Finding games in a catalog (id, name, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewscope.operators import grouping


def search_catalog(catalog: DataFrame, query: str, max_results: int = 10) -> DataFrame:
    """The first entries, by name and id, whose name contains the query."""
    hit = F.contains(F.lower("name"), F.lit(query.lower()))
    return catalog.filter(hit).orderBy("name", "id").limit(max_results)


def resolve_items(inputs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per distinct input the catalog id and name: digits are an id, anything else a name search.

    A name search is an equi-join: of each different name the pieces that are as long as some input are looked up among
    the inputs, so that no input is compared with names that do not contain it, and work grows with the names. Sides are broadcast
    only if they were measured to be small: file sizes say nothing about exploded pieces. Unresolved inputs stay, with null id.
    """
    asked = inputs.select(F.col("input").cast("string").alias("input")).distinct()
    by_id = asked.filter(F.col("input").rlike("^[0-9]+$")).withColumn(
        "id", F.col("input").try_cast("long")
    )
    entries = catalog.select(F.col("id").cast("long").alias("id"), "name")
    ids = by_id.join(entries.hint("merge"), "id").select("input", "id", "name")

    words = asked.filter(~F.col("input").rlike("^[0-9]+$") & (F.length("input") > 0)).select(
        "input", F.lower("input").alias("wanted")
    )
    wanted = words.select(F.col("wanted").alias("piece")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("piece")).alias("lengths"))
    # Of equal names the first is the one with the smallest id, and one without id comes before all.
    least = F.when(F.count("id") == F.count(F.lit(1)), F.min("id"))
    named = entries.filter(F.length("name") > 0).groupBy("name").agg(least.alias("id")).withColumn("low", F.lower("name"))
    pieces = F.expr(
        "array_distinct(flatten(transform(filter(lengths, n -> n <= length(low)), "
        "n -> transform(sequence(1, length(low) - n + 1), i -> substring(low, i, n)))))"
    )
    index = named.crossJoin(F.broadcast(lengths)).select("id", "name", F.explode_outer(pieces).alias("piece"))
    small, fits = grouping.measured(wanted)
    hits = index.join(small if fits else small.hint("merge"), "piece")
    found = hits.groupBy("piece").agg(F.min(F.struct("name", "id")).alias("first"))
    first = words.join(found.hint("merge"), F.col("wanted") == F.col("piece")).select("input", "first")
    names = first.select("input", F.col("first.id").alias("id"), F.col("first.name").alias("name"))
    return asked.join(ids.unionByName(names).hint("merge"), "input", "left")


def cap_rows(df: DataFrame, n: int = 1000, order: str = "review_id") -> DataFrame:
    """Testing mode: the first n rows per game in source order."""
    return grouping.first_n(df, ["game_id"], [F.col(order)], n).drop("rank")
