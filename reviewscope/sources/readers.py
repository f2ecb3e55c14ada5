"""Review tables and stored pages as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope import schema
from reviewscope.functions import text as ft
from reviewscope.functions.numeric import epoch_to_utc


def read_reviews(
    spark: SparkSession,
    path: str,
    columns: T.StructType = schema.REVIEW_CSV,
    fmt: str = "csv",
    multi_line: bool = True,
    damaged: str | None = None,
) -> DataFrame:
    """A stored review table, in CSV or parquet; numbers of a CSV stay text until they are coerced.

    Quoted line ends need `multi_line`, which reads each file in one task; turn it off for files without them.
    `damaged` names a column that keeps the raw text of lines which do not fit the columns (null for the others).
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', mode="PERMISSIVE")
    if damaged:
        columns = T.StructType([*columns.fields, T.StructField(damaged, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", damaged)
    return reader.schema(columns).csv(path)


def read_review_pages(spark: SparkSession, path: str, columns: T.StructType = schema.REVIEW_PAGE) -> DataFrame:
    """Stored API pages, one JSON document per line."""
    return spark.read.schema(columns).json(path)


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages that succeeded and hold reviews; the others end the crawl at the source."""
    return pages.filter((F.col("success") == 1) & (F.col("query_summary.num_reviews") > 0))


def review_columns(r: Column) -> list[Column]:
    """The columns of a review table from a page's review: author fields lifted, time as text in UTC."""
    author = ("author_id", "playtime_forever", "num_games_owned", "num_reviews")
    own = (
        "votes_up",
        "votes_funny",
        "weighted_vote_score",
        "comment_count",
        "steam_purchase",
        "written_during_early_access",
        "primarily_steam_deck",
    )
    return [
        r["review_id"].alias("review_id"),
        *[r["author"][c].alias(c) for c in author],
        *[r[c].alias(c) for c in own],
        epoch_to_utc(r["timestamp_created"]).alias("timestamp_created"),
        r["review"].alias("review"),
    ]


def flatten_review_pages(pages: DataFrame) -> DataFrame:
    """One row per review."""
    rows = usable_pages(pages).select("game_id", F.explode("reviews").alias("r"))
    return rows.select("game_id", *review_columns(F.col("r")))


def prepare_reviews(reviews: DataFrame, lang: str = "en", min_words: int = 3) -> DataFrame:
    """What the source does before a row is stored: language, encoding repair, normalised words."""
    from reviewscope.operators.cleaning import language_filter, normalise_reviews

    kept = language_filter(reviews, lang=lang)
    return normalise_reviews(kept.withColumn("review", ft.repair_text(F.col("review"))), min_words=min_words)
