"""Registry and input adapters: driver table -> review shape, in SQL both engines accept."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.session import spread


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


BOOK: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its oracle."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__doc__ = fn.__doc__
        BOOK[name] = Entry(run, sql)
        return fn

    return keep


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint, fractions rounded: sums differ in the last bits by order."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # + 0.0 turns a negative zero into zero.
            col = (F.round(col.cast("double"), digits) + F.lit(0.0))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)


def r6(expr: str) -> str:
    """The same rounding in the oracle."""
    return f"(round({expr}, 6) + 0.0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ----------------------------------------------------------------- reviews from `events`
REVIEWS_META = [
    "event_id as review_id",
    "event_type as game_id",
    "case when user_id % 10 = 0 then 'bulk' else cast(user_id as varchar(20)) end as author_id",
    "ts as timestamp_created",
    "value as playtime_forever",
    "cast((event_id*13)%800 as double) as num_games_owned",
    "cast((event_id*7)%73 as double) as num_reviews",
    "cast(case when event_id%3=0 then 0 else event_id%9 end as double) as votes_up",
    "cast(case when event_id%101=0 then 150 else event_id%5 end as double) as votes_funny",
    "cast((event_id*37)%1000 as double)/1000 as weighted_vote_score",
    "cast(case when event_id%101=0 then 12 else event_id%3 end as double) as comment_count",
    "event_id%4<>0 as steam_purchase",
    "concat(event_type, ' ', props) as review",
]
META_SQL = f"reviews as (select {', '.join(REVIEWS_META)} from events)"

# The same rows as a source would deliver them: numbers as text, some unusable, some blank.
REVIEWS_RAW = [
    "event_id as review_id",
    "event_type as game_id",
    "case when event_id%211=0 then 'not a time' else cast(ts as varchar(40)) end as timestamp_created",
    "case when event_id%97=0 then null when event_id%89=0 then 'x' when event_id%83=0 then '-5' "
    "else cast(value as varchar(40)) end as playtime_forever",
    "case when event_id%79=0 then 'NaN' else cast((event_id*13)%800 as varchar(20)) end as num_games_owned",
    "cast((event_id*7)%73 as varchar(20)) as num_reviews",
    "cast(case when event_id%3=0 then 0 else event_id%9 end as varchar(20)) as votes_up",
    "cast(case when event_id%101=0 then 150 else event_id%5 end as varchar(20)) as votes_funny",
    "case when event_id%71=0 then '1.5' when event_id%73=0 then 'bad' "
    "else cast(cast((event_id*37)%1000 as double)/1000 as varchar(40)) end as weighted_vote_score",
    "cast(case when event_id%101=0 then 12 else event_id%3 end as varchar(20)) as comment_count",
    "event_id%4<>0 as steam_purchase",
    "case when event_id%50=0 then null when event_id%50=1 then '  ' "
    "else concat(event_type, ' ', props) end as review",
]
RAW_SQL = f"raw as (select {', '.join(REVIEWS_RAW)} from events)"


def reviews_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*REVIEWS_META)


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*REVIEWS_RAW)


# --------------------------------------------------------------- reviews from `documents`
REVIEWS_TEXT = ["doc_id as review_id", "source as game_id", "text as review", "lang"]
TEXT_SQL = f"reviews as (select {', '.join(REVIEWS_TEXT)} from documents)"


def reviews_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).selectExpr(*REVIEWS_TEXT)
