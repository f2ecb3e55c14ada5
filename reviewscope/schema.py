"""Explicit schemas of the inputs: nothing is inferred from data."""

from pyspark.sql import types as T

AUTHOR = T.StructType(
    [
        T.StructField("author_id", T.StringType()),
        T.StructField("playtime_forever", T.DoubleType()),
        T.StructField("num_games_owned", T.DoubleType()),
        T.StructField("num_reviews", T.DoubleType()),
    ]
)

PAGE_REVIEW = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("review", T.StringType()),
        T.StructField("timestamp_created", T.LongType()),
        T.StructField("votes_up", T.DoubleType()),
        T.StructField("votes_funny", T.DoubleType()),
        T.StructField("weighted_vote_score", T.StringType()),
        T.StructField("comment_count", T.DoubleType()),
        T.StructField("steam_purchase", T.BooleanType()),
        T.StructField("written_during_early_access", T.BooleanType()),
        T.StructField("primarily_steam_deck", T.BooleanType()),
        T.StructField("author", AUTHOR),
    ]
)

REVIEW_PAGE = T.StructType(
    [
        T.StructField("game_id", T.StringType()),
        T.StructField("success", T.IntegerType()),
        T.StructField(
            "query_summary",
            T.StructType(
                [
                    T.StructField("num_reviews", T.LongType()),
                    T.StructField("total_reviews", T.LongType()),
                ]
            ),
        ),
        T.StructField("cursor", T.StringType()),
        T.StructField("reviews", T.ArrayType(PAGE_REVIEW)),
    ]
)

# A stored review table, every numeric still text: coercion is an operator of its own.
REVIEW_CSV = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("game_id", T.StringType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("timestamp_created", T.StringType()),
        T.StructField("playtime_forever", T.StringType()),
        T.StructField("num_games_owned", T.StringType()),
        T.StructField("num_reviews", T.StringType()),
        T.StructField("votes_up", T.StringType()),
        T.StructField("votes_funny", T.StringType()),
        T.StructField("weighted_vote_score", T.StringType()),
        T.StructField("comment_count", T.StringType()),
        T.StructField("steam_purchase", T.BooleanType()),
        T.StructField("written_during_early_access", T.BooleanType()),
        T.StructField("primarily_steam_deck", T.BooleanType()),
        T.StructField("review", T.StringType()),
    ]
)
