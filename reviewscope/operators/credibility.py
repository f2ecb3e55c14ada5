"""Nine credibility rules as columns, per game.

Row rules are plain expressions.  Per-game facts (row count, a percentile, means) are tiny
and are broadcast after their size was measured; the two author rules aggregate by author
before anything is joined back, and a hot author is cut into days.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewscope.config import CREDIBILITY, NUMERIC_COLUMNS, CredibilityThresholds
from reviewscope.functions.numeric import log_score
from reviewscope.operators import grouping

GAME = "game_id"
RULES = tuple(f"rule{i}" for i in range(1, 10))


def row_rules(t: CredibilityThresholds = CREDIBILITY) -> dict[str, Column]:
    """The rules that need nothing but the row itself."""
    c = F.col
    unvoted = c("votes_up") == 0
    return {
        "rule1": (c("playtime_forever") < t.r1_playtime) & (c("weighted_vote_score") > t.r1_score) & unvoted,
        "rule2": (c("num_games_owned") > t.r2_games) & (c("playtime_forever") < t.r2_playtime),
        "rule3": (c("num_reviews") > t.r3_reviews) & (c("votes_up") < t.r3_votes),
        "rule4": (c("weighted_vote_score") > t.r4_score)
        & unvoted
        & (c("comment_count") == 0)
        & (c("playtime_forever") < t.r4_playtime),
        "rule6": (c("comment_count") > t.r6_comments)
        & (c("votes_funny") > t.r6_funny)
        & (c("weighted_vote_score") < t.r6_score),
    }


def rule9(t: CredibilityThresholds = CREDIBILITY) -> Column:
    """Many reviews, hardly any reaction (to be gated on the size of the game)."""
    reactions = F.col("votes_up") + F.col("votes_funny") + F.col("comment_count")
    ratio = reactions / F.greatest(F.col("num_reviews"), F.lit(1.0))
    return (F.col("num_reviews") > t.r9_reviews) & (ratio < t.r9_ratio)


def game_facts(df: DataFrame, t: CredibilityThresholds = CREDIBILITY) -> DataFrame:
    """Per game: row count `game_rows` and the review-count percentile `cut5` of rule 5."""
    counts = df.groupBy(GAME).agg(F.count("*").alias("game_rows"))
    cuts = grouping.exact_quantiles(df, [GAME], "num_reviews", {"cut5": t.r5_quantile})
    return counts.join(cuts, GAME, "left")


def with_rule5(df: DataFrame, t: CredibilityThresholds = CREDIBILITY) -> DataFrame:
    """Above the game's own percentile of review counts, and never voted up."""
    df = grouping.join_small(df, game_facts(df, t).select(GAME, "cut5"), [GAME], "left")
    hit = (F.col("num_reviews") > F.col("cut5")) & (F.col("votes_up") == 0)
    return df.withColumn("rule5", F.coalesce(hit, F.lit(False))).drop("cut5")


def _within(gap_start: Column, gap_end: Column, minutes: int) -> Column:
    """Strictly after, and less than `minutes` later; false if a side is missing."""
    close = (gap_end > gap_start) & (gap_end < gap_start + F.expr(f"interval {minutes} minutes"))
    return F.coalesce(close, F.lit(False))


def _author_order_splits(authors: DataFrame, parts: int) -> DataFrame:
    """Per game a sorted array of at most `parts` author ids that cut the author list evenly.

    The ids with the smallest hashes are a uniform draw that does not depend on how the data
    are partitioned, and are bounded whatever the game's size.
    """
    picked = grouping.first_n(authors, [GAME], [F.xxhash64("__author"), F.col("__author")], parts)
    return picked.groupBy(GAME).agg(F.array_sort(F.collect_list("__author")).alias("splits"))


def rapid_fire(df: DataFrame, scope: str = "author", t: CredibilityThresholds = CREDIBILITY, parts: int = 128) -> DataFrame:
    """Add rule7: less than five minutes after the previous row in (author, time) order.

    scope="author": the previous row of the same author.  scope="reference": the first row of
    an author is also compared with the last row of the author before, as a plain difference
    over the sorted rows does.

    A window over one author would put a hot author into one task.  Rows are compared inside
    (author, day); only the first row of a day looks at the author's previous day, and only
    the first row of an author at the previous author.  Only ids and times are shuffled; the few
    hits are then joined to the full rows by (game_id, review_id).

    Rows without a time cannot hit and take no part.  Rows without an author are nobody's: with scope="author" they take
    no part either, with scope="reference" they are one author, before all others.
    """
    if "timestamp_created" not in df.columns:
        return df.withColumn("rule7", F.lit(False))
    ts = F.col("timestamp_created")
    day = ["game_id", "__author", "__day"]
    known = ts.isNotNull() & F.col("author_id").isNotNull() if scope == "author" else ts.isNotNull()
    rows = df.filter(known).select(
        GAME,
        "review_id",
        "timestamp_created",
        F.coalesce("author_id", F.lit("")).alias("__author"),
        F.to_date(ts).alias("__day"),
    )
    days = rows.groupBy(*day).agg(
        F.min("timestamp_created").alias("first_ts"), F.max("timestamp_created").alias("last_ts")
    )
    by_author = Window.partitionBy(GAME, "__author").orderBy("__day")
    days = days.withColumn("before", F.lag("last_ts").over(by_author))
    if scope == "reference":
        days = _before_first_day(days, by_author, parts)
    in_day = Window.partitionBy(*day).orderBy(ts.asc_nulls_last(), "review_id")
    rows = rows.withColumn("__prev", F.lag(ts).over(in_day)).withColumn(
        "__first", F.row_number().over(in_day) == 1
    )
    rows = rows.join(days.select(*day, "before"), day, "left")
    previous = F.when(F.col("__first"), F.col("before")).otherwise(F.col("__prev"))
    hits = rows.filter(_within(previous, ts, t.r7_minutes)).select(
        GAME, "review_id", F.lit(True).alias("rule7")
    )
    return grouping.join_small(df, hits, [GAME, "review_id"], "left").withColumn(
        "rule7", F.coalesce("rule7", F.lit(False))
    )


def _before_first_day(days: DataFrame, by_author, parts: int) -> DataFrame:
    """Fill `before` of every author's first day with the last time of the author before."""
    authors = days.groupBy(GAME, "__author").agg(F.max_by("last_ts", "__day").alias("last_ts"))
    splits = _author_order_splits(authors.select(GAME, "__author"), parts)
    part = F.size(F.filter("splits", lambda s: s <= F.col("__author")))
    placed = grouping.join_small(authors, splits, [GAME]).select(
        GAME, "__author", "last_ts", part.alias("part")
    )
    edges = placed.groupBy(GAME, "part").agg(F.max_by("last_ts", "__author").alias("edge"))
    edges = edges.withColumn(
        "edge", F.lag("edge").over(Window.partitionBy(GAME).orderBy("part"))
    )
    in_part = Window.partitionBy(GAME, "part").orderBy("__author")
    placed = placed.withColumns(
        {"prev": F.lag("last_ts").over(in_part), "head": F.row_number().over(in_part) == 1}
    )
    neighbour = grouping.join_small(placed, edges, [GAME, "part"], "left").select(
        GAME, "__author", F.when(F.col("head"), F.col("edge")).otherwise(F.col("prev")).alias("neighbour")
    )
    days = days.withColumn("__opening", F.row_number().over(by_author) == 1)
    days = days.join(neighbour, [GAME, "__author"], "left")
    return days.withColumn(
        "before", F.when(F.col("__opening"), F.col("neighbour")).otherwise(F.col("before"))
    ).drop("__opening", "neighbour")


def fast_authors(df: DataFrame, t: CredibilityThresholds = CREDIBILITY) -> DataFrame:
    """Authors of a game with many lifetime reviews and more than five rows per day there."""
    seconds = F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts"))
    days = F.greatest(F.floor(seconds / 86400), F.lit(1))
    stats = df.filter(F.col("author_id").isNotNull()).groupBy(GAME, "author_id").agg(
        F.min_by("num_reviews", "review_id").alias("num_reviews"),
        F.min("timestamp_created").alias("first_ts"),
        F.max("timestamp_created").alias("last_ts"),
        F.count("timestamp_created").alias("n"),
    )
    return stats.filter(
        (F.col("num_reviews") > t.r8_reviews) & (F.col("n") / days > t.r8_per_day)
    ).select(GAME, "author_id")


def with_rule8(df: DataFrame, t: CredibilityThresholds = CREDIBILITY) -> DataFrame:
    """Flag every row of a fast author; off below the row gate or without the columns.

    Needs `game_rows` on the rows.
    """
    if not {"author_id", "timestamp_created"} <= set(df.columns):
        return df.withColumn("rule8", F.lit(False))
    gated = df.filter(F.col("game_rows") > t.gate_rows)
    fast = fast_authors(gated, t).withColumn("rule8", F.lit(True))
    return grouping.join_small(df, fast, [GAME, "author_id"], "left").withColumn(
        "rule8", F.coalesce("rule8", F.lit(False))
    )


def credibility_rules(df: DataFrame, scope: str = "author", t: CredibilityThresholds = CREDIBILITY) -> DataFrame:
    """Add rule1..rule9 and their OR as is_fake."""
    facts, _ = grouping.measured(game_facts(df, t))
    df = df.join(facts, [GAME], "left")
    # A rule that cannot be decided, for a missing value, does not flag.
    df = df.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in row_rules(t).items()})
    cut = (F.col("num_reviews") > F.col("cut5")) & (F.col("votes_up") == 0)
    df = df.withColumns(
        {
            "rule5": F.coalesce(cut, F.lit(False)),
            "rule9": F.coalesce((F.col("game_rows") > t.gate_rows) & rule9(t), F.lit(False)),
        }
    )
    df = with_rule8(df, t)
    df = rapid_fire(df, scope, t)
    return df.withColumn("is_fake", reduce(or_, [F.col(r) for r in RULES])).drop("game_rows", "cut5")


def flag_rates(flagged: DataFrame) -> DataFrame:
    """Rows flagged by each rule, by any, and the overall rate, per game."""
    return flagged.groupBy(GAME).agg(
        F.count("*").alias("n"),
        *[F.count_if(r).alias(r) for r in RULES],
        F.count_if("is_fake").alias("flagged"),
        F.avg(F.col("is_fake").cast("int")).alias("flag_rate"),
    )


def split_reviews(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(credible, fake) without the rule columns; every row is in one of them, a null flag counts as credible."""
    plain = flagged.drop(*[r for r in RULES if r in flagged.columns])
    fake = F.coalesce("is_fake", F.lit(False))
    return plain.filter(~fake).drop("is_fake"), plain.filter(fake).drop("is_fake")


def knn_features(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, categories: Sequence[str] | None = None) -> DataFrame:
    """Standardised numeric columns per game as `features`, vote score on a log scale.

    Population deviation, a constant column divides by one.  A sentiment_score column adds one
    0/1 entry per category: the given ones, or those found in the data (checked to be few).
    """
    value = {c: log_score(F.col(c)) if c == "weighted_vote_score" else F.col(c) for c in columns}
    stats = df.groupBy(GAME).agg(
        *[F.avg(v).alias(f"{c}__mean") for c, v in value.items()],
        *[F.stddev_pop(v).alias(f"{c}__dev") for c, v in value.items()],
    )
    joined = grouping.join_small(df, stats, [GAME])
    scaled = [
        (v - F.col(f"{c}__mean"))
        / F.when(F.col(f"{c}__dev") > 0, F.col(f"{c}__dev")).otherwise(F.lit(1.0))
        for c, v in value.items()
    ]
    if "sentiment_score" in df.columns:
        if categories is None:
            found = df.select("sentiment_score").distinct().limit(1001).collect()
            if len(found) > 1000:
                raise ValueError("sentiment_score has more than 1000 categories; pass `categories`")
            categories = sorted(r[0] for r in found if r[0] is not None)
        scaled += [
            F.coalesce((F.col("sentiment_score") == c).cast("double"), F.lit(0.0)) for c in categories
        ]
    return joined.withColumn("features", F.array(*scaled)).select(*df.columns, "features")
