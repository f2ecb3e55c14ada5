"""Summaries and volume gates, one row (or a few) per game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewscope.config import GATES, QualityGates
from reviewscope.functions.numeric import percent
from reviewscope.operators import grouping

GAME = "game_id"


def ingest_filter_stats(raw: DataFrame, kept: Column) -> DataFrame:
    """Rows processed, kept and filtered, in one pass over the raw rows."""
    stats = raw.groupBy(GAME).agg(
        F.count("*").alias("processed"), F.count_if(kept).alias("kept")
    )
    filtered = F.col("processed") - F.col("kept")
    return stats.select(
        GAME,
        "processed",
        "kept",
        filtered.alias("filtered"),
        percent(filtered, F.col("processed")).alias("filtered_pct"),
    )


def data_summary(df: DataFrame) -> DataFrame:
    """Counts, mean and median playtime, reviewers, text length, votes, purchases, date range."""
    medians = grouping.exact_quantiles(df, [GAME], "playtime_forever", {"median": 0.5})
    main = df.groupBy(GAME).agg(
        F.count("*").alias("total_reviews"),
        (F.avg("playtime_forever") / 60).alias("avg_playtime_hours"),
        F.count_distinct("author_id").alias("total_unique_reviewers"),
        F.avg("review_length").alias("avg_review_length"),
        F.count_if(F.col("votes_up") > 0).alias("reviews_with_votes"),
        F.count_if("steam_purchase").alias("steam_purchases"),
        F.min("timestamp_created").alias("earliest"),
        F.max("timestamp_created").alias("latest"),
    )
    return main.join(
        medians.select(GAME, (F.col("median") / 60).alias("median_playtime_hours")), GAME, "left"
    )


def flagged_summary(fake: DataFrame) -> DataFrame:
    """Means and the most common playtime of the flagged rows; no row for a game without any."""
    means = fake.groupBy(GAME).agg(
        F.count("*").alias("total_fake_reviews"),
        F.avg("playtime_forever").alias("avg_playtime"),
        F.avg("num_games_owned").alias("avg_num_games"),
        F.avg("num_reviews").alias("avg_num_reviews"),
        F.avg("votes_up").alias("avg_votes_up"),
    )
    mode = grouping.group_mode(fake, [GAME], "playtime_forever", "most_common_playtime")
    return means.join(mode, GAME, "left")


def playtime_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    hours = df.select(GAME, (F.col("playtime_forever") / 60).alias("hours"))
    return grouping.histogram(hours, [GAME], "hours", bins)


def retention_report(flagged: DataFrame, raw_rows: DataFrame | None = None) -> DataFrame:
    """Raw, credible and fake counts and shares.

    `flagged` carries is_fake; `raw_rows` (game_id, raw) names the rows before cleaning, by
    default the flagged rows themselves.
    """
    counts = flagged.groupBy(GAME).agg(
        F.count("*").alias("cleaned"),
        F.count_if(~F.col("is_fake")).alias("credible"),
        F.count_if("is_fake").alias("fake"),
    )
    if raw_rows is None:
        counts = counts.withColumn("raw", F.col("cleaned"))
    else:
        counts = raw_rows.join(counts, GAME, "left").fillna(0, ["cleaned", "credible", "fake"])
    return counts.select(
        GAME,
        "raw",
        "credible",
        "fake",
        percent(F.col("credible"), F.col("raw")).alias("credible_pct"),
        percent(F.col("fake"), F.col("raw")).alias("fake_pct"),
    )


def quality_gates(flagged: DataFrame, raw_rows: DataFrame | None = None, gates: QualityGates = GATES) -> DataFrame:
    """One row per game and gate with the value that was tested and ok / warn / refuse."""
    report = retention_report(flagged, raw_rows)
    raw, credible = F.col("raw"), F.col("credible")
    rate = F.try_divide(F.col("fake").cast("double"), (F.col("fake") + credible).cast("double"))
    status = {
        "volume": (
            raw.cast("double"),
            F.when(raw < gates.refuse_below, "refuse").when(raw < gates.warn_below, "warn"),
        ),
        "volume_strict": (
            raw.cast("double"),
            F.when(raw < gates.strict_refuse_below, "refuse").when(
                raw <= gates.strict_warn_upto, "warn"
            ),
        ),
        "fake_rate": (rate, F.when(rate > gates.fake_rate, "warn")),
        "credible_volume": (
            credible.cast("double"),
            F.when(credible < gates.credible_below, "warn"),
        ),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("gate"),
                value.alias("value"),
                F.coalesce(verdict, F.lit("ok")).alias("status"),
            )
            for name, (value, verdict) in status.items()
        ]
    )
    return report.select(GAME, F.inline(rows))


def flagged_examples(fake: DataFrame, n: int = 5) -> DataFrame:
    """The first n flagged rows per game in row order."""
    rows = grouping.first_n(fake, [GAME], [F.col("review_id")], n)
    return rows.select(
        GAME, "rank", "review_id", "playtime_forever", "review", "num_reviews", "votes_up"
    )
