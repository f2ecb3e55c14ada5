"""Aggregates over predictions (game_id, review_id, emotion, confidence, models, jsd).

Everything is first reduced per (game, emotion), at most seven rows per game, with map-side
combining; what follows works on those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewscope.config import EMOTIONS, NEGATIVE_EMOTIONS, POSITIVE_EMOTIONS, UNKNOWN
from reviewscope.functions.numeric import percent
from reviewscope.operators import grouping

GAME = "game_id"


def draw_order(seed: int, row_id: str = "review_id") -> list[Column]:
    """A fixed pseudo-random order of rows, the same on any partitioning and engine."""
    key = F.concat_ws("-", F.col(row_id).cast("string"), F.lit(str(seed)))
    return [F.md5(key), F.col(row_id)]


def sample_reviews(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows per game (all of a smaller game), drawn without replacement."""
    return grouping.first_n(df, [GAME], draw_order(seed), n).drop("rank")


def emotion_distribution(df: DataFrame) -> DataFrame:
    counts = df.groupBy(GAME, "emotion").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(GAME))
    return counts.withColumn("pct", percent(F.col("n"), whole))


def confidence_by_emotion(df: DataFrame) -> DataFrame:
    """Mean confidence per emotion, and with emotion null over all of the game."""
    parts = df.groupBy(GAME, "emotion").agg(
        F.sum("confidence").alias("s"), F.count("confidence").alias("n")
    )
    overall = parts.groupBy(GAME).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    both = parts.unionByName(overall.withColumn("emotion", F.lit(None).cast("string")))
    return both.select(GAME, "emotion", (F.col("s") / F.col("n")).alias("avg_confidence"))


def high_confidence(df: DataFrame, above: float = 0.8) -> DataFrame:
    """Confident predictions per emotion, and their share of all predictions of the game."""
    parts = df.groupBy(GAME, "emotion").agg(
        F.count_if(F.col("confidence") > above).alias("high"), F.count("*").alias("n")
    )
    w = Window.partitionBy(GAME)
    ratio = F.sum("high").over(w) / F.sum("n").over(w)
    return parts.select(GAME, "emotion", "high", ratio.alias("high_ratio")).filter("high > 0")


def divided(models: int = 3) -> Column:
    """Do the models (all of them present) name more than one emotion?"""
    return (F.size("models") >= models) & (F.size(F.array_distinct(F.transform("models", lambda m: m["emotion"]))) > 1)


def disagreement_rate(df: DataFrame, models: int = 3) -> DataFrame:
    """Predictions whose models (all of them present) do not name one emotion."""
    stats = df.groupBy(GAME).agg(F.count("*").alias("sample_size"), F.count_if(divided(models)).alias("disagreement_count"))
    return stats.withColumn("disagreement_rate", F.col("disagreement_count") / F.col("sample_size"))


def grouped_distribution(df: DataFrame, threshold: float = 0.7, small: float = 0.05) -> DataFrame:
    """Slices of a pie: one dominant emotion and "Others", else all with small ones marked."""
    dist = emotion_distribution(df)
    w = Window.partitionBy(GAME)
    share = F.col("n") / F.sum("n").over(w)
    place = F.row_number().over(w.orderBy(F.desc("n"), "emotion"))
    ranked = dist.withColumns({"share": share, "place": place})
    ranked = ranked.withColumn("dominated", F.max("share").over(w) > threshold)
    label = F.when(F.col("dominated") & (F.col("place") > 1), "Others").otherwise(F.col("emotion"))
    slices = ranked.groupBy(GAME, label.alias("label"), "dominated").agg(
        F.sum("n").alias("n"), F.sum("share").alias("share")
    )
    lift = F.when(F.col("dominated"), F.col("label") == "Others").otherwise(F.col("share") < small)
    return slices.select(GAME, "label", "n", (F.col("share") * 100).alias("pct"), lift.alias("lifted"))


def confidence_histogram(df: DataFrame) -> DataFrame:
    """Twenty bins of 0.05 with a low / mid / high band."""
    bins = grouping.histogram(df, [GAME], "confidence", 20, 0.0, 1.0)
    band = F.when(F.col("bin") < 10, "low").when(F.col("bin") < 16, "mid").otherwise("high")
    return bins.withColumn("band", band)


def confidence_stats(df: DataFrame) -> DataFrame:
    median = grouping.exact_quantiles(df, [GAME], "confidence", {"median": 0.5})
    stats = df.groupBy(GAME).agg(
        F.count("*").alias("n"),
        F.avg("confidence").alias("mean"),
        F.stddev_samp("confidence").alias("std"),
    )
    return stats.join(median, GAME, "left")


BANDS = {"Low (<0.6)": (0.0, 0.6), "Medium (0.6-0.8)": (0.6, 0.8), "High (>0.8)": (0.8, 1.0)}


def band_by_emotion(df: DataFrame, emotions: Sequence[str] = (*EMOTIONS, UNKNOWN)) -> DataFrame:
    """Confidence bands (low, high] by emotion, zeros kept; a confidence of 0 is in no band.

    One pass: all cells are conditional counts of a single aggregate.
    """
    inside = {b: (F.col("confidence") > lo) & (F.col("confidence") <= hi) for b, (lo, hi) in BANDS.items()}
    cells = df.groupBy(GAME).agg(
        *[
            F.count_if(hit & (F.col("emotion") == e)).alias(f"{i}|{e}")
            for i, hit in enumerate(inside.values())
            for e in emotions
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(b).alias("band"), *[F.col(f"`{i}|{e}`").alias(e) for e in emotions])
            for i, b in enumerate(inside)
        ]
    )
    return cells.select(GAME, F.inline(rows))


def jsd_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    means = df.groupBy(GAME).agg(F.avg("jsd").alias("mean_jsd"))
    return grouping.histogram(df, [GAME], "jsd", bins).join(means, GAME)


def jsd_boxplot(df: DataFrame) -> DataFrame:
    """Per emotion: n, quartiles and whiskers (furthest points within 1.5 interquartile ranges)."""
    keys = [GAME, "emotion"]
    quartiles = grouping.exact_quantiles(df, keys, "jsd", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    side, _ = grouping.measured(quartiles)
    rows = df.select(*keys, "jsd").join(side, keys)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    low = F.min(F.when(F.col("jsd") >= F.col("q1") - reach, F.col("jsd")))
    high = F.max(F.when(F.col("jsd") <= F.col("q3") + reach, F.col("jsd")))
    return rows.groupBy(*keys, "q1", "median", "q3").agg(
        F.count("*").alias("n"),
        F.least(low, F.col("q1")).alias("whisker_low"),
        F.greatest(high, F.col("q3")).alias("whisker_high"),
    )


def jsd_trend(df: DataFrame) -> DataFrame:
    """Least-squares line of jsd on confidence: per emotion with three or more rows, and overall
    (emotion null) together with the correlation."""
    line = [
        F.count("*").alias("n"),
        F.regr_slope("jsd", "confidence").alias("slope"),
        F.regr_intercept("jsd", "confidence").alias("intercept"),
    ]
    parts = df.groupBy(GAME, "emotion").agg(*line).filter("n > 2")
    parts = parts.withColumn("correlation", F.lit(None).cast("double"))
    overall = df.groupBy(GAME).agg(*line, F.corr("confidence", "jsd").alias("correlation"))
    return parts.unionByName(overall.withColumn("emotion", F.lit(None).cast("string")))


def stratified_points(df: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """At most n random (confidence, jsd) points per emotion."""
    drawn = grouping.first_n(df, [GAME, "emotion"], draw_order(seed), n)
    return drawn.select(GAME, "emotion", "review_id", "confidence", "jsd")


def valence(df: DataFrame) -> DataFrame:
    """Shares of positive and negative emotions, their ratio, and the dominant emotion."""
    dist = emotion_distribution(df)
    share = lambda group: F.sum(
        F.when(F.col("emotion").isin(*group), F.col("pct")).otherwise(0.0)
    )
    # min_by over (-pct, name): the largest share, the first name on ties.
    first = F.struct(-F.col("n"), F.col("emotion"))
    out = dist.groupBy(GAME).agg(
        share(POSITIVE_EMOTIONS).alias("positive_pct"),
        share(NEGATIVE_EMOTIONS).alias("negative_pct"),
        F.min_by("emotion", first).alias("dominant_emotion"),
        F.max("pct").alias("dominant_pct"),
    )
    ratio = F.when(F.col("negative_pct") > 0, F.col("positive_pct") / F.col("negative_pct"))
    return out.withColumn("valence_ratio", ratio)


def top_emotions(df: DataFrame, n: int = 3) -> DataFrame:
    dist = emotion_distribution(df)
    return grouping.first_n(dist, [GAME], [F.desc("n"), F.col("emotion")], n)


def emotion_report(df: DataFrame) -> DataFrame:
    """The report as ordered rows (game_id, section, position, item, value, n, confidence).

    The predictions are aggregated once, to a row per game that holds its emotions, and all sections are made from that row.
    """
    parts = df.groupBy(GAME, "emotion").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("s"),
        F.count_if(F.col("confidence") > 0.8).alias("high"),
        F.count_if(divided()).alias("apart"),
    )
    # The most frequent emotion first, by name on ties.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "emotion", F.col("n").alias("count"), "s")))
    whole = parts.groupBy(GAME).agg(*[F.sum(c).alias(c) for c in ("n", "s", "high", "apart")], listed.alias("each"))
    n, each = F.col("n"), F.col("each")

    def cell(section: str, position: Column, item: Column, value: Column, count: Column | None = None, confidence: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            position.cast("long").alias("position"),
            item.alias("item"),
            value.cast("double").alias("value"),
            (F.lit(None) if count is None else count).cast("long").alias("n"),
            (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
        )

    def section(name: str, items: Sequence[tuple]) -> Column:
        return F.array(*[cell(name, F.lit(i), item if isinstance(item, Column) else F.lit(item), value) for i, (item, value) in enumerate(items, 1)])

    def share(group: Sequence[str]) -> Column:
        return F.aggregate(F.filter(each, lambda x: x["emotion"].isin(*group)), F.lit(0.0), lambda sum_, x: sum_ + percent(x["count"], n))

    positive, negative = share(POSITIVE_EMOTIONS), share(NEGATIVE_EMOTIONS)
    distribution = F.transform(each, lambda x, i: cell("2 distribution", i + 1, x["emotion"], percent(x["count"], n), x["count"], x["s"] / x["count"]))
    rows = F.concat(
        section("1 summary", [("total_analyzed", n), ("overall_avg_confidence", F.col("s") / n), ("high_confidence_pct", percent(F.col("high"), n))]),
        distribution,
        section("3 agreement", [("sample_size", n), ("disagreement_pct", F.col("apart") / n * 100), ("disagreement_count", F.col("apart"))]),
        section(
            "4 insights",
            [
                (each[0]["emotion"], percent(each[0]["count"], n)),
                ("positive_pct", positive),
                ("negative_pct", negative),
                ("valence_ratio", F.when(negative > 0, positive / negative)),
            ],
        ),
    )
    return whole.select(GAME, F.inline(rows))


def emotion_report_lines(report: DataFrame) -> DataFrame:
    """The report rows as text lines, ready for a text sink: item = value, with reviews and confidence of an emotion."""
    c = F.col
    rounded = F.floor(c("value") * 1000 + 0.5) / 1000
    value = F.when(c("value") == F.floor("value"), F.format_string("%d", c("value").cast("long"))).otherwise(
        F.format_string("%.3f", rounded)
    )
    line = F.concat(c("item"), F.lit(" = "), value)
    emotion = F.format_string(" %% of reviews; reviews = %d; mean confidence = %.3f", c("n"), c("confidence"))
    line = F.when(c("section") == "2 distribution", F.concat(line, emotion)).otherwise(line)
    return report.filter(c("value").isNotNull()).select(GAME, "section", "position", line.alias("line"))
