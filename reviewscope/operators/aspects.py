"""Aspects: which ones a review mentions, and how they are judged, per game.

Tagging and scoring are row-level; only reviews with an aspect are scored.  One aggregate per
(game, aspect) feeds every later table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewscope.config import ASPECT_SEEDS, CUTS, SentimentCuts
from reviewscope.functions import text as ft
from reviewscope.functions.numeric import percent
from reviewscope.operators import grouping
from reviewscope.operators.automaton import ANY_GAME, MOST_KEYWORDS, tag_by_automaton
from reviewscope.operators.sentiment import Scorer, score_sentiment

GAME = "game_id"
KEYWORDS = ASPECT_SEEDS
PATTERN_KEYWORDS = 500


def tag_aspects(
    df: DataFrame,
    keywords: Mapping[str, Sequence[str]] | DataFrame = KEYWORDS,
    text: str = "review",
    automaton: bool | None = None,
) -> DataFrame:
    """Add `aspects`, the names of all aspects with a keyword (word or phrase) in the text.

    `keywords` is one dictionary for all games, or a DataFrame (game_id, aspect, keywords) with a
    dictionary per game; a game missing there gets no aspects. `automaton` looks for all keywords in one pass; it is the
    default for dictionaries of more than PATTERN_KEYWORDS. A table is then collected, of MOST_KEYWORDS keywords at most.
    """
    low = F.lower(F.col(text))
    if isinstance(keywords, DataFrame):
        if automaton:
            entries = keywords.select(F.col(GAME).cast("string"), "aspect", F.explode("keywords").alias("keyword")).limit(MOST_KEYWORDS + 1)
            return tag_by_automaton(df, [(r[0] if r[0] is not None else "", r[1], r[2]) for r in entries.collect()], text)
        return _tag_by_game(df, keywords, low)
    named = {a: w for a, w in sorted(keywords.items()) if w}
    if automaton if automaton is not None else large(keywords):
        return tag_by_automaton(df, [(ANY_GAME, a, w) for a, words in named.items() for w in words], text)
    hits = [F.when(low.rlike(ft.any_word(words)), F.lit(a)) for a, words in named.items()]
    return df.withColumn("aspects", F.array_compact(F.array(*hits)))


def large(keywords: Mapping[str, Sequence[str]]) -> bool:
    """Too many keywords for patterns."""
    return sum(map(len, keywords.values())) > PATTERN_KEYWORDS


def _tag_by_game(df: DataFrame, keywords: DataFrame, low: Column) -> DataFrame:
    hits = F.transform(
        F.transform("keywords", lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}_ ])", r"\\$1")),
        lambda q: F.concat(q, F.lit(f"(?<!{ft.WORD}"), q, F.lit(")")),
    )
    pattern = F.concat(F.lit("(?:"), F.array_join(hits, "|"), F.lit(")" + ft.NOT_BEFORE_WORD))
    rules = (
        keywords.filter(F.size("keywords") > 0)
        .groupBy(GAME)
        .agg(F.array_sort(F.collect_list(F.struct("aspect", pattern.alias("pattern")))).alias("__rules"))
    )
    tagged = grouping.join_small(df.withColumn("__low", low), rules, [GAME], "left")
    found = F.expr("transform(filter(__rules, r -> __low rlike r.pattern), r -> r.aspect)")
    empty = F.array().cast("array<string>")
    return tagged.withColumn("aspects", F.coalesce(found, empty)).drop("__rules", "__low")


def judged_reviews(df: DataFrame, keywords=KEYWORDS, scorer: Scorer | None = None, text: str = "review") -> DataFrame:
    """Reviews with at least one aspect, with label and confidence: (..., aspects, label, confidence).

    Later steps unfold `aspects` with an outer generator; an inner one would tag every text again
    for the filter Spark derives from it.
    """
    if isinstance(keywords, DataFrame) or large(keywords):
        tagged = tag_aspects(df, keywords, text).filter(F.size("aspects") > 0)
    else:
        # One pattern of all keywords decides; a filter on `aspects` would run all patterns twice.
        every = [w for words in keywords.values() for w in words]
        tagged = tag_aspects(df.filter(F.lower(text).rlike(ft.any_word(every))), keywords, text)
    return score_sentiment(tagged, scorer, text)


def aspect_sentiment(judged: DataFrame, cuts: SentimentCuts = CUTS) -> DataFrame:
    """Per aspect: mentions (before the cut), positive, negative, shares and mean confidence (after).

    Rounding is half-even: percent to two digits, confidence to three.
    """
    kept = F.col("confidence") >= cuts.aspect_confidence
    stats = (
        judged.select(GAME, F.explode_outer("aspects").alias("aspect"), "label", "confidence")
        .groupBy(GAME, "aspect")
        .agg(
            F.count("*").alias("mentions"),
            F.count_if(kept & (F.col("label") == "POSITIVE")).alias("positive"),
            F.count_if(kept & (F.col("label") == "NEGATIVE")).alias("negative"),
            F.avg(F.when(kept, F.col("confidence"))).alias("mean"),
        )
    )
    total = F.col("positive") + F.col("negative")
    return stats.filter(total > 0).select(
        GAME,
        "aspect",
        "mentions",
        "positive",
        "negative",
        total.alias("total_analyzed"),
        F.bround(F.col("positive") / total * 100, 2).alias("percent_positive"),
        F.bround("mean", 3).alias("avg_confidence"),
    )


def aspect_examples(judged: DataFrame, n: int = 5, text: str = "review", cuts: SentimentCuts = CUTS) -> DataFrame:
    """The first n reviews per aspect above the cut, shortened to 200 characters."""
    kept = judged.filter(F.col("confidence") >= cuts.aspect_confidence)
    rows = kept.select(GAME, F.explode_outer("aspects").alias("aspect"), "review_id", text, "label", "confidence")
    return grouping.first_n(rows, [GAME, "aspect"], [F.col("review_id")], n).select(
        GAME,
        "aspect",
        "rank",
        "review_id",
        ft.truncate(F.col(text), 200, ellipsis=True).alias("review"),
        F.col("label").alias("sentiment"),
        "confidence",
    )


def confidence_distribution(judged: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of the confidences of all tagged reviews, before the cut."""
    return grouping.histogram(judged, [GAME], "confidence", bins)


def confidence_summary(judged: DataFrame, cuts: SentimentCuts = CUTS) -> DataFrame:
    median = grouping.exact_quantiles(judged, [GAME], "confidence", {"median": 0.5})
    low = F.col("confidence") < cuts.aspect_confidence
    stats = judged.groupBy(GAME).agg(
        F.count("*").alias("total"),
        F.count_if(~low).alias("included"),
        F.count_if(low).alias("excluded"),
        F.avg("confidence").alias("mean"),
    )
    return stats.join(median, GAME, "left")


def absa_summary(aspects: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Number of aspects and topics, and the most mentioned, most and least positive aspect."""
    c = F.col
    out = aspects.groupBy(GAME).agg(
        F.count("*").alias("total_keyword_aspects"),
        F.min_by("aspect", F.struct(-c("mentions"), c("aspect"))).alias("most_mentioned_aspect"),
        F.min_by("aspect", F.struct(-c("percent_positive"), c("aspect"))).alias("most_positive_aspect"),
        F.min_by("aspect", F.struct(c("percent_positive"), c("aspect"))).alias("most_negative_aspect"),
    )
    if topics is None:
        return out.withColumn("total_discovered_topics", F.lit(0).cast("long"))
    counts = topics.groupBy(GAME).agg(F.count("*").alias("total_discovered_topics"))
    return out.join(counts, GAME, "full").fillna(0, ["total_keyword_aspects", "total_discovered_topics"])


def aspect_bars(aspects: DataFrame) -> DataFrame:
    """Bars per aspect in drawing order, and whether a log axis is due (range over 100)."""
    w = Window.partitionBy(GAME)
    use_log = F.max("total_analyzed").over(w) / F.min("total_analyzed").over(w) > 100
    return aspects.select(
        GAME,
        "aspect",
        "positive",
        "negative",
        F.col("total_analyzed").alias("total"),
        percent(F.col("positive"), F.col("total_analyzed")).alias("positive_pct"),
        F.row_number().over(w.orderBy(F.desc("total_analyzed"), "aspect")).alias("position"),
        use_log.alias("use_log"),
    )


def overall_sentiment(aspects: DataFrame) -> DataFrame:
    sums = aspects.groupBy(GAME).agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    total = F.col("positive") + F.col("negative")
    return sums.filter(total > 0).select(
        GAME,
        "positive",
        "negative",
        total.alias("total"),
        percent(F.col("positive"), total).alias("positive_pct"),
        percent(F.col("negative"), total).alias("negative_pct"),
    )


def aspect_matrix(aspects: DataFrame) -> DataFrame:
    """Long form of the heat map (aspect, measure, value); none for games with one aspect."""
    w = Window.partitionBy(GAME)
    wide = aspects.withColumns(
        {"aspects": F.count("*").over(w), "top": F.max("mentions").over(w)}
    ).filter("aspects >= 2")
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"))
            for name, value in (
                ("positive_pct", F.col("percent_positive")),
                ("confidence_pct", F.col("avg_confidence") * 100),
                ("mentions", F.col("mentions")),
                ("mentions_share", F.col("mentions") / F.col("top")),
            )
        ]
    )
    return wide.select(GAME, "aspect", F.inline(cells))


def topic_bars(topics: DataFrame) -> DataFrame:
    """Bars per topic in drawing order, labelled with the first three words."""
    w = Window.partitionBy(GAME).orderBy(F.desc("mentions"), "topic")
    words = F.array_join(F.slice("words", 1, 3), ", ")
    return topics.select(
        GAME,
        "topic",
        F.concat_ws("", "topic", F.lit("\n("), words, F.lit(")")).alias("label"),
        "positive",
        "negative",
        F.row_number().over(w).alias("position"),
    )


def top_aspects(aspects: DataFrame, n: int = 3) -> DataFrame:
    rows = grouping.first_n(aspects, [GAME], [F.desc("mentions"), F.col("aspect")], n)
    return rows.select(GAME, "rank", "aspect", "mentions", "percent_positive", "avg_confidence")


REPORT_COLUMNS = (
    "game_id section position item mentions analyzed positive positive_pct negative negative_pct "
    "avg_confidence detail"
).split()


def aspect_report(aspects: DataFrame, examples: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """The report as ordered rows: aspects with up to three examples, topics, summary."""
    quotes = examples.filter("rank <= 3").groupBy(GAME, "aspect").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", F.format_string("[%s] %s", "sentiment", "review").alias("line")))
        ).alias("q")
    )
    w = Window.partitionBy(GAME)

    def judged_rows(df: DataFrame, section: str, item: str, analyzed: Column, confidence: Column, detail: Column) -> DataFrame:
        return df.select(
            GAME,
            F.lit(section).alias("section"),
            F.row_number().over(w.orderBy(F.desc("mentions"), item)).cast("long").alias("position"),
            F.col(item).alias("item"),
            "mentions",
            analyzed.alias("analyzed"),
            "positive",
            F.col("percent_positive").alias("positive_pct"),
            "negative",
            (100 - F.col("percent_positive")).alias("negative_pct"),
            confidence.alias("avg_confidence"),
            detail.alias("detail"),
        )

    out = judged_rows(
        aspects.join(quotes, [GAME, "aspect"], "left"),
        "1 aspects",
        "aspect",
        F.col("total_analyzed"),
        F.col("avg_confidence"),
        F.coalesce(F.array_join(F.transform("q", lambda x: x["line"]), "\n"), F.lit("")),
    )
    if topics is not None:
        none = F.lit(None)
        out = out.unionByName(
            judged_rows(
                topics,
                "2 topics",
                "topic",
                F.col("mentions"),
                none.cast("double"),
                F.array_join("words", ", "),
            )
        )
    facts = absa_summary(aspects, topics)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("position"),
                F.lit(name).alias("item"),
                F.coalesce(F.col(name).cast("string"), F.lit("N/A")).alias("detail"),
            )
            for i, name in enumerate(
                (
                    "total_keyword_aspects",
                    "total_discovered_topics",
                    "most_mentioned_aspect",
                    "most_positive_aspect",
                    "most_negative_aspect",
                ),
                1,
            )
        ]
    )
    summary = facts.select(GAME, F.lit("3 summary").alias("section"), F.inline(cells))
    return out.unionByName(summary, allowMissingColumns=True).select(*REPORT_COLUMNS)


def aspect_report_lines(report: DataFrame) -> DataFrame:
    """The report rows as text lines, ready for a text sink."""
    c = F.col
    counts = F.format_string(
        "%s = %d mentions; positive %d, %.2f %%; negative %d, %.2f %%",
        F.upper("item"), c("mentions"), c("positive"), c("positive_pct"), c("negative"), c("negative_pct"),
    )
    line = F.when(c("section") == "3 summary", F.concat_ws(": ", "item", "detail")).otherwise(
        F.concat_ws("\n", counts, F.when(c("detail") != "", c("detail")))
    )
    return report.select(GAME, "section", "position", line.alias("line"))
