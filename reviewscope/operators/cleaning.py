"""Row-level cleaning: every operator is a narrow projection or filter, none shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewscope.config import NUMERIC_COLUMNS, REQUIRED_COLUMNS
from reviewscope.functions import numeric as fn
from reviewscope.functions import text as ft
from reviewscope.operators.languages import LanguageModel


def language_filter(
    df: DataFrame, text: str = "review", lang: str = "en", column: str | None = "lang", model: LanguageModel | None = None
) -> DataFrame:
    """Keep rows in one language: by a trained model if given, else by a language column if there is one, else by a guess."""
    if model is not None:
        known = model.detect(text)["language"]
    else:
        known = F.col(column) if column and column in df.columns else ft.guess_language(F.col(text))
    return df.filter(known == lang)


def normalise_reviews(df: DataFrame, text: str = "review", min_words: int = 3) -> DataFrame:
    """Replace the text by its normalised words and drop rows with too few."""
    return df.withColumn(text, ft.normalise_tokens(F.col(text), min_words)).filter(F.col(text).isNotNull())


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def contract_report(
    df: DataFrame,
    required: Sequence[str] = REQUIRED_COLUMNS,
    numeric: Sequence[str] = NUMERIC_COLUMNS,
) -> DataFrame:
    """Per required column: null rows, and rows whose value is no number and will become 0."""
    require_columns(df, required)
    aggs = []
    for name in required:
        value = F.col(name)
        aggs.append(F.count_if(value.isNull()).alias(f"{name}|nulls"))
        bad = F.lit(False)
        if name in numeric:
            number = value.try_cast("double")
            bad = value.isNotNull() & (number.isNull() | F.isnan(number))
        aggs.append(F.count_if(bad).alias(f"{name}|bad"))
    totals = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"`{name}|nulls`").alias("nulls"),
                F.col(f"`{name}|bad`").alias("bad"),
            )
            for name in required
        ]
    )
    return totals.select(F.inline(rows))


def drop_empty_reviews(df: DataFrame, text: str = "review") -> DataFrame:
    return df.filter(~ft.is_blank(F.col(text)))


def parse_timestamps(df: DataFrame, column: str = "timestamp_created") -> DataFrame:
    """Parse per row (an unparsable value is null) and add date and hour; no-op without the column."""
    if column not in df.columns:
        return df
    return df.withColumn(column, F.col(column).try_cast("timestamp_ntz")).withColumns(
        {"review_date": F.to_date(column), "review_hour": F.hour(column)}
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> DataFrame:
    return df.withColumns({c: fn.to_number(F.col(c)) for c in columns})


def text_lengths(df: DataFrame, text: str = "review") -> DataFrame:
    return df.withColumns(
        {"review_length": ft.text_length(F.col(text)), "review_words": ft.word_count(F.col(text))}
    )


def ensure_author_id(df: DataFrame, row_id: str = "review_id") -> DataFrame:
    """A pseudo author per row where the source names none (unique per row by design)."""
    if "author_id" in df.columns:
        return df
    parts = [F.col(c).cast("string") for c in ("num_games_owned", "num_reviews", row_id)]
    return df.withColumn("author_id", F.concat_ws("_", *parts))


def validate_ranges(df: DataFrame) -> DataFrame:
    return df.filter((F.col("playtime_forever") >= 0) & F.col("weighted_vote_score").between(0, 1))


def clean_reviews(df: DataFrame) -> DataFrame:
    """The whole cleaning step; Spark fuses it into one pass over the scan."""
    df = require_columns(df)
    df = drop_empty_reviews(df)
    df = parse_timestamps(df)
    df = coerce_numeric(df)
    df = text_lengths(df)
    df = ensure_author_id(df)
    return validate_ranges(df)
