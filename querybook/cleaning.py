"""Row-level cleaning operators."""

from pyspark.sql import functions as F

from querybook.base import META_SQL, RAW_SQL, TEXT_SQL, query, r6, reviews_meta, reviews_raw, reviews_text, table
from reviewscope.config import LANGUAGE_PROFILES, NUMERIC_COLUMNS, REQUIRED_COLUMNS
from reviewscope.functions import numeric as fn
from reviewscope.functions import text as ft
from reviewscope.operators import cleaning, languages, text_models

BLANK = r"coalesce(not regexp_matches(review, '[^\pZ\pC]'), true)"
W = r"[\pL\pN_]"


@query(
    "language_filter",
    f"with {TEXT_SQL} select review_id, game_id, md5(review) as digest from reviews where lang = 'en'",
)
def _(spark, sf):
    kept = cleaning.language_filter(reviews_text(spark, sf))
    return kept.select("review_id", "game_id", F.md5("review").alias("digest"))


def _hits(words):
    # One word per match on both sides of a run of non-word characters, so pad every word.
    runs = f"regexp_extract_all(lower(review), '{W}+')"
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter({runs}, lambda w: w in ({listed})))"


@query(
    "language_guess",
    f"with {TEXT_SQL}, hits as (select review_id, "
    + ", ".join(f"{_hits(words)} as {lang}_" for lang, words in LANGUAGE_PROFILES.items())
    + " from reviews) select review_id, case "
    + "when greatest(en_, fr_, de_, es_) = 0 then null "
    + " ".join(
        f"when {lang}_ = greatest(en_, fr_, de_, es_) then '{lang}'" for lang in LANGUAGE_PROFILES
    )
    + " end as guessed from hits",
)
def _(spark, sf):
    df = reviews_text(spark, sf)
    return df.select("review_id", ft.guess_language(F.col("review")).alias("guessed"))


# Trained on four fifths of the documents; every document is told, the rest of them held out.
TRIGRAMS_SQL = (
    f"{TEXT_SQL}, points as (select review_id, lang, list_transform(string_split(' ' || "
    "trim(regexp_replace(lower(review), '[^\\pL]+', ' ', 'g')) || ' ', ''), lambda c: unicode(c)) as p from reviews where review is not null), "
    f"cells as (select review_id, lang, unnest(list_transform(range(1, len(p) - 1), lambda i: (p[i]::bigint * 961 + p[i + 1] * 31 + p[i + 2]) % {languages.CELLS})) as cell from points), "
    "counts as (select lang, cell, count(*) as n from cells where review_id % 5 <> 0 and lang is not null group by all), "
    "totals as (select lang, sum(n) as total from counts group by lang), "
    "sums as (select review_id, t.lang, count(*) as size, "
    f"sum(round(ln((coalesce(n, 0) + 1)::double / (total + {languages.CELLS})) * {languages.UNIT})::bigint)::bigint as sum "
    "from cells c join totals t on true left join counts k on k.lang = t.lang and k.cell = c.cell group by all), "
    "ranked as (select *, row_number() over (partition by review_id order by sum desc, lang) as place, "
    "lead(sum) over (partition by review_id order by sum desc, lang) as next from sums)"
)


@query(
    "language_trigrams",
    f"with {TRIGRAMS_SQL} select r.review_id, r.review_id % 5 = 0 as held_out, k.lang as detected, "
    f"{r6(f'(sum - next) / {languages.UNIT}::double / size')} as margin from reviews r left join ranked k on r.review_id = k.review_id and place = 1",
)
def _(spark, sf):
    df = reviews_text(spark, sf)
    held_out = F.col("review_id") % 5 == 0
    model = languages.train_languages(df.filter(~held_out))
    found = df.select("review_id", held_out.alias("held_out"), model.detect("review").alias("found"))
    return found.select("review_id", "held_out", F.col("found.language").alias("detected"), "found.margin")


# The documents' letters beyond ASCII are bytes 0xC0 to 0xFF in windows-1252: each begins a UTF-8 character that no continuation follows.
@query(
    "repair_text",
    f"with {TEXT_SQL} select review_id, replace(regexp_replace(review, '[À-ÿ]', '�', 'g'), chr(39), '') as review from reviews",
)
def _(spark, sf):
    df = reviews_text(spark, sf)
    return df.select("review_id", ft.repair_text(F.col("review")).alias("review"))


_NORMALISED = (
    f"with {TEXT_SQL}, words as (select review_id, list_filter("
    f"regexp_extract_all(lower(review), '{W}+'), lambda w: regexp_full_match(w, '[a-z]+')) as w from reviews)"
)


@query(
    "normalise_tokens",
    _NORMALISED
    + " select review_id, array_to_string(w, ' ') as review from words where len(w) >= 3",
)
def _(spark, sf):
    return cleaning.normalise_reviews(reviews_text(spark, sf)).select("review_id", "review")


@query("stem_and_stop")
def _(spark, sf):
    df = reviews_text(spark, sf)
    return df.select("review_id", text_models.stem_and_stop(F.col("review")).alias("review"))


@query(
    "epoch_to_utc",
    "select event_id, strftime(make_timestamp(epoch(ts)::bigint * 1000000), '%Y-%m-%d %H:%M:%S') as posted "
    "from (select event_id, date_trunc('second', ts) as ts from events)",
)
def _(spark, sf):
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", start, F.date_trunc("second", "ts").cast("timestamp_ntz"))
    df = table(spark, sf, "events").select("event_id", seconds.alias("seconds"))
    return df.select("event_id", fn.epoch_to_utc(F.col("seconds")).alias("posted"))


@query(
    "contract_report",
    f"with {RAW_SQL} "
    + " union all ".join(
        f"select '{c}' as \"column\", count(*) filter ({c} is null) as nulls, "
        + (
            f"count(*) filter ({c} is not null and (try_cast({c} as double) is null or isnan(try_cast({c} as double))))"
            if c in NUMERIC_COLUMNS
            else "0::bigint"
        )
        + " as bad from raw"
        for c in REQUIRED_COLUMNS
    ),
)
def _(spark, sf):
    return cleaning.contract_report(reviews_raw(spark, sf))


@query(
    "drop_empty_reviews",
    f"with {RAW_SQL} select review_id, review from raw where not {BLANK}",
)
def _(spark, sf):
    return cleaning.drop_empty_reviews(reviews_raw(spark, sf)).select("review_id", "review")


@query(
    "parse_timestamps",
    f"with {RAW_SQL}, t as (select review_id, try_cast(timestamp_created as timestamp) as t from raw) "
    "select review_id, t as timestamp_created, cast(t as date) as review_date, hour(t) as review_hour from t",
)
def _(spark, sf):
    return cleaning.parse_timestamps(reviews_raw(spark, sf)).select(
        "review_id", "timestamp_created", "review_date", "review_hour"
    )


def number(c):
    return f"case when isnan(try_cast({c} as double)) then 0 else coalesce(try_cast({c} as double), 0) end"


@query(
    "coerce_numeric",
    f"with {RAW_SQL} select review_id, "
    + ", ".join(f"{r6(number(c))} as {c}" for c in NUMERIC_COLUMNS)
    + " from raw",
)
def _(spark, sf):
    return cleaning.coerce_numeric(reviews_raw(spark, sf)).select("review_id", *NUMERIC_COLUMNS)


@query(
    "text_lengths",
    f"with {TEXT_SQL} select review_id, length(review) as review_length, "
    r"len(regexp_extract_all(review, '[^\s\pZ]+')) as review_words from reviews",
)
def _(spark, sf):
    df = cleaning.text_lengths(reviews_text(spark, sf))
    return df.select("review_id", "review_length", "review_words")


@query(
    "ensure_author_id",
    f"with {RAW_SQL} select review_id, concat_ws('_', {number('num_games_owned')}::double, "
    f"{number('num_reviews')}::double, review_id) as author_id from raw",
)
def _(spark, sf):
    df = cleaning.coerce_numeric(reviews_raw(spark, sf))
    return cleaning.ensure_author_id(df).select("review_id", "author_id")


@query(
    "validate_ranges",
    f"with {RAW_SQL}, n as (select review_id, {number('playtime_forever')} as p, "
    f"{number('weighted_vote_score')} as s from raw) "
    f"select review_id, {r6('p')} as playtime_forever, {r6('s')} as weighted_vote_score "
    "from n where p >= 0 and s >= 0 and s <= 1",
)
def _(spark, sf):
    df = cleaning.validate_ranges(cleaning.coerce_numeric(reviews_raw(spark, sf)))
    return df.select("review_id", "playtime_forever", "weighted_vote_score")


@query(
    "truncate_text",
    f"with {TEXT_SQL} select review_id, "
    "case when length(review) > 200 then substr(review, 1, 200) || '...' else review end as example, "
    "case when length(review) > 100 then substr(review, 1, 100) || '...' else review end as preview, "
    "substr(review, 1, 512) as model_input from reviews",
)
def _(spark, sf):
    text = F.col("review")
    return reviews_text(spark, sf).select(
        "review_id",
        ft.truncate(text, 200, ellipsis=True).alias("example"),
        ft.truncate(text, 100, ellipsis=True).alias("preview"),
        ft.truncate(text, 512).alias("model_input"),
    )


@query(
    "log_score",
    f"with {META_SQL} select review_id, {r6('log2(greatest(weighted_vote_score, 0.01))')} as score from reviews",
)
def _(spark, sf):
    df = reviews_meta(spark, sf)
    return df.select("review_id", fn.log_score(F.col("weighted_vote_score")).alias("score"))


CLEAN_SQL = (
    f"{RAW_SQL}, numbers as (select review_id, game_id, review, steam_purchase, "
    "try_cast(timestamp_created as timestamp) as timestamp_created, "
    + ", ".join(f"{number(c)} as {c}" for c in NUMERIC_COLUMNS)
    + f" from raw where not {BLANK}), cleaned as (select *, cast(timestamp_created as date) as review_date, "
    "hour(timestamp_created) as review_hour, length(review) as review_length, "
    r"len(regexp_extract_all(review, '[^\s\pZ]+')) as review_words, "
    "concat_ws('_', num_games_owned::double, num_reviews::double, review_id) as author_id "
    "from numbers where playtime_forever >= 0 and weighted_vote_score between 0 and 1)"
)


@query(
    "clean_reviews",
    f"with {CLEAN_SQL} select review_id, game_id, review, steam_purchase, timestamp_created, "
    + ", ".join(f"{r6(c)} as {c}" for c in NUMERIC_COLUMNS)
    + ", review_date, review_hour, review_length, review_words, author_id from cleaned",
)
def _(spark, sf):
    return cleaning.clean_reviews(reviews_raw(spark, sf))
