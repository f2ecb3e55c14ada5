"""Summaries and gates."""

from pyspark.sql import functions as F

from querybook.base import META_SQL, TEXT_SQL, query, r6, reviews_meta, reviews_text
from querybook.cleaning import W
from reviewscope.functions import text as ft
from reviewscope.operators import cleaning, summary
from reviewscope.operators.credibility import row_rules

# A simple flag for the summary operators: the rules that need only the row.
FLAG = (
    "(playtime_forever < 10 and weighted_vote_score > 0.95 and votes_up = 0) "
    "or (num_games_owned > 500 and playtime_forever < 30) "
    "or (num_reviews > 50 and votes_up < 1)"
)
FLAGGED_SQL = f"{META_SQL}, flagged as (select *, {FLAG} as is_fake from reviews)"


def flagged(spark, sf):
    rules = row_rules()
    hit = rules["rule1"] | rules["rule2"] | rules["rule3"]
    return reviews_meta(spark, sf).withColumn("is_fake", hit)


@query(
    "ingest_filter_stats",
    f"with {TEXT_SQL}, k as (select game_id, lang = 'en' and len(list_filter("
    f"regexp_extract_all(lower(review), '{W}+'), lambda w: regexp_full_match(w, '[a-z]+'))) >= 3 as kept from reviews) "
    "select game_id, count(*) as processed, count(*) filter (kept) as kept, count(*) filter (not kept) as filtered, "
    f"{r6('count(*) filter (not kept) * 100.0::double / count(*)')} as filtered_pct from k group by game_id",
)
def _(spark, sf):
    words = ft.normalise_tokens(F.col("review"))
    kept = (F.col("lang") == "en") & words.isNotNull()
    return summary.ingest_filter_stats(reviews_text(spark, sf), kept)


@query(
    "data_summary",
    f"with {META_SQL} select game_id, count(*) as total_reviews, {r6('avg(playtime_forever)/60')} as avg_playtime_hours, "
    "count(distinct author_id) as total_unique_reviewers, "
    f"{r6('avg(length(review))')} as avg_review_length, count(*) filter (votes_up > 0) as reviews_with_votes, "
    "count(*) filter (steam_purchase) as steam_purchases, min(timestamp_created) as earliest, "
    f"max(timestamp_created) as latest, {r6('quantile_cont(playtime_forever, 0.5)/60')} as median_playtime_hours "
    "from reviews group by game_id",
)
def _(spark, sf):
    return summary.data_summary(cleaning.text_lengths(reviews_meta(spark, sf)))


@query(
    "flagged_summary",
    f"with {FLAGGED_SQL}, f as (select * from flagged where is_fake), "
    "m as (select game_id, playtime_forever, row_number() over (partition by game_id order by count(*) desc, playtime_forever) as rn "
    "from f group by game_id, playtime_forever) "
    f"select game_id, count(*) as total_fake_reviews, {r6('avg(f.playtime_forever)')} as avg_playtime, "
    f"{r6('avg(num_games_owned)')} as avg_num_games, {r6('avg(num_reviews)')} as avg_num_reviews, "
    f"{r6('avg(votes_up)')} as avg_votes_up, {r6('min(m.playtime_forever)')} as most_common_playtime "
    "from f join m using (game_id) where m.rn = 1 group by game_id",
)
def _(spark, sf):
    return summary.flagged_summary(flagged(spark, sf).filter("is_fake"))


@query(
    "playtime_histogram",
    f"with {META_SQL}, h as (select game_id, playtime_forever/60 as h from reviews), "
    "r as (select game_id, min(h) as lo, max(h) as hi from h group by game_id), "
    "c as (select game_id, least(floor((h-lo)*50/(hi-lo)), 49)::bigint as bin, count(*) as n "
    "from h join r using (game_id) group by all), "
    "b as (select game_id, lo, hi, unnest(range(50)) as bin from r) "
    f"select game_id, bin, {r6('lo+(hi-lo)/50*bin')} as bin_lo, {r6('lo+(hi-lo)/50*(bin+1)')} as bin_hi, "
    "coalesce(n, 0) as n from b left join c using (game_id, bin)",
)
def _(spark, sf):
    return summary.playtime_histogram(reviews_meta(spark, sf))


RETENTION_SQL = (
    f"{FLAGGED_SQL}, k as (select game_id, count(*) as raw, count(*) filter (not is_fake) as credible, "
    "count(*) filter (is_fake) as fake from flagged group by game_id)"
)


@query(
    "quality_gates",
    f"with {RETENTION_SQL} "
    "select game_id, 'volume' as gate, raw::double as value, "
    "case when raw < 500 then 'refuse' when raw < 1000 then 'warn' else 'ok' end as status from k "
    "union all select game_id, 'volume_strict', raw, "
    "case when raw < 1000 then 'refuse' when raw <= 2500 then 'warn' else 'ok' end from k "
    f"union all select game_id, 'fake_rate', {r6('fake::double/raw')}, case when fake::double/raw > 0.1 then 'warn' else 'ok' end from k "
    "union all select game_id, 'credible_volume', credible, case when credible < 1000 then 'warn' else 'ok' end from k",
)
def _(spark, sf):
    return summary.quality_gates(flagged(spark, sf))


@query(
    "retention_report",
    f"with {RETENTION_SQL} select game_id, raw, credible, fake, {r6('credible*100.0::double/raw')} as credible_pct, "
    f"{r6('fake*100.0::double/raw')} as fake_pct from k",
)
def _(spark, sf):
    return summary.retention_report(flagged(spark, sf))


@query(
    "flagged_examples",
    f"with {FLAGGED_SQL}, f as (select *, row_number() over (partition by game_id order by review_id) as rank from flagged where is_fake) "
    f"select game_id, rank, review_id, {r6('playtime_forever')} as playtime_forever, review, num_reviews, votes_up from f where rank <= 5",
)
def _(spark, sf):
    return summary.flagged_examples(flagged(spark, sf).filter("is_fake"))
