"""Catalog lookup and whole runs."""

from pyspark.sql import functions as F

from querybook.base import META_SQL, TEXT_SQL, query, r6, reviews_meta, reviews_text, table
from querybook.credibility import KNN_SQL, rules_sql
from querybook.emotions import LONG_SQL, MODELS, logits, predictions
from querybook.texts import JUDGED_SQL, KEYWORDS, SCORER, SUMMARY_SQL, aspect_table
from reviewscope.operators import catalog, ensemble, summary
from reviewscope.plans import jobs
from reviewscope.session import scratch_path
from reviewscope.sources import publish


def parts(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey as id", "p_name as name", "p_retailprice as price")


@query(
    "search_catalog",
    f"select p_partkey as id, p_name as name, {r6('p_retailprice')} as price from part where contains(lower(p_name), 'red') order by p_name, p_partkey limit 10",
)
def _(spark, sf):
    return catalog.search_catalog(parts(spark, sf), "Red")


INPUTS = (
    "select cast(o_orderkey as varchar(20)) as input from orders union select upper(substr(p_name, 3, 6)) from part "
    "union select p_type from part union select substr(p_name, 1, 2) from part"
)


@query(
    "resolve_items",
    f"with asked as ({INPUTS}), ids as (select input, p_partkey as id, p_name as name from asked join part "
    "on regexp_full_match(input, '[0-9]+') and p_partkey = try_cast(input as bigint)), "
    "names as (select input, p_partkey as id, p_name as name, row_number() over (partition by input order by p_name, p_partkey) as rn "
    "from asked join part on contains(lower(p_name), lower(input)) where not regexp_full_match(input, '[0-9]+')) "
    "select input, id, name from asked left join (select * from ids union all select input, id, name from names where rn = 1) using (input)",
)
def _(spark, sf):
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    inputs = (
        o.select(F.col("o_orderkey").cast("string").alias("input"))
        .union(p.select(F.upper(F.substring("p_name", 3, 6))))
        .union(p.select("p_type"))
        .union(p.select(F.substring("p_name", 1, 2)))
    )
    return catalog.resolve_items(inputs, parts(spark, sf))


@query(
    "cap_rows",
    f"with {META_SQL}, r as (select *, row_number() over (partition by game_id order by review_id) as rn from reviews) "
    "select review_id, game_id from r where rn <= 1000",
)
def _(spark, sf):
    return catalog.cap_rows(reviews_meta(spark, sf)).select("review_id", "game_id")


def _state(flag, source, where=""):
    return (
        f"select game_id, count(*) as raw, count(*) filter (not {flag}) as credible, count(*) filter ({flag}) as fake, "
        f"{r6(f'count(*) filter (not {flag}) * 100.0::double / count(*)')} as credible_pct, "
        f"{r6(f'count(*) filter ({flag}) * 100.0::double / count(*)')} as fake_pct from {source} {where} group by game_id"
    )


@query("run_review_pipeline", f"with {KNN_SQL} {_state('fake', 'relabelled')}")
def _(spark, sf):
    return jobs.run_review_pipeline(reviews_meta(spark, sf)).state


@query(
    "multi_game_batch",
    f"with {rules_sql()} {_state('is_fake', 'flagged', 'where game_id in (' + repr('click') + ', ' + repr('purchase') + ')')}",
)
def _(spark, sf):
    chosen = jobs.select_games(reviews_meta(spark, sf), ["click", "purchase"])
    return jobs.run_review_pipeline(chosen, jobs.RunConfig(use_knn=False)).state


# A run over all games, then one over every second review of two of them: what is current afterwards.
AGAIN = ("click", "purchase")
AGAIN_SQL = rules_sql().replace("from events)", f"from events where not (event_type in {AGAIN} and event_id % 2 = 1))")


@query(
    "publish_review_run",
    f"with {AGAIN_SQL}, kinds as (select unnest(['raw', 'cleaned', 'credible', 'fake']) as kind) "
    "select game_id, kind, count(*) as n, sum(review_id)::bigint as ids from flagged join kinds "
    "on kind in ('raw', 'cleaned') or kind = case when is_fake then 'fake' else 'credible' end group by all",
)
def _(spark, sf):
    path = scratch_path(spark, "published")
    rows = reviews_meta(spark, sf)
    jobs.run_review_pipeline(rows, jobs.RunConfig(use_knn=False, publish=path, run="first"))
    half = rows.filter(F.col("game_id").isin(*AGAIN) & (F.col("review_id") % 2 == 0))
    jobs.run_review_pipeline(half, jobs.RunConfig(use_knn=False, publish=path, run="second", whole=False))
    found = None
    for kind in ("raw", "cleaned", "credible", "fake"):
        own = publish.published(spark, path, kind).groupBy("game_id").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("review_id").alias("ids"))
        found = own if found is None else found.unionByName(own)
    return found


def written_reviews(spark, sf):
    """All events with the text of the same id, where there is one, all other texts, and logits where there is a vector."""
    meta = reviews_meta(spark, sf).drop("review").withColumnRenamed("game_id", "event_game")
    both = meta.join(reviews_text(spark, sf), "review_id", "full")
    both = both.withColumn("game_id", F.coalesce("game_id", "event_game")).drop("event_game")
    return both.join(logits(spark, sf).drop("game_id", "truth"), "review_id", "left")


@query("run_full_analysis")
def _(spark, sf):
    config = jobs.RunConfig(
        keywords=KEYWORDS,
        scorer=SCORER,
        emotion_models=lambda df: ensemble.score_models(df, {m: F.col(m) for m in MODELS}),
        n_topics=5,
    )
    done = jobs.run_full_analysis(written_reviews(spark, sf), config)
    return done.results.select(
        "game_id",
        "data_summary.raw",
        "data_summary.credible",
        F.size("aspect_sentiments").alias("aspects"),
        "absa_summary.total_discovered_topics",
        "emotion_summary.total_analyzed",
        "emotion_summary.overall_confidence",
    )


# Reviews with text and numbers: events joined with the documents of the same id, a game per source.
BOTH_SQL = (
    rules_sql()
    .replace("from events)", "from events join documents on doc_id = event_id)")
    .replace("event_type as game_id", "source as game_id")
    .replace("concat(event_type, ' ', props) as review", "text as review")
)
CREDIBLE_SQL = "credible as (select * from flagged where not is_fake), " + JUDGED_SQL.replace(f"{TEXT_SQL}, ", "").replace("from reviews)", "from credible)")


@query(
    "run_full_analysis_resumed",
    f"with {BOTH_SQL}, {CREDIBLE_SQL}, counts as (select game_id, count(*) as raw, count(*) filter (not is_fake) as credible from flagged group by game_id) "
    f"select game_id, raw, credible, aspect, mentions, {r6('pct')} as positive_percentage, 'reused' as status from counts join aspects using (game_id)",
)
def _(spark, sf):
    """A run whose aspects succeed and whose emotions fail, and the run that takes up what is complete."""
    texts = reviews_text(spark, sf).drop("lang")
    rows = reviews_meta(spark, sf).drop("review", "game_id").join(texts, "review_id")

    def broken(df):
        raise RuntimeError("no model")

    config = jobs.RunConfig(use_knn=False, run_nmf=False, keywords=KEYWORDS, scorer=SCORER, emotion_models=broken, output=scratch_path(spark, "resumed"), resume=True)
    jobs.run_full_analysis(rows, config)
    done = jobs.run_full_analysis(rows, config).results
    each = done.select("game_id", "data_summary.raw", "data_summary.credible", F.col("parts")["aspects"].alias("status"), F.inline("aspect_sentiments"))
    return each.select("game_id", "raw", "credible", "aspect", "mentions", "positive_percentage", "status")


@query(
    "analysis_summary",
    f"with {LONG_SQL}, {JUDGED_SQL}, {SUMMARY_SQL}, "
    "flagged as (select game_id, review_id, coalesce(toxic, 0) = 1 as is_fake from reviews left join labels on doc_id = review_id), "
    f"state as ({_state('is_fake', 'flagged')}), "
    "felt as (select reviews.game_id, pred.emotion, pred.confidence from pred join reviews on reviews.review_id = pred.review_id), "
    "dist as (select game_id, emotion, count(*) as n, count(*) * 100.0::double / sum(count(*)) over (partition by game_id) as pct, "
    "row_number() over (partition by game_id order by count(*) desc, emotion) as rank from felt group by game_id, emotion), "
    "val as (select game_id, coalesce(sum(pct) filter (emotion in ('joy', 'love', 'surprise')), 0) as pos, "
    "coalesce(sum(pct) filter (emotion in ('sadness', 'anger', 'fear')), 0) as neg, max(emotion) filter (rank = 1) as dominant_emotion, "
    "max(pct) as dominant_pct, string_agg(emotion, ', ' order by rank) filter (rank <= 3) as top_emotions from dist group by game_id), "
    "ra as (select *, row_number() over (partition by game_id order by mentions desc, aspect) as rank from aspects), "
    "ta as (select game_id, string_agg(aspect, ', ' order by rank) filter (rank <= 3) as top_aspects from ra group by game_id), "
    "mc as (select game_id, avg(confidence) as conf from felt group by game_id) "
    "select state.*, summary.* exclude (game_id), top_aspects, top_emotions, "
    f"{r6('conf')} as overall_confidence, {r6('pos')} as positive_pct, {r6('neg')} as negative_pct, dominant_emotion, "
    f"{r6('dominant_pct')} as dominant_pct, case when neg > 0 then {r6('pos / neg')} end as valence_ratio "
    "from state left join summary using (game_id) left join ta using (game_id) left join val using (game_id) left join mc using (game_id)",
)
def _(spark, sf):
    docs = reviews_text(spark, sf)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("review_id"), "toxic")
    flagged = docs.join(labels, "review_id", "left").withColumn(
        "is_fake", F.coalesce(F.col("toxic") == 1, F.lit(False))
    )
    felt = predictions(spark, sf).drop("game_id").join(docs.select("review_id", "game_id"), "review_id")
    return jobs.analysis_summary(summary.retention_report(flagged), aspect_table(spark, sf), felt)
