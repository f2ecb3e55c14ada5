"""Term weights, aspects and their tables, over `documents` (one game per source)."""

from pyspark.sql import functions as F

from querybook.base import TEXT_SQL, query, r6, reviews_text
from querybook.cleaning import W
from reviewscope.config import STOP_WORDS
from reviewscope.functions import text as ft
from reviewscope.operators import aspects, features, topics
from reviewscope.operators.sentiment import lexicon_scorer, score_sentiment

# The tables hold invented prose, so a stand-in dictionary takes the place of the seed words.
KEYWORDS = {
    "gameplay": ["from", "thing"],
    "graphics": ["erin", "then"],
    "performance": ["thnt", "ing"],
    "content": ["of the", "tion"],
    "audio": ["than", "eron"],
    "value": ["thor", "ble"],
}
POSITIVE, NEGATIVE = ["the"], ["of", "and"]
SCORER = lexicon_scorer(POSITIVE, NEGATIVE)

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS_SQL = (
    f"{TEXT_SQL}, words as (select game_id, review_id, list_filter(regexp_extract_all(lower(review), '{W}{{2,}}'), "
    f"lambda w: w not in ({STOP})) as w from reviews), "
    "grams as (select game_id, review_id, unnest(list_concat(w, list_transform(range(1, len(w)), "
    "lambda i: w[i] || ' ' || w[i + 1]))) as term from words), "
    "tf as (select game_id, review_id, term, count(*) as tf from grams group by all), "
    "docs as (select game_id, count(*) as docs from reviews group by game_id), "
    "totals as (select game_id, term, count(*) as df, sum(tf)::bigint as total from tf group by all)"
)


def vocab_sql(min_df, max_df, n=1000):
    return (
        f"{TERMS_SQL}, ranked as (select *, row_number() over (partition by game_id order by total desc, term) as rank "
        f"from totals join docs using (game_id) where df >= {min_df} and df <= docs * {max_df}::double), "
        f"vocab as (select * from ranked where rank <= {n})"
    )


def counts(spark, sf):
    return features.stored_counts(reviews_text(spark, sf))


for _name, _cut in (("guided", features.GUIDED), ("free", features.FREE)):

    def _vocab(name, cut):
        @query(f"vocabulary_{name}", f"with {vocab_sql(**cut)} select game_id, term, df, total, rank from vocab")
        def _(spark, sf):
            vocab = features.vocabulary(counts(spark, sf), **cut)
            return vocab.select("game_id", "term", "df", "total", "rank")

        @query(
            f"tfidf_{name}",
            f"with {vocab_sql(**cut)}, w as (select game_id, review_id, term, tf, tf * (ln((1 + docs)::double / (1 + df)) + 1) as w "
            "from tf join vocab using (game_id, term)) select game_id, review_id, term, tf, "
            f"{r6('w / sqrt(sum(w * w) over (partition by game_id, review_id))')} as weight from w",
        )
        def _(spark, sf):
            c = counts(spark, sf)
            return features.tfidf(c, features.vocabulary(c, **cut)).drop("rank")

    _vocab(_name, _cut)


def _found(words):
    return f"regexp_matches(low, '(^|[^\\pL\\pN_])({'|'.join(words)})($|[^\\pL\\pN_])')"


def _n(words):
    # Both sides of a word must be free, so every run of word characters is looked at alone.
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(regexp_extract_all(low, '{W}+'), lambda w: w in ({listed})))"


JUDGED_SQL = (
    f"{TEXT_SQL}, low as (select *, lower(review) as low from reviews), "
    "tagged as ("
    + " union all ".join(
        f"select game_id, review_id, '{a}' as aspect from low where {_found(w)}" for a, w in KEYWORDS.items()
    )
    + f"), hits as (select game_id, review_id, review, {_n(POSITIVE)} as pos, {_n(NEGATIVE)} as neg from low), "
    "scored as (select *, case when pos > neg then 'POSITIVE' when neg > pos then 'NEGATIVE' else 'NEUTRAL' end as label, "
    "case when pos = neg then 0.5::double else greatest(pos, neg)::double / (pos + neg) end as confidence from hits), "
    "judged as (select * from tagged join scored using (game_id, review_id)), "
    "perreview as (select game_id, review_id, any_value(confidence) as confidence from judged group by all), "
    "stats as (select game_id, aspect, count(*) as mentions, "
    "count(*) filter (confidence >= 0.6 and label = 'POSITIVE') as positive, "
    "count(*) filter (confidence >= 0.6 and label = 'NEGATIVE') as negative, "
    "avg(confidence) filter (confidence >= 0.6) as mean from judged group by all), "
    "aspects as (select game_id, aspect, mentions, positive, negative, positive + negative as total, "
    "round_even(positive::double / (positive + negative) * 100, 2) as pct, round_even(mean, 3) as conf "
    "from stats where positive + negative > 0)"
)


def judged(spark, sf):
    return aspects.judged_reviews(reviews_text(spark, sf), KEYWORDS, SCORER)


def aspect_table(spark, sf):
    return aspects.aspect_sentiment(judged(spark, sf))


@query("tag_aspects", f"with {JUDGED_SQL} select review_id, aspect from tagged")
def _(spark, sf):
    tagged = aspects.tag_aspects(reviews_text(spark, sf), KEYWORDS)
    return tagged.select("review_id", F.explode("aspects").alias("aspect"))


@query("tag_aspects_automaton", f"with {JUDGED_SQL} select review_id, aspect from tagged")
def _(spark, sf):
    tagged = aspects.tag_aspects(reviews_text(spark, sf), KEYWORDS, automaton=True)
    return tagged.select("review_id", F.explode("aspects").alias("aspect"))


# Ten thousand keywords: the words found in most reviews, dealt to aspects by their length.
MANY = 10_000
MANY_SQL = (
    f"{TEXT_SQL}, tokens as (select distinct review_id, unnest(regexp_extract_all(lower(review), '{W}+')) as word from reviews), "
    "most as (select word, count(*) as n from tokens group by word), "
    f"listed as (select word, 'length ' || length(word) as aspect from most order by n desc, word limit {MANY})"
)


@query("tag_many_keywords", f"with {MANY_SQL} select distinct review_id, aspect from tokens join listed using (word)")
def _(spark, sf):
    words = reviews_text(spark, sf).select("review_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("review"), F.lit(ft.WORD + "+"), F.lit(0)))).alias("word"))
    most = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(MANY)
    dictionary: dict[str, list[str]] = {}
    for r in most.collect():
        dictionary.setdefault(f"length {len(r['word'])}", []).append(r["word"])
    tagged = aspects.tag_aspects(reviews_text(spark, sf), dictionary)
    return tagged.select("review_id", F.explode("aspects").alias("aspect"))


@query(
    "score_sentiment",
    f"with {JUDGED_SQL} select review_id, label, {r6('confidence')} as confidence from scored",
)
def _(spark, sf):
    df = score_sentiment(reviews_text(spark, sf), SCORER)
    return df.select("review_id", "label", "confidence")


@query(
    "aspect_sentiment",
    f"with {JUDGED_SQL} select game_id, aspect, mentions, positive, negative, total as total_analyzed, "
    f"{r6('pct')} as percent_positive, {r6('conf')} as avg_confidence from aspects",
)
def _(spark, sf):
    return aspect_table(spark, sf)


EXAMPLES_SQL = (
    "examples as (select *, row_number() over (partition by game_id, aspect order by review_id) as rank, "
    "case when length(review) > 200 then substr(review, 1, 200) || '...' else review end as short from judged where confidence >= 0.6)"
)


@query(
    "aspect_examples",
    f"with {JUDGED_SQL}, {EXAMPLES_SQL} select game_id, aspect, rank, review_id, short as review, label as sentiment, "
    f"{r6('confidence')} as confidence from examples where rank <= 5",
)
def _(spark, sf):
    return aspects.aspect_examples(judged(spark, sf))


@query(
    "aspect_confidence_distribution",
    f"with {JUDGED_SQL}, r0 as (select game_id, min(confidence) as lo, max(confidence) as hi from perreview group by game_id), "
    "r as (select game_id, case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi from r0), "
    "c as (select game_id, least(floor((confidence - lo) * 30 / (hi - lo)), 29)::bigint as bin, count(*) as n from perreview join r using (game_id) group by all), "
    "b as (select r.*, bin from r, range(30) t(bin)) "
    f"select game_id, bin, {r6('lo + (hi - lo) / 30 * bin')} as bin_lo, {r6('lo + (hi - lo) / 30 * (bin + 1)')} as bin_hi, "
    "coalesce(n, 0) as n from b left join c using (game_id, bin)",
)
def _(spark, sf):
    return aspects.confidence_distribution(judged(spark, sf))


@query(
    "aspect_confidence_summary",
    f"with {JUDGED_SQL} select game_id, count(*) as total, count(*) filter (confidence >= 0.6) as included, "
    f"count(*) filter (confidence < 0.6) as excluded, {r6('avg(confidence)')} as mean, {r6('quantile_cont(confidence, 0.5)')} as median "
    "from perreview group by game_id",
)
def _(spark, sf):
    return aspects.confidence_summary(judged(spark, sf))


SUMMARY_SQL = (
    "summary as (select game_id, count(*) as total_keyword_aspects, 0::bigint as total_discovered_topics, "
    "first(aspect order by mentions desc, aspect) as most_mentioned_aspect, "
    "first(aspect order by pct desc, aspect) as most_positive_aspect, "
    "first(aspect order by pct, aspect) as most_negative_aspect from aspects group by game_id)"
)


@query("absa_summary", f"with {JUDGED_SQL}, {SUMMARY_SQL} select * from summary")
def _(spark, sf):
    return aspects.absa_summary(aspect_table(spark, sf))


@query(
    "aspect_bars",
    f"with {JUDGED_SQL} select game_id, aspect, positive, negative, total, {r6('positive * 100.0::double / total')} as positive_pct, "
    "row_number() over (partition by game_id order by total desc, aspect) as position, "
    "max(total) over (partition by game_id)::double / min(total) over (partition by game_id) > 100 as use_log from aspects",
)
def _(spark, sf):
    return aspects.aspect_bars(aspect_table(spark, sf))


@query(
    "overall_sentiment",
    f"with {JUDGED_SQL}, s as (select game_id, sum(positive)::bigint as positive, sum(negative)::bigint as negative from aspects group by game_id) "
    f"select game_id, positive, negative, positive + negative as total, {r6('positive * 100.0::double / (positive + negative)')} as positive_pct, "
    f"{r6('negative * 100.0::double / (positive + negative)')} as negative_pct from s",
)
def _(spark, sf):
    return aspects.overall_sentiment(aspect_table(spark, sf))


@query(
    "aspect_matrix",
    f"with {JUDGED_SQL}, m as (select *, count(*) over (partition by game_id) as k, max(mentions) over (partition by game_id) as top from aspects) "
    f"select game_id, aspect, 'positive_pct' as measure, {r6('pct')} as value from m where k >= 2 "
    f"union all select game_id, aspect, 'confidence_pct', {r6('conf * 100')} from m where k >= 2 "
    f"union all select game_id, aspect, 'mentions', mentions from m where k >= 2 "
    f"union all select game_id, aspect, 'mentions_share', {r6('mentions::double / top')} from m where k >= 2",
)
def _(spark, sf):
    return aspects.aspect_matrix(aspect_table(spark, sf))


@query(
    "top_aspects",
    f"with {JUDGED_SQL}, r as (select *, row_number() over (partition by game_id order by mentions desc, aspect) as rank from aspects) "
    f"select game_id, rank, aspect, mentions, {r6('pct')} as percent_positive, {r6('conf')} as avg_confidence from r where rank <= 3",
)
def _(spark, sf):
    return aspects.top_aspects(aspect_table(spark, sf))


ASPECT_REPORT_SQL = (
    f"with {JUDGED_SQL}, {EXAMPLES_SQL}, {SUMMARY_SQL}, "
    "q as (select game_id, aspect, string_agg('[' || label || '] ' || short, chr(10) order by rank) as q from examples where rank <= 3 group by all) "
    "select game_id, '1 aspects' as section, row_number() over (partition by game_id order by mentions desc, aspect) as position, aspect as item, "
    f"mentions, total as analyzed, positive, {r6('pct')} as positive_pct, negative, {r6('100 - pct')} as negative_pct, {r6('conf')} as avg_confidence, "
    "coalesce(q, '') as detail from aspects left join q using (game_id, aspect) "
    + "".join(
        f"union all select game_id, '3 summary', {i}, '{c}', null, null, null, null, null, null, null, {c}::varchar from summary "
        for i, c in enumerate(
            (
                "total_keyword_aspects",
                "total_discovered_topics",
                "most_mentioned_aspect",
                "most_positive_aspect",
                "most_negative_aspect",
            ),
            1,
        )
    )
)


@query("aspect_report", ASPECT_REPORT_SQL)
def _(spark, sf):
    j = judged(spark, sf)
    return aspects.aspect_report(aspects.aspect_sentiment(j), aspects.aspect_examples(j))


ASPECT_LINES_SQL = (
    "select game_id, section, position, case when section = '3 summary' then concat_ws(': ', item, detail) else "
    "printf('%s = %d mentions; positive %d, %.2f %%; negative %d, %.2f %%', upper(item), mentions, positive, positive_pct, negative, negative_pct) "
    "|| case when detail <> '' then chr(10) || detail else '' end end as line "
    f"from ({ASPECT_REPORT_SQL})"
)


@query("aspect_report_lines", ASPECT_LINES_SQL)
def _(spark, sf):
    j = judged(spark, sf)
    report = aspects.aspect_report(aspects.aspect_sentiment(j), aspects.aspect_examples(j))
    return aspects.aspect_report_lines(report)


# ---------------------------------------------------------------------------- topics
# A given factor table: the entries of each vector, without signs, dealt to ten topics; none for a document without a vector.
def factors(spark, sf):
    from querybook.base import table

    docs = reviews_text(spark, sf)
    w = table(spark, sf, "embeddings").selectExpr("vec_id as review_id", "embedding")
    parts = " + ".join(f"coalesce(abs(double(get(embedding, t + {k}))), 0D)" for k in range(0, 70, 10))
    weights = F.expr(f"transform(sequence(0, 9), t -> ({parts}) / 7D)")
    return docs.join(w, "review_id", "left").withColumn("weights", weights).drop("embedding")


def given_topics(spark, sf):
    """Words per topic from the vocabulary: topic t owns ranks t, t+10, t+20, ..."""
    vocab = features.vocabulary(counts(spark, sf), **features.FREE)
    words = vocab.withColumn("topic", F.concat(F.lit("topic_"), ((F.col("rank") - 1) % 10).cast("string")))
    return words.groupBy("game_id", "topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("words")
    )


DOMINANT_SQL = (
    "f as (select d.game_id, d.review_id, list_transform(range(10), lambda t: ("
    + " + ".join(f"coalesce(abs(embedding[t + {k + 1}]::double), 0)" for k in range(0, 70, 10))
    + ") / 7) as w from reviews d left join embeddings e on e.vec_id = d.review_id), "
    "best as (select game_id, review_id, list_max(w) as relevance, list_position(w, list_max(w)) - 1 as t from f), "
    "dominant as (select game_id, review_id, 'topic_' || t as topic, relevance from best where relevance > 0.1)"
)
TOPIC_SQL = (
    f"{JUDGED_SQL}, {DOMINANT_SQL}, "
    "ts as (select game_id, topic, count(*) filter (label = 'POSITIVE') as positive, count(*) filter (label = 'NEGATIVE') as negative, "
    "round_even(avg(relevance), 3) as avg_relevance from dominant join scored using (game_id, review_id) where confidence > 0.6 group by all), "
    "topics as (select *, positive + negative as mentions, round_even(positive::double / (positive + negative) * 100, 2) as pct from ts where positive + negative > 0)"
)
WORDS_SQL = vocab_sql(**features.FREE).removeprefix(TEXT_SQL + ", ") + (
    ", topicwords as (select game_id, 'topic_' || ((rank - 1) % 10) as topic, list(term order by rank) as words "
    "from vocab group by all)"
)


@query(
    "dominant_topic",
    f"with {TEXT_SQL}, {DOMINANT_SQL} select game_id, review_id, topic, {r6('relevance')} as relevance from dominant",
)
def _(spark, sf):
    return topics.dominant_topic(factors(spark, sf)).select("game_id", "review_id", "topic", "relevance")


@query(
    "topic_sentiment",
    f"with {TOPIC_SQL}, {WORDS_SQL} select game_id, topic, words[1:5] as words, mentions, positive, negative, "
    f"{r6('pct')} as percent_positive, {r6('avg_relevance')} as avg_relevance from topics left join topicwords using (game_id, topic)",
)
def _(spark, sf):
    return topics.topic_sentiment(factors(spark, sf), given_topics(spark, sf), SCORER)


@query(
    "topic_bars",
    f"with {TOPIC_SQL}, {WORDS_SQL} select game_id, topic, topic || chr(10) || '(' || coalesce(array_to_string(words[1:3], ', '), '') || ')' as label, "
    "positive, negative, row_number() over (partition by game_id order by mentions desc, topic) as position "
    "from topics left join topicwords using (game_id, topic)",
)
def _(spark, sf):
    return aspects.topic_bars(topics.topic_sentiment(factors(spark, sf), given_topics(spark, sf), SCORER))


@query("guided_nmf_keywords")
def _(spark, sf):
    # The stand-in dictionary as seeds, over the terms of each game.
    seeds = {a: [w for k in words for w in k.split()] for a, words in KEYWORDS.items()}
    return topics.guided_keywords(reviews_text(spark, sf), seeds)


@query("nmf_topics")
def _(spark, sf):
    return topics.nmf_topics(reviews_text(spark, sf)).topics


@query("nmf_topic_sentiment")
def _(spark, sf):
    found = topics.nmf_topics(reviews_text(spark, sf))
    rows = reviews_text(spark, sf).join(found.weights, ["game_id", "review_id"])
    return topics.topic_sentiment(rows, found.topics, SCORER)


# One multiplicative step on the free topics' weights, in blocks of ten reviews: what the models' table and the blocks' sums have to give.
STEP_TOPICS, STEP_SEED, STEP_SCALE, STEP_TERMS = 3, 42, 0.1, 5


def _start_sql(item: str) -> str:
    number = topics.scattered(item, "c", STEP_SEED).replace("pmod(", "mod(").replace(f"{topics.PRIME + 1}D", f"{topics.PRIME + 1}::double")
    return f"{number} * {STEP_SCALE}::double"


STEP_SQL = (
    f"{vocab_sql(**features.FREE)}, raw as (select game_id, review_id, rank, tf * (ln((1 + docs)::double / (1 + df)) + 1) as w "
    "from tf join vocab using (game_id, term)), "
    "x as (select game_id, review_id, rank, w / sqrt(sum(w * w) over (partition by game_id, review_id)) as v from raw), "
    f"parts as (select unnest(range({STEP_TOPICS})) as c), "
    f"w0 as (select game_id, review_id, c, {_start_sql('review_id')} as w from (select distinct game_id, review_id from x), parts), "
    f"h0 as (select game_id, rank, c, {_start_sql('rank')} as h from vocab, parts), "
    "xht as (select game_id, review_id, c, sum(v * h) as s from x join h0 using (game_id, rank) group by all), "
    "hht as (select a.game_id, a.c, b.c as d, sum(a.h * b.h) as s from h0 a join h0 b using (game_id, rank) group by all), "
    "wden as (select w0.game_id, review_id, hht.c, sum(w * s) as s from w0 join hht on w0.game_id = hht.game_id and w0.c = hht.d group by all), "
    "w1 as (select game_id, review_id, c, w * xht.s / wden.s as w from w0 join xht using (game_id, review_id, c) join wden using (game_id, review_id, c)), "
    "wtx as (select game_id, rank, c, sum(v * w) as s from x join w1 using (game_id, review_id) group by all), "
    "wtw as (select a.game_id, a.c, b.c as d, sum(a.w * b.w) as s from w1 a join w1 b using (game_id, review_id) group by all), "
    "hden as (select h0.game_id, rank, wtw.c, sum(h * s) as s from h0 join wtw on h0.game_id = wtw.game_id and h0.c = wtw.d group by all), "
    "h1 as (select game_id, rank, c, h * wtx.s / hden.s as h from h0 join wtx using (game_id, rank, c) join hden using (game_id, rank, c)), "
    "best as (select *, row_number() over (partition by game_id, c order by h desc, rank) as place from h1 where h > 0)"
)


@query(
    "nmf_one_step",
    f"with {STEP_SQL} select game_id, 'review' as part, review_id::varchar as item, c as component, null::bigint as place, {r6('w')} as weight from w1 "
    f"union all select game_id, 'term', term, c, place, {r6('h')} from best join vocab using (game_id, rank) where place <= {STEP_TERMS}",
)
def _(spark, sf):
    def start(game, terms, places):
        return topics.scattered_rows(STEP_TOPICS, terms, STEP_SEED) * STEP_SCALE

    given = counts(spark, sf)
    vocab = features.vocabulary(given, **features.FREE)
    terms, reviews = topics.factorise(given, vocab, STEP_TOPICS, start, max_iter=1, w_scale=STEP_SCALE, seed=STEP_SEED, top_n=STEP_TERMS, block_rows=10, alone=0)
    rows = reviews.select("game_id", F.lit("review").alias("part"), F.col("review_id").cast("string").alias("item"), F.posexplode("weights").alias("component", "weight"))
    rows = rows.withColumn("place", F.lit(None).cast("bigint"))
    return rows.unionByName(terms.select("game_id", F.lit("term").alias("part"), F.col("term").alias("item"), "component", "weight", "place"))
