"""Emotion ensemble and its aggregates, over synthetic logits drawn from `embeddings`."""

from pyspark.sql import functions as F

from querybook.base import query, r6, table
from reviewscope.config import EMOTIONS
from reviewscope.operators import emotions, ensemble

MODELS = ("alpha", "beta", "gamma")


def folded(i: str) -> str:
    """All 64 entries of a vector laid over 24 places, so that the whole vector counts."""
    return "(" + " + ".join(f"coalesce(double(get(embedding, {i} + {k})), 0D)" for k in (0, 24, 48)) + ")"


def folded_sql(i: str) -> str:
    return "(" + " + ".join(f"coalesce(embedding[{i} + {k}]::double, 0)" for k in (1, 25, 49)) + ")"


def logits(spark, sf):
    z = {
        name: F.expr(
            f"transform(sequence(0, 5), j -> 20D * ({folded('j')} + 0.35D * {folded(f'6 + 6 * {m} + j')}))"
        )
        for m, name in enumerate(MODELS)
    }
    df = table(spark, sf, "embeddings")
    return df.select(
        F.col("vec_id").alias("review_id"),
        (F.col("label") % 2).cast("string").alias("game_id"),
        (F.col("label") % 6).alias("truth"),
        *[c.alias(n) for n, c in z.items()],
    )


def scored(spark, sf):
    return ensemble.score_models(logits(spark, sf), {m: F.col(m) for m in MODELS}).drop(*MODELS)


def predictions(spark, sf, include_ensemble=False):
    return ensemble.disagreement(ensemble.ensemble(scored(spark, sf)), include_ensemble)


LABELS = ", ".join(f"({j}, '{e}')" for j, e in enumerate(EMOTIONS))
# Long form (review, model, label): windows and groups instead of vectors.
LONG_SQL = f"""
names(j, name) as (values {LABELS}),
z as (
  select vec_id as review_id, cast(label % 2 as varchar) as game_id, label % 6 as truth, m.m, n.j, n.name,
    20 * ({folded_sql('n.j')} + 0.35::double * {folded_sql('6 + 6 * m.m + n.j')}) as z
  from embeddings, range(3) m(m), names n),
p as (select * exclude (z), exp(z - max(z) over w) / sum(exp(z - max_z)) over w as p
  from (select *, max(z) over (partition by review_id, m) as max_z from z) window w as (partition by review_id, m)),
single as (select review_id, game_id, truth, m, max(p) as confidence, arg_max(name, (p, -j)) as emotion
  from p group by all),
wide as (select review_id, game_id, truth, j, name, sum(p) filter (m = 0) as a, sum(p) filter (m = 1) as b,
  sum(p) filter (m = 2) as c from p group by all),
pen as (select *, (a + b + c) / 3 as mean, 0.3::double * (power(a - b, 2) + power(b - c, 2) + power(c - a, 2)) / 3 as pen from wide),
joint as (select *, greatest(mean - pen, 0) / (sum(greatest(mean - pen, 0)) over (partition by review_id) + 1e-8) as f from pen),
best as (select review_id, game_id, truth, max(f) as confidence, arg_max(name, (f, -j)) as emotion, sum(pen) as penalty,
  list(f order by j) as probs from joint group by all),
votes as (select review_id, max(n) as top, sum(n) as whole, count(*) as labels from
  (select review_id, emotion, count(*) as n from single group by all) group by all),
spread as (select review_id, var_samp(confidence) as var, stddev_pop(confidence) / (avg(confidence) + 1e-10) as cv from single group by all),
clipped as (select review_id, j, greatest(least(q, 1), 1e-10) as q, d, greatest(least(avg(q) over (partition by review_id, j), 1), 1e-10) as avg3
  from (select review_id, j, m as d, p as q from p)),
jsd3 as (select review_id, sum(q * ln(q / avg3)) / 3 / ln(3) as jsd from clipped group by all),
clipped4 as (select review_id, j, greatest(least(q, 1), 1e-10) as q, greatest(least(avg(q) over (partition by review_id, j), 1), 1e-10) as avg4
  from (select review_id, j, p as q from p union all select review_id, j, f from joint)),
jsd4 as (select review_id, sum(q * ln(q / avg4)) / 4 / ln(4) as jsd_all from clipped4 group by all),
pred as (select best.*, top::double / whole as agreement, labels, var, cv, jsd, jsd_all
  from best join votes using (review_id) join spread using (review_id) join jsd3 using (review_id) join jsd4 using (review_id))
"""
WITH = f"with {LONG_SQL} "


def vector(expr):
    return f"list_transform({expr}, lambda x: round(x, 6) + 0.0)"


def rounded(col):
    return F.transform(col, lambda x: F.round(x, 6) + F.lit(0.0))


@query(
    "score_models",
    WITH
    + f", v as (select review_id, m, list(p order by j) as probs from p group by all) select review_id, "
    + ", ".join(
        f"max(emotion) filter (m = {m}) as {n}_emotion, {r6(f'max(confidence) filter (m = {m})')} as {n}_confidence, "
        f"{vector(f'max(probs) filter (m = {m})')} as {n}_probs"
        for m, n in enumerate(MODELS)
    )
    + " from single join v using (review_id, m) group by review_id",
)
def _(spark, sf):
    df = scored(spark, sf)
    out = [F.col("review_id")]
    for i, n in enumerate(MODELS):
        m = F.get("models", F.lit(i))
        out += [
            m["emotion"].alias(f"{n}_emotion"),
            m["confidence"].alias(f"{n}_confidence"),
            rounded(m["probs"]).alias(f"{n}_probs"),
        ]
    return df.select(*out)


@query(
    "ensemble",
    WITH
    + f"select review_id, emotion, {r6('confidence')} as confidence, {r6('penalty')} as disagreement_penalty, "
    + f"{vector('probs')} as probs from pred",
)
def _(spark, sf):
    df = predictions(spark, sf)
    return df.select(
        "review_id", "emotion", "confidence", "disagreement_penalty", rounded(F.col("probs")).alias("probs")
    )


@query(
    "agreement",
    WITH + f"select review_id, {r6('agreement')} as agreement, case when agreement < 0.7 then 'high' else 'low' end as uncertainty from pred",
)
def _(spark, sf):
    return predictions(spark, sf).select("review_id", "agreement", "uncertainty")


@query("confidence_variance", WITH + f"select review_id, {r6('var')} as confidence_variance from pred")
def _(spark, sf):
    return predictions(spark, sf).select("review_id", "confidence_variance")


@query(
    "unknown_fallback",
    WITH + f"select review_id, case when truth = 5 then 'unknown' else emotion end as emotion, "
    f"case when truth = 5 then 0 else {r6('confidence')} end as confidence from pred",
)
def _(spark, sf):
    # Two of the three models fail on one class of rows.
    failed = F.col("truth") == 5
    df = logits(spark, sf)
    models = {
        m: F.col(m) if m == "alpha" else F.when(~failed, F.col(m)) for m in MODELS
    }
    return ensemble.ensemble(ensemble.score_models(df, models)).select("review_id", "emotion", "confidence")


@query(
    "two_model_ensemble",
    WITH
    + ", two as (select review_id, j, name, (a + b) / 3 - 0.3::double * (power(a - b, 2) + b * b + a * a) / 3 as raw from wide), "
    "f as (select *, greatest(raw, 0) / (sum(greatest(raw, 0)) over (partition by review_id) + 1e-8) as f from two) "
    f"select review_id, arg_max(name, (f, -j)) as emotion, {r6('max(f)')} as confidence from f group by review_id",
)
def _(spark, sf):
    df = ensemble.score_models(logits(spark, sf), {m: F.col(m) for m in MODELS[:2]})
    return ensemble.ensemble(df).select("review_id", "emotion", "confidence")


@query(
    "flatten_predictions",
    WITH
    + f", v as (select review_id, m, list(p order by j) as probs from p group by all) select pred.review_id, pred.game_id, pred.emotion, "
    f"{r6('pred.confidence')} as confidence, {r6('penalty')} as disagreement_penalty, {r6('agreement')} as prediction_agreement, "
    f"{vector('pred.probs')} as raw_probabilities, "
    + ", ".join(
        f"s{m}.emotion as {n}_emotion, {r6(f's{m}.confidence')} as {n}_confidence, {vector(f'v{m}.probs')} as {n}_probabilities"
        for m, n in enumerate(MODELS)
    )
    + " from pred "
    + " ".join(
        f"join single s{m} on s{m}.review_id = pred.review_id and s{m}.m = {m} join v v{m} on v{m}.review_id = pred.review_id and v{m}.m = {m}"
        for m in range(3)
    ),
)
def _(spark, sf):
    df = ensemble.flatten_predictions(predictions(spark, sf), MODELS)
    vectors = [c for c in df.columns if c.endswith("_probabilities")]
    return df.withColumns({c: rounded(F.col(c)) for c in vectors})


@query(
    "sample_reviews",
    "with r as (select event_id as review_id, event_type as game_id from events), "
    "o as (select *, row_number() over (partition by game_id order by md5(concat_ws('-', review_id, '42')), review_id) as rn from r) "
    "select review_id, game_id from o where rn <= 1500",
)
def _(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id as review_id", "event_type as game_id")
    return emotions.sample_reviews(df, 1500)


DIST = (
    ", dist as (select game_id, emotion, count(*) as n, count(*) * 100.0::double / sum(count(*)) over (partition by game_id) as pct, "
    "row_number() over (partition by game_id order by count(*) desc, emotion) as rank from pred group by game_id, emotion)"
)


@query("emotion_distribution", WITH + DIST + f" select game_id, emotion, n, {r6('pct')} as pct from dist")
def _(spark, sf):
    return emotions.emotion_distribution(predictions(spark, sf))


@query(
    "confidence_by_emotion",
    WITH + f"select game_id, emotion, {r6('avg(confidence)')} as avg_confidence from pred group by grouping sets ((game_id, emotion), (game_id))",
)
def _(spark, sf):
    return emotions.confidence_by_emotion(predictions(spark, sf))


@query(
    "high_confidence",
    WITH + ", h as (select game_id, avg((confidence > 0.8)::int) as ratio from pred group by game_id) "
    f"select game_id, emotion, count(*) as high, {r6('max(ratio)')} as high_ratio from pred join h using (game_id) where confidence > 0.8 group by all",
)
def _(spark, sf):
    return emotions.high_confidence(predictions(spark, sf))


AGREE = ", agree as (select game_id, count(*) as sample_size, count(*) filter (labels > 1) as disagreement_count, avg((labels > 1)::int) as rate from pred group by game_id)"


@query(
    "disagreement_rate",
    WITH + AGREE + f" select game_id, sample_size, disagreement_count, {r6('rate')} as disagreement_rate from agree",
)
def _(spark, sf):
    return emotions.disagreement_rate(predictions(spark, sf))


@query(
    "jsd",
    WITH + f"select review_id, {r6('jsd')} as jsd, {r6('jsd_all')} as jsd_with_ensemble from pred",
)
def _(spark, sf):
    df = predictions(spark, sf)
    both = ensemble.disagreement(df.withColumnRenamed("jsd", "jsd_models"), include_ensemble=True)
    return both.select("review_id", F.col("jsd_models").alias("jsd"), F.col("jsd").alias("jsd_with_ensemble"))


@query("confidence_cv", WITH + f"select review_id, {r6('cv')} as confidence_cv from pred")
def _(spark, sf):
    return ensemble.confidence_cv(scored(spark, sf)).select("review_id", "confidence_cv")


def _grouped(threshold):
    return (
        WITH
        + DIST
        + f", top as (select game_id, max(pct) / 100 > {threshold} as dominated from dist group by game_id), "
        "s as (select game_id, case when dominated and rank > 1 then 'Others' else emotion end as label, dominated, "
        "sum(n)::bigint as n, sum(pct) as pct from dist join top using (game_id) group by all) "
        f"select game_id, label, n, {r6('pct')} as pct, case when dominated then label = 'Others' else pct < 5 end as lifted from s"
    )


@query("grouped_distribution", _grouped(0.7))
def _(spark, sf):
    return emotions.grouped_distribution(predictions(spark, sf))


@query("grouped_distribution_dominated", _grouped(0.18))
def _(spark, sf):
    return emotions.grouped_distribution(predictions(spark, sf), threshold=0.18)


@query(
    "confidence_histogram",
    WITH + ", c as (select game_id, least(floor(confidence * 20), 19)::bigint as bin, count(*) as n from pred group by all), "
    "b as (select distinct game_id, bin from pred, range(20) r(bin)) "
    f"select game_id, bin, {r6('bin * 0.05::double')} as bin_lo, {r6('(bin + 1) * 0.05::double')} as bin_hi, coalesce(n, 0) as n, "
    "case when bin < 10 then 'low' when bin < 16 then 'mid' else 'high' end as band from b left join c using (game_id, bin)",
)
def _(spark, sf):
    return emotions.confidence_histogram(predictions(spark, sf))


@query(
    "confidence_stats",
    WITH + f"select game_id, count(*) as n, {r6('avg(confidence)')} as mean, {r6('stddev_samp(confidence)')} as std, "
    f"{r6('quantile_cont(confidence, 0.5)')} as median from pred group by game_id",
)
def _(spark, sf):
    return emotions.confidence_stats(predictions(spark, sf))


@query(
    "band_by_emotion",
    WITH + ", b(band, lo, hi) as (values ('Low (<0.6)', 0.0, 0.6), ('Medium (0.6-0.8)', 0.6, 0.8), ('High (>0.8)', 0.8, 1.0)), "
    "g as (select distinct game_id from pred) select g.game_id, band, "
    + ", ".join(f"count(*) filter (emotion = '{e}') as {e}" for e in (*EMOTIONS, "unknown"))
    + " from g cross join b left join pred on pred.game_id = g.game_id and confidence > lo::double and confidence <= hi::double group by g.game_id, band",
)
def _(spark, sf):
    return emotions.band_by_emotion(predictions(spark, sf))


@query(
    "jsd_histogram",
    WITH + ", r as (select game_id, min(jsd) as lo, max(jsd) as hi, avg(jsd) as mean_jsd from pred group by game_id), "
    "c as (select game_id, least(floor((jsd - lo) * 20 / (hi - lo)), 19)::bigint as bin, count(*) as n from pred join r using (game_id) group by all), "
    "b as (select r.*, bin from r, range(20) t(bin)) "
    f"select game_id, bin, {r6('lo + (hi - lo) / 20 * bin')} as bin_lo, {r6('lo + (hi - lo) / 20 * (bin + 1)')} as bin_hi, "
    f"coalesce(n, 0) as n, {r6('mean_jsd')} as mean_jsd from b left join c using (game_id, bin)",
)
def _(spark, sf):
    return emotions.jsd_histogram(predictions(spark, sf))


@query(
    "jsd_boxplot",
    WITH + ", q as (select game_id, emotion, count(*) as n, quantile_cont(jsd, 0.25) as q1, quantile_cont(jsd, 0.5) as median, "
    "quantile_cont(jsd, 0.75) as q3 from pred group by all) select game_id, emotion, "
    f"{r6('q1')} as q1, {r6('median')} as median, {r6('q3')} as q3, n, "
    f"{r6('least(min(jsd) filter (jsd >= q1 - 1.5 * (q3 - q1)), q1)')} as whisker_low, "
    f"{r6('greatest(max(jsd) filter (jsd <= q3 + 1.5 * (q3 - q1)), q3)')} as whisker_high "
    "from pred join q using (game_id, emotion) group by game_id, emotion, q1, median, q3, n",
)
def _(spark, sf):
    return emotions.jsd_boxplot(predictions(spark, sf))


@query(
    "jsd_trend",
    WITH + "select game_id, emotion, count(*) as n, "
    f"{r6('regr_slope(jsd, confidence)')} as slope, {r6('regr_intercept(jsd, confidence)')} as intercept, "
    f"case when grouping(emotion) = 1 then {r6('corr(confidence, jsd)')} end as correlation "
    "from pred group by grouping sets ((game_id, emotion), (game_id)) having grouping(emotion) = 1 or count(*) > 2",
)
def _(spark, sf):
    return emotions.jsd_trend(predictions(spark, sf))


@query(
    "stratified_points",
    WITH + ", o as (select *, row_number() over (partition by game_id, emotion order by md5(concat_ws('-', review_id, '42')), review_id) as rn from pred) "
    f"select game_id, emotion, review_id, {r6('confidence')} as confidence, {r6('jsd')} as jsd from o where rn <= 20",
)
def _(spark, sf):
    return emotions.stratified_points(predictions(spark, sf), 20)


VALENCE = (
    DIST + ", val as (select game_id, coalesce(sum(pct) filter (emotion in ('joy', 'love', 'surprise')), 0) as pos, "
    "coalesce(sum(pct) filter (emotion in ('sadness', 'anger', 'fear')), 0) as neg, "
    "max(emotion) filter (rank = 1) as dominant_emotion, max(pct) as dominant_pct from dist group by game_id)"
)


@query(
    "valence",
    WITH + VALENCE + f" select game_id, {r6('pos')} as positive_pct, {r6('neg')} as negative_pct, dominant_emotion, "
    f"{r6('dominant_pct')} as dominant_pct, case when neg > 0 then {r6('pos / neg')} end as valence_ratio from val",
)
def _(spark, sf):
    return emotions.valence(predictions(spark, sf))


@query("top_emotions", WITH + DIST + f" select game_id, emotion, n, {r6('pct')} as pct, rank from dist where rank <= 3")
def _(spark, sf):
    return emotions.top_emotions(predictions(spark, sf))


def _cells(section, source, items):
    return " union all ".join(
        f"select game_id, '{section}' as section, {i} as position, {item} as item, {r6(f'({value})::double')} as value, "
        f"null::bigint as n, null::double as confidence from {source}"
        for i, (item, value) in enumerate(items, 1)
    )


REPORT_SQL = (
    WITH
    + VALENCE
    + AGREE
    + ", whole as (select game_id, count(*) as n, avg(confidence) as conf, avg((confidence > 0.8)::int) * 100 as high from pred group by game_id), "
    "mean as (select game_id, emotion, avg(confidence) as conf from pred group by all) "
    + _cells(
        "1 summary",
        "whole",
        [("'total_analyzed'", "n"), ("'overall_avg_confidence'", "conf"), ("'high_confidence_pct'", "high")],
    )
    + f" union all select game_id, '2 distribution', rank, emotion, {r6('pct')}, n, {r6('conf')} from dist join mean using (game_id, emotion) union all "
    + _cells(
        "3 agreement",
        "agree",
        [("'sample_size'", "sample_size"), ("'disagreement_pct'", "rate * 100"), ("'disagreement_count'", "disagreement_count")],
    )
    + " union all "
    + _cells(
        "4 insights",
        "val",
        [
            ("dominant_emotion", "dominant_pct"),
            ("'positive_pct'", "pos"),
            ("'negative_pct'", "neg"),
            ("'valence_ratio'", "case when neg > 0 then pos / neg end"),
        ],
    )
)


@query("emotion_report", REPORT_SQL)
def _(spark, sf):
    return emotions.emotion_report(predictions(spark, sf))


LINES_SQL = (
    "select game_id, section, position, item || ' = ' || "
    "case when value = floor(value) then cast(cast(value as bigint) as varchar) else printf('%.3f', floor(value * 1000 + 0.5) / 1000) end || "
    "case when section = '2 distribution' then printf(' %% of reviews; reviews = %d; mean confidence = %.3f', n, confidence) else '' end as line "
    f"from ({REPORT_SQL}) where value is not null"
)


@query("emotion_report_lines", LINES_SQL)
def _(spark, sf):
    return emotions.emotion_report_lines(emotions.emotion_report(predictions(spark, sf)))
