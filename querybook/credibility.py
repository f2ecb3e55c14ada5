"""The nine rules, their union, and the neighbour features."""

from pyspark.sql import functions as F

from querybook.base import META_SQL, query, r6, reviews_meta
from reviewscope.config import NUMERIC_COLUMNS
from reviewscope.operators import credibility as cred
from reviewscope.operators import neighbours
from reviewscope.session import stored

ROW_RULES = {
    "rule1": "playtime_forever < 10 and weighted_vote_score > 0.95 and votes_up = 0",
    "rule2": "num_games_owned > 500 and playtime_forever < 30",
    "rule3": "num_reviews > 50 and votes_up < 1",
    "rule4": "weighted_vote_score > 0.97 and votes_up = 0 and comment_count = 0 and playtime_forever < 15",
    "rule6": "comment_count > 10 and votes_funny > 100 and weighted_vote_score < 0.1",
}
FACTS = "facts as (select game_id, count(*) as game_rows, quantile_cont(num_reviews, 0.98) as cut5 from reviews group by game_id)"


def rule7_sql(scope):
    keys = "game_id, author_id" if scope == "author" else "game_id"
    return (
        "timed as (select *, lag(timestamp_created) over (partition by "
        f"{keys} order by author_id, timestamp_created, review_id) as prev from reviews)"
    )


R7 = "coalesce(timestamp_created > prev and timestamp_created < prev + interval 5 minute, false)"
FAST = (
    "fast as (select game_id, author_id from timed join facts using (game_id) where game_rows > 1000 "
    "group by game_id, author_id having arg_min(num_reviews, review_id) > 20 and "
    "count(timestamp_created) / greatest(floor(epoch(max(timestamp_created) - min(timestamp_created)) / 86400), 1) > 5)"
)


def rules_sql(scope="author"):
    rules = {k: f"({v})" for k, v in ROW_RULES.items()}
    rules["rule5"] = "(num_reviews > cut5 and votes_up = 0)"
    rules["rule7"] = R7
    rules["rule8"] = "((game_id, author_id) in (select (game_id, author_id) from fast))"
    rules["rule9"] = (
        "(game_rows > 1000 and num_reviews > 30 and (votes_up + votes_funny + comment_count) / greatest(num_reviews, 1) < 0.1)"
    )
    names = sorted(rules)
    return (
        f"{META_SQL}, {FACTS}, {rule7_sql(scope)}, {FAST}, "
        f"ruled as (select timed.*, {', '.join(f'{rules[n]} as {n}' for n in names)} from timed join facts using (game_id)), "
        f"flagged as (select *, {' or '.join(names)} as is_fake from ruled)"
    )


def _row_rule(name):
    @query(f"credibility_{name}", f"with {META_SQL} select review_id, game_id from reviews where {ROW_RULES[name]}")
    def _(spark, sf):
        return reviews_meta(spark, sf).filter(cred.row_rules()[name]).select("review_id", "game_id")


for _name in ROW_RULES:
    _row_rule(_name)


@query(
    "credibility_rule5",
    f"with {META_SQL}, {FACTS} select review_id, game_id from reviews join facts using (game_id) "
    "where num_reviews > cut5 and votes_up = 0",
)
def _(spark, sf):
    return cred.with_rule5(reviews_meta(spark, sf)).filter("rule5").select("review_id", "game_id")


def _rapid(scope):
    @query(
        f"credibility_rule7_{scope}",
        f"with {META_SQL}, {rule7_sql(scope)} select review_id, game_id from timed where {R7}",
    )
    def _(spark, sf):
        rows = cred.rapid_fire(reviews_meta(spark, sf), scope)
        return rows.filter("rule7").select("review_id", "game_id")


for _scope in ("author", "reference"):
    _rapid(_scope)


def gated(spark, sf):
    from reviewscope.operators import grouping

    df = reviews_meta(spark, sf)
    rows = df.groupBy("game_id").agg(F.count("*").alias("game_rows"))
    return grouping.join_small(df, rows, ["game_id"])


@query("credibility_rule8", f"with {rules_sql()} select review_id, game_id from flagged where rule8")
def _(spark, sf):
    return cred.with_rule8(gated(spark, sf)).filter("rule8").select("review_id", "game_id")


@query("credibility_rule9", f"with {rules_sql()} select review_id, game_id from flagged where rule9")
def _(spark, sf):
    rows = gated(spark, sf).filter(F.col("game_rows") > 1000)
    return rows.filter(cred.rule9()).select("review_id", "game_id")


def _all_rules(scope):
    @query(
        f"credibility_rules_{scope}",
        f"with {rules_sql(scope)} select game_id, count(*) as n, "
        + ", ".join(f"count(*) filter ({r}) as {r}" for r in cred.RULES)
        + f", count(*) filter (is_fake) as flagged, {r6('avg(is_fake::int)')} as flag_rate from flagged group by game_id",
    )
    def _(spark, sf):
        return cred.flag_rates(cred.credibility_rules(reviews_meta(spark, sf), scope))


for _scope in ("author", "reference"):
    _all_rules(_scope)


@query(
    "split_reviews",
    f"with {rules_sql()} select review_id, game_id, case when is_fake then 'fake' else 'credible' end as part from flagged",
)
def _(spark, sf):
    credible, fake = cred.split_reviews(cred.credibility_rules(reviews_meta(spark, sf)))
    pick = ["review_id", "game_id"]
    return credible.select(*pick, F.lit("credible").alias("part")).unionByName(
        fake.select(*pick, F.lit("fake").alias("part"))
    )


def _scaled(c):
    v = f"log2(greatest({c}, 0.01))" if c == "weighted_vote_score" else c
    dev = f"stddev_pop({v}) over w"
    return f"({v} - avg({v}) over w) / case when {dev} > 0 then {dev} else 1 end"


FEATURES_SQL = (
    "features as (select *, "
    + ", ".join(f"{_scaled(c)} as z_{c}" for c in NUMERIC_COLUMNS)
    + " from reviews window w as (partition by game_id))"
)


@query(
    "knn_features",
    f"with {META_SQL}, {FEATURES_SQL} select review_id, game_id, "
    + ", ".join(f"{r6('z_' + c)} as z_{c}" for c in NUMERIC_COLUMNS)
    + " from features",
)
def _(spark, sf):
    rows = cred.knn_features(reviews_meta(spark, sf))
    return rows.select(
        "review_id", "game_id", *[F.col("features")[i].alias(f"z_{c}") for i, c in enumerate(NUMERIC_COLUMNS)]
    )


# Brute force over all pairs of a game, as a check of the cell search.
KNN_SQL = (
    f"{rules_sql()}, {FEATURES_SQL.replace('from reviews', 'from flagged')}, "
    "f as (select features.* from features join facts using (game_id) where game_rows > 1000), "
    "pairs as (select a.game_id, a.review_id, b.review_id as other, b.is_fake, round(sqrt("
    + " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in NUMERIC_COLUMNS)
    + "), 9) as dist from f a join f b using (game_id)), "
    "near as (select game_id, review_id, is_fake, row_number() over (partition by game_id, review_id order by dist, other) as rn from pairs), "
    "knn as (select game_id, review_id, avg(is_fake::int) > 0.5 as knn_fake from near where rn <= 7 group by all), "
    "relabelled as (select flagged.*, coalesce(knn_fake, false) as knn_fake, is_fake or coalesce(knn_fake, false) as fake from flagged left join knn using (game_id, review_id))"
)


def _relabel(name, **how):
    @query(name, f"with {KNN_SQL} select review_id, game_id, knn_fake, fake as is_fake from relabelled")
    def _(spark, sf):
        # Written once, as the review run does: the rules are costly, and features and votes both start from them.
        flagged = stored(cred.credibility_rules(reviews_meta(spark, sf)), "flagged")
        rows = neighbours.knn_relabel(cred.knn_features(flagged), **how)
        return rows.select("review_id", "game_id", "knn_fake", "is_fake")


_relabel("knn_relabel")
# The search over pivot cells, which large games take.
_relabel("knn_relabel_cells", one_cell=20)
