"""Sources and sinks: written to the shared folder from the driver tables, then read back."""

from pyspark.sql import functions as F

from querybook.base import META_SQL, RAW_SQL, query, r6, reviews_meta, reviews_raw, table
from querybook.emotions import LINES_SQL, WITH, predictions
from querybook.texts import JUDGED_SQL, aspect_table
from querybook.summaries import RETENTION_SQL, flagged
from reviewscope.operators import aspects, emotions, summary
from reviewscope.schema import REVIEW_CSV
from reviewscope.session import scratch_path
from reviewscope.sources import pages as html
from reviewscope.sources import readers, writers
from reviewscope.streaming import crawl, ingest


@query(
    "read_reviews",
    f"with {RAW_SQL} select review_id, game_id, timestamp_created, playtime_forever, weighted_vote_score, steam_purchase, "
    "nullif(review, '') as review from raw",
)
def _(spark, sf):
    path = scratch_path(spark, "reviews-csv")
    rows = reviews_raw(spark, sf)
    given = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in REVIEW_CSV]
    rows.select(*given).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return readers.read_reviews(spark, path).select(
        "review_id", "game_id", "timestamp_created", "playtime_forever", "weighted_vote_score", "steam_purchase", "review"
    )


def review_pages(spark, sf, repeats=0):
    """API pages of up to 100 reviews each, every 17th page failed and every 19th empty; each repeats the first few of the next one."""
    c = F.col
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    author = F.struct("author_id", "playtime_forever", "num_games_owned", "num_reviews")
    review = F.struct(
        "review_id",
        "review",
        F.timestamp_diff("SECOND", start, c("timestamp_created")).alias("timestamp_created"),
        "votes_up",
        "votes_funny",
        c("weighted_vote_score").cast("string").alias("weighted_vote_score"),
        "comment_count",
        "steam_purchase",
        F.lit(False).alias("written_during_early_access"),
        F.lit(False).alias("primarily_steam_deck"),
        author.alias("author"),
    )
    page = F.floor(c("review_id") / 100)
    rows = reviews_meta(spark, sf).select("game_id", page.alias("page"), review.alias("review"), "review_id")
    if repeats:
        again = rows.filter(c("review_id") % 100 < repeats).withColumn("page", c("page") - 1).filter("page >= 0")
        rows = rows.unionByName(again)
    grouped = rows.groupBy("game_id", "page").agg(F.array_sort(F.collect_list("review")).alias("reviews"))
    n = F.when(c("page") % 19 == 3, 0).otherwise(F.size("reviews")).cast("long")
    return grouped.select(
        "game_id",
        F.when(c("page") % 17 == 5, 2).otherwise(1).alias("success"),
        F.struct(n.alias("num_reviews"), n.alias("total_reviews")).alias("query_summary"),
        c("page").cast("string").alias("cursor"),
        "reviews",
    )


FLAT_SQL = (
    f"with {META_SQL} select game_id, review_id, author_id, {r6('playtime_forever')} as playtime_forever, votes_up, "
    "strftime(date_trunc('second', timestamp_created), '%Y-%m-%d %H:%M:%S') as timestamp_created, steam_purchase, review from reviews "
    "where floor(review_id / 100) % 17 <> 5 and floor(review_id / 100) % 19 <> 3"
)
FLAT = ["game_id", "review_id", "author_id", "playtime_forever", "votes_up", "timestamp_created", "steam_purchase", "review"]


@query("flatten_review_pages", FLAT_SQL)
def _(spark, sf):
    return readers.flatten_review_pages(review_pages(spark, sf)).select(*FLAT)


@query("ingest_pages", FLAT_SQL)
def _(spark, sf):
    path = scratch_path(spark, "pages")
    review_pages(spark, sf).write.json(path)
    target, state = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    ingest.ingest_pages(spark, path, target, state).awaitTermination()
    return spark.read.parquet(target).select(*FLAT)


# Where the read of a game ends, as a part of its pages: no cursor, a failed page, an empty one, a page that is missing.
CRAWL_ENDS = {"click": 0.4, "view": 0.3, "purchase": 0.5, "error": 0.2}
CRAWL_END_SQL = " ".join(f"when '{g}' then floor({part} * m)" for g, part in CRAWL_ENDS.items())


@query(
    "ingest_crawl",
    f"with {META_SQL}, last as (select floor(max(review_id) / 100) as m from reviews), "
    f"ends as (select *, floor(review_id / 100) as page, review_id % 100 < 10 as again, case game_id {CRAWL_END_SQL} else m end as stop from reviews, last) "
    f"select game_id, review_id, author_id, {r6('playtime_forever')} as playtime_forever, votes_up, "
    "strftime(date_trunc('second', timestamp_created), '%Y-%m-%d %H:%M:%S') as timestamp_created, steam_purchase, review from ends "
    "where case when game_id in ('click', 'signup') then page <= stop or (again and page = stop + 1) else page < stop or (again and page = stop) end",
)
def _(spark, sf):
    """Two drops of a crawl, the second one with the pages in between; a restart from the checkpoint."""
    c = F.col
    path, target, state = (scratch_path(spark, n) for n in ("crawl", "crawled", "crawl-state"))
    pages = review_pages(spark, sf, repeats=10).withColumn("page", c("cursor").cast("long"))
    last = table(spark, sf, "events").agg(F.max("event_id")).first()[0] // 100
    stop = F.coalesce(*(F.when(c("game_id") == g, int(part * last)) for g, part in CRAWL_ENDS.items()), F.lit(-1))
    at_end = c("page") == stop
    size = F.size("reviews").cast("long")
    n = F.when(at_end & (c("game_id") == "purchase"), 0).otherwise(size).cast("long")
    pages = pages.filter(~(at_end & (c("game_id") == "error"))).select(
        F.when(c("page") > 0, F.concat(F.lit("c"), c("page"))).alias("requested"),
        "game_id",
        F.when(at_end & (c("game_id") == "view"), 2).otherwise(1).alias("success"),
        F.struct(n.alias("num_reviews"), size.alias("total_reviews")).alias("query_summary"),
        F.when(at_end & (c("game_id") == "click"), F.lit(None)).otherwise(F.concat(F.lit("c"), c("page") + 1)).alias("cursor"),
        "reviews",
        (c("page") % 3 == 1).alias("late"),
    )
    for drop in (~c("late"), c("late")):
        pages.filter(drop).drop("late").write.mode("append").json(path)
        crawl.ingest_crawl(spark, path, target, state).awaitTermination()
    return spark.read.parquet(target).select(*FLAT)


@query(
    "extract_page_links",
    "with l as (select page_id, regexp_extract_all(html, '<a\\b[^>]*?\\bhref=\"([^\"]*)\"', 1) as hrefs from pages) "
    "select page_id, unnest(range(len(hrefs))) as position, unnest(hrefs) as href from l",
)
def _(spark, sf):
    return html.extract_page_links(table(spark, sf, "pages"))


MARKUP = html.CatalogMarkup(
    item=r"(?s)<li><a\b[^>]*>.*?</a></li>", id=r'href="/([^"]+)"', name=r"(?s)<a\b[^>]*>(.*?)</a>"
)


@query(
    "extract_catalog",
    "with l as (select page_id, regexp_extract_all(html, '(?s)<li><a\\b[^>]*>.*?</a></li>') as items from pages), "
    "i as (select page_id, unnest(range(len(items))) as position, unnest(items) as item from l) "
    "select page_id, position, regexp_extract(item, 'href=\"/([^\"]+)\"', 1) as id, "
    "trim(replace(regexp_replace(regexp_extract(item, '(?s)<a\\b[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')) as name, "
    "'Unknown' as release_date, 'Unknown' as price from i where regexp_extract(item, 'href=\"/([^\"]+)\"', 1) <> ''",
)
def _(spark, sf):
    return html.extract_catalog(table(spark, sf, "pages"), MARKUP)


@query(
    "extract_page_title",
    "with t as (select page_id, len(regexp_extract_all(html, '(?s)<h2[^>]*>(.*?)</h2>', 1)) > 0 as has, "
    "regexp_extract(html, '(?s)<h2[^>]*>(.*?)</h2>', 1) as h, regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) as t from pages) "
    "select page_id, case when has then trim(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&amp;', '&')) "
    "when contains(t, ' the ') then trim(replace(split_part(t, ' the ', 1), '&amp;', '&')) else 'Game ' || page_id end as name from t",
)
def _(spark, sf):
    return html.extract_page_title(table(spark, sf, "pages"), heading=r"(?s)<h2\b[^>]*>(.*?)</h2>", marker=" the ")


@query("extract_page_sections")
def _(spark, sf):
    markup = html.SectionMarkup(section=("article", None), title=("h1", None), content=("p", None))
    return html.extract_page_sections(table(spark, sf, "pages"), markup).select(
        "page_id", F.size("sections").alias("n"), "guide"
    )


# Guides made of the documents: up to four sections each, some without a title, some without text, a blank one in every seventh guide.
GUIDE_SQL = (
    "parts as (select doc_id as page_id, unnest(range(doc_id % 4 + 1)) as i, doc_id, lang, source, text from documents), "
    "made as (select page_id, i, case when (doc_id + i) % 5 = 0 then 'No Title' else source || ' & ' || i end as title, "
    "case when doc_id % 7 = 3 and i = 1 then '' when (doc_id + 2 * i) % 6 = 0 then 'No Content' "
    "else concat_ws(chr(10), nullif(trim(regexp_replace(substr(text, 40 * i + 1, 40), '[^a-zA-Z]+', ' ', 'g')), ''), 'in <' || coalesce(lang, '?') || '>') end as content from parts), "
    "stops as (select page_id, min(i) filter (content = '') as stop from made group by page_id)"
)


@query(
    "extract_guide_sections",
    f"with {GUIDE_SQL} select page_id, count(*) filter (i < coalesce(stop, 9)) as n, "
    "coalesce(string_agg('Section Title: ' || title || chr(10) || 'Content: ' || chr(10) || content || chr(10), '' order by i) filter (i < coalesce(stop, 9)), '') as guide "
    "from made join stops using (page_id) group by page_id",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))))
    words = F.trim(F.regexp_replace(F.expr("substring(text, 40 * i + 1, 40)"), "[^a-zA-Z]+", " "))
    title = F.when(
        (F.col("doc_id") + F.col("i")) % 5 != 0, F.concat(F.lit('<div class="subSectionTitle"> '), "source", F.lit(" &amp; "), F.col("i").cast("string"), F.lit("</div>\n"))
    ).otherwise("")
    body = F.concat(F.lit('<div class="subSectionDesc">\n '), words, F.lit("<br/> <i>in &lt;"), F.coalesce("lang", F.lit("?")), F.lit("&gt;</i></div>"))
    body = (
        F.when((F.col("doc_id") % 7 == 3) & (F.col("i") == 1), '<div class="subSectionDesc"> </div>')
        .when((F.col("doc_id") + 2 * F.col("i")) % 6 == 0, "")
        .otherwise(body)
    )
    section = F.concat(F.lit('<div class="detailBox wide">'), title, body, F.lit("</div><p>between</p>"))
    pages = docs.select(F.col("doc_id").alias("page_id"), "i", section.alias("section")).groupBy("page_id")
    pages = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "section"))), lambda s: s["section"]), "").alias("html"))
    return html.extract_page_sections(pages).select("page_id", F.size("sections").alias("n"), "guide")


@query(
    "write_reviews",
    f"with {META_SQL} select review_id, game_id, author_id, {r6('playtime_forever')} as playtime_forever from reviews",
)
def _(spark, sf):
    path = scratch_path(spark, "table")
    rows = reviews_meta(spark, sf).select("review_id", "game_id", "author_id", "playtime_forever")
    writers.write_reviews(rows.filter("playtime_forever > 50"), path, "20240101_000000")
    writers.write_reviews(rows, path, "20240102_000000")
    return spark.read.parquet(writers.latest_run(spark, path)).select(*rows.columns)


@query("write_predictions", WITH + f"select review_id, game_id, truth, emotion, {r6('confidence')} as confidence from pred")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    writers.write_predictions(predictions(spark, sf), path, ["review_id", "game_id", "truth"])
    return spark.read.parquet(path)


@query(
    "write_results_json",
    f"with {JUDGED_SQL}, counts as (select game_id, count(*) as total_reviews from reviews group by game_id) "
    f"select game_id, total_reviews, a.aspect, a.mentions, {r6('a.pct')} as positive_percentage from counts join aspects a using (game_id)",
)
def _(spark, sf):
    from querybook.base import reviews_text

    path = scratch_path(spark, "results")
    table_ = aspect_table(spark, sf)
    counts = reviews_text(spark, sf).groupBy("game_id").agg(F.count("*").alias("total_reviews"))
    doc = writers.results_document(counts, aspects.absa_summary(table_), table_, config={"testing_mode": "false"})
    writers.write_results_json(doc, path)
    back = spark.read.schema(doc.schema).json(path)
    return back.select("game_id", "data_summary.total_reviews", F.inline("aspect_sentiments"))


@query("write_report", f"select game_id, line from ({LINES_SQL})")
def _(spark, sf):
    path = scratch_path(spark, "report")
    report = emotions.emotion_report(predictions(spark, sf))
    writers.write_report(emotions.emotion_report_lines(report), path)
    return spark.read.text(path).select(F.col("game_id").cast("string").alias("game_id"), F.col("value").alias("line"))
