import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querybook.base import reviews_meta
from querybook.inputs import review_pages
from reviewscope.operators import catalog, models
from reviewscope.plans import jobs
from reviewscope.session import scratch_path, shared_dir
from reviewscope.sources import pages, readers, writers
from reviewscope.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_two_drops_equal_one_batch(spark):
    inbox, out, state = (scratch_path(spark, n) for n in ("inbox", "out", "state"))
    all_pages = review_pages(spark, SF)
    first = F.col("cursor").cast("int") % 2 == 0
    for part in (first, ~first):
        all_pages.filter(part).write.mode("append").json(inbox)
        ingest.ingest_pages(spark, inbox, out, state).awaitTermination()
    batch = readers.flatten_review_pages(readers.read_review_pages(spark, inbox))
    got = spark.read.parquet(out)
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def html(spark, text):
    return spark.createDataFrame([(7, text)], "page_id long, html string")


def test_sections(spark):
    box = '<div class="detailBox x">{}</div>'
    page = (
        box.format('<div class="subSectionTitle"> A </div><div class="subSectionDesc">one<br>two <b>three</b></div>')
        + box.format('<div class="subSectionDesc">only text</div>')
        + box.format('<div class="subSectionTitle">T</div>')
        + box.format('<div class="subSectionTitle">blank</div><div class="subSectionDesc"> </div>')
        + box.format('<div class="subSectionTitle">late</div><div class="subSectionDesc">x</div>')
    )
    row = pages.extract_page_sections(html(spark, page)).first()
    assert [(s["title"], s["content"]) for s in row["sections"]] == [
        ("A", "one\ntwo\nthree"), ("No Title", "only text"), ("T", "No Content"),
    ]
    assert row["guide"].startswith("Section Title: A\nContent: \none\ntwo\nthree\nSection Title: No Title\n")


def test_titles(spark):
    name = lambda t: pages.extract_page_title(html(spark, t)).first()["name"]
    assert name('<div class="apphub_AppName"> A &amp; B </div><title>x on Steam</title>') == "A & B"
    assert name("<title> Quest on Steam</title>") == "Quest"
    assert name("<title>Quest</title>") == "Game 7"


def test_catalog_entries(spark):
    item = '<a class="search_result_row" href="/app/{}/x"><span class="title">{}</span><div class="search_price"> 1 \n 2 </div></a>'
    page = item.format(12, "One") + item.format("no", "Skipped") + '<a class="search_result_row" href="/app/5">bare</a>'
    got = [tuple(r)[2:] for r in pages.extract_catalog(html(spark, page)).orderBy("position").collect()]
    assert got == [("12", "One", "Unknown", "1 2"), ("5", "Unknown", "Unknown", "Unknown")]


def test_runs_keep_the_previous_one(spark):
    path = scratch_path(spark, "runs")
    assert writers.latest_run(spark, path) is None
    df = spark.range(4).withColumn("game_id", F.lit("g"))
    old = writers.write_reviews(df, path, "20240101")
    new = writers.write_reviews(df.limit(1), path, "20240102")
    assert writers.latest_run(spark, path) == new and spark.read.parquet(old).count() == 4


def test_only_completed_runs_count_and_the_last_one_wins(spark):
    path = scratch_path(spark, "runs")
    df = spark.range(4).withColumn("game_id", F.lit("g"))
    writers.write_reviews(df, path, "20240103")
    failing = df.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        writers.write_reviews(failing, path, "20240104")
    assert writers.latest_run(spark, path).endswith("20240103")
    writers.write_reviews(df, path, "current", keep_backup=False)
    assert writers.latest_run(spark, path).endswith("current")
    writers.write_reviews(df, path, "20240105")
    assert writers.latest_run(spark, path).endswith("20240105")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_resolve_short_and_unknown_inputs(spark):
    games = spark.createDataFrame([(1, "Ab Cd"), (2, "abc"), (30, "zz 9")], "id long, name string")
    asked = spark.createDataFrame([("b",), ("AB",), ("30",), ("31",), ("d",), ("q",), ("",)], "input string")
    got = {r["input"]: r["id"] for r in catalog.resolve_items(asked, games).collect()}
    assert got == {"b": 1, "AB": 1, "30": 30, "31": None, "d": 1, "q": None, "": None}


def test_resolve_with_a_prefix_that_all_entries_share(spark):
    games = spark.createDataFrame([(i, f"The Game {i:04d} end") for i in range(500)], "id long, name string")
    asked = spark.createDataFrame([("the game 0123",), ("THE GAME",), ("0499 e",), ("the game 9",)], "input string")
    got = {r["input"]: r["id"] for r in catalog.resolve_items(asked, games).collect()}
    assert got == {"the game 0123": 123, "THE GAME": 0, "0499 e": 499, "the game 9": None}


def test_a_failed_part_leaves_the_rest(spark):
    def broken(df):
        raise RuntimeError("no model")

    df = reviews_meta(spark, SF)
    config = jobs.RunConfig(use_knn=False, keywords={"x": ["k"]}, emotion_models=broken, run_nmf=False)
    done = jobs.run_full_analysis(df, config)
    assert done.predictions is None and done.results.count() == 5
    parts = done.results.first()["parts"]
    assert parts["emotions"].startswith("failed: RuntimeError: no model") and parts["topics"] == "not asked for"
    kept = done.review.state.agg(F.sum("credible") + F.sum("fake"), F.sum("raw")).first()
    assert kept[0] == kept[1] == 1000


def test_evaluation_counts_missing_classes_as_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    row = models.evaluate(df).first()
    assert row["accuracy"] == pytest.approx(1 / 3)
    assert row["precision"] == pytest.approx(1 / 6) and row["recall"] == pytest.approx(1 / 6)


def test_review_tables_keep_damaged_lines(spark):
    path = scratch_path(spark, "csv")
    lines = ["a,b", "1,x", "2,y,surplus", "3,z"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    got = readers.read_reviews(spark, path, T.StructType.fromDDL("a string, b string"), multi_line=False, damaged="raw").collect()
    assert [(r["a"], r["raw"]) for r in got] == [("1", None), ("2", "2,y,surplus"), ("3", None)]
    table = scratch_path(spark, "parquet")
    spark.range(3).write.parquet(table)
    assert readers.read_reviews(spark, table, fmt="parquet").count() == 3


def broadcast_generators(df):
    """Generators below a broadcast in the plan as it starts."""
    found, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if "BroadcastExchange" in line and inside is None:
            inside = depth
        elif inside is not None and "Generate " in line:
            found.append(line)
    return found


def test_exploded_names_are_never_broadcast(spark):
    path = scratch_path(spark, "names")
    rows = [(i if i % 3 else None, f"Name {i % 7} of a Thing") for i in range(40)] + [(50, None), (51, "")]
    spark.createDataFrame(rows, "id long, name string").write.parquet(path)
    asked = spark.createDataFrame([("me 3 of",), ("THING",), ("of a thingy",), ("me",), ("3",), ("4",), ("", ), (None,)], "input string")
    got = catalog.resolve_items(asked, spark.read.parquet(path))
    assert broadcast_generators(got) == []
    want = {"me 3 of": (None, "Name 3 of a Thing"), "THING": (None, "Name 0 of a Thing"), "me": (None, "Name 0 of a Thing"), "4": (4, "Name 4 of a Thing")}
    rest = {"of a thingy", "3", "", None}
    assert {r["input"]: (r["id"], r["name"]) for r in got.collect()} == {**want, **{i: (None, None) for i in rest}}
