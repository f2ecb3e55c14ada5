"""Crawls with cursors: where reads end, pages out of order, restarts, reviews that pages repeat."""

import itertools
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewscope.session import scratch_path
from reviewscope.streaming import crawl


def page(game, requested, cursor, ids, success=1, n=None):
    return {
        "game_id": game, "requested": requested, "cursor": cursor, "success": success,
        "query_summary": {"num_reviews": len(ids) if n is None else n, "total_reviews": 9},
        "reviews": [{"review_id": i, "review": f"text {i}", "timestamp_created": 1, "author": {"author_id": "a"}} for i in ids],
    }


PAGES = {
    "whole": [page("whole", None, "c1", [1, 2]), page("whole", "c1", "c2", [2, 3]), page("whole", "c2", "", [3, 4])],
    "fails": [page("fails", "*", "c1", [1]), page("fails", "c1", "c2", [2], success=2), page("fails", "c2", None, [3])],
    "empty": [page("empty", "*", "c1", [1]), page("empty", "c1", "c2", [2], n=0), page("empty", "c2", None, [3])],
    "open": [page("open", "*", None, [1]), page("open", "c1", None, [2])],
    "loops": [page("loops", "*", "c1", [1]), page("loops", "c1", "c1", [1, 2])],
    "gap": [page("gap", "*", "c1", [1]), page("gap", "c2", "c3", [3])],
    "headless": [page("headless", "c1", None, [1])],
    "no ids": [page("no ids", "", "c1", [None, None]), page("no ids", "c1", None, [None, 5, 5])],
    None: [page(None, "*", None, [1])],
}
WANT = {("whole", 1), ("whole", 2), ("whole", 3), ("whole", 4), ("fails", 1), ("empty", 1), ("open", 1), ("loops", 1), ("loops", 2), ("gap", 1), ("no ids", 5)}


def drop(folder, name, pages):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as out:
        out.writelines(json.dumps(p) + "\n" for p in pages)


def paths(spark):
    return [scratch_path(spark, n).removeprefix("file:") for n in ("crawl", "crawled", "crawl-state")]


def ids(spark, target):
    rows = spark.read.parquet(target).select("game_id", "review_id").collect()
    return sorted(((g, i) for g, i in rows), key=repr)


@pytest.mark.parametrize("order", list(itertools.permutations(range(3)))[::2])
def test_any_order_of_files_and_runs(spark, order):
    inbox, out, state = paths(spark)
    for turn in order:
        drop(inbox, f"part{turn}", [ps[turn] for ps in PAGES.values() if len(ps) > turn])
        crawl.ingest_crawl(spark, inbox, out, state).awaitTermination()
    assert ids(spark, out) == sorted([*WANT, *[("no ids", None)] * 3], key=repr)


def test_one_run_and_late_pages(spark):
    inbox, out, state = paths(spark)
    drop(inbox, "all", [p for ps in PAGES.values() for p in reversed(ps)])
    crawl.ingest_crawl(spark, inbox, out, state).awaitTermination()
    want = sorted([*WANT, *[("no ids", None)] * 3], key=repr)
    assert ids(spark, out) == want
    # Behind the end nothing counts, whatever it says; the missing page lets its game go on.
    drop(inbox, "late", [page("fails", "c1", "c2", [7]), page("open", "*", None, [8]), page("gap", "c1", "c2", [1, 2])])
    crawl.ingest_crawl(spark, inbox, out, state).awaitTermination()
    assert ids(spark, out) == sorted([*want, ("gap", 2), ("gap", 3)], key=repr)
    crawl.ingest_crawl(spark, inbox, out, state).awaitTermination()
    assert spark.read.parquet(out).filter(F.col("review") != F.concat(F.lit("text "), "review_id")).count() == 0


class Held:
    """What a game's state is asked for."""

    exists, get = False, None

    def update(self, values):
        self.exists, self.get = True, values


def test_state_of_a_game_does_not_grow_with_its_reviews():
    early = pd.DataFrame(
        [("g", f"c{i}", f"c{i + 1}", True, "x" * 100_000, "x" * 200, f"{i:032x}") for i in range(1, 50)],
        columns=["game_id", "requested", "leads", "usable", "reviews", "head", "digest"],
    )
    state = Held()
    assert list(crawl._follow(("g",), iter([early]), state)) == []
    assert len(state.get[1]) < 49 * 100
    opening = early.head(1).assign(requested="*", leads="c1", digest="f" * 32)
    turn = pd.concat(crawl._follow(("g",), iter([opening]), state))
    assert turn["requested"].tolist() == ["*", *(f"c{i}" for i in range(1, 50))]


def test_pages_with_one_cursor_in_one_batch(spark):
    inbox, out, state = paths(spark)
    drop(inbox, "all", [page("twice", "*", "c2", [2]), page("twice", "*", "c1", [1]), page("twice", "c1", None, [7]), page("twice", "c2", None, [8])])
    crawl.ingest_crawl(spark, inbox, out, state).awaitTermination()
    assert ids(spark, out) == [("twice", 1), ("twice", 7)]
