"""Ingest of paged crawls with a cursor per game: where a read ends, and reviews that pages repeat.

A page names the cursor that it was requested with and the one that leads on. Per game a read begins at the page without a requested cursor
(or with `*`) and follows the cursors. It ends at a page that failed, at one without reviews, and behind one that
leads nowhere (no cursor, or its own). What lies behind the end, and pages that no cursor leads to, yield no rows.

Files may come in any order and over many runs. Per game the state holds the cursor that is awaited and where the cursors lead that came
before their turn, with a digest of their reviews; the reviews themselves wait in the state of a join by (game, requested cursor, digest), so
only cursors of a game meet in one task. Reviews are told by (game, review id), which is state of its own, dealt by that key. The states
lie in RocksDB, on disk and with bounded memory, unless the session names another store.

Edge cases: a page without a game is left out; of pages with one requested cursor the first that comes counts (within one batch the one
with the smaller payload, told by its first LEADING characters and then by its digest), later ones are ignored. A review without an id is kept as often as it occurs. A missing `success` or
`query_summary` counts as a failed page. A page that comes after its game's end changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reviewscope import schema
from reviewscope.sources.readers import review_columns

START = "*"
#: Awaited cursor (null behind the end) and [leads, usable, digest] of the pages that came early, by requested cursor, as JSON.
STATE = "awaited string, early string"
TURN = "game_id string, requested string, digest string"
#: Characters of a payload that are compared where several pages of one batch name the same cursor.
LEADING = 200

#: Session setting -> (Spark's default, what the stream uses in its place).
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    ),
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": ("false", "true"),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": ("false", "true"),
}


def crawl_page(columns: T.StructType = schema.REVIEW_PAGE) -> T.StructType:
    """The schema of a stored page that knows the cursor it was requested with."""
    return T.StructType([T.StructField("requested", T.StringType()), *columns.fields])


def _follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The cursors of a game whose turn has come."""
    awaited, early = state.get if state.exists else (START, "{}")
    came: dict[str, tuple] = {}
    for part in parts:
        if awaited is not None:
            for requested, leads, usable, head, digest in zip(part["requested"], part["leads"], part["usable"], part["head"], part["digest"]):
                page = (head, digest, leads or "", bool(usable))
                known = came.get(requested)
                came[requested] = page if known is None else min(known, page, key=lambda p: p[:3])
    waiting = {requested: [leads, usable, digest] for requested, (_, digest, leads, usable) in came.items()}
    waiting |= json.loads(early)  # those that came in an earlier batch stay
    turn = []
    while awaited in waiting:
        leads, usable, digest = waiting.pop(awaited)
        if usable:
            turn.append((key[0], awaited, digest))
        awaited = leads if usable and leads and leads != awaited else None
    state.update((awaited, json.dumps(waiting if awaited is not None else {})))
    if turn:
        yield pd.DataFrame(turn, columns=["game_id", "requested", "digest"])


def pages_in_turn(pages: DataFrame) -> DataFrame:
    """(game_id, requested, at, r) of a stream of pages: the reviews of all pages up to the end of each game's read.

    Only cursors are looked at in Python; reviews pass as text.
    """
    reviews = pages.schema["reviews"].dataType
    n = F.coalesce(F.col("query_summary.num_reviews"), F.lit(0))
    short = pages.filter("game_id is not null").select(
        "game_id",
        F.coalesce(F.when(F.col("requested") != "", F.col("requested")), F.lit(START)).alias("requested"),
        F.when(F.col("cursor") != "", F.col("cursor")).alias("leads"),
        F.coalesce((F.col("success") == 1) & (n > 0), F.lit(False)).alias("usable"),
        F.coalesce(F.to_json("reviews"), F.lit("")).alias("reviews"),
    ).withColumn("digest", F.md5("reviews"))
    cursors = short.select("game_id", "requested", "leads", "usable", F.substring("reviews", 1, LEADING).alias("head"), "digest")
    turns = cursors.groupBy("game_id").applyInPandasWithState(_follow, TURN, STATE, "append", GroupStateTimeout.NoTimeout)
    told = short.filter("usable").select("game_id", "requested", "digest", "reviews").join(turns, ["game_id", "requested", "digest"])
    return told.select("game_id", "requested", F.posexplode(F.from_json("reviews", reviews)).alias("at", "r"))


def once(reviews: DataFrame) -> DataFrame:
    """Reviews without those that were there before; one without id is told by its page and its place there."""
    place = F.when(F.col("r.review_id").isNull(), F.struct("requested", "at"))
    return reviews.withColumns({"id": F.col("r.review_id"), "place": place}).dropDuplicates(["game_id", "id", "place"]).select("game_id", "r")


def ingest_crawl(
    spark: SparkSession, path: str, target: str, checkpoint: str, columns: T.StructType | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append the reviews of all pages whose turn has come to a review table, each once, then stop; the next run goes on from there."""
    pages = spark.readStream.schema(columns or crawl_page()).option("maxFilesPerTrigger", files_per_batch).json(path)
    writer = (
        once(pages_in_turn(pages))
        .select("game_id", *review_columns(F.col("r")))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    # A stream keeps the settings it was started with; what the session has set itself stays.
    own = {key: value for key, (usual, value) in SETTINGS.items() if spark.conf.get(key, usual) == usual}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        return writer.start()
    finally:
        for key in own:
            spark.conf.unset(key)
