"""Publishing several tables as one run, with a version per game.

A run writes each of its tables to a folder of its own (`<path>/<table>/run_ts=<run>/game_id=...`) and is entered in the list of runs
by one small file when all of them are complete. Readers go by that list alone: a run that failed at any table was never there, and
nothing that is current is ever overwritten.

The list has a row per (run, game), so a later run over a few games replaces these and leaves the others as they are. A run that is
`whole` replaces everything: games that it does not have are gone. The files of replaced versions stay where they are, for
`published(..., run=...)` and for whoever cleans up.

Edge cases: a game without rows in one of the tables is still a game of the run, with none there. A null game is published under Hive's
name for null partitions and read back as null. Of runs entered at one moment the one with the larger name is the later one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAME = "game_id"
RUN = "run_ts"
LIST = "_published"
ENTRY = f"run string, {GAME} string, written timestamp, whole boolean, schemas map<string,string>"


def publish_run(tables: Mapping[str, DataFrame], path: str, run: str, whole: bool = True) -> None:
    """Write all tables of a run, then enter it. Each has the column game_id; together they name the games of the run."""
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    for name, df in tables.items():
        # Rebalancing merges the rows of small games into one file and splits a hot game over several.
        df.hint("rebalance", GAME).write.mode("overwrite").partitionBy(GAME).parquet(f"{path}/{name}/{RUN}={run}")
    games = None
    for name, df in tables.items():
        own = spark.read.schema(df.schema).parquet(f"{path}/{name}/{RUN}={run}").select(F.col(GAME).cast("string")).distinct()
        games = own if games is None else games.union(own)
    schemas = F.create_map(*(F.lit(x) for name, df in tables.items() for x in (name, df.schema.json())))
    entry = games.distinct().select(F.lit(run).alias("run"), GAME, F.current_timestamp().alias("written"), F.lit(whole).alias("whole"), schemas.alias("schemas"))
    entry.coalesce(1).write.mode("append").json(f"{path}/{LIST}")


def published_runs(spark: SparkSession, path: str) -> DataFrame:
    """The list of runs; empty if nothing was published."""
    try:
        return spark.read.schema(ENTRY).json(f"{path.rstrip('/')}/{LIST}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], ENTRY)
        raise


def current_versions(spark: SparkSession, path: str) -> DataFrame:
    """(game_id, run): the run that each game is to be read from."""
    runs = published_runs(spark, path)
    order = F.struct("written", "run")
    last = runs.filter("whole").agg(F.max(order).alias("last")).first()["last"]
    if last is not None:
        runs = runs.filter(order >= F.struct(F.lit(last["written"]), F.lit(last["run"])))
    return runs.groupBy(GAME).agg(F.max_by("run", order).alias("run"))


def published(spark: SparkSession, path: str, table: str, run: str | None = None) -> DataFrame:
    """A published table as it is now, or as one run wrote it."""
    path = path.rstrip("/")
    runs = published_runs(spark, path)
    known = runs.filter(F.col("run") == run) if run else runs
    newest = known.filter(F.map_contains_key("schemas", table)).orderBy(F.desc("written"), F.desc("run")).select("schemas").first()
    if newest is None:
        raise ValueError(f"no table {table!r} was published below {path}" + (f" by run {run}" if run else ""))
    schema = T._parse_datatype_json_string(newest["schemas"][table])
    if run:
        return spark.read.schema(schema).parquet(f"{path}/{table}/{RUN}={run}").select(*schema.names)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(RUN, T.StringType())])).parquet(f"{path}/{table}")
    now = current_versions(spark, path).select(F.col(GAME).alias("__game"), F.col("run").alias("__run"))
    # Both are folder names, so folders of other versions are not read.
    here = (F.col(RUN) == F.col("__run")) & F.col(GAME).cast("string").eqNullSafe(F.col("__game"))
    return rows.join(now, here, "left_semi").select(*schema.names)
