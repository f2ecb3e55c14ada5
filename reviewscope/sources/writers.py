"""Sinks: review tables, predictions, nested results, text reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


MANIFEST = "_runs"


def write_reviews(df: DataFrame, path: str, run: str, fmt: str = "parquet", keep_backup: bool = True) -> str:
    """Write one run of a review table below `path`, partitioned by game; returns its folder.

    Every run has a folder run_ts=<run> of its own, so the previous run stays as the backup and a failed job never
    damages it. Only a run that was written to its end is entered in the list of runs. Without keep_backup the list
    starts anew with this run: earlier ones are not found any more (their files are left to the owner).
    """
    target = f"{path}/run_ts={run}"
    # Rebalancing merges the rows of small games into one file and splits a hot game over several.
    writer = df.hint("rebalance", "game_id").write.mode("overwrite").partitionBy("game_id").format(fmt)
    if fmt == "csv":
        # A cleaned table may hold quotes and line ends inside the text.
        writer = writer.options(header=True, quote='"', escape='"')
    writer.save(target)
    spark = df.sparkSession
    entry = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("written"))
    entry.coalesce(1).write.mode("append" if keep_backup else "overwrite").json(f"{path}/{MANIFEST}")
    return target


def latest_run(spark: SparkSession, path: str) -> str | None:
    """Folder of the run that was completed last; None if there is none."""
    try:
        runs = spark.read.schema("run string, written timestamp").json(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    last = runs.orderBy(F.desc("written"), F.desc("run")).first()
    return f"{path}/run_ts={last['run']}" if last else None


def write_predictions(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The original review columns with emotion and confidence of the same row."""
    keep = columns or [c for c in df.columns if c not in ("models", "probs")]
    df.select(*dict.fromkeys([*keep, "emotion", "confidence"])).write.mode("overwrite").parquet(path)


def results_document(
    counts: DataFrame,
    summary: DataFrame | None = None,
    aspects: DataFrame | None = None,
    emotions: DataFrame | None = None,
    confidence: DataFrame | None = None,
    config: dict[str, str] | None = None,
    parts: dict[str, str] | None = None,
) -> DataFrame:
    """One nested row per game: counts, configuration, aspect and emotion summaries, and with `parts` what became of each.

    All inputs hold one row per game, or a handful (aspects, emotions).
    """
    out = counts.select(
        "game_id", F.struct(*[c for c in counts.columns if c != "game_id"]).alias("data_summary")
    )
    pairs = [F.lit(x) for kv in (config or {}).items() for x in kv]
    out = out.withColumn("config", F.create_map(*pairs).cast("map<string,string>"))
    if parts:
        out = out.withColumn("parts", F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]))
    if summary is not None:
        rest = [c for c in summary.columns if c != "game_id"]
        out = out.join(summary.select("game_id", F.struct(*rest).alias("absa_summary")), "game_id", "left")
    if aspects is not None:
        each = F.struct("aspect", "mentions", F.col("percent_positive").alias("positive_percentage"))
        lists = aspects.groupBy("game_id").agg(F.array_sort(F.collect_list(each)).alias("aspect_sentiments"))
        out = out.join(lists, "game_id", "left")
    if emotions is not None:
        shares = F.map_from_entries(F.array_sort(F.collect_list(F.struct("emotion", "pct"))))
        dist = emotions.groupBy("game_id").agg(
            F.sum("n").alias("total_analyzed"), shares.alias("emotion_distribution")
        )
        if confidence is not None:
            overall = confidence.filter(F.col("emotion").isNull())
            dist = dist.join(
                overall.select("game_id", F.col("avg_confidence").alias("overall_confidence")), "game_id", "left"
            )
        rest = [c for c in dist.columns if c != "game_id"]
        out = out.join(dist.select("game_id", F.struct(*rest).alias("emotion_summary")), "game_id", "left")
    return out


def write_results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text, one folder per game, lines in order (a report has a few dozen lines)."""
    ordered = lines.repartition("game_id").sortWithinPartitions("game_id", "section", "position")
    ordered.select("game_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy(
        "game_id"
    ).text(path)
