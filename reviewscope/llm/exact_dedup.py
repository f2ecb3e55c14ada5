"""Exact dedup: skew-safe combining of equal texts, native DataFrame operations only.

Three combining steps, each of which groups by the *whole text* (the digest only deals rows to partitions):

1. local: the map side of the first aggregation folds the copies inside one task into one row,
2. salted: (digest, salt, text) - the copies of one text are dealt over `salts` groups, so no task gets a hot text,
3. global: (digest, text) - at most `salts` winners per text meet.

Edge cases: a null text counts as empty. Of equal texts the largest key stays; null keys lose against any other and
a text whose keys are all null has a null `keep_id`, of which no row is marked as kept. Rows that repeat key and text
carry the same verdict (`kept` on each of them); `deduplicate` leaves one. An empty table gives an empty result.
Other columns are ignored by `classes` and carried by `deduplicate`, whatever their names (they must be orderable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def combine(rows: DataFrame, winner: Column) -> DataFrame:
    """One row per distinct text: `_digest`, `_text`, the largest `winner` and the number of rows.

    Takes rows with `_digest`, `_salt` and `_text`.
    """
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max(winner).alias("_winner"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_digest", "_text").agg(F.max("_winner").alias("_winner"), F.sum("_n").alias("_n"))


def keyed(docs: DataFrame, key: str, text: str, digest, salts: int, *more: Column) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(whole.alias("_text"), F.col(f"`{key}`").alias("_key"), *more).select(
        "*", digest(F.col("_text")).alias("_digest"), F.pmod(F.xxhash64("_key"), F.lit(salts)).alias("_salt")
    )


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, salts: int = SALTS) -> DataFrame:
    """For every row: key, keep_id, group_size, kept, text_sha256.

    Rows find their class by digest. Should two different texts ever share one, the job stops with an error instead
    of merging them.
    """
    rows = keyed(docs, key, text, digest, salts)
    second = F.xxhash64("_text").alias("_second")
    found = (
        combine(rows, F.col("_key"))
        .select("_digest", second, "_winner", "_n")
        .groupBy("_digest")
        .agg(
            F.max("_second").alias("_second"),
            F.max("_winner").alias("_winner"),
            F.sum("_n").alias("_n"),
            F.count(F.lit(1)).alias("_texts"),
        )
        .withColumn(
            "_n",
            F.when(F.col("_texts") == 1, F.col("_n")).otherwise(
                F.raise_error(F.lit("different texts share a digest")).cast("bigint")
            ),
        )
    )
    own = rows.select("_key", "_digest", second, sha256(F.col("_text")).alias("text_sha256"))
    # Both sides are dealt anew by these two columns, so that AQE may split the rows of a hot text.
    return own.join(found, ["_digest", "_second"]).select(
        F.col("_key").alias(key),
        F.col("_winner").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.coalesce(F.col("_key") == F.col("_winner"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256, salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest key.

    Rows that agree in the key too are decided by their other columns, so exactly one row per text is left.
    """
    rest = [c for c in docs.columns if c not in (key, text)]
    row = F.struct(
        F.col(f"`{key}`").alias("k"),
        F.col(f"`{text}`").isNull().alias("n"),
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)),
    )
    won = combine(keyed(docs, key, text, digest, salts, row.alias("_row")), F.col("_row"))
    place = {key: "_winner.k", **{c: f"_winner.c{i}" for i, c in enumerate(rest)}}
    whole = F.when(~F.col("_winner.n"), F.col("_text")).alias(text)
    return won.select(*(whole if c == text else F.col(place[c]).alias(c) for c in docs.columns))
