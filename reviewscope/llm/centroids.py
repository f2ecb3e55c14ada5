"""Centroid clustering on whole numbers by scalar lookup tables.

Vectors are turned into integers, floor(`SCALE` * x), and written once. In each round every task tabulates, dimension by dimension, the squared difference
of each integer that occurs in its rows to each centroid; a row's distances are then gathered from the tables and summed up. A
table has a row for each occurring value only, so it is never larger than the batch that it serves. What leaves a task is a count and a sum
per cluster and dimension; they are added up by Spark, and the driver sees `clusters * dimensions` numbers per round, whatever
the table. All arithmetic is exact.

The first centroids are the kept vectors with the smallest SHA-256 of `<seed>:<id>`. A round assigns every vector to the nearest centroid, of
equally near ones to that with the smaller number, and replaces each centroid that has vectors by the floor of their mean.

Edge cases: vectors that are null, of another length, or that hold null or non-finite components are left out. With fewer vectors
than clusters every vector is a first centroid; equal centroids leave the later ones empty, and empty ones stay as they are. Rows that repeat an
id are vectors of their own; equal hashes are ordered by the vector. A null id is hashed as `<seed>:null`. Components beyond
`LARGEST` after scaling have squared distances that no 64-bit number holds: they end the job with an error that says so. An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.session import stored

CLUSTERS = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2
LARGEST = 1 << 27
ROWS = 4096


# ------------------------------------------------------------------------------------- in tasks
def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centroids, from one table per dimension."""
    out = np.zeros((len(vectors), len(centroids)), dtype=np.int64)
    for column, center in zip(vectors.T, centroids.T):
        values, row = np.unique(column, return_inverse=True)
        out += np.square(values[:, None] - center[None, :])[row]
    return out


def matrices(batch: pa.RecordBatch, column: int):
    """(first row, matrix) of parts of a batch; the column holds lists of one length."""
    for at in range(0, len(batch), ROWS):
        part = batch.column(column).slice(at, ROWS)
        yield at, part.flatten().to_numpy().reshape(len(part), -1)


def sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of vectors of each centroid, and the sum of them."""

    def run(batches):
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            for _, rows in matrices(batch, 0):
                near = distances(rows, centroids).argmin(axis=1)
                order = np.argsort(near, kind="stable")
                some, first = np.unique(near[order], return_index=True)
                total[some] += np.add.reduceat(rows[order], first, axis=0)
                count += np.bincount(near, minlength=len(count))
        some = np.flatnonzero(count)
        if len(some):
            columns = [pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "total"])

    parts = vectors.select("vector").mapInArrow(run, "cluster long, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("at", "part"))
    found = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect()
    count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    for r in found:
        count[r["cluster"]], total[r["cluster"], r["at"]] = r["n"], r["total"]
    return count, total


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """key, cluster, distance of every vector."""
    schema = T.StructType([vectors.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for batch in batches:
            for at, rows in matrices(batch, 1):
                found = distances(rows, centroids)
                near = found.argmin(axis=1)
                columns = [batch.column(0).slice(at, len(rows)), pa.array(near.astype(np.int32)), pa.array(found[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.select("key", "vector").mapInArrow(run, schema)


# ------------------------------------------------------------------------------------- on Spark
def integers(rows: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """key and vector (whole numbers) of the rows that are kept."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    too_far = F.exists(v, lambda x: F.abs(F.floor(x * scale)) > LARGEST)
    error = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}: squared distances would not fit 64 bits"))
    kept = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter((F.size("v") == dimensions) & fine)
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return kept.select("key", F.when(too_far, error.cast("array<bigint>")).otherwise(whole).alias("vector"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null")))
    rows = vectors.orderBy(F.sha2(name.cast("binary"), 256), "vector").limit(clusters).select("vector").collect()
    return np.array([r["vector"] for r in rows], dtype=np.int64)


def cluster(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """For every kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256 and cluster_size."""
    vectors = stored(integers(rows, key, vector, dimensions, scale), "whole-vectors")
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), dtype=np.int64)
    for _ in range(rounds):
        count, total = sums(vectors, centroids)
        some = count > 0
        centroids[some] = total[some] // count[some][:, None]
    found = stored(assigned(vectors, centroids), "assigned-vectors")
    # At most one row per centroid.
    per = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia"), F.count(F.lit(1)).alias("n")).collect()}
    inertia = sum(r["inertia"] for r in per.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, r["inertia"], inertia, names[c], r["n"]) for c, r in per.items()]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return found.withColumnRenamed("key", key).join(F.broadcast(facts), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size"
    )
