"""Near-duplicate vectors by an exact metric range join over pivot cells.

Vectors are scaled to length one; cosine >= c is angle <= eps, and the angle is a metric. `pivots` vectors are drawn by hash, and each
vector lives in the cell of its nearest pivot. A vector visits another cell p only if a partner can live there:

    angle(x, p) <= angle(x, own pivot) + 2 eps        the partner is nearer to p than to any other pivot,
    angle(x, p) <= radius(p) + eps                    and no farther from p than the farthest that lives there,
    the bisecting plane of own pivot and p is at most 2 sin(eps / 2) away from x.

Cells are joined independently of each other, in blocks of bounded size: at most `block` vectors that live there against at most
about `guests` that visit or live there, by products in double precision. A pair at the edge of the product's rounding error is decided by an exactly rounded
sum (math.fsum), the same on every machine and in any order. A block emits a count for each vector and one
link per vector to the smallest it is connected with inside the block - never the pairs themselves.

Equal vectors are one class and are compared once; their copies count as links of each other.

Edge cases: vectors that are null or empty, of length zero, or hold null or non-finite components link with nothing,
and so do vectors of different dimensions among each other. Rows that repeat id and vector count as links of each
other. The smallest id of a component is its id; null ids lose. Empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.llm.components import components
from reviewscope.session import stored

COSINE = 0.95
PIVOTS = 512  # most of them: with up to 4,096 dimensions in double precision, 16 MB are sent to each worker
CELL = 2048  # vectors per pivot that are aimed at
BLOCK = 8192
GUESTS = 32_768
#: Products of vectors of length one are off by less than this; nearer to the limit a pair is added up exactly.
DOUBT = 1e-9


def usable(vector) -> F.Column:
    """Not null, not empty, all components finite, not all of them zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def exact_cosine_reaches(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    """Is a . b / (|a| |b|) >= limit, with sums rounded once?"""
    dot = math.fsum((a * b).tolist())
    return dot / (math.sqrt(math.fsum((a * a).tolist())) * math.sqrt(math.fsum((b * b).tolist()))) >= limit


class Cells:
    """Which cell a vector lives in and which it visits."""

    def __init__(self, pivots: np.ndarray, cosine: float):
        self.pivots = scaled(pivots)
        self.eps = math.acos(cosine) + 1e-7
        gap = np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 1e-18))
        self.reach = 2 * math.sin(self.eps / 2) * 2 * gap

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = self.angles(x)
        home = angle.argmin(axis=1)
        return home, angle[np.arange(len(x)), home]

    def stays(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell each vector lives in, and which cells it has to be in at all."""
        angle = self.angles(x)
        home = angle.argmin(axis=1)
        least = angle[np.arange(len(x)), home][:, None]
        near = (angle <= least + 2 * self.eps) & (angle <= radius + self.eps)
        # |x - p|^2 - |x - own|^2 = 2 (cos own - cos p)
        near &= 2 * (np.cos(least) - np.cos(angle)) <= self.reach[home] + 1e-7
        near[np.arange(len(x)), home] = True
        return home, near


def join_block(home: np.ndarray, guest: np.ndarray, raw_home, raw_guest, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (guest row, home row) of two sets of scaled vectors."""
    product = guest @ home.T
    i, j = np.nonzero(product >= limit - DOUBT)
    sure = product[i, j] > limit + DOUBT
    for at in np.flatnonzero(~sure):
        sure[at] = exact_cosine_reaches(raw_guest[i[at]], raw_home[j[at]], limit)
    return i[sure], j[sure]


def smallest_reached(one: np.ndarray, other: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after the links (one, other): per node the smallest node it is known to be connected with."""
    while len(one):
        before = label.copy()
        low = np.minimum(label[one], label[other])
        for end in (one, other):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def classes(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    cosine: float = COSINE,
    cell: int = CELL,
    block: int = BLOCK,
    guests: int = GUESTS,
) -> DataFrame:
    """For every row: key, n_links, component_id, kept."""
    given = F.col(f"`{vector}`")
    if rows.schema[vector].dataType.simpleString() != "array<float>":
        given = given.cast("array<double>")
    kept = rows.select(F.col(f"`{key}`").alias("key"), given.alias("vector"))
    kept = kept.withColumn("usable", usable(F.col("vector")))
    # A class is named by the digest of its components; -0.0 is 0.0.
    plain = F.transform("vector", lambda x: x.cast("double") + F.lit(0.0))
    kept = kept.withColumn("node", F.when(F.col("usable"), F.unhex(F.md5(F.to_json(plain).cast("binary")))))
    own = stored(kept.select("key", "node"), "vector-classes")
    nodes = kept.filter("usable").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"), F.first("vector").alias("vector")
    )
    nodes = stored(nodes.withColumn("dim", F.size("vector")), "distinct-vectors")
    links, counts = [], []
    for dim in [r[0] for r in nodes.select("dim").distinct().collect()]:
        one = range_join(nodes.filter(F.col("dim") == dim), cosine, cell, block, guests)
        links.append(one.filter("low is not null").select(F.col("node").alias("a"), F.col("low").alias("b")))
        counts.append(one.select("node", "links"))
    if not links:
        return own.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"))
    links, counts = (_union(x) for x in (links, counts))
    roots = components(links)
    per = nodes.select("node", "copies", "least").join(counts.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    per = per.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = per.groupBy("root").agg(F.min("least").alias("component_id"))
    per = stored(per.join(first, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-verdicts")
    component = F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("key"))
    return own.join(per, "node", "left").select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("key"), F.lit(False)).alias("kept"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def range_join(nodes: DataFrame, cosine: float, cell_rows: int, block: int, guests: int) -> DataFrame:
    """Per class and block: node, links (rows linked with), low (the smallest class connected inside the block).

    `nodes` is a written table of distinct vectors of one dimension.
    """
    spark = nodes.sparkSession
    k = max(1, min(PIVOTS, nodes.count() // cell_rows))
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(k).select("vector").collect()
    cells = spark.sparkContext.broadcast(Cells(np.array([r[0] for r in drawn], dtype=np.float64), cosine))

    def settle(batches):
        for batch in batches:
            home, angle = cells.value.homes(scaled(matrix(batch.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(angle)], names=["cell", "angle"])

    settled = nodes.select("vector").mapInArrow(settle, "cell int, angle double")
    radius, blocks = np.full(k, -10.0), np.ones(k, dtype=np.int64)
    for r in settled.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("held")).collect():
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], -(-r["held"] // block)

    def count(batches):
        for batch in batches:
            _, near = cells.value.stays(scaled(matrix(batch.column(0))), radius)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(near.sum(axis=0))], names=["cell", "n"])

    parts = np.ones(k, dtype=np.int64)
    for r in nodes.select("vector").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        parts[r["cell"]] = max(1, -(-r["n"] // guests))

    def travel(batches):
        """As a guest to one part of each block of the cells it stays in; as host to all parts of its own block."""
        for batch in batches:
            home, near = cells.value.stays(scaled(matrix(batch.column(1))), radius)
            draw = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64).reshape(-1, 2).astype(np.int64) & 0xFFFFFFFFFFFF
            who, cell = np.nonzero(near)
            times = blocks[cell]
            guest, at = np.repeat(who, times), np.repeat(cell, times)
            rows = [(guest, at, counters(times), draw[guest, 1] % parts[at], np.zeros(len(guest), dtype=bool))]
            times = parts[home]
            host = np.repeat(np.arange(len(home)), times)
            rows.append((host, home[host], draw[host, 0] % blocks[home[host]], counters(times), np.ones(len(host), dtype=bool)))
            who, cell, which, part, hosts = (np.concatenate(c) for c in zip(*rows))
            for at in range(0, len(who), 4096):
                to = slice(at, at + 4096)
                taken = [batch.column(c).take(pa.array(who[to])) for c in range(3)]
                place = [pa.array(c[to].astype(np.int32)) for c in (cell, which, part)]
                yield pa.RecordBatch.from_arrays([*taken, *place, pa.array(hosts[to])], names=["node", "vector", "copies", "cell", "block", "part", "hosts"])

    schema = T.StructType([*nodes.select("node", "vector", "copies").schema, *T._parse_datatype_string("cell int, block int, part int, hosts boolean")])
    travelled = nodes.select("node", "vector", "copies").mapInArrow(travel, schema)

    def meet(table: pa.Table) -> pa.Table:
        hosts = table.column("hosts").to_numpy(zero_copy_only=False)
        names, index = np.unique(np.array([b.hex() for b in table.column("node").to_pylist()]), return_inverse=True)
        raw = matrix(table.column("vector"))
        x = scaled(raw)
        copies = table.column("copies").to_numpy()
        home, guest = np.flatnonzero(hosts), np.flatnonzero(~hosts)
        links = np.zeros(len(names), dtype=np.int64)
        label = np.arange(len(names))
        for at in range(0, len(guest), 1024):
            some = guest[at : at + 1024]
            i, j = join_block(x[home], x[some], raw[home], raw[some], cosine)
            i, j = some[i], home[j]
            i, j = i[index[i] != index[j]], j[index[i] != index[j]]
            np.add.at(links, index[i], copies[j])
            label = smallest_reached(index[i], index[j], label)
        keep = (links > 0) | (label != np.arange(len(names)))
        node = [bytes.fromhex(v) for v in names[keep]]
        low = [bytes.fromhex(names[a]) if a != i else None for i, a in zip(np.flatnonzero(keep), label[keep])]
        return pa.table([pa.array(node, pa.binary()), pa.array(links[keep]), pa.array(low, pa.binary())], names=["node", "links", "low"])

    return stored(travelled.groupBy("cell", "block", "part").applyInArrow(meet, "node binary, links long, low binary"), "vector-links")


def counters(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for each entry, as many as it says."""
    ends = np.cumsum(times)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
