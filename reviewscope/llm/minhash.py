"""MinHash near-dedup with circulant signatures, banding and exact verification.

A document's set is its distinct word n-grams. One permutation sigma scatters them over 2**32 positions; coordinate i of the
signature is the smallest value that a second permutation pi, shifted circularly by i steps, gives to them:
min over v of pi((sigma(v) + i * STEP) mod 2**32). `BANDS` bands of `ROWS` coordinates are the bucket keys: a pair of
Jaccard similarity 0.8 misses all of them with probability (1 - 0.8**5)**32 = 3e-6, a closer one more rarely.

Links are found without listing the pairs of a bucket:

1. Documents with equal sets are one class, and classes are the nodes from here on.
2. Each class is compared with the smallest class of every bucket it is in. A group of near copies is one
   component after this, however large it is.
3. Only classes of one bucket that are still in different components are compared with each other, inside one task;
   only links leave it. Where a bucket has more than `MEMBERS` members, or these more than `CROWD` words (say, they share one passage), their
   pairs come from an exact prefix join instead: two similar sets share one of their rarest shingles.

A sketch is the low byte of every coordinate. A pair goes on only if its sketches agree in as many coordinates as a
similar pair does but for one in 10**10 (6.3 standard deviations below). Every pair that goes on is confirmed on the
full sets (64-bit hashes of all shingles, in exact integer arithmetic). Links that steps 2 and 3 need not look at lie
inside a component, so components are those of all links.

Edge cases: a document with fewer words than the n-gram is one shingle; one without words, or null, has none, is
linked with nothing and stays. The smallest key of a component stays; null keys lose, and a class with null keys only has a null
component. Rows that repeat key and text get the same verdict, and `deduplicate` leaves one of them. Texts of any length are
taken whole. Empty tables give empty results. Other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.llm.components import components, written
from reviewscope.llm.words import BASE, hashed_words, mapped, mix64, shingles, slices, text_batches
from reviewscope.session import stored

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 32, 5
STEP = 0x9E3779B1
CHUNK = 1 << 16
CROWD = 4_000_000
MEMBERS = 4096


# -------------------------------------------------------------------------------- signatures
def pi(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation of the 2**32 positions, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        np.right_shift(x, shift, out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A row of coordinates for every set; sets are not empty."""
    lengths = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    sigma = (mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    shifted, spare = np.empty_like(sigma), np.empty_like(sigma)
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    for i in range(coordinates):
        np.add(sigma, np.uint32(i * STEP & 0xFFFFFFFF), out=shifted)
        out[:, i] = np.minimum.reduceat(pi(shifted, spare), at)
    return out


def bands(sets: list[np.ndarray], count: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of every set (the band's number is part of the key) and its sketch."""
    out = np.empty((len(sets), count), dtype=np.uint64)
    sketch = np.empty((len(sets), count * rows), dtype=np.uint8)
    at = 0
    while at < len(sets):
        to, held = at + 1, len(sets[at])
        while to < len(sets) and held + len(sets[to]) <= CHUNK:
            held += len(sets[to])
            to += 1
        found = signatures(sets[at:to], count * rows)
        sketch[at:to] = found.astype(np.uint8)
        found = found.astype(np.uint64).reshape(to - at, count, rows)
        key = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), found.shape[:2])
        for r in range(rows):
            key = mix64(key * np.uint64(BASE) + found[:, :, r])
        out[at:to] = key
        at = to
    return out, sketch


def agreement(coordinates: int, percent: int) -> int:
    """Coordinates in which two similar sets agree at least, but for one pair in 10**10."""
    p = percent / 100
    return max(0, int(coordinates * p - 6.3 * (coordinates * p * (1 - p)) ** 0.5))


def text_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    words, counts = hashed_words(texts)
    ends = np.cumsum(counts)
    return [shingles(words[e - c : e], width) for e, c in zip(ends, counts)]


def digest(one: np.ndarray) -> bytes:
    return blake2b(one.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of two sorted sets, at least `percent` of a hundred."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# ------------------------------------------------------------------------------------- Spark
def signed(docs: DataFrame, key: str, text: str, width: int, count: int, rows: int) -> DataFrame:
    """key, n (set size), node (digest of the set), bands and sketch, for every row."""
    text_batches(docs)
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([kept.schema["key"], *T._parse_datatype_string("n long, node binary, bands array<long>, sketch binary").fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = text_sets(part.column(1), width)
                full = [s for s in sets if len(s)]
                keys, sketches = bands(full, count, rows)
                keys, sketches = iter(keys.view(np.int64).tolist()), iter(sketches)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                        pa.array([next(sketches).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=["key", "n", "node", "bands", "sketch"],
                )

    return mapped(kept, run, schema)


def with_node(docs: DataFrame, carried, text: str, width: int) -> DataFrame:
    """`row`, n and node: the rows again with the digest of their set."""
    kept = docs.select(carried.alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([kept.schema["row"], T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = text_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary())],
                    names=["row", "n", "node"],
                )

    return mapped(kept, run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar."""
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        last = (None, None)
        for batch in batches:
            for part in slices(batch, 2):
                found = []
                names = part.column(1).to_pylist()
                for i, name in enumerate(names):
                    if name != last[0]:
                        last = (name, text_sets(part.column(3).slice(i, 1), width)[0])
                    found.append(similar(text_sets(part.column(2).slice(i, 1), width)[0], last[1], percent))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(found))

    return mapped(both, run, "a binary, b binary")


def matrix(sketches) -> np.ndarray:
    """One row of bytes per sketch."""
    return np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint8).reshape(len(sketches), -1)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sketches agree enough."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)

    def run(batches):
        for batch in batches:
            if len(batch):
                one, other = matrix(batch.column(2)), matrix(batch.column(3))
                fine = (one == other).sum(axis=1) >= agreement(one.shape[1], percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fine))

    return mapped(pairs.select("a", "b", "sketch_a", "sketch_b"), run, "a binary, b binary")


def linked_across(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside each bucket (bucket, node, n, root, sketch, bands, text) between different components.

    A pair is looked at in the first of the buckets that it shares, and only as long as links found before, in this
    bucket, have not joined its components. Pairs of similar size and sketch are confirmed on the full sets, so only links leave
    the task.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket, first, second, sets = table.column("bucket")[0].as_py(), [], [], {}
        sketch, n, names = matrix(table.column("sketch")), table.column("n").to_numpy(), table.column("node").to_pylist()
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
        label = np.unique(np.array([b.hex() for b in table.column("root").to_pylist()]), return_inverse=True)[1]
        texts, least = table.column("text").combine_chunks(), agreement(sketch.shape[1], percent)

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = text_sets(texts.slice(i, 1), width)[0]
            return sets[i]

        for i in range(len(names) - 1):
            other = np.arange(i + 1, len(names))
            other = other[(label[other] != label[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            other = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
            shared = np.where(keys[other] == keys[i], keys[i], np.iinfo(np.int64).max).min(axis=1) if len(other) else other
            for j in other[shared == bucket]:
                if label[j] != label[i] and similar(full(i), full(j), percent):
                    label[label == label[j]] = label[i]
                    first.append(names[i])
                    second.append(names[j])
        return pa.table([pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["a", "b"])

    return members.groupBy("bucket").applyInArrow(run, "a binary, b binary")


def sized(left, right, percent: int):
    """Can two sets of these sizes be similar?"""
    return (100 * F.least(left, right)) >= (percent * F.greatest(left, right))


def crowded_pairs(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Exact prefix join of the classes (node, n, root): pairs in different components that may be similar.

    Shingles are ordered from rare to frequent; of two similar sets of n shingles each has one of the other's in its
    first n - ceil(percent / 100 * n) + 1. Shingles of one class only come first, so they take places but are not listed.
    """

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                one = text_sets(batch.column(1).slice(i, 1), width)[0].view(np.int64)
                for at in range(0, len(one), 10_000):
                    some = pa.array(one[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(some), pa.binary()), some], names=["node", "shingle"])

    listed = stored(mapped(members.join(texts, "node").select("node", "text"), run, "node binary, shingle long"), "shingles")
    common = stored(listed.groupBy("shingle").count(), "shingle-counts")
    rare = W.partitionBy("node").orderBy("count", "shingle")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = listed.join(common.filter("count > 1"), "shingle").withColumns(
        {"place": F.row_number().over(rare), "shared": F.count(F.lit(1)).over(W.partitionBy("node"))}
    )
    prefix = prefix.join(members, "node").filter(F.col("n") - F.col("shared") + F.col("place") <= length).select("shingle", "node", "n", "root")
    prefix = stored(prefix, "prefixes")
    return across(prefix, "shingle", percent)


def across(rows: DataFrame, bucket: str, percent: int) -> DataFrame:
    """Pairs of one bucket that lie in different components and are of similar size."""
    other = rows.select(bucket, *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "root")))
    pairs = rows.join(other, bucket).filter(
        (F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b")) & sized(F.col("n"), F.col("n_b"), percent)
    )
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def linked(rows: DataFrame, docs: DataFrame, text: str, width: int, percent: int, crowd: int, members: int) -> DataFrame:
    """(node, root) of all classes that have a link; `rows` is the written table of `signed`."""
    nodes = rows.filter("n > 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "bands", "sketch")))
    nodes = stored(nodes, "classes")
    exploded = stored(nodes.select("node", "n", F.explode("bands").alias("bucket")), "buckets")
    pivots = exploded.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count(F.lit(1)).alias("members"))
    pivots = written(pivots.filter("members > 1").drop("members"), "pivots")
    shared = stored(exploded.join(pivots, "bucket"), "shared-buckets")
    involved = shared.select("node").distinct()
    texts = with_node(docs, F.col(f"`{text}`"), text, width).groupBy("node").agg(F.first("row").alias("text"))
    texts = stored(texts.join(involved, "node"), "candidate-texts")

    stars = shared.filter((F.col("node") != F.col("pivot.node")) & sized(F.col("n"), F.col("pivot.n"), percent))
    stars = stars.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct()
    links = written(confirmed(plausible(stars, nodes, percent), texts, width, percent), "links")

    # What is still apart in a bucket.
    roots = components(links)
    apart = shared.select("bucket", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = stored(apart, "rooted-buckets")
    mixed = apart.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("words"), F.count(F.lit(1)).alias("members")
    )
    full = (F.col("words") > crowd) | (F.col("members") > members)
    mixed = written(mixed.filter(F.col("low") != F.col("high")).select("bucket", full.alias("full")), "mixed-buckets")
    open_ = apart.join(mixed, "bucket")
    few = open_.filter("not full").join(nodes.select("node", "sketch", "bands"), "node").join(texts, "node")
    more = linked_across(few.select("bucket", "node", "n", "root", "sketch", "bands", "text"), width, percent)
    crowded = written(open_.filter("full").select("node", "n", "root").distinct(), "crowded")
    if not crowded.isEmpty():
        pairs = plausible(crowded_pairs(crowded, texts, width, percent), nodes, percent)
        more = more.unionByName(confirmed(pairs, texts, width, percent))
    more = written(more, "links")
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def verdicts(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Per class: component_id (smallest key of the component) and the class that holds it."""
    least = rows.filter("n > 0").groupBy("node").agg(F.min("key").alias("least"))
    known = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = known.groupBy("root").agg(F.min(F.when(F.col("least").isNotNull(), F.struct("least", "node"))).alias("first"))
    return stored(
        known.join(first, "root").select("node", F.col("first.least").alias("component_id"), F.coalesce("first.node", "node").alias("keeper")),
        "verdicts",
    )


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    count: int = BANDS,
    rows: int = ROWS,
    crowd: int = CROWD,
    members: int = MEMBERS,
) -> DataFrame:
    """For every row: key, n_shingles, component_id, kept."""
    sets = stored(signed(docs, key, text, width, count, rows), "signed")
    found = verdicts(sets, linked(sets, docs, text, width, percent, crowd, members))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return sets.select("key", "n", "node").join(found, "node", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(own == F.col("key"), F.lit(False)).alias("kept"),
    )


def deduplicate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    count: int = BANDS,
    rows: int = ROWS,
    crowd: int = CROWD,
    members: int = MEMBERS,
) -> DataFrame:
    """The rows that stay, with their own columns: one document of each component, and all that have no words."""
    sets = stored(signed(docs, key, text, width, count, rows), "signed")
    found = verdicts(sets, linked(sets, docs, text, width, percent, crowd, members))
    again = with_node(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), text, width)
    stay = found.filter(F.col("node") == F.col("keeper")).select("node", "component_id")
    full = again.filter("n > 0").join(stay, "node").filter(F.col(f"row.`{key}`").eqNullSafe(F.col("component_id")))
    one = full.groupBy("node").agg(F.first("row").alias("row")).select("row.*")
    return one.unionByName(again.filter("n = 0").select("row.*"))
