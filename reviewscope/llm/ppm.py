"""Language-model scores by prediction with partial matching, beside a word model as the base.

The model is the counts of all byte contexts of up to `ORDER` bytes. A symbol is predicted in the longest context that was seen.
If it was never seen there, an escape is paid (method C: as many escapes as distinct symbols) and
the next shorter context is asked, with all symbols of the longer one excluded. Below the empty context every byte that is left
is equally likely. So the probabilities of all 256 symbols add up to one in every context.

Texts are read as the word model reads them: A-Z in lower case, words `[^\\x20\\x09-\\x0D]+` joined by one space, then an
end (byte 0xFF, which UTF-8 never uses; contexts before the first word are made of it too). The score is log10 of the
probability of all bytes and the end.

All training documents are counted: tasks fold the (ORDER + 1)-grams and the words of their documents, and the
counts are merged by shuffles. Shorter contexts are sums over longer ones. Nothing is pruned; what workers need in memory is
bounded: the logs of the longest grams that make up at least 1 / `NODES` of all symbols are sent along, as are the words that
make up at least 1 / `WORDS` of all tokens. The logs of all other grams and the counts of all other words are joined to the
documents by a shuffle. Grams of held-out texts that were never seen get theirs by joins, context by context. Words are
64-bit hashes.

Edge cases: a null or empty text is the end alone. Rows that repeat a key are scored each on its own; null keys train
(they are in no held-out part). Without training documents every symbol costs log10(1/256) and the base is 0 for each token.
Texts of any length are scored whole, in slices of bounded size. Empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.llm.words import _LOWER, _SPACE, hashed_words, mapped, raw_bytes, slices, text_batches
from reviewscope.session import stored

ORDER = 5
NODES = 1 << 21
WORDS = 1 << 20
END = 0xFF
END_WORD = np.uint64(0xE7D_0F_7E27)
HELD = 1_000_000
GRAM, WORD = 0, 1


# -------------------------------------------------------------------------------- byte grams
def streams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-gram that ends at each symbol of every text, and the number of symbols per text."""
    raw, bounds = raw_bytes(texts)
    solid = ~_SPACE[raw]
    # A space is kept where a word of the same text follows it and a word of the same text went before.
    last = np.concatenate([[False], solid[:-1]])
    kept = solid | last
    symbols = np.where(solid, _LOWER[raw].astype(np.uint8), 32).astype(np.uint8)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    first = bounds[:-1][np.diff(bounds) > 0]
    kept[first] = solid[first]
    symbols, owner = symbols[kept], owner[kept]
    # Texts that end in white space have one space too many.
    sizes = np.bincount(owner, minlength=n)
    ends = np.cumsum(sizes)
    trail = ends[sizes > 0] - 1
    trail = trail[symbols[trail] == 32]
    symbols, owner = np.delete(symbols, trail), np.delete(owner, trail)
    sizes = np.bincount(owner, minlength=n)
    # Lay out: order ends before each text, its symbols, one end.
    at = np.cumsum(sizes + order + 1) - (sizes + order + 1)
    padded = np.full(int((sizes + order + 1).sum()), END, dtype=np.uint64)
    inside = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(at + order, sizes) + inside] = symbols
    grams = np.zeros(max(0, len(padded) - order), dtype=np.uint64)
    for i in range(order + 1):
        np.left_shift(grams, np.uint64(8), out=grams)
        np.bitwise_or(grams, padded[i : i + len(grams)], out=grams)
    count = sizes + 1
    place = np.repeat(at, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return grams[place], count


class Hashed:
    """Unsigned keys -> row numbers by open addressing; rows are found for many keys at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.rows = np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        self.tries = 0
        while len(left):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]  # of several the last one stays
            self.keys[slot[free]] = keys[left[free]]
            lost = self.rows[slot] != left
            self.keys[slot[~lost]] = keys[left[~lost]]
            left, slot = left[lost], (slot[lost] + 1) & self.mask
            self.tries += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of every key, or -1."""
        slot = self.slot(keys)
        out = np.where(self.keys.take(slot) == keys, self.rows.take(slot), -1)
        # An empty slot ends a search; its row is -1 whatever its key.
        open_ = np.flatnonzero((out < 0) & (self.rows.take(slot) >= 0))
        slot = slot[open_]
        for _ in range(self.tries):
            if not len(open_):
                break
            slot = (slot + 1) & self.mask
            rows = self.rows.take(slot)
            hit = (rows >= 0) & (self.keys.take(slot) == keys[open_])
            out[open_[hit]] = rows[hit]
            going = (rows >= 0) & ~hit
            open_, slot = open_[going], slot[going]
        return out


# ------------------------------------------------------------------------------------- Spark
class Tally:
    """Counts of keys, folded again and again so that a task holds few of them: at most HELD, and those of one slice."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        keys, index = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(index, weights=np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return keys, counts


def counted(train: DataFrame, order: int) -> DataFrame:
    """kind, key, n: how often each gram and each word occurs. `train` has the column text."""

    def run(batches):
        tallies = (Tally(), Tally())

        def out(clear: bool):
            for kind, tally in enumerate(tallies):
                keys, counts = tally.fold()
                if clear:
                    tally.__init__()
                for at in range(0, len(keys), 100_000):
                    some = keys[at : at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), kind, dtype=np.int8)), pa.array(some), pa.array(counts[at : at + 100_000])],
                        names=["kind", "key", "n"],
                    )

        for batch in batches:
            for part in slices(batch, 0):
                tallies[GRAM].add(streams(part.column(0), order)[0])
                words, _ = hashed_words(part.column(0))
                tallies[WORD].add(np.concatenate([words, np.full(len(part), END_WORD)]))
                if max(t.held for t in tallies) > HELD:
                    if max(len(t.fold()[0]) for t in tallies) > HELD // 2:
                        yield from out(True)
        yield from out(True)

    rows = mapped(train.select("text"), run, "kind byte, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def level_rows(grams: DataFrame, order: int) -> DataFrame:
    """level, key, n: the grams of every context length. `grams` has key and n."""
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("level"), F.lit((1 << 8 * (j + 1)) - 1).alias("mask")) for j in range(order + 1))))
    rows = grams.select("key", "n", each.alias("at")).select(F.col("at.level").alias("level"), F.col("key").bitwiseAND(F.col("at.mask")).alias("key"), "n")
    return rows.groupBy("level", "key").agg(F.sum("n").alias("n"))


def context_rows(levels: DataFrame) -> DataFrame:
    """level, context, total, distinct, excluded: of each context the symbols after it, and what these count in the next shorter context."""
    below = levels.select((F.col("level") + 1).alias("level"), F.col("key").alias("suffix"), F.col("n").alias("below"))
    rows = levels.withColumn("suffix", F.expr("key & (shiftleft(1L, 8 * level) - 1)")).join(below, ["level", "suffix"], "left")
    return rows.groupBy("level", F.shiftright("key", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("below").alias("excluded")
    )


def seen_logs(levels: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """gram, n, log: log10 probability of the grams of the longest level."""
    longest = levels.filter(F.col("level") == order).select(F.col("key").alias("gram"), "n", F.shiftright("key", 8).alias("context"))
    longest = longest.join(contexts.filter(F.col("level") == order).select("context", "total", "distinct"), "context")
    return longest.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("distinct"))).alias("log"))


def unseen_logs(unseen: DataFrame, levels: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """gram, log: log10 probability of grams that the longest level does not have."""
    rows = unseen
    for j in range(order, -1, -1):
        of = contexts.filter(F.col("level") == j).select(
            F.col("context").alias(f"c{j}"), F.col("total").alias(f"t{j}"), F.col("distinct").alias(f"d{j}"), F.col("excluded").alias(f"e{j}")
        )
        key = F.col("gram").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1))
        # Tables of at most 2**16 rows are sent along: their keys are hot.
        rows = rows.withColumn(f"c{j}", F.shiftright(key, 8)).join(F.broadcast(of) if j <= 2 else of, f"c{j}", "left")
        if j < order:
            seen = levels.filter(F.col("level") == j).select(F.col("key").alias(f"g{j}"), F.col("n").alias(f"n{j}"))
            rows = rows.withColumn(f"g{j}", key).join(F.broadcast(seen) if j <= 1 else seen, f"g{j}", "left")
    log = -F.log10(256 - F.coalesce("d0", F.lit(0)))
    for j in range(order + 1):
        longer = (F.coalesce(f"e{j + 1}", F.lit(0)), F.coalesce(f"d{j + 1}", F.lit(0))) if j < order else (F.lit(0), F.lit(0))
        left, new = F.col(f"t{j}") - longer[0], F.col(f"d{j}") - longer[1]
        # A context never seen costs no escape, nor does one that leaves no other symbol.
        log = F.when(new > 0, F.log10(new / (left + new))).otherwise(0.0) + log
        if j < order:
            log = F.when(F.col(f"n{j}").isNotNull(), F.log10(F.col(f"n{j}") / (left + new))).otherwise(log)
    return rows.select("gram", log.alias("log"))


def listed(keys: np.ndarray, owner: np.ndarray, size: int, name: str) -> pa.ListArray:
    """The distinct keys of each text, with how often they occur in it."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(keys)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[start], minlength=size))]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.StructArray.from_arrays([pa.array(keys[start].view(np.int64)), pa.array(times.astype(np.int64))], names=[name, "times"]),
    )


def score(
    docs: DataFrame,
    held_out: Column,
    key: str = "doc_id",
    text: str = "text",
    order: int = ORDER,
    nodes: int = NODES,
    words: int = WORDS,
) -> DataFrame:
    """For every row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows for which `held_out` is not true train the model.
    """
    spark = docs.sparkSession
    text_batches(docs)
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    counts = stored(counted(kept.filter("not held_out"), order), "ppm-counts")
    vocabulary = counts.filter(F.col("kind") == WORD).select("key", "n")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    floor = total / words
    often = vocabulary.filter(F.col("n") >= floor).toArrow()
    levels = stored(level_rows(counts.filter(F.col("kind") == GRAM).select("key", "n"), order), "ppm-grams")
    contexts = stored(context_rows(levels), "ppm-contexts")
    logs = stored(seen_logs(levels, contexts, order), "ppm-logs")
    gram_floor = (logs.agg(F.sum("n")).first()[0] or 0) / nodes
    frequent = logs.filter(F.col("n") >= gram_floor).select("gram", "log").toArrow()
    held = spark.sparkContext.broadcast(
        {
            "frequent": (frequent.column("gram").to_numpy().view(np.uint64), frequent.column("log").to_numpy()),
            "often": (often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()),
        }
    )
    fields = "row long, n_tokens long, n_often long, base_often double, score double, rare array<struct<word long, times long>>, grams array<struct<gram long, times long>>"
    schema = T.StructType([*kept.select("key", "held_out").schema, *T._parse_datatype_string(fields)])

    def run(batches):
        at_worker = held.value
        if "find" not in at_worker:
            at_worker["find_gram"] = Hashed(at_worker["frequent"][0]).find
            at_worker["find"] = Hashed(at_worker["often"][0]).find
            at_worker["logs"] = np.log10(at_worker["often"][1] + 0.1)
        find_gram, find, logs, gram_logs = at_worker["find_gram"], at_worker["find"], at_worker["logs"], at_worker["frequent"][1]
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 2):
                size = len(part)
                grams, sizes = streams(part.column(2), order)
                owner = np.repeat(np.arange(size), sizes)
                found = find_gram(grams)
                known = found >= 0
                scores = np.bincount(owner[known], weights=gram_logs[found[known]], minlength=size)
                rest = listed(grams[~known], owner[~known], size, "gram")
                hashes, sizes = hashed_words(part.column(2))
                hashes = np.concatenate([hashes, np.full(size, END_WORD)])
                owner = np.concatenate([np.repeat(np.arange(size), sizes), np.arange(size)])
                found = find(hashes)
                known = found >= 0
                base = np.bincount(owner[known], weights=logs[found[known]], minlength=size)
                often = np.bincount(owner[known], minlength=size)
                rare = listed(hashes[~known], owner[~known], size, "word")
                columns = [np.arange(row, row + size), sizes + 1, often.astype(np.int64), base.astype(np.float64), scores.astype(np.float64)]
                row += size
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, columns), rare, rest], names=schema.names)

    scored = stored(mapped(kept, run, schema), "ppm-scores")
    seldom = vocabulary.filter(F.col("n") < floor).select(F.col("key").alias("word"), F.col("n").alias("c"))
    pairs = scored.select("row", F.explode("rare").alias("rare")).select("row", "rare.word", "rare.times")
    by_word = pairs.join(seldom, "word", "left").select(
        "row",
        (F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("base"),
        F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0).alias("known"),
        F.lit(0.0).alias("log"),
    )
    # The grams that were not sent: all those of training texts were seen, of the others some never were.
    grams = scored.select("row", "held_out", F.explode("grams").alias("grams")).select("row", "held_out", "grams.gram", "grams.times")
    unseen = stored(grams.filter("held_out").select("gram").distinct().join(logs, "gram", "left_anti"), "ppm-unseen")
    other = logs.filter(F.col("n") < gram_floor).select("gram", "log").unionByName(unseen_logs(unseen, levels, contexts, order))
    by_gram = grams.join(other, "gram", "left").select(
        "row", F.lit(0.0).alias("base"), F.lit(0).cast("bigint").alias("known"), (F.col("times") * F.col("log")).alias("log")
    )
    sums = by_word.unionByName(by_gram).groupBy("row").agg(F.sum("base").alias("base_rare"), F.sum("known").alias("n_rare"), F.sum("log").alias("score_rest"))
    norm = math.log10(total + 0.1 * (distinct + 1))
    return scored.drop("rare", "grams").join(sums, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_often") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_often") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("score") + F.coalesce("score_rest", F.lit(0.0))).alias("score"),
    )
