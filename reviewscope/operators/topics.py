"""Non-negative factorisation of the term weights per game, for all games at once.

Reviews are packed into blocks of bounded size. A game whose weights one task can hold is fitted inside that task. Larger games share a
table of models, one row per game with its topic side H (topics x at most 1000 terms). An iteration joins the models to the blocks,
updates the review side W where it lies, adds up what the next H needs in the executors (per task first, no sum larger than H), and
writes the next models, again in executors. The driver asks every few iterations whether any game is still moving; no matrix
ever reaches it. Starting values are hashed from ids and ranks, so neither partitioning nor engine changes them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewscope.config import ASPECT_SEEDS, CUTS, FALLBACK_KEYWORDS, SentimentCuts
from reviewscope.operators import features, grouping
from reviewscope.operators.sentiment import Scorer, score_sentiment
from reviewscope.session import shared_dir, stored

GAME = "game_id"
BLOCK_ROWS = 2000
# A task holds about this many reviews, in at most so many blocks: what its Python worker gets at once does not grow with the input.
ROWS_PER_TASK = 16_000
BLOCKS_PER_TASK = 1024
# A game of so many weights at most (12 bytes each) is fitted inside one task; such games are dealt over so many tasks at most.
ALONE = 16 << 20
ALONE_TASKS = 1000
# All models together are broadcast up to this size; beyond it they are joined by a shuffle.
MODEL_BYTES = 64 << 20
CHECK_EVERY = 10
EPSILON = float(np.finfo(np.float32).eps)

# Numbers of a block are packed as bytes: they pass between JVM and Python in every iteration.
STATE = "game_id string, block long, ids array<long>, lens binary, idx binary, vals binary, w binary"
BLOCK = [GAME, "block", "ids", "lens", "idx", "vals"]
STATS = pa.list_(pa.float64())
PACKED = {"lens": np.int32, "idx": np.int32, "vals": np.float64, "w": np.float64}
# Share of filled cells from which a block's terms are multiplied as a full matrix, and its cells in a processor's cache.
FULL = 0.02
CACHED = 1 << 17


MODEL = "game_id string, h array<double>, first double, last double, active boolean"
PRIME = 1_000_003

# (game, number of terms, seed word -> column) -> first H
Start = Callable[[str, int, Mapping[str, int]], np.ndarray]


class Topics(NamedTuple):
    topics: DataFrame  # game_id, topic, words, weights
    weights: DataFrame  # game_id, review_id, weights


def scattered(item: str, component: str, seed: int) -> str:
    """A number in (0, 1) for each (item, component), in whole-number arithmetic that SQL and numpy share."""
    x = f"pmod(pmod({item}, {PRIME}) * 7919 + {component} * 104729 + {seed}, {PRIME})"
    return f"(pmod(pmod({x} * {x} + 12345, {PRIME}) * ({x} + 1), {PRIME}) + 1) / {PRIME + 1}D"


def scattered_rows(k: int, terms: int, seed: int) -> np.ndarray:
    """The same for items 1 to `terms`, a row per component."""
    x = ((np.arange(1, terms + 1) % PRIME) * 7919 + np.arange(k)[:, None] * 104729 + seed) % PRIME
    return (((x * x + 12345) % PRIME * (x + 1)) % PRIME + 1) / (PRIME + 1)


def _blocks(docs: DataFrame, k: int, scale: float, seed: int, sizes: DataFrame, tasks: int) -> DataFrame:
    """Reviews of a game in blocks of about BLOCK_ROWS, with hashed starting values for W."""
    docs = grouping.join_small(docs, sizes.select(GAME, "blocks"), [GAME]).withColumn(
        "block", F.pmod(F.xxhash64("review_id"), F.col("blocks"))
    )
    start = F.expr(f"transform(sequence(0, {k - 1}), c -> {scattered('review_id', 'c', seed)} * {scale!r}D)")
    packed = docs.withColumn("w", start).groupBy(GAME, "block").agg(
        F.array_sort(F.collect_list(F.struct("review_id", "t", "w"))).alias("rows")
    )
    arrays = packed.select(
        GAME,
        "block",
        F.expr("transform(rows, r -> r.review_id)").alias("ids"),
        F.expr("transform(rows, r -> size(r.t))").alias("lens"),
        F.expr("flatten(transform(rows, r -> transform(r.t, x -> x.i)))").alias("idx"),
        F.expr("flatten(transform(rows, r -> transform(r.t, x -> x.v)))").alias("vals"),
        F.expr("flatten(transform(rows, r -> r.w))").alias("w"),
    ).repartition(tasks, GAME, "block")
    return arrays.mapInArrow(_pack, STATE)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c, kind in PACKED.items():
            rows = (row.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) for row in batch.column(c))
            batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array([r.tobytes() for r in rows], pa.binary()))
        yield batch


def _unpack_w(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(w=[np.frombuffer(w) for w in pdf["w"]])


class _Block:
    """The term weights of a block's reviews, as matrix X, and its products."""

    def __init__(self, lens: np.ndarray, idx: np.ndarray, vals: np.ndarray, terms: int):
        self.idx, self.vals = idx, vals
        self.rows, self.full = np.repeat(np.arange(len(lens)), lens), None
        self.starts = np.concatenate(([0], np.cumsum(lens)[:-1])).astype(int)
        if len(self.vals) >= FULL * len(lens) * terms:
            # Added up, since a review id that occurs twice has its terms twice.
            cells = self.rows * terms + self.idx
            self.full = np.bincount(cells, weights=self.vals, minlength=len(lens) * terms).reshape(len(lens), terms)

    def parts(self) -> Iterator[tuple[slice, _Block | _Full]]:
        yield slice(None), self

    def by_topics(self, h: np.ndarray) -> np.ndarray:
        if self.full is not None:
            return self.full @ h.T
        return np.add.reduceat(self.vals[:, None] * h[:, self.idx].T, self.starts, axis=0)

    def by_reviews(self, w: np.ndarray, terms: int) -> np.ndarray:
        if self.full is not None:
            return w.T @ self.full
        return np.stack([np.bincount(self.idx, weights=self.vals * w[self.rows, c], minlength=terms) for c in range(w.shape[1])])


class _Full(NamedTuple):
    """Some rows of X as a full matrix."""

    x: np.ndarray

    def by_topics(self, h: np.ndarray) -> np.ndarray:
        return self.x @ h.T

    def by_reviews(self, w: np.ndarray, terms: int) -> np.ndarray:
        return w.T @ self.x


class _Pieces:
    """X of a block whose reviews have each term once, a few rows at a time as full matrices in the same small memory."""

    def __init__(self, lens: np.ndarray, idx: np.ndarray, vals: np.ndarray, terms: int):
        self.vals, self.terms, self.reviews = vals, terms, len(lens)
        self.size = max(1, CACHED // terms)
        self.ends = np.concatenate(([0], np.cumsum(lens)))
        self.cells = np.repeat((np.arange(len(lens)) % self.size * terms).astype(np.int32), lens) + idx

    def once(self) -> bool:
        """Whether cells rise within every piece, so that none is there twice."""
        falls = np.flatnonzero(np.diff(self.cells) <= 0) + 1
        return bool(np.isin(falls, self.ends[:: self.size]).all())

    def parts(self) -> Iterator[tuple[slice, _Block | _Full]]:
        room = np.zeros(min(self.size, self.reviews) * self.terms)
        for start in range(0, self.reviews, self.size):
            stop = min(start + self.size, self.reviews)
            own = slice(self.ends[start], self.ends[stop])
            room[self.cells[own]] = self.vals[own]
            yield slice(start, stop), _Full(room[: (stop - start) * self.terms].reshape(-1, self.terms))
            room[self.cells[own]] = 0.0


def _product(lens: bytes, idx: bytes, vals: bytes, terms: int) -> _Block | _Pieces:
    """X of a packed block, in the form that is multiplied quickest."""
    numbers = [np.frombuffer(v, dtype=PACKED[c]) for c, v in (("lens", lens), ("idx", idx), ("vals", vals))]
    if len(numbers[2]) >= FULL * len(numbers[0]) * terms:
        pieces = _Pieces(*numbers, terms)
        if pieces.once():
            return pieces
    return _Block(*numbers, terms)


def _packed_block(lens: bytes, idx: bytes, vals: bytes, terms: int) -> _Block:
    return _Block(*(np.frombuffer(v, dtype=PACKED[c]) for c, v in (("lens", lens), ("idx", idx), ("vals", vals))), terms)


def _update_block(w: np.ndarray, h: np.ndarray, lens, idx, vals):
    return _updated(w, h, _Block(lens, idx, vals, h.shape[1]))


def _updated(w: np.ndarray, h: np.ndarray, x: _Block | _Pieces):
    """One multiplicative step of W against H, and the sums the next H needs."""
    hht = h @ h.T
    new, wtx, before = np.empty_like(w), np.zeros_like(h), np.zeros(2)
    for own, part in x.parts():
        v = w[own]
        xht, den = part.by_topics(h), v @ hht
        before += (v * xht).sum(), (den * v).sum()
        new[own] = v = v * xht / np.where(den == 0, EPSILON, den)
        wtx += part.by_reviews(v, h.shape[1])
    return new, np.concatenate([wtx.ravel(), (new.T @ new).ravel(), [float(x.vals @ x.vals), *before]])


def _step(k: int):
    """W against the H that came with each block, and per game one row of sums.

    Blocks are read where they lie in the batch, and all but W goes on as it came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            new = []
            for game, lens, idx, vals, w, h in zip(*(batch.column(c) for c in (GAME, "lens", "idx", "vals", "w", "h"))):
                w = w.as_buffer()
                if h.is_valid:
                    model, game = h.values.to_numpy().reshape(k, -1), game.as_py()
                    block = _product(lens.as_buffer(), idx.as_buffer(), vals.as_buffer(), model.shape[1])
                    next_w, stats = _updated(np.frombuffer(w).reshape(-1, k), model, block)
                    sums[game] = sums[game] + stats if game in sums else stats
                    w = next_w.tobytes()
                new.append(bytes(w))
            yield _stepped(batch.select(BLOCK), pa.array(new, pa.binary()), pa.nulls(len(new), STATS))
        if sums:
            blank = [pa.nulls(len(sums), batch.schema.field(c).type) for c in BLOCK[1:]]
            own = pa.RecordBatch.from_arrays([pa.array(list(sums), batch.schema.field(GAME).type), *blank], names=BLOCK)
            yield _stepped(own, pa.nulls(len(sums), pa.binary()), pa.array(list(sums.values()), STATS))

    return run


def _stepped(block: pa.RecordBatch, w: pa.Array, stats: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*block.columns, w, stats], names=[*BLOCK, "w", "stats"])


def _advance(k: int, turn: int, tol: float):
    """The next model of each game from the sums of one pass; a game that has stalled rests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                h, first, last, active = row.h, row.first, row.last, row.active
                if row.sums is not None:
                    h, error, before = _next_h(h.reshape(k, -1), row.sums, k)
                    if turn == 1:
                        first = last = before or EPSILON
                    if turn % CHECK_EVERY == 0:
                        active, last = (last - error) / first >= tol, error
                out.append((row.game_id, np.ravel(h), first, last, active))
            yield pd.DataFrame(out, columns=["game_id", "h", "first", "last", "active"])

    return run


def _next_h(h: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, float, float]:
    """H after the sums of one pass, the error now, and the error before that pass."""
    cut = h.size
    wtx, wtw = sums[:cut].reshape(h.shape), sums[cut : cut + k * k].reshape(k, k)
    x2, cross, quad = sums[cut + k * k :]
    den = wtw @ h
    h = h * wtx / np.where(den == 0, EPSILON, den)
    now = x2 - 2 * float((wtx * h).sum()) + float((wtw * (h @ h.T)).sum())
    return h, math.sqrt(max(now, 0.0)), math.sqrt(max(x2 - 2 * cross + quad, 0.0))


def _top_terms(h: np.ndarray, n: int) -> list[tuple[int, int, int, float]]:
    """(component, place, vocabulary rank, weight) of the n strongest positive terms."""
    out = []
    for c, row in enumerate(h):
        best = np.lexsort((np.arange(len(row)), -row))[:n]
        out += [(c, p, int(i) + 1, float(row[i])) for p, i in enumerate(best, 1) if row[i] > 0]
    return out


FITTED = (
    "game_id string, ids array<long>, w array<double>, "
    "tops array<struct<component:int, place:int, rank:int, weight:double>>"
)
TOP = pa.struct([("component", pa.int32()), ("place", pa.int32()), ("rank", pa.int32()), ("weight", pa.float64())])
FITTED_TYPES = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(TOP)]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(game, terms, seeds, ids, W, lens, idx, vals) of each block; numbers stay where they lie in the batch."""
    for batch in batches:
        for game, terms, seeds, ids, *numbers in zip(*(batch.column(c) for c in (GAME, "terms", "seeds", "ids", "w", "lens", "idx", "vals"))):
            yield game.as_py(), terms.as_py(), seeds.as_py(), ids, *(n.as_buffer() for n in numbers)


def _fit_alone(k: int, start: Start, max_iter: int, tol: float, top_n: int):
    """All iterations of games whose blocks lie one after the other in a task."""

    def fit(game: str, blocks: list[tuple]) -> tuple[list[np.ndarray], np.ndarray]:
        terms, seeds = blocks[0][1:3]
        h, ws = start(game, int(terms), _places(seeds)), [np.frombuffer(b[4]).reshape(-1, k) for b in blocks]
        # One block is kept as it is multiplied; of more only the packed numbers stay.
        kept = _packed_block(*blocks[0][5:], h.shape[1]) if len(blocks) == 1 else None
        first = last = 0.0
        for turn in range(1, max_iter + 1):
            sums = 0.0
            for i, block in enumerate(blocks):
                ws[i], own = _updated(ws[i], h, kept or _product(*block[5:], h.shape[1]))
                sums = sums + own
            h, error, before = _next_h(h, sums, k)
            if turn == 1:
                first = last = before or EPSILON
            if turn % CHECK_EVERY == 0:
                if (last - error) / first < tol:
                    break
                last = error
        return ws, h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for game, own in groupby(_blocks_of(batches), key=itemgetter(0)):
            blocks = list(own)
            ws, h = fit(game, blocks)
            for i, w in enumerate(ws):
                tops = [] if i else _top_terms(h, top_n)
                columns = [[game], [blocks[i][3].as_py()], [w.ravel()], [[dict(zip(("component", "place", "rank", "weight"), t)) for t in tops]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FITTED_TYPES)], names=[GAME, "ids", "w", "tops"])

    return run


def _places(seeds) -> dict[str, int]:
    """Seed word -> column of H, from array<struct<term, rank>>."""
    return {} if seeds is None else {x["term"]: x["rank"] - 1 for x in seeds}


def _first_models(start: Start):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = [np.ravel(start(g, int(n), _places(s))) for g, n, s in zip(pdf[GAME], pdf["terms"], pdf["seeds"])]
            yield pd.DataFrame({GAME: pdf[GAME], "h": h, "first": 0.0, "last": 0.0, "active": True})

    return run


def _best_terms(k: int, top_n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(g, *t) for g, h in zip(pdf[GAME], pdf["h"]) for t in _top_terms(h.reshape(k, -1), top_n)]
            yield pd.DataFrame(rows, columns=["game_id", "component", "place", "rank", "weight"])

    return run


def _fit_together(
    state: DataFrame, models: DataFrame, small: bool, k: int, max_iter: int, tol: float
) -> tuple[DataFrame, DataFrame]:
    """Games of many blocks: one pass over the blocks per iteration, until every game's error stalls. (blocks, models)

    `small` says that all models together may be broadcast.
    """
    models = stored(models, "topic-models")
    columns = ["game_id", "block", "ids", "lens", "idx", "vals", "w"]
    held: DataFrame | None = None
    for turn in range(1, max_iter + 1):
        moving = models.filter("active").select(GAME, "h")
        together = state.join(F.broadcast(moving) if small else moving, GAME, "left")
        moved = together.mapInArrow(_step(k), STATE + ", stats array<double>").persist(StorageLevel.MEMORY_AND_DISK)
        sums = moved.filter("stats is not null").groupBy(GAME)
        sums = sums.agg(vector_to_array(Summarizer.sum(array_to_vector("stats"))).alias("sums"))
        models = stored(models.join(sums, GAME, "left").mapInPandas(_advance(k, turn, tol), MODEL), "topic-models")
        state = moved.filter("ids is not null").select(*columns)
        check = turn % CHECK_EVERY == 0
        done = turn == max_iter or (check and models.filter("active").isEmpty())
        if check or done:
            # Written to the shared folder: bounds the lineage and survives lost executors.
            state = state.checkpoint()
        for old in (held, moved if check or done else None):
            if old is not None:
                old.unpersist()
        held = None if check or done else moved
        if done:
            break
    return state, models


def factorise(
    counts: DataFrame,
    vocab: DataFrame,
    k: int,
    start: Start,
    seeds: Sequence[str] = (),
    max_iter: int = 300,
    w_scale: float = 0.1,
    tol: float = 1e-4,
    seed: int = 42,
    top_n: int = 10,
    block_rows: int = BLOCK_ROWS,
    alone: int = ALONE,
) -> tuple[DataFrame, DataFrame]:
    """(top terms per component, review weights). Games of several blocks and more than `alone` weights are fitted by many tasks.

    `start(game, terms, places)` gives a game's first H; `places` locates those of `seeds` that are
    in its vocabulary.  Terms come as (game_id, component, place, term, weight), positive only.
    """
    spark = counts.sparkSession
    shared_dir(spark)
    vocab = stored(vocab, "vocabulary")
    weights = features.tfidf_lists(counts, vocab)
    seeded = vocab.filter(F.col("term").isin(*seeds)) if seeds else vocab.limit(0)
    sizes = vocab.groupBy(GAME).agg(
        F.count("*").alias("terms"), F.max("docs").alias("docs"), F.ceil(F.max("docs") / block_rows).alias("blocks"), F.sum("df").alias("weights")
    )
    sizes = sizes.join(
        seeded.groupBy(GAME).agg(F.collect_list(F.struct("term", "rank")).alias("seeds")), GAME, "left"
    )
    sizes = stored(sizes, "games")
    blocks, rows = (int(n or 0) for n in sizes.agg(F.sum("blocks"), F.sum("docs")).first())
    needed = max(math.ceil(rows / ROWS_PER_TASK), math.ceil(blocks / BLOCKS_PER_TASK))
    tasks = max(min(blocks, spark.sparkContext.defaultParallelism), needed, 1)
    packed = stored(_blocks(weights, k, w_scale, seed, sizes, tasks), "blocks")

    small = sizes.filter("blocks = 1").select(GAME, "terms", "seeds")
    single = grouping.join_small(packed, small, [GAME])
    fit = _fit_alone(k, start, max_iter, tol, top_n)
    fitted = single.mapInArrow(fit, FITTED)
    whole = sizes.filter((F.col("blocks") > 1) & (F.col("weights") <= alone))
    games = whole.count()
    if games:
        # The largest games come first, each in a task of its own while there are tasks.
        parts = min(games, ALONE_TASKS)
        slot = (F.row_number().over(Window.orderBy(F.desc("weights"), GAME)) - 1) % parts
        dealt = grouping.join_small(packed, whole.select(GAME, "terms", "seeds", slot.alias("slot")), [GAME])
        dealt = dealt.repartitionById(parts, "slot").sortWithinPartitions(GAME, "block").drop("slot")
        fitted = dealt.mapInArrow(fit, FITTED).unionByName(fitted)
    fitted = stored(fitted, "fitted")
    tops = fitted.select(GAME, F.inline("tops"))
    states = [fitted.select(GAME, "ids", "w")]

    large = sizes.filter((F.col("blocks") > 1) & (F.col("weights") > alone))
    terms = int(large.agg(F.sum("terms")).first()[0] or 0)
    if terms:
        own = grouping.join_small(packed, large.select(GAME), [GAME])
        models = large.select(GAME, "terms", "seeds").mapInPandas(_first_models(start), MODEL)
        state, models = _fit_together(own, models, terms * k * 8 <= MODEL_BYTES, k, max_iter, tol)
        states.append(state.select(GAME, "ids", "w").mapInPandas(_unpack_w, states[0].schema))
        tops = tops.unionByName(models.mapInPandas(_best_terms(k, top_n), tops.schema))

    named = tops.join(vocab.select(GAME, "rank", "term"), [GAME, "rank"])
    reviews = reduce(DataFrame.unionByName, states)
    reviews = reviews.select(GAME, F.posexplode("ids").alias("pos", "review_id"), "w").select(
        GAME, "review_id", F.slice("w", F.col("pos") * k + 1, F.lit(k)).alias("weights")
    )
    return named.select(GAME, "component", "place", "term", "weight"), reviews


def guided_keywords(
    df: DataFrame,
    seeds: Mapping[str, Sequence[str]] = ASPECT_SEEDS,
    top_n: int = 5,
    strength: float = 10.0,
    floor: float = 0.0,
    max_iter: int = 1000,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(game_id, aspect, keywords): one component per aspect, started at its seed words.

    Entries that start at zero stay zero, so with floor=0 only seed words can rank; a positive
    `floor` lets other terms in.  A game without vocabulary falls back to the first seeds.
    """
    names = list(seeds)

    def start(game: str, terms: int, places: Mapping[str, int]) -> np.ndarray:
        h = np.full((len(names), terms), floor)
        for i, name in enumerate(names):
            for word in seeds[name]:
                if word in places:
                    h[i, places[word]] = strength
        return h

    words = sorted({w for listed in seeds.values() for w in listed})
    counts = features.stored_counts(df)
    vocab = features.vocabulary(counts, **features.GUIDED)
    tops, _ = factorise(
        counts, vocab, len(names), start, words, max_iter=max_iter, top_n=top_n, block_rows=block_rows
    )
    lists = tops.groupBy(GAME, "component").agg(
        F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t")
    )
    aspects = F.array(
        *[
            F.struct(
                F.lit(i).alias("component"),
                F.lit(name).alias("aspect"),
                F.array(*[F.lit(w) for w in seeds[name][:FALLBACK_KEYWORDS]]).alias("seeds"),
            )
            for i, name in enumerate(names)
        ]
    )
    fitted = tops.select(GAME).distinct().withColumn("fitted", F.lit(True))
    games = df.select(GAME).distinct().join(fitted, GAME, "left")
    grid = games.select(GAME, "fitted", F.inline(aspects)).join(lists, [GAME, "component"], "left")
    words = F.when(F.col("fitted"), F.coalesce(F.transform("t", lambda x: x["term"]), F.array().cast("array<string>")))
    return grid.select(GAME, "aspect", F.coalesce(words, F.col("seeds")).alias("keywords"))


def nmf_topics(
    df: DataFrame, n_topics: int = 10, max_iter: int = 300, seed: int = 42, block_rows: int = BLOCK_ROWS, alone: int = ALONE
) -> Topics:
    """Free topics: the ten strongest words of each, and every review's weight per topic."""

    def start(game: str, terms: int, places: Mapping[str, int]) -> np.ndarray:
        return scattered_rows(n_topics, terms, seed) * 0.1

    counts = features.stored_counts(df)
    vocab = features.vocabulary(counts, **features.FREE)
    tops, reviews = factorise(
        counts, vocab, n_topics, start, max_iter=max_iter, seed=seed, block_rows=block_rows, alone=alone
    )
    lists = tops.groupBy(GAME, F.concat(F.lit("topic_"), F.col("component").cast("string")).alias("topic")).agg(
        F.array_sort(F.collect_list(F.struct("place", "term", "weight"))).alias("t")
    )
    topics = lists.select(
        GAME,
        "topic",
        F.transform("t", lambda x: x["term"]).alias("words"),
        F.transform("t", lambda x: x["weight"]).alias("weights"),
    )
    return Topics(topics, reviews)


def dominant_topic(df: DataFrame, cuts: SentimentCuts = CUTS) -> DataFrame:
    """Add topic and relevance (largest of `weights`, the first on ties) and keep relevant reviews."""
    top = F.array_max("weights")
    position = (F.array_position("weights", top) - 1).cast("string")
    return df.filter(top > cuts.topic_relevance).withColumns(
        {"topic": F.concat(F.lit("topic_"), position), "relevance": top}
    )


def topic_sentiment(df: DataFrame, topics: DataFrame, scorer: Scorer | None, cuts: SentimentCuts = CUTS) -> DataFrame:
    """Judge relevant reviews per dominant topic; confidence must exceed the cut."""
    kept = score_sentiment(dominant_topic(df, cuts), scorer).filter(
        F.col("confidence") > cuts.topic_confidence
    )
    stats = kept.groupBy(GAME, "topic").agg(
        F.count_if(F.col("label") == "POSITIVE").alias("positive"),
        F.count_if(F.col("label") == "NEGATIVE").alias("negative"),
        F.avg("relevance").alias("mean"),
    )
    total = F.col("positive") + F.col("negative")
    words = topics.select(GAME, "topic", F.slice("words", 1, 5).alias("words"))
    return stats.filter(total > 0).join(words, [GAME, "topic"], "left").select(
        GAME,
        "topic",
        "words",
        total.alias("mentions"),
        "positive",
        "negative",
        F.bround(F.col("positive") / total * 100, 2).alias("percent_positive"),
        F.bround("mean", 3).alias("avg_relevance"),
    )
