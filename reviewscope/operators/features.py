"""Term weights per game (TF-IDF over words and two-word phrases).

Words are counted in the task, a piece of the texts at a time, as numbers. For the vocabulary only (game, term) totals leave a task,
and of the phrases only those whose two words are frequent enough themselves. Weights of the bounded vocabulary are finished in the task
that reads the review; only reviews whose id comes more than once in their game are brought together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.config import STOP_WORDS
from reviewscope.functions import text as ft
from reviewscope.operators import grouping
from reviewscope.session import stored

GAME = "game_id"
GUIDED = {"min_df": 2, "max_df": 0.95}
FREE = {"min_df": 5, "max_df": 0.8}
MAX_FEATURES = 1000
# Characters whose words a task counts at once, about.
PIECE = 8 << 20

ROWS = [GAME, "review_id", "term", "tf"]
TOTALS = [GAME, "term", "df", "total"]
WEIGHTS = [GAME, "review_id", "term", "rank", "tf", "weight"]
LISTS = [GAME, "review_id", "t"]

# game -> some of its words or terms
Listed = Mapping[object, Sequence[str]]


def term_counts(df: DataFrame, text: str = "review", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(game_id, review_id, words): the words of one review without stop words, joined by blanks; null without any.

    Stop words go first, so phrases join the words around them.
    """
    words = F.nullif(F.array_join(ft.terms(F.col(text), stop_words), " "), F.lit(""))
    return df.select(GAME, "review_id", words.alias("words"))


def stored_counts(df: DataFrame) -> DataFrame:
    """`term_counts`, written once, the games of a file one after the other.

    A piece then has few games, and a word is counted over many reviews of its game before it leaves the task.
    """
    return stored(term_counts(df).sortWithinPartitions(GAME), "words")


class _Piece(NamedTuple):
    """The words of some reviews, in order, as places in `names`."""

    row: np.ndarray  # of each word: its review, a row of the batch
    word: np.ndarray
    names: pa.Array
    game: np.ndarray  # of each row of the batch: a place in `games`
    games: list

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, pair) of neighbouring words; a pair is first * names + second."""
        same = self.row[1:] == self.row[:-1]
        return self.row[1:][same], self.word[:-1][same] * len(self.names) + self.word[1:][same]

    def named(self, terms: np.ndarray, phrases: bool) -> pa.Array:
        if not phrases:
            return self.names.take(pa.array(terms))
        first, second = (self.names.take(pa.array(t)) for t in np.divmod(terms, len(self.names)))
        return pc.binary_join_element_wise(first, second, " ")

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of words in `names`, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _pieces(batch: pa.RecordBatch) -> Iterator[_Piece]:
    texts = batch.column("words")
    games = batch.column(GAME).dictionary_encode(null_encoding="encode")
    game = games.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
    for start, end in zip(cuts, cuts[1:]):
        split = pc.split_pattern(texts.slice(start, end - start), " ")
        words = split.flatten().dictionary_encode()
        if len(words):
            row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64) + start
            word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            yield _Piece(row, word, words.dictionary, game, games.dictionary.to_pylist())


def _ordered(row: np.ndarray, term: pa.Array) -> np.ndarray:
    """The order by row, then term: sums over a review's terms are then the same on any run."""
    coded = term.dictionary_encode()
    rank = np.empty(len(coded.dictionary), dtype=np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    return np.argsort(row * len(rank) + rank[coded.indices.to_numpy()])


def _rows(listed: Listed | None):
    """Each review's terms in order and how often it has them; with `listed` only a game's listed terms."""
    parts = [(g, *t.partition(" ")[::2]) for g, terms in (listed or {}).items() for t in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, firsts, seconds = (list(c) for c in zip(*parts)) if parts else ([], [], [])
        firsts, seconds = pa.array(firsts, pa.string()), pa.array(seconds, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                size = len(piece.names)
                if listed is not None:
                    at = {g: i for i, g in enumerate(piece.games)}
                    owner = np.array([at.get(g, -1) for g in owners], dtype=np.int64)
                    first, second = piece.places(firsts), piece.places(seconds)
                    single = pc.equal(seconds, "").to_numpy(zero_copy_only=False).astype(bool)
                    known = (owner >= 0) & (first >= 0)
                found = []
                for phrases in (False, True):
                    row, term = piece.pairs() if phrases else (piece.row, piece.word)
                    span = size * size if phrases else size
                    if listed is not None:
                        chosen = known & (~single & (second >= 0) if phrases else single)
                        term_of = first * size + second if phrases else first
                        keep = np.isin(piece.game[row] * span + term, (owner * span + term_of)[chosen])
                        row, term = row[keep], term[keep]
                    cells, tf = np.unique(row * span + term, return_counts=True)
                    row, term = np.divmod(cells, span)
                    found.append((row, piece.named(term, phrases), tf))
                row, term, tf = np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found])
                if len(row):
                    order = _ordered(row, term)
                    own = [batch.column(c).take(pa.array(row[order])) for c in (GAME, "review_id")]
                    yield pa.RecordBatch.from_arrays([*own, term.take(pa.array(order)), pa.array(tf[order])], names=ROWS)

    return run


def term_rows(counts: DataFrame, listed: Listed | None = None) -> DataFrame:
    """(game_id, review_id, term, tf), of all terms or of those listed for the game."""
    types = [counts.schema[GAME].dataType, counts.schema["review_id"].dataType, T.StringType(), T.LongType()]
    return counts.mapInArrow(_rows(listed), T.StructType(list(map(T.StructField, ROWS, types))))


def _frequent_pairs(piece: _Piece, frequent: Listed, row: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """True where both words of a pair are among their game's frequent ones, or the game has no list."""
    ours = [i for i, g in enumerate(piece.games) if g in frequent]
    allowed = np.ones((len(ours) + 1, len(piece.names)), dtype=bool)
    slot = np.full(len(piece.games), len(ours))
    for k, i in enumerate(ours):
        slot[i] = k
        allowed[k] = pc.is_in(piece.names, value_set=pa.array(frequent[piece.games[i]], pa.string())).to_numpy(zero_copy_only=False)
    first, second = np.divmod(pair, len(piece.names))
    own = slot[piece.game[row]]
    return allowed[own, first] & allowed[own, second]


def _totals(phrases: bool, frequent: Listed):
    """Per piece and game: the reviews that have a word (or phrase) and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                row, term, span = piece.row, piece.word, len(piece.names)
                if phrases:
                    row, term = piece.pairs()
                    span *= span
                    if frequent:
                        keep = _frequent_pairs(piece, frequent, row, term)
                        row, term = row[keep], term[keep]
                # With counts it sorts, which is many times faster here than the hash table it builds without.
                once = np.unique(row * span + term, return_counts=True)[0]
                cells, df = np.unique(piece.game[once // span] * span + once % span, return_counts=True)
                total = np.unique(piece.game[row] * span + term, return_counts=True)[1]
                game, term = np.divmod(cells, span)
                own = pa.array(piece.games, batch.schema.field(GAME).type).take(pa.array(game))
                yield pa.RecordBatch.from_arrays([own, piece.named(term, phrases), pa.array(df), pa.array(total)], names=TOTALS)

    return run


def term_totals(counts: DataFrame, phrases: bool, frequent: Listed | None = None) -> DataFrame:
    """(game_id, term, df, total) of the words, or of the phrases; of a game in `frequent` only phrases of its frequent words."""
    types = [counts.schema[GAME].dataType, T.StringType(), T.LongType(), T.LongType()]
    parts = counts.select(GAME, "words").mapInArrow(_totals(phrases, frequent or {}), T.StructType(list(map(T.StructField, TOTALS, types))))
    return parts.groupBy(GAME, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(counts: DataFrame, min_df: int, max_df: float, max_features: int = MAX_FEATURES) -> DataFrame:
    """Per game the most frequent terms found in enough, but not too many, reviews.

    Words are counted first. Where a game has `max_features` words that qualify, the last of them sets a floor: a phrase occurs
    at most as often as either of its words, so only phrases of words at or above the floor can still enter, and only those are
    counted. Other games have all their phrases counted. Only terms at or above the floor are put in order.
    """
    docs, _ = grouping.measured(counts.groupBy(GAME).agg(F.count("*").alias("docs")))

    def kept(totals: DataFrame) -> DataFrame:
        return totals.join(docs, GAME).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * max_df))

    # A phrase is in at most as many reviews as either of its words, so words of too few reviews are not looked at again.
    words = stored(term_totals(counts, False).filter(F.col("df") >= min_df), "word-totals")
    floors, _ = grouping.measured(_floors(kept(words), max_features))

    def above(totals: DataFrame) -> DataFrame:
        return totals.join(floors, GAME, "left").filter(F.col("floor").isNull() | (F.col("total") >= F.col("floor")))

    words = stored(above(words), "frequent-words")
    phrases = term_totals(counts, True, listed(words.filter(F.col("floor").isNotNull()).select(GAME, "term")))
    found = kept(words.unionByName(above(phrases)).drop("floor"))
    return grouping.first_n(found, [GAME], [F.desc("total"), F.col("term")], max_features, "rank")


def _floors(totals: DataFrame, n: int) -> DataFrame:
    """(game_id, floor): the total of the n-th most frequent term, of games with so many."""
    upto = F.sum("n").over(Window.partitionBy(GAME).orderBy(F.desc("total")))
    sizes = totals.groupBy(GAME, "total").agg(F.count("*").alias("n")).withColumn("upto", upto)
    return sizes.filter(F.col("upto") >= n).groupBy(GAME).agg(F.max("total").alias("floor"))


def listed(terms: DataFrame) -> Listed | None:
    """The terms of each game as sets for the tasks, if they prove few."""
    table = grouping.fetched(terms.select(GAME, "term"))
    if table is None:
        return None
    found: dict = {}
    for game, term in zip(table.column(GAME).to_pylist(), table.column("term").to_pylist()):
        found.setdefault(game, []).append(term)
    return found


class _Vocabulary:
    """The terms of all games, and where a piece has them."""

    def __init__(self, known: pa.Table):
        column = {c: known.column(c).combine_chunks() for c in known.column_names}
        games = column[GAME].dictionary_encode()
        self.games, self.game = games.dictionary.to_pylist(), games.indices.to_numpy()
        self.term, self.rank, self.idf = column["term"], column["rank"].to_numpy(), column["idf"].to_numpy()
        parts = [t.partition(" ") for t in self.term.to_pylist()]
        self.first, self.second = (pa.array([p[i] for p in parts], pa.string()) for i in (0, 2))
        self.phrase = np.array([bool(p[1]) for p in parts], dtype=bool)
        # Terms in order: sums over a review's terms are then the same on any run.
        self.place = np.empty(len(parts), dtype=np.int64)
        self.place[pc.sort_indices(self.term).to_numpy()] = np.arange(len(parts))

    def weigh(self, piece: _Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf, weight) by row, then term; a term is a place in this vocabulary, rows have length 1."""
        at = {g: i for i, g in enumerate(piece.games)}
        owner = np.array([at.get(g, -1) for g in self.games], dtype=np.int64)[self.game]
        first, second = piece.places(self.first), piece.places(self.second)
        known = (owner >= 0) & (first >= 0)
        size = len(piece.names)
        found = []
        for phrases in (False, True):
            ours = np.flatnonzero(known & (self.phrase & (second >= 0) if phrases else ~self.phrase))
            if not len(ours):
                continue
            span = size * size if phrases else size
            keys = owner[ours] * span + (first[ours] * size + second[ours] if phrases else first[ours])
            order = np.argsort(keys)
            keys, ours = keys[order], ours[order]
            row, term = piece.pairs() if phrases else (piece.row, piece.word)
            keep = np.isin(term // size if phrases else term, first[ours], kind="table")
            row, term = row[keep], term[keep]
            code = piece.game[row] * span + term
            slot = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
            keep = keys[slot] == code
            cells, tf = np.unique(row[keep] * len(self.term) + ours[slot[keep]], return_counts=True)
            found.append((*np.divmod(cells, len(self.term)), tf))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0),)
        row, term, tf = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(row * len(self.term) + self.place[term])
        row, term, tf = row[order], term[order], tf[order]
        w = tf * self.idf[term]
        return row, term, tf, w / np.sqrt(np.bincount(row, weights=w * w))[row]


def _weights(known: pa.Table, lists: bool):
    """Weights of reviews whose id comes once: a row per term, or one per review with its terms by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Vocabulary(known)
        for batch in batches:
            for piece in _pieces(batch):
                row, term, tf, weight = vocabulary.weigh(piece)
                if not len(row):
                    continue
                if not lists:
                    own = [batch.column(c).take(pa.array(row)) for c in (GAME, "review_id")]
                    numbers = [pa.array(n) for n in (vocabulary.rank[term], tf, weight)]
                    yield pa.RecordBatch.from_arrays([*own, vocabulary.term.take(pa.array(term)), *numbers], names=WEIGHTS)
                    continue
                order = np.lexsort((vocabulary.rank[term], row))
                pairs = pa.StructArray.from_arrays([pa.array(vocabulary.rank[term[order]] - 1), pa.array(weight[order])], names=["i", "v"])
                reviews, starts = np.unique(row, return_index=True)
                own = [batch.column(c).take(pa.array(reviews)) for c in (GAME, "review_id")]
                yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pairs)], names=LISTS)

    return run


def _together(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """Weights from (game_id, review_id, term, tf), whatever tasks the rows of an id come from."""
    weighted = rows.join(idf, [GAME, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(GAME, "review_id")))
    return weighted.select(GAME, "review_id", "term", "rank", "tf", (F.col("w") / norm).alias("weight"))


def _by_repeats(counts: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Reviews whose id comes once in their game, and the others; all are others if the repeated ids prove many."""
    again = counts.groupBy(GAME, "review_id").agg(F.count("*").alias("n")).filter("n > 1").select(GAME, "review_id")
    table = grouping.fetched(again)
    if table is None:
        return None, counts
    if not table.num_rows:
        return counts, None
    local = F.broadcast(counts.sparkSession.createDataFrame(table, again.schema)).alias("again")
    same = grouping.same_row("own", "again", [GAME, "review_id"])
    return tuple(counts.alias("own").join(local, same, how) for how in ("left_anti", "left_semi"))


def _weighed(counts: DataFrame, vocab: DataFrame, lists: bool, shaped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    idf = vocab.select(GAME, "term", "rank", (F.ln((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    known = grouping.fetched(idf)
    if known is None:
        return shaped(_together(term_rows(counts), idf))
    once, again = _by_repeats(counts)
    parts = []
    if again is not None:
        local = F.broadcast(counts.sparkSession.createDataFrame(known, idf.schema))
        parts.append(shaped(_together(term_rows(again, listed(local)), local)))
    if once is not None:
        kinds = {
            GAME: counts.schema[GAME].dataType, "review_id": counts.schema["review_id"].dataType, "term": T.StringType(), "rank": T.IntegerType(),
            "tf": T.LongType(), "weight": T.DoubleType(), "t": T.ArrayType(T.StructType().add("i", T.IntegerType()).add("v", T.DoubleType())),
        }
        parts.append(once.mapInArrow(_weights(known, lists), T.StructType([T.StructField(c, kinds[c]) for c in (LISTS if lists else WEIGHTS)])))
    return reduce(DataFrame.unionByName, parts)


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(game_id, review_id, term, rank, tf, weight): tf * (ln((1+n)/(1+df)) + 1), reviews of length 1."""
    return _weighed(counts, vocab, False, lambda rows: rows)


def tfidf_lists(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(game_id, review_id, t): the same weights, a row per review with its (i, v) in order, i the rank from 0."""

    def listed_up(rows: DataFrame) -> DataFrame:
        pair = F.struct((F.col("rank") - 1).cast("int").alias("i"), F.col("weight").alias("v"))
        return rows.groupBy(GAME, "review_id").agg(F.array_sort(F.collect_list(pair)).alias("t"))

    return _weighed(counts, vocab, True, listed_up)
