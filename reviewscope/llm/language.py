"""Language identification by cross-parsing entropy.

Each language has labelled text, held in a suffix automaton. A document is parsed with it into phrases, each the
longest match found anywhere in the language's text; the number of phrases times log2 of the length of that text, over the
document's length, estimates the bits a symbol costs in that language. The language that needs the fewest wins.

Symbols are the bytes of the lower-case text; ASCII characters that are no letters are one separator, and runs of
it count once. A phrase ends after `BLOCK` symbols at the latest, so long texts are many blocks, and a batch of blocks walks
through the automata side by side: one step is a table lookup for all of them.

Fitting takes a bounded sample: per language pieces of labelled texts, of `PIECE` characters at most and from a place that the text's hash
says, in the order of that hash, until there are `sample_bytes` bytes (`sample_texts` texts at most). Pieces are cut in the
tasks; with many languages each has an equal part of `TOTAL_BYTES`. The driver builds the automata once, and their tables, at most
about 500 bytes per sampled byte, are sent to the workers.

Edge cases: a null text, and one without any letter, is `und` with score 0; so is everything if no language was learned, but `identified`
then keeps every row that has a letter.
Equal costs are decided by the smaller language name. Rows that repeat are each predicted alike. Very long texts are
walked through in blocks of bounded memory. Empty tables give empty results; other columns are carried or ignored,
whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.llm.words import mapped, slices, text_batches
from reviewscope.session import stored

SAMPLE_BYTES = 49_152
SAMPLE_TEXTS = 512
TOTAL_BYTES = 1 << 19
PIECE = 2048
BLOCK = 256
WALK_BYTES = 1 << 20
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    samples: list[bytes]


# ------------------------------------------------------------------------------------ symbols
def _separators() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    other = [b for b in range(128) if not chr(b).isalpha()]
    table[other] = 32
    return table


SEPARATED = _separators()


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the position at which each text ends."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    lower = lower.combine_chunks() if isinstance(lower, pa.ChunkedArray) else lower
    bounds = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = lower.buffers()[2]
    raw = SEPARATED[np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]] if data else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    keep = raw != 32
    keep[1:] |= raw[:-1] != 32
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[first] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return raw[keep], kept[bounds[1:]]


# ---------------------------------------------------------------------------------- automata
def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Edges of the smallest automaton of all substrings; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    longest, suffix = [0], [-1]
    end = 0
    for symbol in data:
        made = len(edges)
        edges.append({})
        longest.append(longest[end] + 1)
        suffix.append(0)
        at, end = end, made
        while at >= 0 and symbol not in edges[at]:
            edges[at][symbol] = made
            at = suffix[at]
        if at < 0:
            continue
        onto = edges[at][symbol]
        if longest[onto] != longest[at] + 1:
            # Split off the part of `onto` that is reached by the shorter contexts.
            part = len(edges)
            edges.append(dict(edges[onto]))
            longest.append(longest[at] + 1)
            suffix.append(suffix[onto])
            suffix[onto] = part
            while at >= 0 and edges[at].get(symbol) == onto:
                edges[at][symbol] = part
                at = suffix[at]
            onto = part
        suffix[made] = onto
    return edges


class Walker:
    """Dense tables of one language. States are row offsets; 0 in a table says that no phrase goes on.

    Two states are added: after a symbol that the language never shows (every next symbol starts a phrase), and behind the end
    of a text (symbol code 1, which never starts one).
    """

    def __init__(self, sample: bytes, code: np.ndarray, width: int):
        edges = suffix_automaton(sample)
        lost, over = len(edges), len(edges) + 1
        table = np.zeros((len(edges) + 2, width), dtype=np.int32)
        for state, out in enumerate(edges):
            if out:
                table[state, code[list(out)]] = list(out.values())
        table[:, 1] = over
        self.start = table[0].copy()
        self.start[self.start == 0] = lost
        self.start *= width
        self.table = (table * width).ravel()
        self.cost = np.log2(max(2, len(sample)))

    def phrases(self, grid: np.ndarray) -> np.ndarray:
        """grid: a row per step, a column per block; returns the phrases of each block."""
        state = self.start.take(grid[0])
        count = np.ones(grid.shape[1], dtype=np.int32)
        for step in grid[1:]:
            state += step
            state = self.table.take(state)
            ended = np.flatnonzero(state == 0)
            count[ended] += 1
            state[ended] = self.start.take(step[ended])
        return count


class Identifier:
    def __init__(self, model: Model):
        self.languages = model.languages
        seen = sorted(set().union(*model.samples)) if model.samples else []
        self.code = np.zeros(256, dtype=np.int64)
        self.code[seen] = np.arange(2, len(seen) + 2)  # 0: never seen, 1: behind the end
        self.walkers = [Walker(s, self.code, len(seen) + 2) for s in model.samples]

    def plain(self) -> tuple:
        """All it knows as lists and arrays, which workers can read without this package."""
        return self.languages, self.code, [vars(w) for w in self.walkers]

    @classmethod
    def of(cls, plain: tuple) -> Identifier:
        made = cls(Model([], []))
        made.languages, made.code, tables = plain
        for table in tables:
            walker = Walker.__new__(Walker)
            vars(walker).update(table)
            made.walkers.append(walker)
        return made

    def __call__(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """Language and score of every text."""
        n = len(texts)
        bits = np.zeros((len(self.walkers), n))
        raw, ends = symbols(texts)
        starts = np.concatenate([[0], ends[:-1]])
        lengths = ends - starts
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
        at = starts[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        size = np.minimum(BLOCK, ends[owner] - at)
        codes = self.code[raw].astype(np.int32)
        order = np.argsort(-size, kind="stable")
        for some in range(0, len(order), WALK_BYTES // BLOCK):
            part = order[some : some + WALK_BYTES // BLOCK]
            steps = np.arange(int(size[part].max()))[:, None]
            place = at[part][None, :] + steps
            grid = np.where(steps < size[part][None, :], codes[np.minimum(place, len(codes) - 1)], 1).astype(np.int32)
            for row, walker in zip(bits, self.walkers):
                np.add.at(row, owner[part], walker.phrases(grid))
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.walkers:
            return [UNKNOWN] * n, np.zeros(n)
        bits *= np.array([w.cost for w in self.walkers])[:, None] / np.maximum(lengths, 1)
        best = bits.argmin(axis=0)
        weight = np.exp2(bits.min(axis=0) - bits).sum(axis=0)
        score = np.where(letters, 1 / weight, 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], score


# ------------------------------------------------------------------------------------- Spark
def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Learn from rows that have text and language. A bounded sample of them is collected."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("text is not null and lang is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    # Copies of a text are folded first: the draw is one of distinct texts.
    sizes = stored(rows.groupBy("lang", "hash").agg(F.max(F.octet_length(piece())).alias("size")), "language-texts")
    # About four times the texts wanted, evenly by hash: what is left to order is bounded by language, not by task.
    counts = {r["lang"]: r["n"] for r in sizes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], [])
    sample_bytes = min(sample_bytes, TOTAL_BYTES // len(counts))
    pairs = [F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4 * sample_texts / n))]
    share = F.element_at(F.create_map(*pairs), F.col("lang"))
    sizes = sizes.filter(F.pmod(F.col("hash"), F.lit(1 << 30)) / float(1 << 30) <= share)
    drawn = W.partitionBy("lang").orderBy("hash")
    sizes = sizes.withColumn("place", F.row_number().over(drawn))
    before = F.coalesce(F.sum("size").over(drawn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = sizes.filter(F.col("place") <= sample_texts).withColumn("before", before).filter(F.col("before") < sample_bytes)
    hashes = [r[0] for r in chosen.select("hash").distinct().collect()]
    if not hashes:
        return Model([], [])
    found = rows.filter(F.col("hash").isin(hashes)).select("lang", "hash", piece().alias("text")).distinct().collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["hash"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    joined = {k: symbols(pa.array([" ".join(v)]))[0].tobytes()[:sample_bytes] for k, v in sorted(texts.items())}
    joined = {k: v for k, v in joined.items() if v}
    return Model(list(joined), list(joined.values()))


def piece() -> Column:
    """What a text may give to the sample."""
    start = F.pmod(F.shiftright("hash", 20), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1)
    return F.substring(F.col("text"), (start + 1).cast("int"), F.lit(PIECE))


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`row` (a struct of the carried columns, all by default), lang_pred, score."""
    carry = docs.columns if carry is None else carry
    text_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(Identifier(model).plain())
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType(
        [kept.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        identify = Identifier.of(held.value)
        for batch in batches:
            for part in slices(batch, 1, WALK_BYTES):
                lang, score = identify(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return mapped(kept, run, schema)


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` whose language could be told, with their own columns; all with a letter, if there is nothing to tell it by."""
    if not model.languages:
        return docs.filter(F.col(f"`{text}`").rlike(r"\p{L}"))
    return predict(docs, model, text).filter(F.col("lang_pred") != UNKNOWN).select("row.*")
