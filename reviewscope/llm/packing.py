"""Packing: sum-of-squares online packing of tokenised documents into windows of a fixed number of tokens.

A document's tokens are its ids and an end id. Full windows are cut off a long document; the rest (shorter than a
window) is placed online: among the levels of the partially filled windows, and a new window, the one is taken that
minimises the sum over levels of squared counts. The counts are one array per task, so a placement is two slices of
it and an argmin. A task packs the documents of its own partition; nothing is shuffled and no state is shared.

At the end of a task its open windows are closed: the emptiest are cut up to fill the fullest, and the one that
remains is cut into sequences whose lengths are powers of two. So no sequence needs padding.

Edge cases: a null or empty text is the end id alone. Rows that repeat a key are packed each on its own. A null key
is kept as null. Texts of any length are cut; a task holds one Arrow batch of texts and its open windows. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain, compress, repeat
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.llm.words import _LOWER_BYTES, cut_words, mapped, raw_bytes, slices, text_batches

WINDOW = 4096
END = 2
CACHED_WORDS = 250_000
ROWS_OUT = 4_000
SLICE_BYTES = 1 << 19
#: White space that the tokenizer drops, and that no word of it spans.
BREAK = np.zeros(256, dtype=bool)
BREAK[[9, 10, 13, 32]] = True
#: Kinds of ASCII bytes that no unit of the tokenizer mixes; 0: leave together with what stands beside it.
LETTER, SIGN, DIGIT = 1, 2, 3
UNIT = np.zeros(256, dtype=np.uint8)
UNIT[33:127] = SIGN
UNIT[[*range(65, 91), *range(97, 123)]] = LETTER
UNIT[48:58] = DIGIT
UNIT[39] = 0
OUT = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class WordEncoder:
    """Token ids of texts, from ids of words that are kept.

    For vocabularies that drop white space and tell letters, digits and other signs apart: a text's ids are those of its words, one after the
    other, and words are cut where ASCII letters, signs and single digits meet (not at an apostrophe, which may belong to
    either side, nor next to other scripts). The words of a batch are numbered by Arrow, so each distinct word is looked up once and the ids are gathered by number. `ends` are the
    ids that end a word; they tell apart the words of a joined text. Where the vocabulary has no capitals, A-Z are made small
    ahead of it, unless this could make one of its special tokens.
    """

    def __init__(self, model: str, end: int, limit: int = CACHED_WORDS, suffix: str = "</w>"):
        from tokenizers import Tokenizer

        # A task is one core: threads of the library's own would only take others'.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole, self.limit = Tokenizer.from_str(model), limit
        self.last = np.array([end], dtype=np.uint32)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.special = [t.content.lower().encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.small = self.whole.encode(ascii_uppercase).ids == self.whole.encode(ascii_uppercase.lower()).ids
        self.forget()

    def forget(self) -> None:
        # Word -> its number; where the ids of a number begin in `ids`, and how many there are. Number 0 is the end of a text.
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size = self.last, np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(words, range(self.count, self.count + len(words))))
        self.count += len(words)
        self.more.append((ids, sizes))

    def learn(self, words: list[bytes]) -> None:
        # A word of letters alone is one unit of the tokenizer, so its ids close with one end. No word spans a blank.
        self.count, self.more = len(self.size), []
        texts = b" ".join(words).decode().split(" ")
        plain = [*map(str.isalpha, texts)]
        other = [i for i, one in enumerate(plain) if not one]
        letters, keys = [*compress(texts, plain)], [*compress(words, plain)]
        starts = range(0, len(letters), 500)
        for at, found in zip(starts, self.encoded([" ".join(letters[at : at + 500]) for at in starts])):
            part, ids = keys[at : at + 500], np.array(found, dtype=np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                self.keep(part, ids, np.diff(stops, prepend=0))
            else:
                self.single(part, letters[at : at + 500])
        if other:
            self.single([words[i] for i in other], [texts[i] for i in other])
        if self.more:
            self.ids = np.concatenate([self.ids, *(ids for ids, _ in self.more)])
            self.size = np.concatenate([self.size, *(sizes for _, sizes in self.more)])
            self.begin = np.cumsum(self.size) - self.size

    def single(self, words: list[bytes], texts: list[str]) -> None:
        found = self.encoded(texts)
        ids = np.array([*chain.from_iterable(found)], dtype=np.uint32)
        self.keep(words, ids, np.fromiter(map(len, found), dtype=np.int64, count=len(found)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed with the end id, and the bounds between them."""
        raw, bounds = raw_bytes(texts)
        lower, cuts = _LOWER_BYTES[raw], None
        data = lower.tobytes()
        if not any(s in data for s in self.special):
            raw = lower if self.small else raw
            kind = UNIT[raw]
            cuts = np.zeros(len(raw), dtype=bool)
            cuts[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        words, counts = cut_words(raw, bounds, ~BREAK[raw], cuts)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.limit:
            self.forget()
        known = self.known
        number = np.fromiter(map(known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            words = [distinct[i] for i in new.tolist()]
            self.learn(words)
            number[new] = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        # The words' numbers, with that of the end behind each text.
        last = np.cumsum(counts + 1) - 1
        placed = np.zeros(int(last[-1]) + 1 if len(last) else 0, dtype=np.int64)
        inside = np.ones(len(placed), dtype=bool)
        inside[last] = False
        placed[inside] = number.take(coded.indices.to_numpy())
        length = self.size.take(placed)
        upto = np.cumsum(length)
        at = np.repeat(self.begin.take(placed) - (upto - length), length)
        at += np.arange(len(at))
        return self.ids.take(at), np.concatenate([[0], upto[last]])


class Window:
    __slots__ = ("number", "fill", "pieces")

    def __init__(self, number: int):
        self.number, self.fill, self.pieces = number, 0, []


class Packer:
    """Windows of one task. `done` receives (window number, pieces) of every finished sequence."""

    def __init__(self, size: int, done):
        self.size, self.done, self.made = size, done, 0
        # By free space: how many windows, a penalty where there is none, and the windows themselves.
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.none = np.full(size + 1, 1 << 40, dtype=np.int64)
        self.open: list[list[Window]] = [[] for _ in range(size + 1)]

    def new(self) -> Window:
        self.made += 1
        return Window(self.made - 1)

    def add(self, key, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.done(self.new().number, [(key, at, ids[at : at + self.size], len(ids))])
        if whole < len(ids):
            # A copy: a view would hold the ids of all texts of the slice for as long as its window is open.
            self.place((key, whole, ids[whole:].copy(), len(ids)))

    def place(self, piece) -> None:
        need, count = len(piece[2]), self.count
        # Moving a window from free space f to f - need changes the squares by 2 (count[f - need] - count[f]) + 2.
        free, cost = self.size, 2 * count[self.size - need] + 1
        if need + 1 < self.size:
            change = 2 * (count[1 : self.size - need] - count[need + 1 : self.size]) + 2 + self.none[need + 1 : self.size]
            best = int(change.argmin())
            if change[best] <= cost:
                free, cost = best + need + 1, change[best]
        if count[need] and 1 - 2 * count[need] <= cost:
            free = need
        window = self.new() if free == self.size else self.take(free)
        window.pieces.append(piece)
        window.fill += need
        self.put(window)

    def take(self, free: int) -> Window:
        window = self.open[free].pop()
        self.count[free] -= 1
        if not self.count[free]:
            self.none[free] = 1 << 40
        return window

    def put(self, window: Window) -> None:
        free = self.size - window.fill
        if not free:
            self.done(window.number, window.pieces)
            return
        self.open[free].append(window)
        self.count[free] += 1
        self.none[free] = 0

    def close(self) -> None:
        """Fill the fullest windows with what the emptiest hold; cut the last one at powers of two."""
        left = [w for group in self.open for w in group]
        first, last = 0, len(left) - 1
        while first < last:
            to, source = left[first], left[last]
            key, start, ids, total = source.pieces.pop()
            some = min(self.size - to.fill, len(ids))
            to.pieces.append((key, start + len(ids) - some, ids[len(ids) - some :], total))
            if some < len(ids):
                source.pieces.append((key, start, ids[: len(ids) - some], total))
            to.fill, source.fill = to.fill + some, source.fill - some
            if to.fill == self.size:
                self.done(to.number, to.pieces)
                first += 1
            if not source.fill:
                last -= 1
        if first == last and left and left[first].fill:
            self.split(left[first])

    def split(self, window: Window) -> None:
        pieces, part, room = window.pieces[::-1], [], 0
        fill = window.fill
        while fill:
            room = 1 << (fill.bit_length() - 1)
            fill -= room
            part = []
            while room:
                key, start, ids, total = pieces.pop()
                some = min(room, len(ids))
                part.append((key, start, ids[:some], total))
                if some < len(ids):
                    pieces.append((key, start + some, ids[some:], total))
                room -= some
            self.done(self.new().number, part)


def pack(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", size: int = WINDOW, end: int = END
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `model` is the tokenizer's file as text; it is sent to the workers once. An encoder lives as long as its task.
    """
    text_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    field = kept.schema["key"]
    schema = T.StructType([T.StructField("key", field.dataType), *(T.StructField(c, T.LongType()) for c in OUT)])

    def run(batches):
        encode = WordEncoder(held.value, end)
        base = TaskContext.get().partitionId() << 32
        keys: list = []
        rows: list[tuple] = []

        def done(number, pieces):
            offset = 0
            for k, start, ids, total in pieces:
                keys.append(k)
                rows.append((start, len(ids), zlib.crc32(ids), total, base + number, offset))
                offset += len(ids)

        def out(kind):
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(OUT)).T
            batch = pa.RecordBatch.from_arrays([pa.array(keys, type=kind), *map(pa.array, columns)], names=["key", *OUT])
            keys.clear()
            rows.clear()
            return batch

        packer, kind = Packer(size, done), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, 1, SLICE_BYTES):
                ids, bounds = encode(part.column(1))
                for at, k in enumerate(part.column(0).to_pylist()):
                    packer.add(k, ids[bounds[at] : bounds[at + 1]])
                if len(rows) >= ROWS_OUT:
                    yield out(kind)
        packer.close()
        if rows:
            yield out(kind)

    return mapped(kept, run, schema).withColumnRenamed("key", key)
