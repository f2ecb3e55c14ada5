"""Words and shingles of texts as hashes, computed for a whole Arrow batch at a time.

A word is read in blocks of eight bytes, for all words of a slice at once. Two lanes of 64 bits take the blocks up in different ways, and after
each block a lane is mixed by a bijection that is not linear, so that words with a regular structure are no worse than others; words of
more than `LONG` bytes are hashed by BLAKE2b. With both lanes n different words share a hash with a probability of n**2 / 2**129, with the
64 bits of `hashed_words` of n**2 / 2**65. A null text has no words; neither has one of white space.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
LONG = 4096
BATCH_LIMIT, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
#: The first bytes of a block of eight, by how many there are.
MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER_BYTES = _LOWER.astype(np.uint8)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def word_places(bounds: np.ndarray, solid: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts (runs of solid bytes), and the number of words per text.

    `cuts` says of each byte whether a new word begins there even inside a run.
    """
    n = len(solid)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(bounds) - 1, dtype=np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    if cuts is not None:
        edge[:-1] = cuts
    edge[bounds] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def cut_words(raw: np.ndarray, bounds: np.ndarray, solid: np.ndarray, cuts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one binary array, and the number of words per text."""
    starts, ends, counts = word_places(bounds, solid, cuts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])]), counts


def word_lanes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words that lie at the given places."""
    size = ends - starts
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    one = size.astype(np.uint64) * np.uint64(BASE)
    two = ~one
    at, of = starts, np.arange(len(starts))
    left = size
    long = left > LONG
    if long.any():
        for i in np.flatnonzero(long):
            one[i], two[i] = np.frombuffer(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), dtype="<u8")
        at, of, left = at[~long], of[~long], left[~long]
    while len(of):
        block = eight[at] & MASK[np.minimum(left, 8)]
        one[of] = mix64(one[of] ^ block)
        two[of] = mix64((two[of] + block) * np.uint64(MIX[0]))
        more = left > 8
        at, of, left = at[more] + 8, of[more], left[more] - 8
    return one, two


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text in a row, A-Z in lower case, and the number of words per text."""
    raw, bounds = raw_bytes(texts)
    raw = _LOWER_BYTES[raw]
    starts, ends, counts = word_places(bounds, ~_SPACE[raw])
    one, two = word_lanes(raw, starts, ends)
    return mix64(one + two), counts


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the bounds between them; a null is empty."""
    data = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    if data.buffers()[2] is None or bounds[0] == bounds[-1]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of one text; a shorter text is one n-gram, an empty one has none."""
    if not len(words):
        return words
    n = min(width, len(words))
    mixed = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        mixed = mixed * np.uint64(BASE) + words[i : len(words) - n + 1 + i]
    return np.unique(mix64(mixed))


def text_batches(docs: DataFrame) -> None:
    """From now on rows reach Python in batches of at most BATCH_BYTES, unless the session names a limit of its own.

    Spark's default of 64 MiB is held several times over, by the executor and the worker, in every task that reads long texts.
    """
    conf = docs.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) == BATCH_DEFAULT:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """`mapInArrow` whose workers give their memory back when a partition ends: idle ones are kept, with all that their allocators hold."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass

    return rows.mapInArrow(whole, schema)


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 19):
    """Parts of a batch with about `size` bytes of text each; one text may be longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
