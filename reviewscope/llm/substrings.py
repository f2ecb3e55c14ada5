"""Substring dedup: passages of `WINDOW` words that a document with a smaller id has too are removed, after a count-min prefilter.

A window is `WINDOW` consecutive words of one document. Every word that is covered by a window whose words also start somewhere in a
document with a smaller id is removed.

1. Sketch. Each window has an anchor, the smallest hash of the `SHINGLE`-word runs inside it; windows of equal words have equal anchors,
   and neighbouring windows mostly share theirs. Tasks count the documents of each anchor in a count-min sketch of `DEPTH` rows (a
   cell knows none, one, or more). The sketches of the tasks are sent as sparse blocks and added up block by
   block; what remains is one bit per cell: touched by two documents or more. The estimate of a window is the least cell of its
   anchor. It is never below the number of documents that have the window, so no repeated window is lost. A row has about two cells
   for each anchor that a table of that many bytes has, and at most 2**`MOST_BITS`; a fuller sketch only lets more windows pass.
2. Exact groups. A second pass takes the windows estimated as repeated, by 128 bits of their words' hashes. A slice of documents settles
   what it can by itself: of equal windows in it only those of its smallest id go on, so a passage that fills a third of the
   table leaves a few rows per task. They are dealt out by anchor, a run of windows in one row, and compared by their hashes.
3. The windows to be removed come back to their documents as bit masks of runs, and the words they cover are left out.

Two different windows share 128 bits with a probability of n**2 / 2**129 for n windows; nothing else is estimated. The verdict is that on
the input: removing a passage does not save another.

Edge cases: null and empty texts have no words. A document of less than `WINDOW` words has no window and stays. A window that
a document repeats, or that occurs twice under one id, is not removed for that. Rows without an id neither lose words nor make others lose
any. Rows that repeat an id and a text get the same result each; rows with one id and different texts are told
apart by the text's hash. Texts of any length are taken whole; a slice holds at least one text. An empty table gives an empty
result; other columns are ignored, whatever their names. Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.llm.words import _SPACE, BASE, mapped, mix64, raw_bytes, slices, text_batches, word_lanes, word_places

WINDOW = 50
SHINGLE = 16
DEPTH = 3
MOST_BITS = 27
BLOCK_BITS = 16
HELD = 2_000_000
RUN = 63
SLICE_BYTES = 2 << 20


# -------------------------------------------------------------------------------------- windows
def rolled(one: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive numbers, by doubling."""
    out, done, power, size = None, 0, one, 1
    while True:
        if width & size:
            out = power if out is None else joined(out, power[done:])
            done += size
        if done == width:
            return out
        power, size = joined(power, power[size:]), 2 * size


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left[: len(right)] * np.uint64(BASE) + right)


def smallest(one: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive numbers."""
    size = 1
    while 2 * size <= width:
        one, size = np.minimum(one[: len(one) - size], one[size:]), 2 * size
    return np.minimum(one[: len(one) - (width - size)], one[width - size :])


class Windows:
    """All windows of a slice of texts: their document, place in it, anchor and, if asked for, two 64-bit hashes."""

    def __init__(self, texts: pa.Array, width: int, prints: bool):
        raw, bounds = raw_bytes(texts)
        starts, ends, self.counts = word_places(bounds, ~_SPACE[raw])
        lanes = word_lanes(raw, starts, ends)
        whole = np.flatnonzero(np.repeat(np.cumsum(self.counts), self.counts) - np.arange(len(starts)) >= width)
        first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(len(texts)), self.counts)[whole]
        self.place = whole - first[self.doc]
        self.anchor = np.zeros(0, dtype=np.uint64)
        self.prints = (self.anchor, self.anchor)
        if len(whole):
            shingle = min(SHINGLE, width)
            self.anchor = smallest(rolled(lanes[0], shingle), width - shingle + 1)[whole]
            if prints:
                self.prints = tuple(rolled(lane, width)[whole] for lane in lanes)

    def runs(self) -> np.ndarray:
        """Where a run of windows with one anchor in one document begins."""
        new = np.ones(len(self.doc), dtype=bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        return np.flatnonzero(new)


# --------------------------------------------------------------------------------------- sketch
def cells(anchors: np.ndarray, bits: int) -> np.ndarray:
    """The cells of each anchor, one in each row of the sketch."""
    return np.stack([(mix64(anchors + np.uint64((r + 1) * BASE % 2**64)) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(DEPTH)])


def sparse_blocks(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """block, once, more: cells that one document of a task touches, and cells that several do, as places in their block."""

    def run(batches):
        held, sizes, total = [], [], 0

        def fold():
            at, index = np.unique(np.concatenate(held), return_inverse=True)
            return at, np.minimum(np.bincount(index, weights=np.concatenate(sizes), minlength=len(at)), 2).astype(np.int64)

        def out(at, size):
            some = np.unique(at >> BLOCK_BITS)
            columns = [pa.array(some)]
            for times in (1, 2):
                own = at[size == times]
                ends = np.searchsorted(own >> BLOCK_BITS, np.append(some, some[-1:] + 1)).astype(np.int64) * 2
                places = (own & ((1 << BLOCK_BITS) - 1)).astype("<u2")
                columns.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(places)]).cast(pa.binary()))
            for at in range(0, len(some), 1000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1000) for c in columns], names=["block", "once", "more"])

        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                found = Windows(part.column(0), width, prints=False)
                first = found.runs()
                doc, anchor = found.doc[first], found.anchor[first]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                at, size = np.unique(cells(anchor[new], bits), return_counts=True)
                held.append(at)
                sizes.append(size)
                total += len(at)
                if total > HELD:
                    at, size = fold()
                    held, sizes, total = [at], [size], len(at)
                    if total > HELD // 2:
                        yield from out(at, size)
                        held, sizes, total = [], [], 0
        if total:
            yield from out(*fold())

    return mapped(docs.select("text"), run, "block long, once binary, more binary")


def merged(blocks: DataFrame) -> DataFrame:
    """block, bits: the sum of the sketches, as one bit per cell that two documents or more touch."""
    cells_in = 1 << BLOCK_BITS

    def run(batches):
        # A task holds its share of the sketch, whatever the number of tasks that sent a part of it.
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                sums = held.setdefault(block, np.zeros(cells_in, dtype=np.uint8))
                at = np.frombuffer(once, dtype="<u2")
                sums[at] = np.minimum(sums[at] + 1, 2)
                sums[np.frombuffer(more, dtype="<u2")] = 2
        rows = [(block, np.packbits(sums > 1, bitorder="little").tobytes()) for block, sums in held.items() if (sums > 1).any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bits"])

    return mapped(blocks.repartition("block"), run, "block long, bits binary")


def sketch(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """The merged sketch as bytes of bits: DEPTH * 2**bits / 8 of them at most, whatever the table."""
    out = np.zeros((DEPTH << bits) + 7 >> 3, dtype=np.uint8)
    size = 1 << BLOCK_BITS >> 3
    for r in merged(sparse_blocks(docs, width, bits)).collect():
        own = np.frombuffer(r["bits"], dtype=np.uint8)
        out[r["block"] * size : r["block"] * size + size] = own[: max(0, len(out) - r["block"] * size)]
    return out


def sketch_bits(docs: DataFrame, width: int) -> int:
    """Bits of a row: about two cells for each anchor that a text of so many bytes is likely to have."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = 2 * total / 6 / max(2, width - SHINGLE + 2)
    return min(MOST_BITS, max(10, int(2 * anchors).bit_length()))


# ------------------------------------------------------------------------------- repeated windows
def masks(doc: np.ndarray, place: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of up to RUN neighbouring windows of one document and anchor: where each begins, and which chunk a window is in."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    within = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    first = np.flatnonzero(within % RUN == 0)
    return first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))


SCHEMA = "anchor long, key long, hash long, start int, gone long, open array<struct<i:int,a:long,b:long>>"


def candidates(docs: DataFrame, held, width: int, bits: int) -> DataFrame:
    """Runs of windows that are estimated as repeated: those settled in their slice as a mask, the others with their hashes."""

    def run(batches):
        table = held.value
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                found = Windows(part.column(2), width, prints=True)
                first = found.runs()
                at = cells(found.anchor[first], bits)
                often = ((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
                known = pc.is_valid(part.column(0)).to_numpy(zero_copy_only=False)
                often = np.flatnonzero(np.repeat(often, np.diff(np.append(first, len(found.doc)))) & known[found.doc])
                if not len(often):
                    continue
                doc, place, anchor = found.doc[often], found.place[often], found.anchor[often]
                a, b = (p[often] for p in found.prints)
                keys = pc.fill_null(part.column(0), 0).to_numpy()[doc]
                order = np.lexsort((b, a))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
                group = np.flatnonzero(new)
                least = np.empty(len(order), dtype=np.int64)
                least[order] = np.repeat(np.minimum.reduceat(keys[order], group), np.diff(np.append(group, len(order))))
                later = keys > least
                chunk, of = masks(doc, place, anchor)
                i = np.arange(len(doc)) - chunk[of]
                gone = np.bitwise_or.reduceat(np.where(later, np.int64(1) << i, 0), chunk)
                left = np.flatnonzero(~later)
                ends = np.concatenate([[0], np.cumsum(np.bincount(of[left], minlength=len(chunk)))]).astype(np.int32)
                open_ = pa.StructArray.from_arrays(
                    [pa.array(i[left].astype(np.int32)), pa.array(a[left].view(np.int64)), pa.array(b[left].view(np.int64))], names=["i", "a", "b"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[chunk].view(np.int64)),
                        pa.array(keys[chunk]),
                        part.column(1).take(pa.array(doc[chunk])),
                        pa.array(place[chunk].astype(np.int32)),
                        pa.array(gone),
                        pa.ListArray.from_arrays(pa.array(ends), open_),
                    ],
                    names=["anchor", "key", "hash", "start", "gone", "open"],
                )

    return mapped(docs.select("key", "hash", "text"), run, SCHEMA)


def repeated(found: DataFrame) -> DataFrame:
    """key, hash, marks (start, gone): the windows of each document that one with a smaller key has too.

    Runs with open windows are dealt out by anchor, those that their slice has settled as they come; so each is moved once.
    """
    deal = F.when(F.size("open") > 0, F.col("anchor")).otherwise(F.xxhash64("key", "hash", "start"))
    rows = found.withColumn("deal", deal).select("deal", "key", "hash", "start", "gone", "open").repartition("deal")
    each = rows.select("deal", "key", "hash", "start", "gone", F.explode_outer("open").alias("w")).select("deal", "key", "hash", "start", "gone", "w.*")
    # Equal windows have equal anchors: the rows are where they have to be already.
    each = each.withColumn("least", F.min("key").over(W.partitionBy("deal", "a", "b")))
    bit = F.when(F.col("i").isNotNull() & (F.col("key") > F.col("least")), F.expr("shiftleft(1L, i)")).otherwise(F.lit(0).cast("long"))
    marks = each.groupBy("deal", "key", "hash", "start").agg(F.bit_or(F.col("gone").bitwiseOR(bit)).alias("gone")).filter("gone <> 0")
    return marks.groupBy("key", "hash").agg(F.collect_list(F.struct("start", "gone")).alias("marks"))


# ---------------------------------------------------------------------------------------- result
def stripped(texts: pa.Array, marks: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Words and removed words of each text, and what is kept of all of them, words joined by one space, with the bounds between."""
    raw, bounds = raw_bytes(pc.binary_join_element_wise(pc.fill_null(texts, ""), " ", ""))
    solid = ~_SPACE[raw]
    starts, ends, counts = word_places(bounds, solid)
    first = np.cumsum(counts) - counts
    change = np.zeros(len(starts) + 1, dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))
    if len(owner):
        flat = marks.flatten()
        at, gone = first[owner] + flat.field("start").to_numpy(), flat.field("gone").to_numpy()
        for i in range(RUN):
            on = at[(gone >> i) & 1 == 1] + i
            np.add.at(change, on, 1)
            np.add.at(change, on + width, -1)
    kept = np.cumsum(change[:-1]) == 0
    # The byte behind each word is white space; it becomes the one space behind a kept word.
    raw = raw.copy()
    raw[ends] = 32
    word = np.repeat(kept, ends - starts)
    stays = np.zeros(len(raw), dtype=bool)
    stays[solid] = word
    stays[ends[kept]] = True
    upto = np.concatenate([[0], np.cumsum(stays)])
    gone = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=~kept, minlength=len(texts)).astype(np.int64)
    return counts, gone, raw[stays].tobytes(), upto[bounds]


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, bits: int | None = None, with_text: bool = False) -> DataFrame:
    """For every row: key, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    `bits` is the log2 of a sketch row's cells; by default it follows from the size of the table.
    """
    text_batches(docs)
    whole = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    bits = bits or sketch_bits(whole, width)
    held = docs.sparkSession.sparkContext.broadcast(sketch(whole, width, bits))
    hashed = whole.withColumn("hash", F.xxhash64("text"))
    found = candidates(hashed.withColumn("key", F.col("key").cast("long")), held, width, bits)
    marks = repeated(found).select(F.col("key").alias("of_key"), F.col("hash").alias("of_hash"), "marks")
    rows = hashed.join(marks, (F.col("key").cast("long") == F.col("of_key")) & (F.col("hash") == F.col("of_hash")), "left").select("key", "text", "marks")
    fields = "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    schema = T.StructType([whole.schema["key"], *T._parse_datatype_string(fields)])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                n, gone, kept, upto = stripped(part.column(1), part.column(2), width)
                # All but the space behind the last word.
                parts = [kept[a : max(a, b - 1)] for a, b in zip(upto[:-1], upto[1:])]
                columns = [part.column(0), pa.array(n), pa.array(gone), pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
                if with_text:
                    columns.append(pa.array(parts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return mapped(rows, run, schema).withColumnRenamed("key", key)
