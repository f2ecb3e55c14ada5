"""Source divergence audit by late string materialisation: which words set a source apart, and how far apart sources are.

Terms are runs of letters, A-Z in lower case, and each language keeps those that occur in at least `LEAST` of its documents. For a group
(language, source) and a term counted c times there, p = 1 + floor(10**9 * (c + 2) / (N + 2 V)), N the group's count of all kept terms
and V their number; q is the same of what the group is compared with, and the divergence is floor((p - q)**2 / (p + q)).

1. Tasks fold their documents to (language, source, digest, occurrences, documents), the digest being 64 bits of the term, and write that
   down; the term's string stands beside its first row only. Nothing of it is shuffled but the columns of fixed width: occurrences and
   documents are added up by digest.
2. Which digests are kept is known now. A Bloom filter of them (at most 2**`BLOOM_BITS` bits) lets the written strings of other terms stay where
   they are; of the rest the smallest and the largest string of each digest are found. If they differ, several terms share the digest:
   these are split, that is, counted again from the documents by their strings. Terms are never told apart by digests alone.
3. Everything after that is done by digest; the ten words of a group get their text at the end, when few rows are left.

A pair of sources needs the sum over all kept terms, those that neither has included. The sum is that of two sources without any term (one
product), plus what each source's terms change (by how many terms have a count, not by term), plus a correction for
terms that both have. All numbers are integers; products that may pass 64 bits are decimals.

Edge cases: null text, language and source are empty strings, which is a language or source of its own. A language without kept terms has no
term rows and pairs of value 0; a language with one source has no pairs. Ties are ordered by the item's bytes. Repeated rows count as
often as they are there. Texts of any length are cut in slices. An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reviewscope.llm.words import _LOWER_BYTES, BASE, cut_words, mapped, mix64, raw_bytes, slices, text_batches
from reviewscope.session import stored

LEAST = 10
TOP = 10
SCALE = 1_000_000_000
HELD = 600_000
BLOOM_BITS = 27
HASHES = 4
#: Bytes of letters: a-z, A-Z and all of other scripts' characters.
LETTER = np.ones(256, dtype=bool)
LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
GROUP = ["lang", "source"]
TERM = ["lang", "digest", "split"]
OUT = ["lang", "source", "part", "item", "value", "rank"]


# ------------------------------------------------------------------------------------- counting
def folded(part: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n, docs of a slice of documents (lang, source, text)."""
    raw, bounds = raw_bytes(part.column(2))
    words, counts = cut_words(_LOWER_BYTES[raw], bounds, LETTER[raw])
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    names = [part.column(i).dictionary_encode() for i in (0, 1)]
    group = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
    owner = np.repeat(np.arange(len(part)), counts)
    in_document, times = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
    key, at = np.unique(group[in_document // size] * size + in_document % size, return_inverse=True)
    lang, source = np.divmod(key // size, max(1, len(names[1].dictionary)))
    return pa.table(
        {
            "lang": names[0].dictionary.take(pa.array(lang)),
            "source": names[1].dictionary.take(pa.array(source)),
            "term": coded.dictionary.view(pa.large_string()).cast(pa.string()).take(pa.array(key % size)),
            "n": np.bincount(at, weights=times, minlength=len(key)).astype(np.int64),
            "docs": np.bincount(at, minlength=len(key)).astype(np.int64),
        }
    )


def term_parts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs, first; a task gives a term of a group once, or a few times if it meets very many.

    `first` marks one row for each term of a language that is given at a time.
    """

    def run(batches):
        held, rows = [], 0

        def out():
            table = sums()
            names = [table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term")]
            key = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
            first = np.zeros(len(table), dtype=bool)
            first[np.unique(key, return_index=True)[1]] = True
            # Those come first, so that a reader of strings can skip pages without any.
            order = np.argsort(~first, kind="stable")
            yield from table.append_column("first", pa.array(first)).take(pa.array(order)).combine_chunks().to_batches(max_chunksize=50_000)

        def sums() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(NAMES)

        for batch in batches:
            for part in slices(batch, 2):
                held.append(folded(part))
                rows += len(held[-1])
                if rows > HELD:
                    held = [sums()]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield from out()
                        held, rows = [], 0
        if held:
            yield from out()

    return mapped(docs, run, "lang string, source string, term string, n long, docs long, first boolean")


#: As Arrow's sums leave them.
NAMES = ["lang", "source", "term", "n", "docs"]


# ------------------------------------------------------------------------------- which are kept
def places(digests: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each digest in a Bloom filter of 2**bits bits, a row for each hash."""
    digests = digests.view(np.uint64)
    return np.stack([(mix64(digests + np.uint64((i + 1) * BASE % 2**64)) >> np.uint64(64 - bits)).astype(np.int64) for i in range(HASHES)])


def bloom(kept: DataFrame, bits: int) -> np.ndarray:
    """The digests of `kept` as a Bloom filter in 64-bit words; 2**bits bits at most reach the driver."""

    def run(batches):
        for batch in batches:
            at = np.unique(places(batch.column(0).to_numpy(), bits))
            words, first = np.unique(at >> 6, return_index=True)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bitwise_or.reduceat(np.int64(1) << (at & 63), first))], names=["word", "bits"])

    rows = mapped(kept.select("digest"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits >> 6, dtype=np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def passing(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, digest, term of the parts with a term whose digest is kept, and of a few others."""
    bits = min(BLOOM_BITS, max(10, (16 * kept.count()).bit_length()))
    held = parts.sparkSession.sparkContext.broadcast(bloom(kept, bits))

    def run(batches):
        words = held.value
        for batch in batches:
            if len(batch):
                at = places(batch.column(1).to_numpy(), bits)
                yield batch.filter(pa.array(((words[at >> 6] >> (at & 63)) & 1).all(axis=0)))

    return mapped(parts.filter("term is not null").select("lang", "digest", "term"), run, "lang string, digest long, term string")


def kept_counts(parts: DataFrame, again: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, digest, split, n) of the kept terms that a group has, and (lang, digest, term) of those that have a digest of their own.

    `parts` has strings for some rows; `again`, which is read only if terms share a digest, for all.

    `split` is empty where the digest is one term's, and the term where several share it.
    """
    counts = stored(parts.groupBy(*GROUP, "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    enough = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "digest")
    enough = stored(enough, "term-digests")
    ends = passing(parts, enough).groupBy("lang", "digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    ends = stored(ends.join(enough, ["lang", "digest"]), "term-ends")
    names = ends.filter("low = high").select("lang", "digest", F.col("low").alias("term"))
    found = counts.join(names.select("lang", "digest"), ["lang", "digest"]).select(*GROUP, "digest", F.lit("").alias("split"), "n")
    shared = ends.filter("low <> high").select("lang", "digest")
    if not shared.isEmpty():
        exact = again.join(shared, ["lang", "digest"]).groupBy(*GROUP, "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        often = exact.groupBy("lang", "term").agg(F.sum("docs").alias("all")).filter(F.col("all") >= least).select("lang", "term")
        found = found.unionByName(exact.join(often, ["lang", "term"]).select(*GROUP, "digest", F.col("term").alias("split"), "n"))
    return stored(found, "kept-terms"), names


# ------------------------------------------------------------------------------------ divergence
def probability(count: Column, total: Column, terms: Column) -> Column:
    """p; null where there is no term."""
    wide = "decimal(20,0)"
    over = ((count.cast(wide) + 2) * F.lit(SCALE)).alias("over")
    below = total.cast(wide) + terms.cast(wide) * 2
    return F.when(terms > 0, 1 + F.call_function("div", over, F.greatest(below, F.lit(1).cast(wide))))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(found: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (sources, a < b), value. `found` has p of every kept term that a group has, `groups` the p0 of those that it lacks."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").filter(F.col("source") < F.col("other"))
    neither = pairs.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("terms") * apart(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # Terms of a group that the other one lacks, or that it may have: by count.
    spread = found.groupBy(*GROUP, "p", "p0").agg(F.count(F.lit(1)).alias("times")).join(other, "lang").filter(F.col("source") != F.col("other"))
    change = F.col("times") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))
    own = spread.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), change.alias("value"))
    second = found.select(*TERM, F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = found.join(second, TERM).filter(F.col("source") < F.col("other"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    change = apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)
    shared = both.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), change.alias("value"))
    rows = neither.unionByName(own).unionByName(shared)
    return rows.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST,
    top: int = TOP,
    digest: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. `digest` is a parameter so that tests can make terms collide."""
    text_batches(docs)
    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    whole = term_parts(named).withColumn("digest", digest(F.col("term")))
    parts = stored(whole.select(*GROUP, "digest", "n", "docs", F.when(F.col("first"), F.col("term")).alias("term")), "term-parts")
    kept, names = kept_counts(parts, whole, least)

    totals = stored(kept.groupBy(*TERM).agg(F.sum("n").alias("all")), "term-totals")
    languages = totals.groupBy("lang").agg(F.sum("all").alias("everything"), F.count(F.lit(1)).alias("terms"))
    groups = named.select(*GROUP).distinct().join(kept.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left").join(languages, "lang", "left")
    groups = groups.select(*GROUP, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "everything")))
    groups = stored(groups.withColumn("p0", probability(F.lit(0), F.col("total"), F.col("terms"))), "term-groups")
    found = kept.join(groups, GROUP).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))

    sums = pair_sums(found, groups)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = ranked(sums.select("lang", sides.alias("side"), "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value"))

    over = found.join(totals, TERM).withColumn("q", probability(F.col("all"), F.col("everything"), F.col("terms"))).filter(F.col("p") > F.col("q"))
    over = over.select(*GROUP, "digest", "split", apart(F.col("p"), F.col("q")).alias("value"))
    # All that tie with the last one are kept until the texts are there.
    first = over.withColumn("place", F.rank().over(W.partitionBy(*GROUP).orderBy(F.col("value").desc()))).filter(F.col("place") <= top)
    texts = first.join(names, ["lang", "digest"], "left").withColumn("item", F.when(F.col("split") != "", F.col("split")).otherwise(F.col("term")))
    terms = ranked(texts.select(*GROUP, F.lit("term").alias("part"), "item", "value")).filter(F.col("rank") <= top)
    return pairs.select(*OUT).unionByName(terms.select(*OUT))
