"""Aspects of large dictionaries: one Aho-Corasick automaton over all keywords, run once over each text in Arrow batches.

An alternation per aspect tries every keyword at every place; the automaton reads each character once, however many keywords there
are. Matches have to stand free of word characters on both sides, as in the pattern form, and give the same aspects. A
dictionary per game is one automaton too: a keyword knows the games and aspects that it counts for.

The dictionary is sent to the tasks; `MOST_KEYWORDS` bounds it, and a larger one has to be given per game as a table, which is joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_KEYWORDS = 1_000_000
ANY_GAME = None


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def free_matches(automaton, text: str) -> Iterator:
    """Payloads of all keywords that stand free in a lowered text."""
    last = len(text) - 1
    for end, (size, payload) in automaton.iter(text):
        start = end - size
        if (start < 0 or not is_word(text[start])) and (end == last or not is_word(text[end + 1])):
            yield payload


def built(entries: Iterable[tuple[str | None, str, str]]):
    """Automaton of (game, aspect, keyword): each keyword's payload is {game: aspects}."""
    import ahocorasick

    payloads: dict[str, dict] = {}
    for game, aspect, word in entries:
        if word:
            payloads.setdefault(word, {}).setdefault(game, set()).add(aspect)
    automaton = ahocorasick.Automaton()
    for word, payload in payloads.items():
        automaton.add_word(word, (len(word), payload))
    automaton.make_automaton()
    return automaton, bool(payloads)


def tag_by_automaton(df: DataFrame, entries: list[tuple[str | None, str, str]], text: str = "review", game: str = "game_id", out: str = "aspects") -> DataFrame:
    """Add the sorted aspects of all keywords found. `entries`: (game or ANY_GAME, aspect, lower-case keyword)."""
    if len(entries) > MOST_KEYWORDS:
        raise ValueError(f"{len(entries)} keywords; give more than {MOST_KEYWORDS} as a table per game")
    held = df.sparkSession.sparkContext.broadcast(entries)
    by_game = any(g is not ANY_GAME for g, _, _ in entries)
    key = F.col(game).cast("string") if by_game else F.lit(None).cast("string")
    kept = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != out)).alias("row"), key.alias("game"), F.lower(F.col(text)).alias("low"))
    schema = T.StructType([kept.schema["row"], T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches):
        automaton, some = built(held.value)
        for batch in batches:
            tagged = []
            for at, low in zip(batch.column(1), batch.column(2)):  # one text at a time as a Python string
                at, low = at.as_py(), low.as_py()
                found: set[str] = set()
                if low and some:
                    for payload in free_matches(automaton, low):
                        found |= payload.get(ANY_GAME, ()) if at is None else payload.get(ANY_GAME, set()) | payload.get(at, set())
                tagged.append(sorted(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tagged, pa.list_(pa.string()))], names=["row", out])

    return kept.mapInArrow(run, schema).select("row.*", out)
