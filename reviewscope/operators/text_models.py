"""Optional stemming of words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewscope.config import STOP_WORDS
from reviewscope.functions import text as ft
from reviewscope.functions.stemmer import stem


@F.pandas_udf(T.StringType())
def _stem_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stems of texts of words with blanks between; only one text at a time is a list of words."""
    seen: dict[str, str] = {}

    def stemmed(text: str | None) -> str | None:
        if not text:
            return text
        words = text.split(" ")
        for word in words:
            if word not in seen:
                seen[word] = stem(word)
        return " ".join([seen[w] for w in words])

    for texts in batches:
        yield texts.map(stemmed)
        if len(seen) > 500_000:
            seen.clear()


def stem_and_stop(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lowercased words without stop words, stemmed, joined by a blank."""
    kept = F.filter(ft.latin_words(text), lambda w: ~w.isin(*stop_words))
    return _stem_words(F.array_join(kept, " "))
