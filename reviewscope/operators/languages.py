"""Language detection by naive Bayes over character trigrams, trained by a group-by and scored inside the row.

A text is lowered, runs of other characters than letters become one blank, and each three neighbouring characters give a cell (a fixed mix of their code
points modulo `CELLS`). Training counts cells per language with map-side combining: no more than languages x CELLS counts
leave a task. A cell's weight in a language is its smoothed log probability as a whole number, so sums are exact and equal in every
engine. The model is CELLS numbers per language, which reach the driver and travel inside the query plan.

A detected language is the one with the largest sum, the first by name on ties; a text without any trigram (null, blank, no letter) has none.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewscope.functions import arrays as av

CELLS = 8192
#: Weights are thousandths of natural logs.
UNIT = 1000


def trigram_cells(text: str) -> str:
    """SQL of the cells of a column's text, in order; empty for a text without letters."""
    plain = f"concat(' ', trim(regexp_replace(lower({text}), '[^\\\\p{{L}}]+', ' ')), ' ')"
    points = av.let("s", f"split({plain}, '')", "transform(s, c -> ascii(c))")
    cells = f"transform(slice(p, 1, greatest(size(p) - 2, 0)), (a, i) -> (a * 961L + get(p, i + 1) * 31 + get(p, i + 2)) % {CELLS})"
    return f"coalesce({av.let('p', points, cells)}, array())"


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


class LanguageModel(NamedTuple):
    """Weights of every cell, per language in the order of names."""

    weights: dict[str, list[int]]

    def detect(self, text: str) -> Column:
        """language and margin: what the best language has over the next one, per trigram (null with one language)."""
        if not self.weights:
            return F.expr("cast(null as struct<language: string, margin: double>)")
        sums = [
            f"named_struct('sum', aggregate(g, 0L, (sum, cell) -> sum + get(from_json('{json.dumps(w, separators=(',', ':'))}', 'array<int>'), cast(cell as int))), "
            f"'order', {-i}, 'language', {_quoted(name)})"
            for i, (name, w) in enumerate(self.weights.items())
        ]
        best = av.let(
            "r",
            f"reverse(sort_array(array({', '.join(sums)})))",
            f"named_struct('language', r[0].language, 'margin', (r[0].sum - get(r, 1).sum) / {UNIT}D / size(g))",
        )
        return F.expr(av.let("g", trigram_cells(f"`{text}`"), f"if(size(g) = 0, null, {best})"))


def train_languages(labelled: DataFrame, text: str = "review", lang: str = "lang") -> LanguageModel:
    """Learn from all rows that have a text and a language."""
    cells = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.expr(trigram_cells(f"`{text}`"))).alias("cell"))
    counts = cells.groupBy("lang", "cell").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    weight = F.round(F.ln((F.col("n") + 1) / (F.col("total") + CELLS)) * UNIT).cast("int")
    rest = F.round(F.ln(1 / (F.col("total") + CELLS)) * UNIT).cast("int")
    learned = counts.join(totals, "lang").groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", weight.alias("weight")))).alias("seen"), F.any_value(rest).alias("rest")
    )
    rows = sorted(learned.collect(), key=lambda r: r["lang"])
    return LanguageModel({r["lang"]: [r["seen"].get(i, r["rest"]) for i in range(CELLS)] for r in rows})
