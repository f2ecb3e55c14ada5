"""Arithmetic on probability vectors as SQL array expressions (JVM only, any vector length).

Written as SQL text: one expression string costs one call into the JVM, a tree built operator by
operator costs one per node.
"""

from __future__ import annotations

from collections.abc import Sequence

from reviewscope.config import EMOTIONS


def array_sum(vector: str) -> str:
    return f"aggregate({vector}, 0D, (acc, v) -> acc + v)"


def shifted_exp(logits: str) -> str:
    """exp(z - max z); the first half of a softmax, so that its sum is taken once."""
    return f"transform({logits}, z -> exp(z - array_max({logits})))"


def normalised(powers: str) -> str:
    return f"transform({powers}, x -> x / {array_sum(powers)})"


def best_label(probs: str, labels: Sequence[str] = EMOTIONS) -> str:
    """Label of the largest entry, the first on ties; null for a null vector."""
    names = ", ".join(f"'{x}'" for x in labels)
    return f"get(array({names}), cast(array_position({probs}, array_max({probs})) - 1 as int))"


def usable(vector: str) -> str:
    """A distribution counts unless it is missing, empty or nothing but NaN."""
    return f"coalesce(exists({vector}, x -> not isnan(x)), false)"


def clip(x: str) -> str:
    return f"least(greatest({x}, 1e-10D), 1D)"


def mean(vector: str) -> str:
    return f"({array_sum(vector)} / size({vector}))"


def squared_distance(vector: str) -> str:
    """Sum of squared distances from the mean."""
    return f"aggregate({vector}, 0D, (acc, v) -> acc + power(v - {mean(vector)}, 2))"


def let(name: str, value: str, body: str) -> str:
    """Evaluate `value` once and use it by name in `body`.

    Intermediate columns would not do: a filter on the last of a chain of columns is pushed below
    all of them, and every use of every column is then written out again.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"
