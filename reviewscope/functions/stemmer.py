"""The Porter (1980) suffix-stripping algorithm for one lowercased English word."""

from __future__ import annotations

import re

# Suffix rules of the published algorithm, longest first within a step.
STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"),
    ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"),
    ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("ator", "ate"), ("eli", "e"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
STEP4 = (
    "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()
)


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel) letters; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(base):
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _double_end(base) and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if _measure(base) == 1 and _short_end(base) else base
    return word


def _replace(word: str, rules) -> str:
    for suffix, other in rules:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + other if _measure(base) > 0 else word
    return word


def _strip(word: str) -> str:
    for suffix in STEP4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base if _measure(base) > 1 else word
    if word.endswith("ion") and word[:-3].endswith(("s", "t")) and _measure(word[:-3]) > 1:
        return word[:-3]
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    return _final(_strip(_replace(_replace(word, STEP2), STEP3)))
