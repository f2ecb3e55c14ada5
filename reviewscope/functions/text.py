"""Column functions on text: whole-stage SQL expressions, Unicode-aware, no Python per row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewscope.config import LANGUAGE_PROFILES, STOP_WORDS

# A word character in the sense of a Unicode regular expression; written out because the
# meaning of \b and \w differs between engines and JDK releases.
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"

# The code points that windows-1252 places in 0x80-0x9F, in byte order
# (five bytes of that range are unassigned).
CP1252_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def quote(word: str) -> str:
    """A literal inside a Java and RE2 pattern."""
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in word)


def any_word(words: Iterable[str]) -> str:
    """Pattern that matches any of the words (or phrases) as whole words.

    The look behind comes after the word, so it runs on hits only instead of at every character.
    """
    hits = "|".join(f"{q}(?<!{WORD}{q})" for q in map(quote, words))
    return f"(?:{hits}){NOT_BEFORE_WORD}"


def is_blank(text: Column) -> Column:
    """True for null and for text without a visible character."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def repair_text(text: Column) -> Column:
    """Undo UTF-8 read as windows-1252, then drop apostrophes.

    Characters windows-1252 cannot hold become '?', byte runs that are not UTF-8 become U+FFFD.
    """
    high = "".join(CP1252_HIGH.values())
    low = "".join(chr(b) for b in CP1252_HIGH)
    known = F.regexp_replace(text, rf"[^\x00-\x7F\xA0-\xFF{high}]", "?")
    raw = F.encode(F.translate(known, high, low), "ISO-8859-1")
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("'"), F.lit(""))


def latin_words(text: Column) -> Column:
    """Lowercased words made of a-z only; words touching other word characters are skipped."""
    pattern = NOT_AFTER_WORD + "[a-z]++" + NOT_BEFORE_WORD
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def normalise_tokens(text: Column, min_words: int = 3) -> Column:
    """Words joined by one blank; null when fewer than `min_words` remain."""
    words = latin_words(text)
    return F.when(F.size(words) >= min_words, F.array_join(words, " "))


def guess_language(text: Column, profiles: dict[str, Sequence[str]] = LANGUAGE_PROFILES) -> Column:
    """Language with the most function words; null without any, first of the profiles on ties."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))

    def best(found: Column) -> Column:
        scores = [
            F.struct(
                F.size(F.filter(found, _in(listed))).alias("hits"),
                F.lit(-i).alias("order"),
                F.lit(lang).alias("lang"),
            )
            for i, (lang, listed) in enumerate(profiles.items())
        ]
        return F.array_max(F.array(*scores))

    winner = F.get(F.transform(F.array(words), best), F.lit(0))
    return F.when(winner["hits"] > 0, winner["lang"])


def _in(words: Sequence[str]):
    return lambda w: w.isin(*words)


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two or more word characters, lowercased, without stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD + "{2,}"), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def truncate(text: Column, n: int, ellipsis: bool = False) -> Column:
    """First n characters; with `ellipsis` three dots follow where something was cut."""
    head = F.substring(text, 1, n)
    if not ellipsis:
        return head
    return F.when(F.char_length(text) > n, F.concat(head, F.lit("..."))).otherwise(text)


def text_length(text: Column) -> Column:
    return F.char_length(text).cast("long")


def word_count(text: Column) -> Column:
    """Number of blank-separated tokens."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def unescape_html(text: Column) -> Column:
    """The five predefined entities, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
