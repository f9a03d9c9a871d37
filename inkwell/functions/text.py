"""Text rules as Column expressions: all of them stay in the JVM."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of a well-known public list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has "
    "had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn "
    "couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't "
    "shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
SUPERSCRIPTS, SUBSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉", "0123456789"
#: Signs that vanish, and the other signs of ASCII, which become a space.
DROPPED, SPACED = ",'", "!\"#$%&()*+-./:;<=>?@[\\]^_`{|}~"
# Fixed values of Unicode.
#: Runs of enclosed numbers: first code point, first number, how many.
ENCLOSED = (
    (0x2460, 1, 20), (0x3251, 21, 15), (0x32B1, 36, 15), (0x24EA, 0, 1), (0x24F5, 1, 10), (0x2780, 1, 10),
    (0x2776, 1, 10), (0x24EB, 11, 10), (0x24FF, 0, 1), (0x278A, 1, 10), (0x2474, 1, 20),
)


def enclosed_numbers() -> dict[str, str]:
    """Each circled or bracketed number and what it is written as."""
    return {chr(code + i): f"({number + i})" for code, number, count in ENCLOSED for i in range(count)}


def simple_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, in order; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def plain_numbers(text: Column | str) -> Column:
    """Enclosed numbers as (n). Only texts that hold one are taken apart."""
    text = F.col(text) if isinstance(text, str) else text
    table = enclosed_numbers()
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(known, c), c)), "")
    return F.when(text.rlike("[" + "".join(table) + "]"), spelled).otherwise(text)


def _raised(text: Column | str, glyphs: str) -> Column:
    return F.translate(F.regexp_replace(text, f"([{glyphs}]+)", "^$1 "), glyphs, DIGITS)


def superscripts(text: Column | str) -> Column:
    """Each run of superscript digits as ^digits and a space."""
    return _raised(text, SUPERSCRIPTS)


def subscripts(text: Column | str) -> Column:
    """Each run of subscript digits as ^digits and a space."""
    return _raised(text, SUBSCRIPTS)


def without_punctuation(text: Column | str) -> Column:
    """Commas and apostrophes vanish, the other signs of ASCII become spaces."""
    return F.translate(F.translate(text, DROPPED, ""), SPACED, " " * len(SPACED))


def content_words(text: Column | str) -> Column:
    """The white-space separated words that are longer than one character and no stop words."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def keywords(text: Column | str) -> Column:
    """The light bag of words: lower case, plain numbers, no signs, no stop words, raised digits as ^digits; each word once."""
    words = F.array_join(content_words(without_punctuation(plain_numbers(F.lower(text)))), " ")
    return F.array_distinct(F.filter(F.split(superscripts(subscripts(words)), r"\s+"), lambda w: w != ""))


def keyphrases(text: Column | str) -> Column:
    """The phrases between stop words, each once."""
    plain = superscripts(subscripts(without_punctuation(plain_numbers(F.lower(text)))))
    pattern = r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(re.escape, STOP_WORDS)) + r")(?![\p{L}\p{N}_])"
    parts = F.transform(F.split(plain, pattern), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def char_bucket(word: Column | str) -> Column:
    """The first character of a word if it is a-z or 0-9, else 'other'."""
    first = F.substring(word, 1, 1)
    return F.when(first.rlike("^[0-9a-z]$"), first).otherwise("other")


def clean_sha1(sha1: Column | str) -> Column:
    return F.regexp_replace(sha1, r"(?U)\s", "")


def text_slice(text: Column | str, start: Column | int, length: Column | int) -> Column:
    """length characters from offset start, counted from 0."""
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.substring(text, start + 1, length)


def size_label(size: Column | str) -> Column:
    """A number of bytes in the largest unit of which it has more than one."""
    size = F.col(size) if isinstance(size, str) else size
    result = F.concat(size.cast("string"), F.lit(" Bytes"))
    for unit, name in ((2**10, "KB"), (2**20, "MB"), (2**30, "GB")):
        result = F.when(size > unit, F.concat(F.format_string("%.2f", size / unit), F.lit(f" {name}"))).otherwise(result)
    return result
