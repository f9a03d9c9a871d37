"""The full bag of words: Column expressions as far as they go, one vectorised function for the rest."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

import inkwell.functions.arrow  # noqa: F401  lets the functions below travel with the plan
from inkwell.functions.numbers import spell_numbers
from inkwell.functions.stemming import singular, stem
from inkwell.functions.text import DROPPED, STOP_WORDS, content_words, plain_numbers, subscripts, superscripts, without_punctuation

_SIGNS = str.maketrans({c: None if c in DROPPED else " " for c in string.punctuation})


class Remembered(dict):
    """The results of a rule for the words of one batch."""

    def __init__(self, rule) -> None:
        super().__init__()
        self.rule = rule

    def __missing__(self, word: str) -> str:
        self[word] = self.rule(word)
        return self[word]


def _each(text: str, rules: Remembered) -> str:
    return " ".join(rules[w] for w in text.split())


def finish(text: str, lemmas: Remembered, stems: Remembered) -> list[str]:
    """Numbers to words, lemmas, stems, and again what these may have brought back; without stop words at the end."""
    stop = set(STOP_WORDS)
    text = _each(_each(spell_numbers(text), lemmas), stems).translate(_SIGNS)
    text = _each(spell_numbers(text), stems).translate(_SIGNS)
    return [w for w in text.split() if len(w) > 1 and w not in stop]


@F.pandas_udf(ArrayType(StringType()))
def _finish(texts: pd.Series) -> pd.Series:
    lemmas, stems = Remembered(singular), Remembered(stem)
    return texts.map(lambda t: None if t is None else finish(t, lemmas, stems))


@F.pandas_udf(StringType())
def spelled(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else spell_numbers(t))


@F.pandas_udf(StringType())
def stemmed(texts: pd.Series) -> pd.Series:
    stems = Remembered(stem)
    return texts.map(lambda t: None if t is None else _each(t, stems))


@F.pandas_udf(StringType())
def lemmatised(texts: pd.Series) -> pd.Series:
    lemmas = Remembered(singular)
    return texts.map(lambda t: None if t is None else _each(t, lemmas))


def full_words(text: Column | str) -> Column:
    """All words of the full pipeline, repeated as they occur; null for null."""
    words = F.array_join(content_words(without_punctuation(plain_numbers(F.lower(text)))), " ")
    return _finish(subscripts(superscripts(words)))

