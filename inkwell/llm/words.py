"""Words of texts: longest runs of letters or digits after lower-casing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run of Unicode L and N in Python, where \w is these and the underscore.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def listed_words(idf: DataFrame) -> DataFrame:
    """word: each distinct word of idf, trimmed and lower-cased; null and blank ones are ignored."""
    word = F.regexp_replace(F.lower("word"), r"(?U)^\s+|\s+$", "")
    return idf.select(word.alias("word")).where("word <> ''").distinct()
