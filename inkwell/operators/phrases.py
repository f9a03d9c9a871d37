"""Key phrases scored by the degrees and frequencies of their words (rapid automatic keyword extraction)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.arrow import flat_map
from inkwell.functions.text import STOP_WORDS


def one_of(words: Iterable[str]) -> str:
    """A pattern of the words in which each beginning that they share is tried once."""
    rest: dict[str, set[str]] = {}
    for word in words:
        if word:
            rest.setdefault(word[0], set()).add(word[1:])
    branches = [re.escape(first) + one_of(ends) for first, ends in sorted(rest.items())]
    if "" in words and branches:
        return f"(?:{'|'.join(branches)})?"
    return f"(?:{'|'.join(branches)})" if len(branches) > 1 else "".join(branches)


def phrase_scores(docs: DataFrame) -> DataFrame:
    """doc_id, phrase, score of docs(doc_id, text): the sum over the phrase's words of degree / frequency in the document.

    Phrases are runs of words between stop words and signs, in lower case. A word's frequency is how often it occurs in
    phrases, its degree the sum of the lengths of the phrases it occurs in. Words are cut and counted document by
    document, so only texts are shuffled, once, to bring those of one doc_id together. Rows with null doc_id are left out.
    """
    marked = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s'-]+", " | ")
    stop = r"(?<![\p{L}\p{N}'])" + one_of(STOP_WORDS) + r"(?![\p{L}\p{N}'])"
    runs = F.regexp_replace(F.regexp_replace(marked, stop, "|"), r"\s+", " ")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", runs.alias("runs"))
    together = texts.groupBy("doc_id").agg(F.collect_list("runs").alias("texts"))

    def start():
        def work(doc_id: int, texts: list[str]) -> Iterable[tuple]:
            found = Counter((place, phrase) for text in texts for place, part in enumerate(text.split("|")) if (phrase := part.strip(" ")))
            cut = {phrase: phrase.split(" ") for _, phrase in found}
            degree: Counter[str] = Counter()
            frequency: Counter[str] = Counter()
            for (_, phrase), times in found.items():
                for word in cut[phrase]:
                    degree[word] += times * len(cut[phrase])
                    frequency[word] += times
            best: dict[str, float] = {}
            for (_, phrase), times in found.items():
                score = times * sum(degree[word] / frequency[word] for word in cut[phrase])
                best[phrase] = max(score, best.get(phrase, 0.0))
            return [(doc_id, phrase, score) for phrase, score in best.items()]

        return work

    return flat_map(together, ["doc_id", "texts"], start, f"doc_id {dict(docs.dtypes)['doc_id']}, phrase string, score double")
