"""How characteristic each word of a record is of it: tf times inverse document frequency, normalised by length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators.index import HOTTEST, with_doc_freq
from inkwell.session import written


def record_words(records: DataFrame) -> DataFrame:
    """key, word, tf, length of records(key, text), without Python: each record's words once, and how many it has in all."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = records.select("key", F.explode(words).alias("word")).groupBy("key", "word").agg(F.count("*").alias("tf"))
    return counts.withColumn("length", F.sum("tf").over(W.partitionBy("key")))


def term_scores(records: DataFrame, vocabulary: DataFrame | None = None, smooth: bool = True, normalise: bool = True, hottest: int = HOTTEST) -> DataFrame:
    """key, word, tf, df, length, score for every distinct word of records(key, text).

    smooth: ln((1 + N) / (1 + df)) + 1, else ln(N / df). normalise: divided by length, the number of words of the
    record. N counts all keys, those without words too. vocabulary(word): only its words come out. Null and empty texts
    give no rows; rows of one key make up one record; other columns and rows with null key are ignored.

    Texts are read once: the distinct words of the records are written as a table, from which df is counted and to which
    it is joined back, that of a fixed number of hottest words by a broadcast, see with_doc_freq().
    """
    records = records.where(F.col("key").isNotNull())
    total = records.agg(F.countDistinct("key").alias("n"))
    counts = written(record_words(records))
    rows = with_doc_freq(counts, vocabulary, hottest).crossJoin(F.broadcast(total))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1 if smooth else F.log(F.col("n") / F.col("df"))
    score = F.col("tf") / F.col("length") * idf if normalise else F.col("tf") * idf
    return rows.select("key", "word", "tf", "df", "length", score.alias("score"))


def most_distinctive(scores: DataFrame) -> DataFrame:
    """Of each key the row with the highest score; ties, to nine digits, go to the word first in order."""
    best = F.struct((-F.round("score", 9)).alias("s"), "word", "tf", "df", "score")
    return scores.groupBy("key").agg(F.min(best).alias("b")).select("key", "b.word", "b.tf", "b.df", "b.score")
