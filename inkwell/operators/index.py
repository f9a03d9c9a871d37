"""Term, document and collection statistics, the inverted index and sparse vectors.

Everything derives from one exploded table of (doc_id, word, tf). Counts are aggregated on the map side before they are
shuffled, and no posting list, document or vocabulary is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import inkwell.functions.arrow  # noqa: F401  lets the functions below travel with the plan
from inkwell.functions.text import char_bucket, simple_tokens
from inkwell.session import cut_lineage, written

K1, B = 1.2, 0.75
#: Documents per posting block: a word's postings are one row per block, so a word in every document is no hot row.
BLOCK = 65_536

#: A word with at least this part of all rows is hot, and its df is sent to every task. There can't be more than HOTTEST
#: such words, however large the collection.
HOTTEST = 20_000


def with_doc_freq(counts: DataFrame, listed: DataFrame | None = None, hottest: int = HOTTEST) -> DataFrame:
    """counts(word, ...), which has each record and word once, with df, the number of records of each word.

    The df of words with one in hottest of all rows or more, at most so many words, are broadcast; the others, of which
    none is a hot key, are shuffled. listed(word): only rows of its words come out. counts is read several times and
    should be a written table.
    """
    df = written(doc_freq(counts))
    rows = df.agg(F.sum("df")).head()[0] or 0
    hot = df.where(F.col("df") * hottest >= rows)
    cold, known = df.where(F.col("df") * hottest < rows), hot
    if listed is not None:
        cold, known = (x.join(listed.select("word"), "word", "left_semi") for x in (cold, known))
    others = counts.join(F.broadcast(hot.select("word")), "word", "left_anti").join(cold, "word")
    return counts.join(F.broadcast(known), "word").unionByName(others)


def term_freq(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """doc_id, word, tf of docs(doc_id, text). Null and empty texts have no rows."""
    words = docs.select("doc_id", F.explode(simple_tokens("text") if tokens is None else tokens).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


def doc_freq(tf: DataFrame) -> DataFrame:
    """word, df. tf has each document and word once, so no distinct is needed."""
    return tf.groupBy("word").agg(F.count("*").alias("df"))


def doc_len(docs: DataFrame) -> DataFrame:
    """doc_id, dl of all documents, those without words too."""
    return docs.select("doc_id", F.coalesce(F.size(simple_tokens("text")), F.lit(0)).cast("bigint").alias("n")).groupBy("doc_id").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("dl")
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: corpus_size, avg_doc_len over documents."""
    return doc_len(docs).agg(F.count("*").alias("corpus_size"), F.avg("dl").alias("avg_doc_len"))


def inverse_doc_freq(docs: DataFrame) -> DataFrame:
    """word, df, idf = ln(N / df)."""
    total = docs.agg(F.countDistinct("doc_id").alias("n"))
    return doc_freq(term_freq(docs)).crossJoin(F.broadcast(total)).select("word", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def weighted_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, stats): doc_id, word, tf, doc_len, df of every document and word, and one row with corpus_size, avg_doc_len.

    Texts are tokenised once; all else comes from the written counts.
    """
    tf = written(term_freq(docs))
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
    known = docs.select("doc_id").distinct().join(lengths, "doc_id", "left")
    stats = known.agg(F.count("*").alias("corpus_size"), F.avg(F.coalesce("doc_len", F.lit(0))).alias("avg_doc_len"))
    return with_doc_freq(tf).join(lengths, "doc_id"), stats


def sparse_vectors(docs: DataFrame, k1: float = K1, b: float = B, normalised: bool = False) -> DataFrame:
    """doc_id, word, tf, doc_len, idf, tf_idf, bm25. normalised: tf / doc_len stands for tf in both scores."""
    rows, stats = weighted_counts(docs)
    rows = rows.crossJoin(F.broadcast(stats))
    idf = F.log(F.col("corpus_size") / F.col("df"))
    t = F.col("tf") / F.col("doc_len") if normalised else F.col("tf")
    return rows.select(
        "doc_id", "word", "tf", "doc_len", idf.alias("idf"), (t * idf).alias("tf_idf"),
        (idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_doc_len")))).alias("bm25"),
    )


def inverted_index(tf: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, block, docs: the sorted ids of the documents of one block of ids that hold the word."""
    return tf.groupBy("word", F.floor(F.col("doc_id") / block).alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def postings(tf: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, block, postings: (doc_id, tf) sorted by doc_id."""
    return tf.groupBy("word", F.floor(F.col("doc_id") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def bag_of_words(docs: DataFrame) -> DataFrame:
    """doc_id, words: each word of the document once, in order."""
    return docs.select("doc_id", F.array_sort(F.array_distinct(simple_tokens("text"))).alias("words"))


def dense_ids(keys: DataFrame, key: str, first: int = 1) -> DataFrame:
    """key, id: the distinct keys numbered without gaps in their order, without sorting all of them in one task.

    Keys are spread by range; each range is numbered by itself and shifted by the sizes of the ranges before it.
    """
    ranged = cut_lineage(keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    shift = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    within = F.row_number().over(W.partitionBy("part").orderBy(key))
    return ranged.withColumn("r", within).join(F.broadcast(shift), "part").select(key, (F.col("r") + F.col("shift") + (first - 1)).alias("id"))


def running_totals(rows: DataFrame, order: list[Column], value: str) -> DataFrame:
    """rows with place (from 1) and total (of value up to here) in the given order, range by range as in dense_ids."""
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("s0"))
    here = W.partitionBy("part").orderBy(*order)
    numbered = ranged.withColumn("r", F.row_number().over(here)).withColumn("t", F.sum(value).over(here.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.join(F.broadcast(shift), "part").withColumn("place", F.col("r") + F.col("n0")).withColumn("total", F.col("t") + F.col("s0")).drop("part", "r", "t", "n0", "s0")


def vocab_chunks(df: DataFrame, limit: int) -> DataFrame:
    """word, df, chunk: words by falling df packed one after the other; a chunk closes before its df would pass limit.

    A word above limit fills a chunk alone; no chunk is empty. Words are few kinds of df: those of equal df follow each
    other, so how they fall into chunks follows from the df, the room left, and how many they are. The df and their
    numbers of words, at most the square root of twice the postings, are packed in order in one task; the chunk of a
    word follows from its place among those of its df, which are numbered range by range.
    """
    df = written(df.select("word", "df"))
    kinds = df.groupBy("df").agg(F.count("*").alias("words"))
    packed = kinds.coalesce(1).sortWithinPartitions(F.col("df").desc()).mapInPandas(_pack(limit), "df bigint, first_chunk bigint, first_room bigint, per_chunk bigint, before bigint")
    numbered = running_totals(df, [F.col("df").desc(), F.col("word")], "df").select("word", "df", "place")
    later = F.greatest(F.lit(0).cast("bigint"), F.col("place") - F.col("before") - 1 - F.col("first_room"))
    chunk = F.when(F.col("place") - F.col("before") <= F.col("first_room"), F.col("first_chunk")).otherwise(F.col("first_chunk") + 1 + F.floor(later / F.col("per_chunk")))
    return numbered.join(F.broadcast(packed), "df").select("word", "df", chunk.cast("bigint").alias("chunk"))


def _pack(limit: int):
    """For each df in falling order: the chunk open before its words, how many of them still fit there, how many a new one takes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, used, before = 0, 0, 0  # the open chunk, the df in it, the words before
        for batch in batches:
            rows = []
            for df, words in zip(batch.df.tolist(), batch.words.tolist()):
                per = max(1, limit // df)
                room = min(words, max(0, (limit - used) // df)) if used else min(words, per)
                rows.append((df, chunk, room, per, before))
                left = words - room
                if left:
                    more = -(-left // per)
                    chunk, used = chunk + more, (left - (more - 1) * per) * df
                else:
                    used += room * df
                before += words
            yield pd.DataFrame(rows, columns=["df", "first_chunk", "first_room", "per_chunk", "before"])

    return work


def fixed_chunks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, chunk: the distinct keys in order, size of them to a chunk."""
    return dense_ids(rows, key, first=0).select(key, F.floor(F.col("id") / size).alias("chunk"))


def char_histogram(df: DataFrame) -> DataFrame:
    """bucket, words, longest: vocabulary by first character."""
    return df.groupBy(char_bucket("word").alias("bucket")).agg(F.count("*").alias("words"), F.max(F.length("word")).alias("longest"))


def shard_map(words: DataFrame, shards: int) -> DataFrame:
    """shard, min_word, max_word of a vocabulary cut into ranges of equal length in order."""
    ids = dense_ids(words, "word", first=0)
    n = ids.count()
    size = max(1, -(-n // shards))
    return ids.groupBy(F.floor(F.col("id") / size).alias("shard")).agg(F.min("word").alias("min_word"), F.max("word").alias("max_word"))
