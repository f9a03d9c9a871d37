"""Ranked search over an index: candidates, TF-IDF cosine, BM25 and their helpers.

A query's words reach the scan of the index as a filter, so only rows of query words are ever read, scored and, after
adding up on the map side, shuffled. A query may have any number of words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.text import simple_tokens
from inkwell.operators.index import B, K1
from inkwell.operators.store import as_index
from inkwell.session import written

#: Longer words are not indexed.
WORD_LIMIT = 60


def query_counts_of(query: str) -> dict[str, int]:
    """Each word of the query with its count, in order of the words."""
    counts: dict[str, int] = {}
    for word in re.split(r"[^\w]+", query.lower()):
        if word:
            counts[word] = counts.get(word, 0) + 1
    return dict(sorted(counts.items()))


def any_word(tf: DataFrame, words: list[str]) -> DataFrame:
    """doc_id of the documents with any of the words."""
    return tf.where(F.col("word").isin([w for w in words if len(w) <= WORD_LIMIT])).select("doc_id").distinct()


def every_word(tf: DataFrame, words: list[str]) -> DataFrame:
    """doc_id of the documents with all of the words."""
    found = tf.where(F.col("word").isin(words)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(set(words))).select("doc_id")


def weighted_candidates(tf: DataFrame, idf: DataFrame, words: list[str], least: float = 1.0) -> DataFrame:
    """doc_id, weight of the documents whose query words weigh more than least in idf."""
    known = idf.where(F.col("word").isin(words)).select("word", "idf")
    held = tf.where(F.col("word").isin(words)).join(F.broadcast(known), "word")
    return held.groupBy("doc_id").agg(F.sum("idf").alias("weight")).where(F.col("weight") > least)


def word_candidates(tf: DataFrame, idf: DataFrame, words: list[str], strategy: str = "trie") -> DataFrame:
    """doc_id of the candidates by one of the strategies trie, weighted_doc_idf and word_idf_filter."""
    if strategy == "trie":
        return any_word(tf, words)
    if strategy == "weighted_doc_idf":
        return weighted_candidates(tf, idf, words).select("doc_id")
    if strategy == "word_idf_filter":
        kept = idf.where(F.col("word").isin(words) & (F.col("idf") < 1.0)).select("word")
        return tf.where(F.length("word") <= WORD_LIMIT).join(F.broadcast(kept), "word", "left_semi").select("doc_id").distinct()
    if strategy in ("category_word2vec", "category_weighted_tfidf"):
        raise NotImplementedError(strategy)
    raise ValueError(strategy)


def top(scores: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k rows with the highest score, ties by key."""
    if not isinstance(k, int) or k <= 0:
        raise ValueError("max_results must be a positive whole number")
    return scores.orderBy(F.desc(score), key).limit(k)


def query_weights(index, counted: dict[str, int]) -> DataFrame:
    """word, times, idf of the query's words that the index knows, with corpus_size and avg_doc_len."""
    asked = index.spark.createDataFrame(pa.table({"word": list(counted), "times": list(counted.values())}))
    known = index.words(list(counted)).join(F.broadcast(asked), "word").crossJoin(F.broadcast(index.stats))
    return known.withColumn("idf", F.log(F.col("corpus_size") / F.col("df"))).drop("df")


def _held(index, counted: dict[str, int], normalised: bool) -> DataFrame:
    """The postings of the query's words with their weights, and t, what counts of each."""
    rows = index.postings(list(counted)).join(F.broadcast(query_weights(index, counted)), "word")
    return rows.withColumn("t", F.col("tf") / F.col("doc_len") if normalised else F.col("tf").cast("double"))


NO_SCORES = "doc_id bigint, score double"


def tfidf_scores(source, query: str, normalised: bool = False, threshold: float = -1.0, as_distance: bool = False) -> DataFrame:
    """doc_id, score: cosine of query and document, both restricted to the words of the query.

    source: an index, or docs(doc_id, text). normalised: tf / document length. threshold > 0 keeps scores of at least
    that (as_distance: of at most that). Words that no document has count nothing; documents without any query word, or
    with zero vectors, don't appear.
    """
    index, counted = as_index(source), query_counts_of(query)
    if not counted:
        return index.spark.createDataFrame([], NO_SCORES)
    held = _held(index, counted, normalised)
    q, d = F.col("times") * F.col("idf"), F.col("t") * F.col("idf")
    asked = query_weights(index, counted).agg(F.sqrt(F.sum(q * q)).alias("norm"))
    sums = held.groupBy("doc_id").agg(F.sum(q * d).alias("dot"), F.sqrt(F.sum(d * d)).alias("length"))
    scored = sums.crossJoin(F.broadcast(asked)).select("doc_id", F.try_divide("dot", F.col("length") * F.col("norm")).alias("score")).where("score IS NOT NULL")
    if threshold > 0:
        scored = scored.where(F.col("score") <= threshold if as_distance else F.col("score") >= threshold)
    return scored


def bm25_scores(source, query: str, k1: float = K1, b: float = B, normalised: bool = False) -> DataFrame:
    """doc_id, score: the sum of the BM25 terms of the distinct query words. normalised: tf / document length in place of tf."""
    index, counted = as_index(source), query_counts_of(query)
    if not counted:
        return index.spark.createDataFrame([], NO_SCORES)
    term = F.col("idf") * F.col("t") * (k1 + 1) / (F.col("t") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_doc_len")))
    return _held(index, counted, normalised).groupBy("doc_id").agg(F.sum(term).alias("score"))


def search_all(source, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each of queries(query_id, text) by BM25.

    queries are a given set of moderate size: their distinct words are broadcast. The postings of their words are read
    once for all of them. Scores are rounded to six digits; ties go by doc_id.
    """
    index = as_index(source)
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(simple_tokens("text"))).alias("word")).distinct()
    idf = F.log(F.col("corpus_size") / F.col("df"))
    known = index.words().join(F.broadcast(asked), "word").crossJoin(F.broadcast(index.stats)).select("query_id", "word", idf.alias("idf"), "avg_doc_len")
    t = F.col("tf").cast("double")
    term = F.col("idf") * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_doc_len")))
    scores = index.postings().join(F.broadcast(known), "word").groupBy("query_id", "doc_id").agg(F.round(F.sum(term), 6).alias("score"))
    return top_per_group(scores, "query_id", k).select("query_id", "rank", "doc_id", "score")


#: Longs in the mask of a set of words, and queries that are broadcast at a time.
MASK, AT_ONCE = 4, 200_000


def _place(word: Column) -> Column:
    """Which bit of the mask stands for the word."""
    return F.pmod(F.xxhash64(word), F.lit(64 * MASK)).cast("int")


def _bit(place: Column, part: int) -> Column:
    """The bit in that long of the mask; a shift counts by the last six bits of place."""
    return F.when(F.shiftright(place, 6) == part, F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint"))


def _with_bit(part: int) -> Callable[[Column, Column], Column]:
    return lambda mask, place: mask.bitwiseOR(_bit(place, part))


def own_ranks(docs: DataFrame, asked: DataFrame, least: float, k: int, at_once: int = AT_ONCE) -> DataFrame:
    """query_id, rank: where the document query_id stands in the answer to asked(query_id, word), words of its own, if among the k best.

    Documents score by the sum of the idf of the words they hold, counting words with an idf above least (of 0 or more);
    ties go by doc_id. As the document has all the words, none can score more, and those that score as much have them
    all: its rank is the number of such documents up to it. They are found among the documents with the rarest word of
    the query, by masks of their words first, then word by word. Texts are shuffled once and no pairs are; queries are
    broadcast, at_once at a time.
    """
    parts = [f"m{i}" for i in range(MASK)]
    whole = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    words = whole.select("doc_id", F.array_distinct(simple_tokens("text")).alias("words")).withColumn("places", F.transform("words", _place))
    masks = {m: F.aggregate("places", F.lit(0).cast("bigint"), _with_bit(i)) for i, m in enumerate(parts)}
    held = written(words.withColumns(masks).drop("places"))
    df = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weighed = asked.distinct().join(df, "word").crossJoin(F.broadcast(held.agg(F.count("*").alias("n")))).where(F.log(F.col("n") / F.col("df")) > least)
    rows = weighed.withColumn("place", _place(F.col("word")))
    queries = written(rows.groupBy("query_id").agg(
        F.min(F.struct("df", "word"))["word"].alias("key"), F.collect_list("word").alias("wanted"), *(F.bit_or(_bit(F.col("place"), i)).alias(f"q{i}") for i in range(MASK))
    ))
    slices = -(-queries.count() // at_once)
    tokens, found = held.select("doc_id", "words", *parts, F.explode("words").alias("key")), queries.select("query_id", F.lit(0).alias("before")).limit(0)
    for i in range(slices):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == i)
        likely = F.col("doc_id") <= F.col("query_id")
        for j, m in enumerate(parts):
            likely = likely & (F.col(m).bitwiseAND(F.col(f"q{j}")) == F.col(f"q{j}"))
        pairs = tokens.join(F.broadcast(some), "key").where(likely & (F.size(F.array_except("wanted", "words")) == 0))  # compiled, as forall() is not
        found = found.unionByName(pairs.groupBy("query_id").agg(F.count("*").alias("before")))
    return found.where(F.col("before") <= k).select("query_id", F.col("before").cast("int").alias("rank"))


def aligned_vectors(sparse: DataFrame, words: list[str], value: str = "tf_idf") -> DataFrame:
    """doc_id, vector: value of each of the words in their order, 0 where the document lacks one."""
    held = sparse.where(F.col("word").isin(words)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", value))).alias("m"))
    return held.select("doc_id", F.array(*(F.coalesce(F.col("m")[w], F.lit(0.0)) for w in words)).alias("vector"))


def top_per_group(scores: DataFrame, group: str, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best rows of each group and their rank from 1. The limit applies before the shuffle."""
    order = W.partitionBy(group).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_position(ranked: DataFrame, targets: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """key, position of each target in the ranking, from 0; -1 if absent."""
    best = ranked.groupBy(key).agg(F.min(rank).alias("r"))
    return targets.join(best, key, "left").select(key, F.coalesce(F.col("r") - 1, F.lit(-1)).cast("bigint").alias("position"))


def lookup_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """place, doc_id, text of each requested key(place, doc_id), an error text where it is missing."""
    return keys.join(docs.select("doc_id", "text"), "doc_id", "left").select("place", "doc_id", F.coalesce("text", F.lit("ERROR: article not found")).alias("text"))
