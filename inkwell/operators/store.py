"""The index as stored tables: built once from one reading of the texts, then opened and searched many times.

A stored index is a folder of four Parquet tables. postings (word, doc_id, tf, doc_len) and words (word, df) are parted by
a hash of the word into buckets and sorted by word inside, so a search reads the buckets of its words only, and of these,
by the statistics of the row groups, the parts that hold them. Rows are spread by ranges of (bucket, word, doc_id), so a
word that is in every document fills many files, none of them large. documents (doc_id, doc_len) has all documents, and
stats one row: documents, average length and buckets.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import simple_tokens
from inkwell.operators.index import doc_freq, doc_len, term_freq
from inkwell.session import written

#: Buckets of an index unless told otherwise: some files for each executor core are enough.
BUCKETS = 32


def _bucket(buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> StoredIndex:
    """Build the index of docs(doc_id, text) at path, in place of one that is there, and open it.

    Texts of one doc_id add up; null and empty texts are documents without words; rows with null doc_id are left out;
    other columns are ignored; an empty table gives an empty index.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    tf = written(term_freq(docs))
    lengths = tf.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))

    def save(rows: DataFrame, name: str, order: list[str]) -> None:
        rows = rows.withColumn("bucket", _bucket(buckets)).repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")

    save(tf.join(lengths, "doc_id"), "postings", ["word", "doc_id"])
    save(doc_freq(tf), "words", ["word"])
    documents = docs.select("doc_id").distinct().join(lengths, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    known = docs.sparkSession.read.parquet(f"{path}/documents")
    stats = known.agg(F.count("*").alias("corpus_size"), F.avg("doc_len").alias("avg_doc_len"), F.lit(buckets).alias("buckets"))
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    return StoredIndex(docs.sparkSession, path)


class StoredIndex:
    """The tables of the index at path; nothing is read but what a search asks for."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.stats = spark.read.parquet(f"{path}/stats").select("corpus_size", "avg_doc_len")
        self.buckets = spark.read.parquet(f"{path}/stats").head().buckets

    def _table(self, name: str, schema: str, words: list[str] | None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        if words is not None:
            buckets = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("word").isin(words))
        return rows.drop("bucket")

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """word, doc_id, tf, doc_len: of words only, if given."""
        return self._table("postings", "word string, doc_id bigint, tf bigint, doc_len bigint", words)

    def words(self, words: list[str] | None = None) -> DataFrame:
        """word, df: of words only, if given."""
        return self._table("words", "word string, df bigint", words)

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")


class FreshIndex:
    """What a StoredIndex has, worked out from the texts for each search: for collections that are searched once."""

    def __init__(self, docs: DataFrame) -> None:
        self.spark, self.docs = docs.sparkSession, docs.select("doc_id", "text").where("doc_id IS NOT NULL")

    @property
    def stats(self) -> DataFrame:
        return self.documents().agg(F.count("*").alias("corpus_size"), F.avg("doc_len").alias("avg_doc_len"))

    def postings(self, words: list[str] | None = None) -> DataFrame:
        tokens = simple_tokens("text")
        if words is not None:
            tokens = F.filter(tokens, lambda t: t.isin(words))
        return term_freq(self.docs, tokens).join(self.documents(), "doc_id").select("word", "doc_id", "tf", "doc_len")

    def words(self, words: list[str] | None = None) -> DataFrame:
        tokens = simple_tokens("text")
        if words is not None:
            tokens = F.filter(tokens, lambda t: t.isin(words))
        return doc_freq(term_freq(self.docs, tokens))

    def documents(self) -> DataFrame:
        return doc_len(self.docs).withColumnRenamed("dl", "doc_len")


def as_index(source: StoredIndex | FreshIndex | DataFrame) -> StoredIndex | FreshIndex:
    return FreshIndex(source) if isinstance(source, DataFrame) else source
