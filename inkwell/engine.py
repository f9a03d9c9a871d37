"""Searching by one object: sparse, dense, and both one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators import search, vectors
from inkwell.operators.index import B, K1
from inkwell.operators.store import BUCKETS, FreshIndex, StoredIndex, write_index

KINDS = ("tfidf", "bm25", "vector", "rerank")


class SearchEngine:
    """Ranked search over docs(doc_id, text) and, for dense search, embedded(doc_id, vector).

    index is a StoredIndex of docs; without one, every search reads all texts. build() stores one and open() takes one
    that is stored. embed turns a query into a vector; models are not part of this library. max_results may be any
    positive number.
    """

    def __init__(self, docs: DataFrame, embedded: DataFrame | None = None, embed=None, k1: float = K1, b: float = B, threshold: float = -1.0, first: str = "bm25", index: StoredIndex | None = None) -> None:
        self.docs, self.embedded, self.embed, self.k1, self.b, self.threshold = docs, embedded, embed, k1, b, threshold
        self.index = index or FreshIndex(docs)
        if first not in ("tfidf", "bm25"):
            raise ValueError("the first stage is tfidf or bm25")
        self.first = first

    @classmethod
    def build(cls, docs: DataFrame, path: str, buckets: int = BUCKETS, **options) -> SearchEngine:
        return cls(docs, index=write_index(docs, path, buckets), **options)

    @classmethod
    def open(cls, docs: DataFrame, path: str, **options) -> SearchEngine:
        return cls(docs, index=StoredIndex(docs.sparkSession, path), **options)

    def search(self, query: str, kind: str = "bm25", max_results: int = 50, metric: str = "l2") -> DataFrame:
        """score, doc_id, text, start, end of the best documents: by falling score, for vectors by rising distance."""
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        if not isinstance(max_results, int) or max_results <= 0:
            raise ValueError("max_results must be a positive whole number")
        if kind in ("tfidf", "bm25"):
            return self._format(self._sparse(query, kind, max_results))
        rows = self.embedded.select(F.col("doc_id").alias("id"), "vector")
        if kind == "rerank":
            kept = self._sparse(query, self.first, max_results)
            rows = rows.join(kept.select(F.col("doc_id").alias("id")), "id", "left_semi")
        asked = self.docs.sparkSession.createDataFrame([(-1, [float(x) for x in self.embed(query)])], "id bigint, vector array<double>")
        found = vectors.nearest(asked, rows, max_results, metric)
        return self._format(found.select(F.col("id").alias("doc_id"), F.col("distance").alias("score")), rising=True)

    def _sparse(self, query: str, kind: str, k: int) -> DataFrame:
        scores = search.bm25_scores(self.index, query, self.k1, self.b) if kind == "bm25" else search.tfidf_scores(self.index, query, threshold=self.threshold)
        return search.top(scores, k)

    def _format(self, found: DataFrame, rising: bool = False) -> DataFrame:
        rows = found.join(self.docs.select("doc_id", "text"), "doc_id").select("score", "doc_id", "text", F.lit(0).alias("start"), F.length("text").alias("end"))
        return rows.orderBy(F.asc("score") if rising else F.desc("score"), "doc_id")
