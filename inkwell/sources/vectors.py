"""Tables of vectors by name below one folder: created, opened, appended to, listed and dropped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.chunking import chunk_texts
from inkwell.operators.vectors import good_vectors
from inkwell.sources.files import append_vectors


class VectorStore:
    """Named tables (id, vector, ...) of vectors with dims numbers; rows with bad vectors are dropped as they come in."""

    def __init__(self, spark: SparkSession, path: str, dims: int) -> None:
        self.spark, self.path, self.dims = spark, path.rstrip("/"), dims
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"no name of a table: {name!r}")
        return f"{self.path}/{name}"

    def names(self) -> list[str]:
        """The tables there are, in order."""
        if not self._files.exists(self._root):
            return []
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._root) if x.isDirectory())

    def create(self, name: str, rows: DataFrame) -> DataFrame:
        """A new table of rows; an error if there is one of that name."""
        if name in self.names():
            raise ValueError(f"table {name} exists")
        good_vectors(rows, "vector", self.dims).write.parquet(self._at(name))
        return self.open(name)

    def append(self, name: str, rows: DataFrame) -> None:
        append_vectors(rows, self._at(name), "vector", self.dims)

    def open(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name))

    def drop(self, name: str) -> None:
        """Nothing happens if there is no such table."""
        self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._at(name)), True)

    @staticmethod
    def query_name(query: str) -> str:
        """The name of the table that holds what a query was narrowed down to."""
        return "query-" + hashlib.sha256(query.encode()).hexdigest()


EMBEDDED = "doc_id bigint, chunk_no bigint, text_idx int, text_len int, vector array<float>"


def embed_chunks(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], budget: int) -> DataFrame:
    """EMBEDDED: the chunks of docs(doc_id, text) with their places in the text and embed() of their texts, batch by batch.

    Of one doc_id there must be one text. Null and empty texts have no chunks; other columns are ignored.
    """
    chunks = chunk_texts(docs, budget).join(docs.select("doc_id", "text"), "doc_id")
    parts = chunks.select("doc_id", "chunk_no", "text_idx", "text_len", F.substring("text", F.col("text_idx") + 1, F.col("text_len")).alias("part"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.drop(columns="part")
            found["vector"] = list(np.asarray(embed(batch.part.tolist()), dtype=np.float32)) if len(batch) else []
            yield found

    return parts.mapInPandas(work, EMBEDDED)
