"""Nearest neighbours, exact in blocks and approximate by inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import inkwell.functions.arrow  # noqa: F401  lets the functions below travel with the plan
from inkwell.session import written

#: Queries compared with all rows in one pass; more are taken in several passes.
QUERY_BLOCK = 5_000
#: Vectors on which the cells of the approximate index are fitted, at most.
FIT_ROWS = 50_000
#: Rows of a cell that one task compares with its queries, at most; even if all rows are in one cell, which is then no hot key.
PART_ROWS = 20_000


def good_vectors(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """rows whose vector has dims numbers, none of them null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == dims) & ~bad)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Queries down, rows across; zero vectors are at infinite cosine distance."""
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(rows, axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(norms > 0, 1 - (queries @ rows.T) / norms, np.inf)
    square = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * queries @ rows.T
    return np.sqrt(np.maximum(square, 0))


FOUND = "query_id bigint, id bigint, distance double"


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, metric: str, skip_self: bool) -> pd.DataFrame:
    distance = np.round(_distances(queries, rows, metric), 9)
    if skip_self:
        distance[query_ids[:, None] == ids[None, :]] = np.inf
    keep = min(k, distance.shape[1])
    # equal distances go by id: rows come sorted by id, and the sort is stable
    order = np.argsort(distance, axis=1, kind="stable")[:, :keep]
    best = np.take_along_axis(distance, order, axis=1)
    frame = pd.DataFrame({"query_id": np.repeat(query_ids, keep), "id": ids[order].ravel(), "distance": best.ravel()})
    return frame[np.isfinite(frame.distance)]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows(id, vector) of each of queries(id, vector), exactly.

    Queries go to all rows in blocks of QUERY_BLOCK; each batch of rows answers with its own k best, so nothing grows
    with the number of pairs. Vectors are taken to be good_vectors(); equal distances, to nine digits, go by id.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for block in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "vector").toPandas()
        if part.empty:
            continue
        query_ids, matrix = part.id.to_numpy(), np.array(part.vector.tolist(), dtype=np.float64)

        def compare(batches: Iterator[pd.DataFrame], query_ids=query_ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 2_000):
                    some = batch.iloc[at : at + 2_000].sort_values("id")
                    yield _nearest(query_ids, matrix, some.id.to_numpy(), np.array(some.vector.tolist(), dtype=np.float64), k, metric, skip_self)

        here = rows.select("id", "vector").mapInPandas(compare, FOUND)
        found = here if found is None else found.unionByName(here)
    if found is None:
        return queries.sparkSession.createDataFrame([], FOUND + ", rank int")
    return _best(found, k)


#: Queries on which the number of cells to probe is chosen, at most.
TUNE_QUERIES = 200


#: Cells of the approximate index, at most. Larger collections have larger cells, which are compared in parts.
MOST_CELLS = 1_024


def fit_cells(rows: DataFrame, cells: int | None = None, k: int = 10, target: float = 0.95, seed: int = 1, rounds: int = 12) -> tuple[np.ndarray, int]:
    """(centres, probes): centres of the cells by k-means, and how many cells to probe for a recall of about target.

    cells: the square root of the number of rows, at most MOST_CELLS, if not given.

    Both are fitted on at most FIT_ROWS of rows(id, vector), those first by a hash of their id: probes is the least number
    with which at most TUNE_QUERIES of them find the share target of their k nearest others among them.
    """
    some = rows.select("vector", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(FIT_ROWS).toPandas()
    points = np.array(some.vector.tolist(), dtype=np.float64)
    if len(points) == 0:
        return np.zeros((0, 0)), 1
    cells = cells or max(1, min(MOST_CELLS, round(rows.count() ** 0.5)))
    centres = points[: min(cells, len(points))].copy()
    for _ in range(rounds):
        near = _distances(points, centres, "l2").argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(axis=0)
    home, asked = _distances(points, centres, "l2").argmin(axis=1), points[:TUNE_QUERIES]
    distance = _distances(asked, points, "l2")
    distance[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    nearest_home = home[np.argsort(distance, axis=1, kind="stable")[:, : min(k, max(1, len(points) - 1))]]
    place = np.argsort(np.argsort(_distances(asked, centres, "l2"), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest_home, axis=1).ravel()) + 1
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def nearest_by_cells(queries: DataFrame, rows: DataFrame, k: int, centres: np.ndarray, probes: int, metric: str = "l2", skip_self: bool = False) -> DataFrame:
    """As nearest(), among the rows of the probes cells next to each query only. Every row is in exactly one cell.

    A cell of more than PART_ROWS rows is spread over as many parts as it needs; only its own queries are copied to them.
    """

    def assign(count: int):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(centres):
                    order = np.argsort(_distances(np.array(batch.vector.tolist(), dtype=np.float64), centres, "l2"), axis=1, kind="stable")[:, :count]
                    yield pd.DataFrame({"id": np.repeat(batch.id.to_numpy(), order.shape[1]), "vector": [v for v in batch.vector for _ in range(order.shape[1])], "cell": order.ravel()})

        return work

    schema = "id bigint, vector array<float>, cell bigint"
    held = written(rows.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(assign(1), schema))
    # one row per cell
    sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).alias("parts"))
    held = held.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    asked = queries.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(assign(probes), schema)
    asked = asked.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        right = right.sort_values("id")
        return _nearest(left.id.to_numpy(), np.array(left.vector.tolist(), dtype=np.float64), right.id.to_numpy(), np.array(right.vector.tolist(), dtype=np.float64), k, metric, skip_self)

    found = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInPandas(compare, FOUND)
    return _best(found, k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall of the (query_id, id) of truth."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
