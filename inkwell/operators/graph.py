"""Directed graphs as edge tables (src, dst): search by levels, leaves, cycles, roll-ups and covers.

Loops run once per level or once for several, not once per node, and cut their lineage. Frontiers stay distributed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.arrow import flat_map
from inkwell.operators.index import dense_ids, running_totals
from inkwell.session import cut_lineage, written


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges without nulls."""
    return edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """node: all names of edges."""
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).where(F.col("node").isNotNull()).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node: the nodes no edge leads to."""
    links = clean_edges(edges)
    return nodes_of(links).join(links.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


#: Levels walked before the next look whether any node is left, levels whose results are kept apart before they are
#: merged, and edges up to which they are broadcast.
LOOK, APART, FEW = 4, 12, 200_000


def levels(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth of the nodes reachable from start(node): the fewest edges from any of them.

    Each level writes only the nodes that are new; those of earlier levels are merged every APART levels, so what is
    written grows with the nodes, not with nodes times levels. Edges that have been counted to be few are broadcast;
    more of them are shuffled.
    """
    links = cut_lineage(clean_edges(edges))
    if links.count() <= FEW:
        links = F.broadcast(links)
    first = start.select("node").where(F.col("node").isNotNull()).distinct()
    latest, depth, apart = cut_lineage(first.withColumn("depth", F.lit(0).cast("bigint"))), 0, 1
    seen = latest
    while max_depth is None or depth < max_depth:
        depth += 1
        step = latest.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        latest = cut_lineage(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).cast("bigint").alias("depth")))
        if depth % LOOK == 0 and latest.isEmpty():
            break
        seen, apart = seen.union(latest), apart + 1
        if apart > APART:
            seen, apart = cut_lineage(seen.coalesce(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")))), 1
    return seen


def node_depths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, depth of all nodes of edges; -1 where start doesn't reach."""
    return nodes_of(edges).join(levels(edges, start), "node", "left").select("node", F.coalesce("depth", F.lit(-1)).alias("depth"))


def leaves(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth of the reachable nodes from which no edge goes on."""
    return levels(edges, start, max_depth).join(clean_edges(edges).select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def without_cycles(edges: DataFrame, start: DataFrame) -> DataFrame:
    """The edges between reachable nodes that lead to a greater depth: a graph without cycles, the same on every run."""
    depth = levels(edges, start)
    d1 = depth.select(F.col("node").alias("src"), F.col("depth").alias("d1"))
    d2 = depth.select(F.col("node").alias("dst"), F.col("depth").alias("d2"))
    return clean_edges(edges).join(d1, "src").join(d2, "dst").where(F.col("d2") > F.col("d1")).select("src", "dst")


def held(edges: DataFrame, members: DataFrame, value: str = "doc_id") -> DataFrame:
    """node, value: the distinct members(node, value) of each node and of all below it.

    Sets are handed up one level per round from the deepest nodes to their parents, so paths, not all pairs of
    ancestors and descendants, are walked. Needs edges without cycles, as without_cycles() gives.
    """
    links = cut_lineage(clean_edges(edges))
    latest, apart = cut_lineage(members.select("node", value).where(F.col("node").isNotNull() & F.col(value).isNotNull()).distinct()), 1
    total = latest
    while not latest.isEmpty():
        up = latest.join(links, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), value).distinct()
        latest = cut_lineage(up.join(total, ["node", value], "left_anti"))
        total, apart = total.union(latest), apart + 1
        if apart > APART:
            total, apart = cut_lineage(total), 1
    return total


def roll_up(edges: DataFrame, members: DataFrame, value: str = "doc_id") -> DataFrame:
    """node, docs: how many distinct members(node, value) the node and all below it have; edges as held() needs them."""
    return held(edges, members, value).groupBy("node").agg(F.count("*").alias("docs"))


#: Edges up to which every task walks them by itself, pairs of node and document that are broadcast at a time, such pairs
#: to a task, up to MOST tasks, and broadcasts at a time.
WALKED, AT_ONCE, EACH, MOST, TOGETHER = 5_000_000, 5_000_000, 20_000, 2_000, 8


def holders(edges: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, ids: for each document of members(node, doc_id) the numbers of all nodes that hold it, as held() has them.

    ids(node, id) numbers the nodes from 0. Each document walks up from its own nodes, so there are no rounds and no pairs
    are shuffled; the edges, of which there are counted to be few, go to every task.
    """
    src, dst = ids.select(F.col("node").alias("src"), F.col("id").alias("parent")), ids.select(F.col("node").alias("dst"), F.col("id").alias("child"))
    up = edges.join(src, "src").join(dst, "dst").select(F.col("child").cast("int"), F.col("parent").cast("int")).toArrow()
    order = np.argsort(child := up["child"].to_numpy(), kind="stable")
    parents, starts = up["parent"].to_numpy()[order], np.searchsorted(child[order], np.arange(child.max(initial=-1) + 2))

    def start():
        above, first = parents.tolist(), starts.tolist()

        def work(doc_id: int, own: list[int]) -> list[tuple]:
            seen, open_ = set(own), list(own)
            while open_:
                node = open_.pop()
                for parent in above[first[node] : first[node + 1]] if node + 1 < len(first) else ():
                    if parent not in seen:
                        seen.add(parent)
                        open_.append(parent)
            return [(doc_id, sorted(seen))]

        return work

    own = members.join(ids, "node").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set(F.col("id").cast("int")).alias("own"))
    return flat_map(own, ["doc_id", "own"], start, f"doc_id {dict(members.dtypes)['doc_id']}, ids array<int>")


def roll_up_words(edges: DataFrame, members: DataFrame, counts: DataFrame, walked: int = WALKED, at_once: int = AT_ONCE) -> DataFrame:
    """node, word, tf: counts(doc_id, word, tf) merged over the distinct documents of the node and of all below it.

    Counts are shuffled once, by word; the nodes of each document are broadcast, at_once pairs at a time, and sums are
    made where the word is, so rows of node, document and word are never shuffled. More edges than walked go level by
    level and by shuffles.
    """
    links = cut_lineage(clean_edges(edges))
    if links.count() > walked:
        return held(links, members).join(counts, "doc_id").groupBy("node", "word").agg(F.sum("tf").alias("tf"))
    ids = written(dense_ids(members.select("node").union(nodes_of(links)), "node", first=0))
    lists = written(holders(links, members, ids))
    pairs = lists.agg(F.sum(F.size("ids"))).head()[0] or 0
    blocks, least = max(1, -(-pairs // at_once)), int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread, parts = counts.repartition(max(least, min(MOST, -(-pairs // EACH))), "word"), []
    for i in range(blocks):
        nodes = lists.select("doc_id", F.filter("ids", lambda x: x % blocks == i).alias("ids")).where(F.size("ids") > 0)
        sums = spread.join(F.broadcast(nodes), "doc_id").select("word", F.explode("ids").alias("id"), "tf").groupBy("id", "word").agg(F.sum("tf").alias("tf"))
        part = sums.join(F.broadcast(ids.where(F.col("id") % blocks == i)), "id").select("node", "word", "tf")
        parts.append(written(part) if blocks > TOGETHER else part)
    return reduce(DataFrame.unionByName, parts)


def same_graph(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: same, whether both have the same directed edges."""
    a, b = clean_edges(a), clean_edges(b)
    extra = a.join(b, ["src", "dst"], "left_anti").limit(1).union(b.join(a, ["src", "dst"], "left_anti").limit(1))
    return extra.agg((F.count("*") == 0).alias("same"))


def greedy_cover(sets: DataFrame) -> DataFrame:
    """place, name, gain: sets(name, item) that cover all items, the one with the most items not yet covered first.

    At most ln(n) times as many sets as the best cover has. Ties go by name. A set that beats every set it shares an
    open item with keeps its gain until it is chosen, so all such sets are chosen in one round, which gives the same
    cover as choosing one by one. Falling gain, then name, is the order of choice.
    """
    left = cut_lineage(sets.select("name", "item").where(F.col("name").isNotNull() & F.col("item").isNotNull()).distinct())
    chosen = left.sparkSession.createDataFrame([], f"name {dict(left.dtypes)['name']}, gain bigint")
    while left.limit(1).count():
        gains = left.groupBy("name").agg(F.count("*").alias("gain"))
        rated = left.join(gains, "name")
        best = rated.groupBy("item").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "name")).alias("b")).select("item", F.col("b.name").alias("name"))
        won = best.groupBy("name").agg(F.count("*").alias("wins")).join(gains, "name").where("wins = gain").select("name", "gain")
        won = cut_lineage(won)
        covered = left.join(won.select("name"), "name", "left_semi").select("item").distinct()
        left = cut_lineage(left.join(covered, "item", "left_anti").select("name", "item"))
        chosen = chosen.unionByName(won)
    ranked = running_totals(chosen, [F.col("gain").desc(), F.col("name")], "gain")
    return ranked.select("place", "name", "gain")
