"""Parent-child rows to whole hierarchies by heavy-path decomposition.

Subtree sizes come from pointer doubling, which also separates cycles: in round k a node knows the ancestor 2^k links
up and the number of nodes less than 2^k links below it. Each parent's largest child continues the parent's chain, all
other children head chains of their own; a path from the top then crosses at most log2(n) chains. Positions inside
chains, and then depths, roots and positions of the chains themselves, are again found by doubling. So the number of
rounds grows with the logarithm of the depth, never with the depth, and no group of siblings is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.session import cut_lineage

#: Parts in which the siblings below one parent are summed, so that a parent of a third of all rows is no hot key.
SIBLING_PARTS = 64


def hierarchy(nodes: DataFrame, edges: DataFrame, paths: bool = False) -> DataFrame:
    """Label every node of the forest given by edges(src = parent, dst = child).

    nodes(name) adds names that have no edge. Null names say nothing; repeated edges count once; of several parents the
    first in order is taken. Result, one row per name: name, parent, root, depth, first, last, descendants and, if
    asked for, path. [first, last] is the interval of positions held by the node and its descendants below its root:
    u is a descendant of v if their roots agree and v.first < u.first <= v.last. Names on or below a cycle have root
    '', depth -1 and null interval, count and path. Empty tables give an empty result.
    """
    links = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy(F.col("dst").alias("name")).agg(F.min("src").alias("parent"))
    names = (
        nodes.select("name")
        .unionByName(edges.select(F.col("src").alias("name")))
        .unionByName(edges.select(F.col("dst").alias("name")))
        .where(F.col("name").isNotNull())
        .distinct()
    )
    named = cut_lineage(names.join(links, "name", "left").withColumn("id", F.monotonically_increasing_id()))
    ids = named.select(F.col("name").alias("parent"), F.col("id").alias("pid"))
    linked = cut_lineage(named.select("id", "parent").join(ids, "parent", "left").select("id", "pid"))
    sized = _sizes(linked)
    trees = cut_lineage(named.join(sized, "id").select("id", "name", "parent", "pid", "size", "tree"))
    inside = trees.where("tree")
    chained = _chains(inside)
    placed = _place(inside, chained, paths)
    found = trees.where(~F.col("tree")).select(
        "name", "parent", F.lit("").alias("root"), F.lit(-1).cast("bigint").alias("depth"),
        F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("last"), F.lit(None).cast("bigint").alias("descendants"),
        *([F.lit(None).cast("array<string>").alias("path")] if paths else []),
    )
    return placed.unionByName(found)


def _sizes(linked: DataFrame) -> DataFrame:
    """id, pid, size of the subtree, and whether the node reaches a top (tree)."""
    state = linked.select("id", "pid", F.col("pid").alias("up"), F.lit(1).cast("bigint").alias("size"), F.col("pid").isNull().alias("tree"))
    state = cut_lineage(state)
    total, before = state.count(), -1
    reached = state.where("tree").count()
    while reached not in (before, total):
        below = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("tree").alias("tree2"))
        state = cut_lineage(
            state.join(above, "up", "left").join(below, "id", "left").select(
                "id", "pid", F.col("up2").alias("up"),
                (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
                (F.col("tree") | F.coalesce("tree2", F.lit(False))).alias("tree"),
            )
        )
        before, reached = reached, state.where("tree").count()
    return state.select("id", "pid", "size", "tree")


def _double(state: DataFrame, more: list[Column], keep: list[str]) -> DataFrame:
    """Follow up(id -> up, at null the end) to the end; more says what a node (a) takes over from the one it points to (b)."""
    state = cut_lineage(state)
    while state.where(F.col("up").isNotNull()).limit(1).count():
        a = state.where(F.col("up").isNotNull()).alias("a")
        hop = a.join(state.alias("b"), F.col("a.up") == F.col("b.id")).select(F.col("a.id"), F.col("b.up"), *more, *(F.col(f"a.{k}") for k in keep))
        state = cut_lineage(state.where(F.col("up").isNull()).unionByName(hop))
    return state


def _chains(inside: DataFrame) -> DataFrame:
    """id, head of its chain, place on the chain from 0, and for heads of light chains the offset behind their elder siblings."""
    child = inside.where(F.col("pid").isNotNull())
    heavy = child.groupBy("pid").agg(F.min_by(F.struct("id", "size"), F.struct(-F.col("size"), F.col("name"))).alias("h"))
    heavy = heavy.select("pid", F.col("h.id").alias("heavy"), F.col("h.size").alias("heavy_size"))
    part = F.pmod(F.xxhash64("name"), F.lit(SIBLING_PARTS))
    light = child.join(heavy, "pid").where(F.col("id") != F.col("heavy")).select("id", "pid", "name", "size", "heavy_size", part.alias("part"))
    light = cut_lineage(light)
    own = W.partitionBy("pid", "part").orderBy("name").rowsBetween(W.unboundedPreceding, -1)
    parts = light.groupBy("pid", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(W.partitionBy("pid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    offset = light.withColumn("elder", F.coalesce(F.sum("size").over(own), F.lit(0))).join(parts, ["pid", "part"]).select(
        "id", (F.col("heavy_size") + F.col("elder") + F.col("ahead")).alias("skip")
    )
    start = inside.join(heavy.select(F.col("heavy").alias("id"), F.lit(True).alias("is_heavy")), "id", "left")
    start = start.select("id", F.when(F.col("is_heavy"), F.col("pid")).alias("up"), F.when(F.col("is_heavy"), F.col("pid")).otherwise(F.col("id")).alias("head"),
                         F.when(F.col("is_heavy"), 1).otherwise(0).cast("bigint").alias("place"))
    ended = _double(start, [F.col("b.head"), (F.col("a.place") + F.col("b.place")).alias("place")], [])
    return cut_lineage(ended.select("id", "head", "place").join(offset, "id", "left"))


def _place(inside: DataFrame, chained: DataFrame, paths: bool) -> DataFrame:
    """Concatenate chains from the top: depth, root, interval and path of each node."""
    at = chained.select(F.col("id").alias("pid"), F.col("head").alias("above"), F.col("place").alias("above_place"))
    heads = chained.where(F.col("id") == F.col("head")).join(inside.select("id", "pid"), "id").join(at, "pid", "left")
    start = heads.select(
        "id", F.col("above").alias("up"), F.coalesce("above", F.col("id")).alias("top"),
        F.coalesce(F.col("above_place") + 1, F.lit(0)).alias("depth"),
        F.coalesce(F.col("above_place") + 1 + F.col("skip"), F.lit(0)).alias("first"),
    )
    more = [F.col("b.top"), (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.first") + F.col("b.first")).alias("first")]
    chains = None
    if paths:
        chains = chained.join(inside.select("id", "name"), "id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("all"))
        chains = cut_lineage(chains.select("head", F.col("all.name").alias("names")))
        cuts = heads.select("id", "above", "above_place").join(chains.withColumnRenamed("head", "above"), "above", "left")
        start = start.join(cuts.select("id", F.coalesce(F.slice("names", F.lit(1), (F.col("above_place") + 1).cast("int")), F.array().cast("array<string>")).alias("ahead")), "id")
        more.append(F.concat(F.col("b.ahead"), F.col("a.ahead")).alias("ahead"))
    tops = _double(start, more, []).select(F.col("id").alias("head"), "top", F.col("depth").alias("head_depth"), F.col("first").alias("head_first"), *(["ahead"] if paths else []))
    roots = inside.where(F.col("pid").isNull()).select(F.col("id").alias("top"), F.col("name").alias("root"))
    tops = tops.join(roots, "top").drop("top")
    full = inside.join(chained.select("id", "head", "place"), "id").join(tops, "head")
    if paths:
        full = full.join(chains, "head")
    first = F.col("head_first") + F.col("place")
    return full.select(
        "name", "parent", "root", (F.col("head_depth") + F.col("place")).alias("depth"),
        first.alias("first"), (first + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("descendants"),
        *([F.concat("ahead", F.slice("names", F.lit(1), (F.col("place") + 1).cast("int"))).alias("path")] if paths else []),
    )
