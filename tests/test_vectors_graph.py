import random

import pytest

from inkwell.operators import graph as G
from inkwell.operators import sets as U
from inkwell.operators import vectors as V


def points(spark, n, seed=1, dims=8):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(dims)]) for i in range(n)], "id bigint, vector array<double>")


def test_good_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, float("nan")]), (5, [None, 1.0])], "id bigint, vector array<double>")
    assert [r.id for r in V.good_vectors(rows, "vector", 2).collect()] == [1]


def test_nearest_is_exact_and_expressions_agree(spark):
    rows = points(spark, 60)
    found = V.nearest(rows.where("id < 5"), rows, 3, "cosine", skip_self=True)
    a, b = rows.selectExpr("id as query_id", "vector as a"), rows.selectExpr("id", "vector as b")
    agreed = found.join(a, "query_id").join(b, "id").select((1 - V.cosine("a", "b") - found.distance).alias("d"), V.l2("a", "b").alias("l"))
    assert all(abs(r.d) < 1e-8 for r in agreed.collect()) and found.count() == 15
    assert V.nearest(rows.limit(0), rows, 3).count() == 0


def test_cells_recall(spark):
    rows = points(spark, 800)
    asked = rows.where("id % 20 = 0")
    centres, probes = V.fit_cells(rows, 16)
    assert 1 < probes < 16 and V.fit_cells(rows.limit(0), 16)[1] == 1
    found = V.nearest_by_cells(asked, rows, 10, centres, probes, skip_self=True)
    assert V.recall(found, V.nearest(asked, rows, 10, skip_self=True)).head().recall >= 0.9


EDGES = [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "x"), ("q", "z"), (None, "z"), ("r", "a")]


def test_levels_leaves_cycles(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    start = spark.createDataFrame([("r",)], "node string")
    depth = {r.node: r.depth for r in G.node_depths(edges, start).collect()}
    assert depth == {"r": 0, "a": 1, "b": 1, "c": 2, "d": 3, "x": -1, "q": -1, "z": -1}
    assert {r.node for r in G.roots(edges).collect()} == {"r", "q"}
    assert {r.node for r in G.leaves(edges, G.roots(edges)).collect()} == {"z"}
    dag = {tuple(r) for r in G.without_cycles(edges, start).collect()}
    assert ("d", "a") not in dag and ("c", "d") in dag


def test_levels_of_a_long_chain(spark):
    chain = spark.range(40).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst").union(spark.createDataFrame([("n9", "n2"), ("n0", "n5")], "src string, dst string"))
    start = spark.createDataFrame([("n0",), (None,), ("n0",)], "node string")
    want = {f"n{i}": i if i < 5 else i - 4 for i in range(41)}
    assert {r.node: r.depth for r in G.levels(chain, start).collect()} == want
    assert {r.node for r in G.levels(chain, start, 3).collect()} == {n for n, d in want.items() if d <= 3}


def test_same_graph(spark):
    one = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert G.same_graph(one, one.union(one)).head().same and not G.same_graph(one, one.selectExpr("dst as src", "src as dst")).head().same


def test_roll_up_counts_once(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    members = spark.createDataFrame([("c", 1), ("c", 2), ("a", 1), (None, 5)], "node string, doc_id bigint")
    assert {r.node: r.docs for r in G.roll_up(edges, members).collect()} == {"r": 2, "a": 2, "b": 2, "c": 2}


def one_by_one(rows):
    sets = {}
    for name, item in rows:
        if name is not None and item is not None:
            sets.setdefault(name, set()).add(item)
    chosen = []
    while any(sets.values()):
        name = min(sets, key=lambda n: (-len(sets[n]), n))
        chosen.append((name, len(sets[name])))
        gone = sets.pop(name)
        sets = {n: s - gone for n, s in sets.items()}
    return chosen


def test_greedy_cover(spark):
    rows = [("a", i) for i in range(5)] + [("b", i) for i in range(4, 8)] + [("c", i) for i in range(3)] + [("d", None), (None, 3)]
    rnd = random.Random(8)
    many = [(f"s{rnd.randrange(40):02}", rnd.randrange(120)) for _ in range(500)]
    for case in (rows, many):
        got = [(r.name, r.gain) for r in G.greedy_cover(spark.createDataFrame(case, "name string, item int")).orderBy("place").collect()]
        assert got == one_by_one(case)
    assert one_by_one(rows) == [("a", 5), ("b", 3)]
    assert G.greedy_cover(spark.createDataFrame([], "name string, item int")).count() == 0


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "v string") for s in ("aab", "bcc"))
    assert [r.v for r in U.difference(a, b).collect()] == ["c"] and [r.v for r in U.intersection(a, b).collect()] == ["b"]
    groups = spark.createDataFrame([("g", "a"), ("h", "z"), ("g", "a")], "k string, v string")
    assert {tuple(r) for r in U.filter_groups(groups, a, "k", "v").collect()} == {("g", 1), ("h", 0)}
    assert [r.v for r in U.subset_violations(groups, a, "v").collect()] == ["z"]


def test_words_rolled_up_once_per_document(spark):
    edges = spark.createDataFrame([("top", "a"), ("top", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    members = spark.createDataFrame([("c", 1), ("a", 1), ("b", 2)], "node string, doc_id bigint")
    counts = spark.createDataFrame([(1, "x", 3), (2, "x", 4), (2, "y", 1)], "doc_id bigint, word string, tf bigint")
    got = {tuple(r) for r in G.roll_up_words(edges, members, counts).collect()}
    assert got == {("c", "x", 3), ("a", "x", 3), ("b", "x", 7), ("b", "y", 1), ("top", "x", 7), ("top", "y", 1)}


@pytest.mark.parametrize("options", [{}, {"at_once": 2}, {"at_once": 1}, {"walked": 0}])
def test_words_rolled_up(spark, options):
    """By two ways up each document counts once; sums stay where their word is, so nodes are not shuffled with words."""
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "c"), ("x", None)], "src string, dst string")
    members = spark.createDataFrame([("d", 1), ("d", 1), ("b", 1), ("c", 2), ("lone", 2), ("a", 9), (None, 1), ("d", None)], "node string, doc_id bigint")
    counts = spark.createDataFrame([(1, "red", 2), (1, "cat", 1), (2, "cat", 3), (3, "dog", 1)], "doc_id bigint, word string, tf bigint")
    rolled = G.roll_up_words(edges, members, counts, **options)
    one, two = {"red": 2, "cat": 1}, {"cat": 3}
    both = {"red": 2, "cat": 4}
    want = {"d": one, "b": one, "c": both, "a": both, "x": both, "lone": two}
    assert sorted(tuple(r) for r in rolled.select("node", "word", "tf").collect()) == sorted((n, w, t) for n, words in want.items() for w, t in words.items())
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan or "hashpartitioning(node" in plan) == ("walked" in options)
