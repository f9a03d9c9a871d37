import random

from inkwell.functions.names import category_name
from inkwell.operators.hierarchy import hierarchy
from inkwell.plans.data_queries import QUERIES

NODES, EDGES = "name string", "src string, dst string"


def brute(names, edges):
    parent = {}
    for src, dst in edges:
        if src is not None and dst is not None:
            parent[dst] = min(src, parent.get(dst, src))
    known = {n for n in names if n is not None} | {x for e in edges for x in e if x is not None}
    result = {}
    for name in known:
        path, seen = [name], {name}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        cyclic = path[-1] in parent
        result[name] = ("", -1, None) if cyclic else (path[-1], len(path) - 1, path[::-1])
    return result


def check(spark, names, edges):
    rows = hierarchy(spark.createDataFrame([(n,) for n in names], NODES), spark.createDataFrame(edges, EDGES), paths=True).collect()
    want = brute(names, edges)
    assert {r.name: (r.root, r.depth, r.path) for r in rows} == want
    assert len(rows) == len(want)
    by = {r.name: r for r in rows}
    for a in rows:
        if a.depth < 0:
            assert a.first is None and a.descendants is None
            continue
        below = {n for n, (_, _, path) in want.items() if path and a.name in path and n != a.name}
        inside = {b.name for b in rows if b.root == a.root and b.depth >= 0 and a.first < b.first <= a.last}
        assert inside == below and a.descendants == len(below)
    return by


def test_small_shapes(spark):
    check(spark, ["a", None, "lonely"], [("a", "b"), ("b", "c"), ("a", "d"), ("a", "b"), (None, "e"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s"), ("f", None)])


def test_empty_tables(spark):
    assert hierarchy(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)).count() == 0


def test_long_chain_and_star(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"s{i:03}") for i in range(150)] + [("c060", "hub")]
    check(spark, [], edges)


def test_random_forest(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randrange(i) if rnd.random() < 0.9 else rnd.randrange(120)}", f"n{i}") for i in range(1, 120) if rnd.random() < 0.93]
    check(spark, [f"n{i}" for i in range(125)], edges)


def test_names(spark):
    rows = [("Category:Big_Lake ",), (" \"big' Lake\"",), ("CATEGORY:  x  y\n",), (None,), ("a _b",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(category_name("c")).collect()]
    assert got == ["Big Lake", "big Lake", "x y", None, "a b"]


def test_extra_columns_clash(spark):
    nodes = spark.createDataFrame([("a", 1, "q")], "name string, id int, root string")
    edges = spark.createDataFrame([("a", "b", 5)], "src string, dst string, depth int")
    assert {(r.name, r.root, r.depth) for r in hierarchy(nodes, edges).collect()} == {("a", "a", 0), ("b", "a", 1)}


def test_descendants_agree_with_their_number(spark, data):
    below = QUERIES["p1_descendants"](spark, data).groupBy("category").count().collect()
    counted = QUERIES["p1_hierarchy"](spark, data).where("descendants > 0").collect()
    assert {r.category: r["count"] for r in below} == {r.category: r.descendants for r in counted} and counted
